"""Intermediate tables in the folder that the cluster shares: they end lineage, and a lost executor loses nothing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list = []
_own: list[str] = []
_open: list[Scratch] = []
#: Shuffle files of a finished write go at once, not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows that a Python worker gets at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; one of its own in a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="weftline-"))  # one machine, one process
    return _own[0]


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends and lost executors cost nothing.

    by: columns that part the table's files. The table is deleted when the Scratch around the call ends without keeping it,
    or when the driver process ends."""
    made = _cut(df, *by)
    if _open:
        _open[-1].tables.append(made)
    return made[0]


@contextmanager
def limited(spark: SparkSession, rows: int):
    """Python workers get so many rows at a time from jobs that run inside, for rows that are long."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def _cut(df: DataFrame, *by: str, group_mb: int | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        how = df.write.option("compression", "zstd")
        if group_mb:
            how = how.option("parquet.block.size", group_mb << 20).option("parquet.page.size.row.check.min", 1)
        how.parquet(path, partitionBy=list(by) or None)
    finally:
        spark.conf.set(CLEAN_UP, before)
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def _drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_all() -> None:
    for spark, path in _written:
        try:
            _drop(spark, path)
        except Exception:  # the session has ended already
            return


class Scratch:
    """Tables of one query in the shared folder, which go as soon as nothing reads them any more.

    As a context it gathers the tables of every `cut` inside; those that are left at its end go to the Scratch around it."""

    def __init__(self):
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def __exit__(self, kind, value, trace) -> None:
        _open.remove(self)
        if _open:
            _open[-1].tables += self.tables

    def cut(self, df: DataFrame, *by: str, group_mb: int | None = None) -> DataFrame:
        """As above; group_mb: size of the file's row groups, for rows that are long."""
        made = _cut(df, *by, group_mb=group_mb)
        self.tables.append(made)
        return made[0]

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables."""
        for df, path in [x for x in self.tables if any(x[0] is t for t in tables)]:
            spark = df.sparkSession
            _drop(spark, path)
            _written.remove((spark, path))
            self.tables = [x for x in self.tables if x[1] != path]

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        self.drop(*[df for df, _ in self.tables if not any(df is t for t in tables)])
