"""Shared parts: salted prefix sums, word splitting, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.sources.scratch import Scratch, cut  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes that separate words, and the same as a translation to lower-case A-Z.
SPACES = b" \t\n\x0b\x0c\r"
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def private(df: DataFrame) -> str:
    """A beginning of names that no column of df has."""
    out = "__"
    while any(c.lower().startswith(out) for c in df.columns):
        out += "_"
    return out


def row_hash(df: DataFrame) -> tuple[Column, Column]:
    """128 bits that tell rows apart by the content of all their columns; identical rows are interchangeable."""
    cols = [F.col(f"`{f.name}`").cast("string") if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`") for f in df.schema]
    both = [*cols, *[x.isNull() for x in cols]]
    return F.xxhash64(*both), F.xxhash64(F.lit(97), *both)


def lower_az(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def salted_prefix(df: DataFrame, keys: list[str], value: Column, order: list[str], name: str, bucket_rows: int = 200_000, least: int = 256) -> DataFrame:
    """Exclusive running sum of value within keys, without putting a hot key into one task.

    Rows of a key are dealt over buckets by a hash of the order columns, as many as keep a bucket near bucket_rows even if
    all rows had one key (`least` at least); sums run inside a bucket and the buckets' totals are summed in turn. The order is
    (bucket, order columns); rows that tie in all of them are interchangeable. df is read twice, so it should be a table."""
    buckets = max(least, -(-df.count() // bucket_rows))
    p = private(df)
    bucket, v, total, before, inner, at = (p + x for x in ("b", "v", "t", "before", "in", "tb"))
    df = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).withColumn(v, value.cast("long"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*keys, bucket).agg(F.sum(v).alias(total)).withColumn(before, F.sum(total).over(across) - F.col(total))
    ranked = df.withColumn(inner, F.sum(v).over(inside) - F.col(v))
    t = totals.select(*[F.col(k).alias(f"{p}k{i}") for i, k in enumerate(keys)], F.col(bucket).alias(at), before)
    on = F.col(bucket) == F.col(at)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"{p}k{i}"))
    joined = ranked.join(t, on).withColumn(name, F.col(inner) + F.col(before))
    return joined.drop(bucket, v, inner, before, at, *[f"{p}k{i}" for i in range(len(keys))])


def pieces_of(batch: pa.RecordBatch, most_bytes: int = 16 << 20, most_rows: int = 2000):
    """Slices of a batch that hold few bytes each, so that one worker's memory stays bounded."""
    rows = max(1, min(most_rows, int(batch.num_rows * most_bytes / max(1, batch.nbytes))))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHash:
    """64-bit hashes of words, remembered for words seen before; the memory is emptied when it grows large."""

    def __init__(self, most: int = 1_000_000):
        import xxhash

        self.hash, self.known, self.most = xxhash.xxh3_64_intdigest, {}, most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            hash64 = self.hash
            for i, x in enumerate(found):
                if x is None:
                    w = words[i]
                    known[w] = found[i] = hash64(w)
        return np.array(found, dtype=np.uint64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit hashes (multiply, xor-shift; uint64 arithmetic wraps)."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0xD1B54A32D192ED03) + (a << np.uint64(6)) + (a >> np.uint64(2)))
        return scrambled(x)


def scrambled(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b); nodes without an edge are absent.

    Alternates large-star and small-star rounds (Kiveris et al. 2014) until the edges are stars: each node has one edge to a
    smaller one, and that one has none. Edges stay distributed and each step ends in a table of the shared folder."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not now.isEmpty():
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        small = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())
        roles = now.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        roles = roles.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if roles.where("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", F.col("v").alias("c")).distinct())
