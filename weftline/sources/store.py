"""Page records, crawl indexes and the chunk collection as Parquet tables, with JSON in and out for pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from weftline.functions import text as T
from weftline.functions import urls as U
from weftline.schemas import DOWNLOAD, page_schema


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table that is not there is an empty one."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_pages(pages: DataFrame, path: str, as_json: bool = False) -> None:
    """Records by domain."""
    out = pages.withColumn("__folder", T.sanitized(F.col("domain"), 60)).withColumnRenamed("__folder", "domain_folder")
    writer = out.write.mode("append").partitionBy("domain_folder")
    writer.json(path) if as_json else writer.parquet(path)


def read_pages_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, files that could not be read) of *.json files at any depth, one record each."""
    schema = page_schema().add("_corrupt_record", "string")
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r").isNull()
    return rows.where(~bad).select("r.*").drop("_corrupt_record"), rows.where(bad).select("file")


def crawl_index(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per address: records and failures, the last written wins."""
    good = pages.select("url", "doc_id", "title", "domain", "depth", "status_code", "crawled_at", F.lit(None).cast("string").alias("error"))
    bad = errors.select("url", "depth", "status_code", "crawled_at", "error")
    return latest(good.unionByName(bad, allowMissingColumns=True), "url", "crawled_at")


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Keep-last per key; ties by the rest of the row's content."""
    order = Window.partitionBy(key).orderBy(F.desc(by), F.xxhash64(*[c for c in rows.columns if c not in (key, by)]))
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def not_crawled(frontier: DataFrame, index: DataFrame) -> DataFrame:
    """Addresses that the index does not hold, as written."""
    return frontier.join(index.select("url").distinct(), "url", "left_anti")


def _with_downloads(items: Column, known: Column) -> Column:
    return F.transform(items, lambda x: x.withField("download", F.try_element_at(known, x["url"])))


def page_records(frontier: DataFrame, responses: DataFrame, parsed: DataFrame, crawled_at: str, assets: DataFrame | None = None) -> DataFrame:
    """A-7: page records with identity, source, content and status for the chunker.

    assets: download records (url, kind and the fields of DOWNLOAD), which their pages' images and PDFs get."""
    status = F.struct(F.lit(False).alias("chunked"), F.lit(False).alias("embedded"), F.lit(False).alias("indexed"), F.lit(0).alias("chunk_count"), F.lit(None).cast("string").alias("error"))
    rows = frontier.select("url", "norm", "depth", "parent_url").join(responses.select("url", "final_url", "status_code", "content_type", "response_time_ms"), "url").join(parsed, "url")
    rows = rows.withColumn("doc_id", U.doc_id(F.col("norm"))).withColumn("domain", U.netloc(F.col("url"))).withColumn("crawled_at", F.lit(crawled_at)).withColumn("rag_status", status).withColumn("breadcrumbs", F.array().cast("array<string>"))
    for kind in ("image", "pdf"):
        found = f"__{kind}"
        if assets is None:
            rows = rows.withColumn(found, F.lit(None).cast(f"map<string,{DOWNLOAD}>"))
        else:
            names = [x.split(":")[0] for x in DOWNLOAD[len("struct<") : -1].split(",")]
            known = assets.where(F.col("kind") == kind).select(F.col("url").alias("__u"), F.struct(*names).cast(DOWNLOAD).alias("__d"))
            uses = parsed.select("url", F.explode(F.array_distinct(F.transform(f"{kind}s", lambda x: x["url"]))).alias("__u")).join(known, "__u")
            maps = uses.groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("__u", "__d"))).alias(found))
            rows = rows.join(maps, "url", "left")
        rows = rows.withColumn(f"{kind}s", _with_downloads(F.col(f"{kind}s"), F.col(found))).drop(found)
    return rows.select([F.col(f.name).cast(f.dataType) for f in page_schema()])


def write_indexes(spark: SparkSession, path: str, pages: DataFrame, errors: DataFrame, assets: DataFrame | None = None) -> None:
    """The tables crawl_index, image_index and pdf_index under path, each a new version in place of the last."""
    tables = {"crawl_index": crawl_index(pages, errors)}
    if assets is not None:
        tables |= {f"{kind}_index": assets.where(F.col("kind") == kind).where("success AND NOT duplicate").drop("seq", "body") for kind in ("image", "pdf")}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def crawl_summary(index: DataFrame, session: str = "") -> DataFrame:
    """One row of totals with pages by domain."""
    domains = index.where("error IS NULL").groupBy("domain").count()
    by_domain = domains.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("domain", "count")))).alias("domains"))
    totals = index.agg(F.count(F.lit(1)).alias("urls"), F.count_if(F.col("error").isNull()).alias("pages"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.max("depth").alias("max_depth"))
    return totals.join(by_domain, F.lit(True)).withColumn("session", F.lit(session))


def create_collection(spark: SparkSession, path: str, schema: StructType | str, recreate: bool = False) -> None:
    """An empty collection, unless one is there and may stay."""
    if recreate or not exists(spark, path):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def with_point_id(chunks: DataFrame) -> DataFrame:
    """Ids from content, so that ingesting again replaces and never doubles."""
    return chunks.withColumn("id", F.sha2(F.concat_ws("\x1f", "doc_id", F.col("chunk_index").cast("string")), 256))


def upsert(points: DataFrame, path: str, batch: int | None = None) -> int:
    """Write points as a new batch of the collection; the batch's number. An id is written once per batch, and reading
    takes each id's newest batch, so ingesting again replaces. A batch written again under its number replaces itself."""
    spark = points.sparkSession
    if batch is None:
        batch = (max(_batches(spark, path)) + 1) if _batches(spark, path) else 0
    points.dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return batch


def _batches(spark: SparkSession, path: str) -> list[int]:
    if not exists(spark, path):
        return []
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = [x.getPath().getName() for x in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)]
    return [int(n.partition("=")[2]) for n in names if n.startswith("batch=") and exists(spark, f"{path}/{n}/_SUCCESS")]


def collection(spark: SparkSession, path: str, ident: str = "id") -> DataFrame:
    """The rows of a collection that `upsert` wrote: of each id those of its newest batch."""
    numbers = _batches(spark, path)
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in sorted(numbers)])
    if len(numbers) > 1:
        newest = rows.groupBy(F.col(ident).alias("__i")).agg(F.max("batch").alias("__b"))
        rows = rows.join(newest, (F.col(ident) == F.col("__i")) & (F.col("batch") == F.col("__b"))).drop("__i", "__b")
    return rows.drop("batch")


def collection_info(spark: SparkSession, path: str) -> DataFrame:
    """S17."""
    points = collection(spark, path)
    return points.agg(F.count(F.lit(1)).alias("points"), F.countDistinct("doc_id").alias("documents"), F.first(F.size("dense")).alias("dimension"))
