"""Pages that arrive as files, chunked and encoded as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.config import Config
from weftline.operators.chunking import chunk_pages
from weftline.schemas import PAGE
from weftline.sources.store import upsert, with_point_id


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def chunk_stream(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """Chunks with their ids; no state, so no watermark. Repeated files give repeated ids, which the sink's upsert replaces."""
    return with_point_id(chunk_pages(pages, config.chunking))


def start(chunks: DataFrame, sink: str, checkpoint: str):
    """Each micro-batch is upserted under its own number, so one that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        upsert(batch, sink, number)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
