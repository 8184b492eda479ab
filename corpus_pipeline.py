"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, packing; each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import fertility, lines, mixing, neardup, packing
from weftline.llm.common import cut, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the tokeniser bands reject go."""
    return fertility.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; text and n_chars follow."""
    found = lines.line_dedup(docs).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (two-word shingles as in op6, similarity 0.8) stays."""
    return neardup.first_of_each(docs, shingle_words=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become the words that the mix takes of them; documents of which nothing is taken go."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most 4096 tokens."""
    return packing.pack(docs, 4096)


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("minhash_near_dedup", near_dedup), ("source_mixing", mix), ("best_fit_packing", pack)]

#: The tokenisers of the first and last stage can't be expressed in SQL; tests/llm hold the stages' operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; between stages the rows are a Parquet table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
