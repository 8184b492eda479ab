"""Line deduplication over documents, by built-in functions alone.

Lines are exploded with their position, their normalised key is hashed to 128 bits, distinct documents are
counted per hash, and what is to go comes back to each document as positions.

Nulls: a null text is one empty line; a null doc_id counts for no document and is never the keeper. Repeated
rows (same id and text) keep and lose the same lines and count as one document. Very long texts and texts of
white space alone need no special care. Output columns of the same name replace those of the input; other
columns stay. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, lower_az, private

BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return lower_az(F.btrim(line, F.lit(BLANK)))


def _hash(*of: Column) -> list[Column]:
    return [F.xxhash64(*of), F.xxhash64(F.lit(97), *of)]


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text.

    A key of at least min_chars code points found in at least min_docs documents keeps its lines only in the
    largest doc_id that holds it."""
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    text = F.coalesce(F.col("text"), F.lit(""))
    row = _hash(F.col("doc_id"), text)
    lines = docs.select(F.col("doc_id").alias("d"), row[0].alias("r1"), row[1].alias("r2"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    lines = lines.select("d", "r1", "r2", "pos", *(h.alias(n) for h, n in zip(_hash(F.col("key")), ("h1", "h2"))))
    often = lines.groupBy("h1", "h2").agg(F.countDistinct("d").alias("n"), F.max("d").alias("keeper")).where(F.col("n") >= min_docs)
    often = cut(often.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), "keeper"))
    gone = lines.join(often, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2"))).where(~F.col("d").eqNullSafe(F.col("keeper")))
    p = private(docs)
    r1, r2, g1, g2, places, lines_of = (p + x for x in ("r1", "r2", "g1", "g2", "gone", "lines"))
    gone = gone.groupBy("r1", "r2").agg(F.collect_set("pos").alias(places)).select(F.col("r1").alias(g1), F.col("r2").alias(g2), places)
    marked = docs.withColumn(r1, row[0]).withColumn(r2, row[1])
    both = marked.join(gone, (F.col(r1) == F.col(g1)) & (F.col(r2) == F.col(g2)), "left")
    split = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(places))
    kept = F.when(F.col(places).isNull(), text).otherwise(F.concat_ws("\n", F.transform(stay, lambda i: F.get(F.col(lines_of), i))))
    both = both.withColumn(lines_of, F.when(F.col(places).isNotNull(), split))
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    n_dropped = F.when(F.col(places).isNull(), F.lit(0)).otherwise(F.size(places))
    both = both.withColumn("n_lines", n_lines.cast("long")).withColumn("n_dropped", n_dropped.cast("long"))
    return both.withColumn("kept_text", kept).drop(r1, r2, g1, g2, places, lines_of)
