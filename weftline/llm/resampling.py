"""Importance resampling: how much likelier a text is under a target model than under the raw one.

Both models are bags of hashed words and word pairs with one count per bucket. The target model is fitted on a
bounded sample of labelled good documents (`most_target` rows of smallest id hash), the raw model on all
documents. A document's key is its log ratio plus Gumbel noise drawn from its id, and the `share` of documents
with the largest keys is kept: sampling without replacement in proportion to the ratio.

The threshold is found by counting keys in ever finer ranges, so nothing is sorted in one task; ties at the
threshold go to smaller ids, then to any of rows that are alike. Nulls: a null text has no features and a log
ratio of 0; a null id draws its noise as its own id; labels without an id or quality are no target. Empty tables
give no rows; other columns are ignored, and repeated rows are rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import WordHash, byte_texts, cut, pieces_of
from weftline.llm.linear import gram_buckets, words_of

_hash: dict = {}


def _hashed() -> WordHash:
    return _hash.setdefault(0, WordHash(400_000))


def target_ids(labels: DataFrame, most_target: int) -> np.ndarray:
    """Ids of labelled good documents, at most most_target, by the hash of the id."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("i")).distinct()
    rows = good.orderBy(F.xxhash64("i"), "i").limit(most_target).collect()
    return np.sort(np.array([r["i"] for r in rows], dtype=np.int64))


def bucket_counts(docs: DataFrame, target: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all documents and of the target ones, counted per bucket (2**bits of them, whatever the corpus)."""
    size = 1 << bits

    def run(batches):
        raw, good = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for whole in batches:
            for batch in pieces_of(whole, 8 << 20):
                buckets, of = gram_buckets(words_of(byte_texts(batch.column(1))), _hashed(), bits)
                raw += np.bincount(buckets, minlength=size)
                ids = np.array([-1 if x is None else x for x in batch.column(0).to_pylist()], dtype=np.int64)
                inside = np.isin(ids, target) & np.array([x is not None for x in batch.column(0).to_pylist()], dtype=bool)
                if inside.any():
                    good += np.bincount(buckets[inside[of]], minlength=size)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "bucket long, raw long, good long")
    raw, good = np.zeros(size), np.zeros(size)
    for r in rows.groupBy("bucket").agg(F.sum("raw"), F.sum("good")).collect():  # at most 2**bits rows
        raw[r[0]], good[r[0]] = r[1], r[2]
    return raw, good


def log_ratios(docs: DataFrame, target: np.ndarray, bits: int = 16, smooth: float = 1.0) -> DataFrame:
    """(doc_id, n_features, log_ratio): natural log of target over raw likelihood of the whole text."""
    raw, good = bucket_counts(docs, target, bits)
    ratio = np.log((good + smooth) / (good.sum() + smooth * len(good))) - np.log((raw + smooth) / (raw.sum() + smooth * len(raw)))
    weights = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        table = weights.value
        for whole in batches:
            for batch in pieces_of(whole, 8 << 20):
                buckets, of = gram_buckets(words_of(byte_texts(batch.column(1))), _hashed(), bits)
                n = np.bincount(of, minlength=batch.num_rows)
                total = np.bincount(of, weights=table[buckets], minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(total.astype(np.float64))], names=["doc_id", "n_features", "log_ratio"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_features long, log_ratio double")


def gumbel(of: Column, seed: int) -> Column:
    """Standard Gumbel noise fixed by the value and the seed."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), of), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def _ordinal(key: Column) -> Column:
    """Whole numbers in the order of the keys, by their first 9 decimals."""
    return F.round(key * 1e9).cast("long")


def largest(rows: DataFrame, key: str, tie: str, n: int, name: str = "kept", fine: int = 4096) -> DataFrame:
    """rows with a flag on the n that have the largest keys.

    Each step counts rows in at most `fine` ranges and looks into the range that holds the n-th, until one
    value of the key is left; among equals the smallest tie values are taken in the same way."""
    rows = rows.withColumn("__o", _ordinal(F.col(key))).withColumn("__t", F.coalesce(F.col(tie).cast("long"), F.lit(-(1 << 62))))
    n = max(0, n)
    bound, left = _nth(rows, "__o", n, fine, True)
    equal = rows.where(F.col("__o") == bound) if bound is not None else rows.where(F.lit(False))
    last, _ = _nth(equal, "__t", left, fine, False)
    flag = (F.col("__o") > F.lit(bound)) | ((F.col("__o") == F.lit(bound)) & (F.col("__t") <= F.lit(last))) if bound is not None and n else F.lit(False)
    return rows.withColumn(name, flag).drop("__o", "__t")


def _nth(rows: DataFrame, col: str, n: int, fine: int, down: bool) -> tuple[int | None, int]:
    """The n-th value of col from the top (or bottom), and how many rows of that value are needed."""
    low, high = rows.agg(F.min(col), F.max(col)).first()
    if low is None or n <= 0:
        return None, 0
    while True:
        step = max(1, -(-(high - low + 1) // fine))
        place = F.floor((F.col(col).cast("decimal(38,0)") - F.lit(low)) / F.lit(step)).cast("long")
        inside = rows.where((F.col(col) >= low) & (F.col(col) <= high))
        counts = sorted(((r[0], r[1]) for r in inside.groupBy(place.alias("p")).count().collect()), reverse=down)
        for at, count in counts:
            if n <= count:
                break
            n -= count
        else:
            return (low if down else high), count
        low, high = low + at * step, min(high, low + (at + 1) * step - 1)
        if step == 1:
            return low, n


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, bits: int = 16, most_target: int = 20_000, seed: int = 29) -> DataFrame:
    """(doc_id, n_features, log_ratio, key, kept). share: of documents to keep; by default the good share of the labels."""
    if share is None:
        row = labels.where("quality IS NOT NULL").agg(F.avg(F.col("quality").cast("double"))).first()
        share = row[0] if row[0] is not None else 1.0
    rows = log_ratios(docs, target_ids(labels, most_target), bits)
    rows = cut(rows.withColumn("key", F.col("log_ratio") + gumbel(F.col("doc_id"), seed)))
    return largest(rows, "key", "doc_id", round(share * rows.count()))
