"""Toxicity by logistic regression with FTRL-proximal steps over hashed word n-grams and skip-grams.

Features are the presence of words, word pairs and pairs with one word between them, hashed to 2**bits coordinates.
Each coordinate has its own learning rate, and L1 keeps only coordinates with evidence, so the weights that scoring
broadcasts are few (never more than 2**bits). The model is fitted on a bounded sample of labelled rows (`most_rows`, by
id hash); scoring reads every whole text. The rates were picked by four-fold validation on rows that may be learnt from.

Nulls: a null text has no features and gets the score of the bias alone, as has an empty one; labels without id
or with a mark other than 0 and 1 are left out; documents with a null id are scored and held out of nothing. Repeated ids in the labels
count once per distinct mark. Repeated documents are scored each; empty tables give no rows; other columns are
never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import WordHash, byte_texts, pieces_of
from weftline.llm.linear import distinct_buckets, gram_buckets, words_of

PAIRS = (1, 2)
_hash: dict = {}


def _hashed() -> WordHash:
    return _hash.setdefault(0, WordHash(300_000))


def remainder(doc_id, by: int = 5):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(by))


class Ftrl:
    """FTRL-proximal: w_i = -(z_i - sign(z_i) l1) / ((beta + sqrt(n_i)) / alpha + l2) where |z_i| > l1, else 0."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2, self.bias = alpha, beta, l1, l2, size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sample(labels: DataFrame, most_rows: int) -> DataFrame:
    """(i, y): at most most_rows labelled ids to learn from, by the hash of the id; held-out ids are never among them."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder("doc_id") != 0))
    return known.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("int").alias("y")).distinct().orderBy(F.xxhash64("i"), "i", "y").limit(most_rows)


def fit(docs: DataFrame, labels: DataFrame, bits: int = 20, most_rows: int = 12_000, epochs: int = 4, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that are not zero; the coordinate 2**bits is the bias."""
    marks = {}
    for r in sample(labels, most_rows).collect():  # at most most_rows small rows
        marks.setdefault(r["i"], []).append(r["y"])
    ids = np.sort(np.array(list(marks), dtype=np.int64))

    def run(batches):
        for whole in batches:
            have = whole.column(0).to_pylist()
            found = np.searchsorted(ids, np.array([0 if x is None else x for x in have], dtype=np.int64))
            pick = [k for k, (x, f) in enumerate(zip(have, found)) if x is not None and f < len(ids) and ids[f] == x]
            if not pick:
                continue
            for batch in pieces_of(whole.take(pa.array(pick)), 8 << 20):
                buckets, of = gram_buckets(words_of(byte_texts(batch.column(1)), True), _hashed(), bits, PAIRS)
                of, buckets = distinct_buckets(buckets, of, bits)
                ends = np.searchsorted(of, np.arange(batch.num_rows + 1))
                each = [buckets[a:b].astype("<i4").tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(each, pa.binary())], names=["i", "at"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "i long, at binary")

    def learn(batches):
        got = [(i, at) for b in batches for i, at in zip(b.column("i").to_pylist(), b.column("at").to_pylist())]
        got = sorted({(i, at) for i, at in got})
        model, rng = Ftrl(1 << bits), np.random.default_rng(seed)
        examples = [(np.append(np.frombuffer(at, dtype="<i4").astype(np.int64), 1 << bits), y) for i, at in got for y in marks[i]]
        for _ in range(epochs):
            for k in rng.permutation(len(examples)):
                model.step(*examples[k])
        at = np.arange((1 << bits) + 1)
        w = model.weights(at)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(w[at])], names=["at", "w"])

    # one task learns: its rows are the bounded sample, never the corpus
    model = rows.repartition(1).mapInArrow(learn, "at long, w double")
    found = model.collect()
    return np.array([r["at"] for r in found], dtype=np.int64), np.array([r["w"] for r in found])


def scored(docs: DataFrame, labels: DataFrame, bits: int = 20, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    at, w = fit(docs, labels, bits, **how)
    packed = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), w))

    def run(batches):
        at, w = packed.value
        table, bias = np.zeros(1 << bits), 0.0
        own = at < (1 << bits)
        table[at[own]] = w[own]
        bias = float(w[~own].sum())
        live = table != 0
        for whole in batches:
            for batch in pieces_of(whole, 8 << 20):
                buckets, of = gram_buckets(words_of(byte_texts(batch.column(1)), True), _hashed(), bits, PAIRS)
                hit = live[buckets]
                of, buckets = distinct_buckets(buckets[hit], of[hit], bits)
                total = np.bincount(of, weights=table[buckets], minlength=batch.num_rows) + bias
                score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
