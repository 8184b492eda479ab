"""Dense and sparse encoding of texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.models import Embedder, HashingEmbedder


def sparse_terms(docs: DataFrame, ident: str = "doc_id", text: str = "text", buckets: int = 100_000) -> DataFrame:
    """E-4 as rows (ident, token_id, weight): lower-cased words' buckets with tf / max tf; a text without words has bucket 0 with weight 0.

    A text's terms depend on it alone, so each is counted inside its Arrow batch and nothing is shuffled; rows that
    share an id are texts of their own."""
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches):
        known: dict[str, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids, weights, sizes = [], [], []
                for words in map(str.split, batch.column(1).to_pylist()):
                    tf: dict[int, int] = {}
                    for w, n in Counter(words).items():
                        bucket = known.get(w)
                        if bucket is None:
                            if len(known) > 500_000:
                                known.clear()
                            known[w] = bucket = int.from_bytes(md5(w.encode("utf-8", "surrogatepass")).digest(), "big") % buckets
                        tf[bucket] = tf.get(bucket, 0) + n
                    most = max(tf.values()) if tf else 1
                    ids.extend(tf or (0,))
                    weights.extend([n / most for n in tf.values()] or (0.0,))
                    sizes.append(len(tf) or 1)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(ids, pa.int32()), pa.array(weights, pa.float64())], names=[ident, "token_id", "weight"])

    # str.split() parts at the same characters as WS
    return docs.select(ident, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text")).mapInArrow(run, f"`{ident}` {kind}, token_id int, weight double")


def sparse_map(terms: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Storage form: one map<int,double> per text."""
    return terms.groupBy(ident).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token_id", "weight")))).alias("sparse"))


def dense_udf(embedder: Embedder = HashingEmbedder(), batch: int = 32):
    """E-1, E-2: unit float vectors; the embedder is made ready once per worker."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder.load()
        for texts in batches:
            for i in range(0, len(texts), batch):
                rows = np.asarray(embedder.embed(texts.iloc[i : i + batch].fillna("").tolist()), dtype=np.float64)
                norms = [float(np.linalg.norm(v)) for v in rows]
                yield pd.Series([(v / n if n else v).astype(np.float32) for v, n in zip(rows, norms)])

    return encode.asNondeterministic()

