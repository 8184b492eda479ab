"""Search for many questions at once: payload filter, dense and sparse candidates, rank fusion, floor, reranking.

Ranks are always by (score rounded to 9 places, id), so results do not depend on the order of float sums. Top-k
per question is a window limit that Spark applies before and after the shuffle. Both searches run when they are called and
leave their candidates as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.config import Retrieval
from weftline.sources.models import OverlapReranker, Reranker
from weftline.sources.scratch import Scratch, limited

#: Most parts of the points and of the questions of a search; what goes to the ranking grows with the first.
PARTS = (32, 1_024)


def payload_filter(domain: str | None = None, source_type: str | None = None) -> Column | None:
    """R-1: conjunctive equality on the payload, or None."""
    tests = [F.col(k) == v for k, v in (("domain", domain), ("source_type", source_type)) if v]
    return None if not tests else tests[0] if len(tests) == 1 else tests[0] & tests[1]


def top(scored: DataFrame, k: int, query: str, ident: str, score: str = "score") -> DataFrame:
    """The k best per query with their rank, ties by id."""
    best = Window.partitionBy(query).orderBy(F.desc(score), F.asc(ident))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _filled(batches: Iterator[pa.RecordBatch], size: Callable[[pa.Table], np.ndarray], most: int) -> Iterator[pa.Table]:
    """Rows in tables of about `most` by the sum of their sizes; rows of one id that follow each other stay together."""
    rest = None
    for batch in chain(batches, (None,)):
        if batch is not None:
            more = pa.Table.from_batches([batch])
            rest = more if rest is None else pa.concat_tables([rest, more])
        if rest is None or not rest.num_rows:
            continue
        ends = np.cumsum(size(rest))
        if batch is not None and ends[-1] < most:
            continue
        code = pc.dictionary_encode(rest.column("id").combine_chunks(), null_encoding="encode").indices.to_numpy()
        new = np.append(np.flatnonzero(code[1:] != code[:-1]) + 1, len(code))
        at = 0
        while at < len(code):
            done = ends[at - 1] if at else 0
            to = new[min(np.searchsorted(ends[new - 1], done + most), len(new) - 1)]
            if batch is not None and to == len(code):
                break
            yield rest.slice(at, to - at)
            at = int(to)
        rest = rest.slice(at)


def _blocks_of_terms(rows: DataFrame, key: str, most: int) -> DataFrame:
    """(key, token_id, weight) rows as blocks of about `most` terms by key and token, all of a key in one block; one shuffle of packed rows."""
    kind = rows.schema[key].dataType.simpleString()

    def runs(batches):
        for b in batches:
            if b.num_rows:
                code = pc.dictionary_encode(b.column(0), null_encoding="encode").indices.to_numpy()
                starts = np.append(0, np.flatnonzero(code[1:] != code[:-1]) + 1)
                at = pa.array(np.append(starts, len(code)), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(starts)), pa.ListArray.from_arrays(at, b.column(1)), pa.ListArray.from_arrays(at, b.column(2))], names=["id", "tokens", "weights"])

    def packed(batches):
        for t in _filled(batches, lambda x: pc.list_value_length(x.column("tokens")).to_numpy(), most):
            ids = t.column("id").combine_chunks()
            code = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy()
            starts = np.append(0, np.flatnonzero(code[1:] != code[:-1]) + 1)
            owner = np.repeat(np.cumsum(np.append(False, code[1:] != code[:-1])), pc.list_value_length(t.column("tokens")).to_numpy())
            token, weight = (pc.list_flatten(t.column(n)).combine_chunks().to_numpy(zero_copy_only=False) for n in ("tokens", "weights"))
            order = np.lexsort((token, owner))
            owner, token, weight = owner[order], token[order], weight[order]
            one = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])))
            sizes = np.bincount(owner[one], minlength=len(starts))
            yield _row(ids=ids.take(pa.array(starts)), sizes=pa.array(sizes, pa.int32()), tokens=pa.array(token[one], pa.int32()), weights=pa.array(np.add.reduceat(weight, one), pa.float64()))

    terms = rows.where("token_id IS NOT NULL").select(F.col(key).alias("id"), F.col("token_id").cast("int").alias("t"), F.col("weight").cast("double").alias("w"))
    whole = terms.mapInArrow(runs, f"id {kind}, tokens array<int>, weights array<double>").repartition("id").sortWithinPartitions("id")
    return whole.mapInArrow(packed, f"ids array<{kind}>, sizes array<int>, tokens array<int>, weights array<double>")


def _blocks_of_vectors(rows: DataFrame, key: str, vector: str, most: int) -> DataFrame:
    """(key, vector) rows as blocks of about `most` vectors, in place."""
    kind = rows.schema[key].dataType.simpleString()

    def packed(batches):
        for t in _filled(batches, lambda x: np.ones(x.num_rows, dtype=np.int64), most):
            yield _row(ids=t.column("id").combine_chunks(), values=pc.list_flatten(t.column("v")).combine_chunks())

    own = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    return own.mapInArrow(packed, f"ids array<{kind}>, values {rows.schema[vector].dataType.simpleString()}")


def _row(**lists: pa.Array) -> pa.RecordBatch:
    one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists.values()]
    return pa.RecordBatch.from_arrays(one, names=list(lists))


class _Best:
    """The k best ids of each question of a block over all that it has met; near ties are kept for the ranking that follows."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.least, self.found, self.size = n, k, np.full(n, -np.inf), None, 0

    def wanted(self, scores: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (question, point) that may be among the best."""
        open_ = some & (scores >= self.least[:, None])
        if open_.sum() > self.k * self.n and scores.shape[1] > self.k:
            kth = np.partition(np.where(open_, scores, -np.inf), -self.k, axis=1)[:, -self.k] - 4e-9
            open_ &= scores >= kth[:, None]
        return np.nonzero(open_)

    def add(self, q: np.ndarray, ids: pa.Array, scores: np.ndarray) -> None:
        if len(q):
            more = pa.table({"q": pa.array(q, pa.int64()), "score": pa.array(scores, pa.float64()), "id": ids})
            self.found = more if self.found is None else pa.concat_tables([self.found, more])
            if self.found.num_rows > 2 * self.size + self.k:
                self.trim()

    def trim(self) -> None:
        t = self.found.combine_chunks().sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
        q, s = t.column("q").to_numpy(), t.column("score").to_numpy()
        place = np.arange(len(q))
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        same = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (s[1:] != s[:-1])))
        nth = first + self.k - 1
        full = nth < np.append(first[1:], len(q))
        self.least[q[first[full]]] = s[nth[full]] - 4e-9
        tied = place - np.repeat(same, np.diff(np.append(same, len(q))))
        # of equal scores the k first ids are enough
        self.found = t.take(pa.array(np.flatnonzero((s >= self.least[q]) & (tied < self.k))))
        self.size = self.found.num_rows


class _Terms:
    """A block of terms by owner and token, and in the order of its tokens."""

    def __init__(self, row: dict):
        self.ids, sizes = row["ids"], row["sizes"].to_numpy()
        self.n = len(self.ids)
        self.weight = row["weights"].to_numpy(zero_copy_only=False)
        self.start = np.append(0, np.cumsum(sizes, dtype=np.int64))
        token = row["tokens"].to_numpy()
        order = np.argsort(token, kind="stable")
        self.owner, self.w, self.token = np.repeat(np.arange(self.n), sizes)[order], self.weight[order], token[order]
        new = np.append(True, self.token[1:] != self.token[:-1])
        self.at = np.flatnonzero(new)
        self.known, self.count = self.token[self.at], np.diff(np.append(self.at, len(token)))
        #: number in `known` of each term, by owner
        self.number = np.empty(len(token), dtype=np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.odd = np.flatnonzero(~(self.w > 0))

    def places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For tokens numbered in `known`: their postings, and which of the tokens each is of."""
        return _ranges(self.at[which], self.count[which])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges in turn, and which range each is of."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()), np.repeat(np.arange(len(sizes)), sizes)


def _products(x: _Terms, y: _Terms, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of all questions y with all points x, and which pairs share a token; i, j: numbers of the tokens that both have.

    Tokens that much of both blocks has go through matrix products, all others through their pairs."""
    pairs = x.count[i] * y.count[j]
    dense = pairs > x.n * y.n / 64
    out = np.zeros((y.n, x.n))
    a, b = i[dense], j[dense]
    for at in range(0, len(a), 256):
        sides = []
        for t, which in ((x, a[at : at + 256]), (y, b[at : at + 256])):
            place, of = t.places(which)
            sides.append(np.bincount(of * t.n + t.owner[place], weights=t.w[place], minlength=len(which) * t.n).reshape(len(which), t.n))
        out += sides[1].T @ sides[0]
    a, b, pairs = i[~dense], j[~dense], pairs[~dense]
    parts = np.cumsum(pairs) // 1_000_000
    for part in np.unique(parts):
        u, v = a[parts == part], b[parts == part]
        place, of = y.places(v)  # each term of a question meets all postings of its token
        own, term = _ranges(x.at[u][of], x.count[u][of])
        cell = (y.owner[place] * x.n)[term] + x.owner[own]
        out += np.bincount(cell, weights=x.w[own] * y.w[place][term], minlength=out.size).reshape(out.shape)
    some = out > 0
    for of, other, turned in ((x, y, False), (y, x, True)):  # a weight of zero is shared as well
        for z in of.odd:
            low, high = (np.searchsorted(other.token, of.token[z], side) for side in ("left", "right"))
            who = other.owner[low:high]
            some[(of.owner[z], who) if turned else (who, of.owner[z])] = True
    return out, some


def _again(x: _Terms, y: _Terms, i: np.ndarray, j: np.ndarray, who: np.ndarray, what: np.ndarray) -> np.ndarray:
    """Inner products of these pairs of a question (in order) and a point, added up by token, so that equal texts have equal ones."""
    out = np.zeros(len(who))
    to = np.full(len(y.known), -1)
    to[j] = i
    weights = np.zeros(len(x.known) + 1)  # the last for what no point has
    for q, a, b in zip(*_groups(who)):
        mine = slice(y.start[q], y.start[q + 1])
        at = to[y.number[mine]]
        weights[at] = y.weight[mine]
        weights[-1] = 0
        own, of = _ranges(x.start[what[a:b]], np.diff(x.start)[what[a:b]])
        out[a:b] = np.bincount(of, weights=x.weight[own] * weights[x.number[own]], minlength=b - a)
        weights[at] = 0
    return out


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key of a sorted array with where it starts and ends."""
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[new], new, np.append(new[1:], len(keys))[: len(new)]


def _met(points: DataFrame, questions: DataFrame, of: Callable, scored: Callable, k: int, ident: str, query: str, parts: tuple[int, int]) -> DataFrame:
    """(query, ident, score): for each part of the points, what may be among a question's k best; written.

    points and questions are blocks. Each is written once, and every part of one side then reads every part of the other from
    there, so nothing is copied for it. A task holds one block of points, and of its questions their blocks and k best."""
    spark = points.sparkSession
    kinds = f"`{query}` {questions.schema['ids'].dataType.elementType.simpleString()}, `{ident}` {points.schema['ids'].dataType.elementType.simpleString()}, score double"
    sides = [[f"{s}_{c}" for c in df.columns] for s, df in (("p", points), ("q", questions))]

    def best(batches):
        asked: dict = {}
        at, x, names = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = lambda s: {n[2:]: batch.column(n)[i].values for n in batch.schema.names if n.startswith(s) and n[2:] != "block"}  # noqa: E731, B023
                p, q = batch.column("p_block")[i].as_py(), batch.column("q_block")[i].as_py()
                if p != at:
                    at, x = p, of(row("p_"))
                if q not in asked:
                    y = of(row("q_"))
                    asked[q] = y, _Best(y.n, k)
                y, held = asked[q]
                who, ids, scores = scored(x, y, held)
                held.add(who, ids, scores)
        for y, held in asked.values():
            if held.found is not None:
                held.trim()
                yield pa.RecordBatch.from_arrays([y.ids.take(held.found.column("q").combine_chunks()), held.found.column("id").combine_chunks(), held.found.column("score").combine_chunks()], names=[query, ident, "score"])

    with Scratch() as scratch:
        with limited(spark, 1_000):
            tables = [scratch.cut(df.withColumn("block", F.monotonically_increasing_id()), group_mb=8) for df in (points, questions)]
        left, right = (t.select(*[F.col(n[2:]).alias(n) for n in (*names, f"{names[0][0]}_block")]).coalesce(n) for t, names, n in zip(tables, sides, parts))
        with limited(spark, 1):
            found = scratch.cut(left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(best, kinds))
        scratch.keep(found)
    return found


def dense_topk(points: DataFrame, queries: DataFrame, k: int = 20, ident: str = "id", query: str = "query_id", vector: str = "dense", by: str = "dense", tile: tuple[int, int] = (2_048, 512)) -> DataFrame:
    """R-2: (query, ident, score, rank) by cosine of unit vectors (inner product in double precision); an exact scan.

    queries: (query, by). Both sides are packed into blocks of `tile` vectors, and every block of points meets every block
    of questions as two matrices, so no pair of a question and a point is ever a row, and no vector is copied. Rows without a
    vector are neither found nor asked."""

    class Vectors:
        def __init__(self, row):
            self.ids, self.n = row["ids"], len(row["ids"])
            self.v = row["values"].to_numpy(zero_copy_only=False).astype(np.float64).reshape(self.n, -1)

    def scored(x, y, held):
        scores = y.v @ x.v.T
        scores[np.isnan(scores)] = np.inf
        i, j = held.wanted(scores, np.ones(scores.shape, dtype=bool))
        return i, x.ids.take(pa.array(j)), scores[i, j]

    found = _met(_blocks_of_vectors(points, ident, vector, tile[0]), _blocks_of_vectors(queries, query, by, tile[1]), Vectors, scored, k, ident, query, PARTS)
    return top(found.withColumn("score", F.round("score", 9)), k, query, ident)


def sparse_topk(postings: DataFrame, terms: DataFrame, k: int = 20, ident: str = "id", query: str = "query_id", tiles: tuple[int, int] | None = None, block: tuple[int, int] = (250_000, 150_000)) -> DataFrame:
    """R-3: (query, ident, score, rank) by the inner product over shared buckets.

    postings: (ident, token_id, weight); terms: (query, token_id, weight). Both are packed into blocks of so many terms, each
    shuffled and written once, and every block of postings meets every block of questions; a part of the ids returns each
    question's best k, so a frequent word makes no rows of questions x documents. tiles: most parts of the ids and of the
    questions."""

    def scored(x, y, held):
        _, a, b = np.intersect1d(x.known, y.known, assume_unique=True, return_indices=True)
        i, j = held.wanted(*_products(x, y, a, b))
        return i, x.ids.take(pa.array(j)), _again(x, y, a, b, i, j)

    found = _met(_blocks_of_terms(postings, ident, block[0]), _blocks_of_terms(terms, query, block[1]), _Terms, scored, k, ident, query, tiles or PARTS)
    return top(found.withColumn("score", F.round("score", 9)), k, query, ident)


def rrf(*lists: DataFrame, k: int = 2, limit: int = 20, ident: str = "id", query: str = "query_id") -> DataFrame:
    """R-4: (query, ident, score, rank) by the sum of 1 / (k + position) with positions from 0 in each list.

    Union and one aggregation; no outer join."""
    parts = [x.select(query, ident, (1.0 / (F.lit(k) + F.col("rank") - 1)).alias("__s")) for x in lists]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionAll(x)
    return top(both.groupBy(query, ident).agg(F.round(F.sum("__s"), 9).alias("score")), limit, query, ident)


def floored(candidates: DataFrame, least: float = 0.3) -> DataFrame:
    """R-7."""
    return candidates.where(F.col("score") >= least)


def reranked(candidates: DataFrame, k: int = 5, reranker: Reranker = OverlapReranker(), query: str = "query_id", question: str = "question", text: str = "text") -> DataFrame:
    """R-8: the k best by the scorer, ties by the rank before; a lone candidate is not scored."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        reranker.load()
        for q, t in batches:
            yield pd.Series(reranker.score(list(zip(q.fillna(""), t.fillna("")))), dtype="float64")

    n = F.count(F.lit(1)).over(Window.partitionBy(query))
    counted = candidates.withColumn("__n", n)
    scored = counted.withColumn("__s", scores.asNondeterministic()(question, text)).withColumn("rerank_score", F.when(F.col("__n") > 1, F.col("__s")))
    order = Window.partitionBy(query).orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return scored.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= k).drop("__n", "__s")


def retrieve(chunks: DataFrame, postings: DataFrame, questions: DataFrame, query_terms: DataFrame, config: Retrieval = Retrieval(), mode: str = "hybrid", where: Column | None = None, reranker: Reranker = OverlapReranker(), question: str = "question") -> DataFrame:
    """R-9 for all questions: the final candidates with payload, retrieval_score and rerank_score.

    chunks: points (id, dense, payload); postings: (id, token_id, weight); questions: (query_id, question, dense).
    mode: hybrid or dense, by choice and never as a silent fallback; in dense mode the floor is on the cosine."""
    kept = chunks if where is None else chunks.where(where)
    dense = dense_topk(kept, questions, config.candidates)
    if mode == "dense":
        found = dense
    else:
        terms = postings if where is None else postings.join(kept.select("id"), "id", "left_semi")
        found = rrf(dense, sparse_topk(terms, query_terms, config.candidates), k=config.rrf_k, limit=config.candidates)
    found = floored(found, config.min_score)
    payload = [c for c in ("text", "url", "title", "domain", "section", "source_type", "doc_id", "chunk_index") if c in kept.columns]
    full = found.join(kept.select("id", *payload), "id").join(questions.select("query_id", question), "query_id")
    return reranked(full.withColumnRenamed("score", "retrieval_score"), config.top_k, reranker, question=question)
