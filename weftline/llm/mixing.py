"""Mixing sources to target weights by blocks.

Words of each source are laid end to end and cut into blocks of fixed length. Output shards draw how many
blocks they take from each source (multinomial over what the sources have left to give, so that the totals are
met exactly); a source's n-th slot goes through a pseudorandom permutation of its block numbers, pass after
pass; slots and blocks are joined by (source, block). A source's last slot takes only as many of its block's first
words as the target leaves, so that each source gives its target to the word, however small it is.

Nulls: a null text has no words; a null source is the last source. Ties and repeated rows: rows that agree in
(doc_id, text) are interchangeable, and each has its own words. Documents without words are kept with nothing
taken. Very long documents span many blocks. Empty tables give no rows. Input columns named like an output are
replaced. The list of sources (not of documents) is planned on the driver as one number per source and shard.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import byte_texts, cut, pieces_of, private, row_hash, salted_prefix, scrambled

_word = re.compile(rb"[^\x20\x09-\x0D]+")


def permuted(at: np.ndarray, size: np.ndarray, seed: np.ndarray, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each seed: a four-round Feistel network, walked until inside.

    back: its inverse."""
    at, size, seed = at.astype(np.uint64), size.astype(np.uint64), seed.astype(np.uint64)
    bits = np.maximum(np.ceil(np.log2(np.maximum(size, 2).astype(np.float64)) / 2), 1).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = at.copy(), np.arange(len(at))
    while len(todo):
        x, b, m, s = out[todo], bits[todo], mask[todo], seed[todo]
        left, right = x >> b, x & m
        with np.errstate(over="ignore"):
            for r in range(4):
                if back:
                    left, right = right ^ (scrambled(left + s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(4 - r)) & m), left
                else:
                    left, right = right, left ^ (scrambled(right + s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) & m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, r1, r2, size): the number of words of each text, and what tells rows apart."""

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole, 8 << 20):
                n = [len(x.split()) for x in byte_texts(batch.column(4))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(n, pa.int64())], names=["doc_id", "source", "r1", "r2", "size"])

    r1, r2 = row_hash(docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), r1.alias("r1"), r2.alias("r2"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, r1 long, r2 long, size long")


def targets(totals: list[tuple[str | None, int]], weights: tuple[float, ...], most: float) -> list[float]:
    """Words wanted of each source: shares by weight of all words, none above `most` times what a source has."""
    size = np.array([n for _, n in totals], dtype=float)
    weight = np.array([weights[i % len(weights)] for i in range(len(totals))], dtype=float)
    full, out, whole = np.zeros(len(size), dtype=bool), np.zeros(len(size)), size.sum()
    while not full.all():
        rest = whole - (most * size[full]).sum()
        out = np.where(full, most * size, rest * weight / weight[~full].sum())
        above = ~full & (out > most * size)
        if not above.any():
            break
        full |= above
    return np.minimum(out, most * size).tolist()


def slot_plan(size: np.ndarray, want: np.ndarray, block_words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per source: how many slots meet its wanted words, and how many words of its block the last one takes.

    Whole passes over a source give `size` words each; the rest is met block by block in permuted order. All
    blocks are full but the highest, whose place in that order decides whether one slot more is needed."""
    blocks = -(-size // block_words)
    words = np.rint(want).astype(np.int64)
    passes = np.where(size > 0, words // np.maximum(size, 1), 0)
    rest = np.where(size > 0, words - passes * size, 0)
    missing = blocks * block_words - size
    place = permuted(np.maximum(blocks - 1, 0), np.maximum(blocks, 1), _seeds(np.arange(len(size)), seed), back=True)
    slots = -(-rest // block_words)
    slots += slots * block_words - np.where(place < slots, missing, 0) < rest
    before = (slots - 1) * block_words - np.where(place < slots - 1, missing, 0)
    return passes * blocks + slots, np.where(rest > 0, rest - before, block_words)


def _seeds(source: np.ndarray, seed: int) -> np.ndarray:
    return source.astype(np.int64) + 1 + seed * 1000003


def shard_plan(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots per (shard, source): each shard draws its sources from a multinomial over the quotas left; the last takes the rest."""
    rng, left = np.random.default_rng(seed), quota.astype(np.int64).copy()
    out = np.zeros((shards, len(quota)), dtype=np.int64)
    for i in range(shards):
        want = int(left.sum()) // (shards - i)
        if i == shards - 1:
            out[i], left = left, left * 0
            break
        while want:
            drawn = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[i] += drawn
            left -= drawn
            want -= int(drawn.sum())
    return out


def mix(docs: DataFrame, block_words: int = 128, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, shards: int | None = None, seed: int = 17):
    """(documents, slots, spans).

    documents: doc_id, row, source_no, size, source_size, target. slots: shard, slot, source_no, block, part (words
    taken from the block's beginning where the slot is cut, else null). spans: source_no, block, doc_id, row,
    copy_no, first (word of the document), words, at (words of the block before the span). Joined by (source_no,
    block), slots and spans are the mixture."""
    spark = docs.sparkSession
    rows = cut(sizes(docs))
    found = rows.groupBy("source").agg(F.sum("size").alias("n")).toArrow()  # a row for each source
    totals = sorted(zip(found.column("source").to_pylist(), found.column("n").to_pylist()), key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8")))
    want = np.array(targets(totals, weights, most))
    if shards is None:  # of about 2**26 words each
        shards = min(4096, max(64, sum(n for _, n in totals) >> 26))
    size = np.array([n for _, n in totals], dtype=np.int64)
    blocks = -(-size // block_words)
    quota, last = slot_plan(size, want, block_words, seed)
    table = spark.createDataFrame([(s, i, int(n), float(t)) for i, ((s, n), t) in enumerate(zip(totals, want.tolist()))], "name string, source_no int, source_size long, target double")
    known = rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    placed = cut(salted_prefix(known, ["source_no"], F.col("size"), ["doc_id", "r1", "r2"], "start"))
    covered = F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("block")
    spans = placed.where("size > 0").select("source_no", covered, "doc_id", "r1", "r2", "start", "size")
    first = F.greatest(F.lit(0), F.col("block") * block_words - F.col("start"))
    spans = spans.withColumn("first", first).withColumn("words", F.least("size", (F.col("block") + 1) * block_words - F.col("start")) - F.col("first"))
    spans = spans.withColumn("at", F.greatest(F.lit(0), F.col("start") - F.col("block") * block_words))

    plan = shard_plan(quota, shards, seed) if len(quota) else np.zeros((shards, 0), dtype=np.int64)
    flat = plan.reshape(-1)
    bounds = np.concatenate(([0], np.cumsum(flat)))
    before = (np.cumsum(plan, axis=0) - plan).reshape(-1)
    n_sources = max(1, len(quota))

    def draw(batches):
        for batch in batches:
            slot = batch.column(0).to_numpy()
            cell = np.searchsorted(bounds, slot, "right") - 1
            source = cell % n_sources
            nth = before[cell] + slot - bounds[cell]
            n = blocks[source]
            block = permuted(nth % n, n, _seeds(source, seed))
            whole = (nth < quota[source] - 1) | (last[source] >= np.minimum(block_words, size[source] - block * block_words))
            yield pa.RecordBatch.from_arrays([pa.array((cell // n_sources).astype(np.int32)), pa.array(slot), pa.array(source.astype(np.int32)), pa.array(block), pa.array(last[source], mask=whole)], names=["shard", "slot", "source_no", "block", "part"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slots = spark.range(0, int(flat.sum()), 1, parts).mapInArrow(draw, "shard int, slot long, source_no int, block long, part long")
    return placed, slots, spans


def _hits(slots: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans of the blocks that slots take, with how many times as a whole, and how many words once more (part)."""
    often = slots.groupBy(F.col("source_no").alias("s"), F.col("block").alias("b")).agg(F.count_if(F.col("part").isNull()).alias("times"), F.coalesce(F.max("part"), F.lit(0)).alias("upto"))
    both = spans.join(often, (F.col("source_no") == F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    both = both.withColumn("part", F.greatest(F.lit(0), F.least("words", F.col("upto") - F.col("at")))).drop("upto", "at")
    return both.where("times > 0 OR part > 0")


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    placed, slots, spans = mix(docs, **how)
    own = ["doc_id", "r1", "r2", "size", "start", "source_no"]
    both = _hits(slots, spans).select(*own, (F.col("times") * F.col("words") + F.col("part")).alias("n")).union(placed.select(*own, F.lit(0).cast("long")))
    out = both.groupBy(*own).agg(F.sum("n").alias("taken"), F.count_if(F.col("n") == 0).alias("rows"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("rows"), F.lit(1)))))
    source = placed.groupBy("source_no").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"))
    return out.join(F.broadcast(source), "source_no").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: each row's text becomes the words taken of it, pass after pass, each pass on
    lines of its own; rows of which nothing is taken go, and n_chars follows the text. A whole pass is the text
    as it was. Other columns stay."""
    _, slots, spans = mix(docs, **how)
    per = _hits(slots, spans).groupBy("r1", "r2", "start", "size").agg(F.sort_array(F.collect_list(F.struct("first", "words", "times", "part"))).alias("takes"))
    p = private(docs)
    r1, r2, m1, m2, copies, takes_of = (p + x for x in ("r1", "r2", "m1", "m2", "copies", "takes"))
    per = per.groupBy(F.col("r1").alias(m1), F.col("r2").alias(m2)).agg(F.collect_list("takes").alias(copies))
    own = row_hash(docs)
    rows = docs.withColumn(r1, own[0]).withColumn(r2, own[1]).dropDuplicates([r1, r2])
    joined = rows.join(per, (F.col(r1) == F.col(m1)) & (F.col(r2) == F.col(m2)))
    names, text_at = docs.columns, docs.columns.index("text")
    joined = joined.select(*[F.col(f"`{n}`") for n in names], F.explode(copies).alias(takes_of))

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole, 8 << 20):
                texts = [_cut_out(t, takes) for t, takes in zip(byte_texts(batch.column(text_at)), batch.column(len(names)).to_pylist())]
                cols = [batch.column(i) for i in range(len(names))]
                cols[text_at] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    at = names.index("n_chars")
                    cols[at] = pa.array([len(x) for x in texts], pa.int64()).cast(batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(run, docs.schema)


def _cut_out(text: bytes, takes: list[dict]) -> str:
    """The words taken of a text: each pass over it, with runs of neighbouring spans as they stand in the text."""
    at = [m.span() for m in _word.finditer(text)]
    out = []
    for turn in range(max(x["times"] + (x["part"] > 0) for x in takes)):
        runs: list[list[int]] = []
        for x in takes:
            words = x["words"] if x["times"] > turn else x["part"] if x["times"] == turn else 0
            if words:
                if runs and runs[-1][1] == x["first"]:
                    runs[-1][1] += words
                else:
                    runs.append([x["first"], x["first"] + words])
        out += [text[at[a][0] : at[b - 1][1]] if (a, b) != (0, len(at)) else text for a, b in runs]
    return b"\n".join(out).decode("utf-8", "replace")
