"""Near-duplicate documents by banded MinHash with odd sketches, confirmed on full shingle sets.

Documents with the same shingle set are one class from the start. Class representatives meet in buckets of
banded MinHash values; pairs pass a bound on sizes and an odd sketch (parity bitmap of the MinHash sample, whose
XOR population count estimates high similarities), and are confirmed on their full sets. Buckets never emit
their pairs: each first compares its members with one of them, the member that meets most others; only members
that are outside a bucket's largest component after that meet its other members, in tiles of bounded size, by
sketches and then full sets.

With the defaults two sets of similarity 0.8 share no bucket with probability (1 - 0.8**6)**40 < 6e-6.

Nulls and empties: a text that is null or without words has an empty set, links with nothing and stands for
itself; a row with a null doc_id is its own group and is kept. Fewer words than a shingle has make one shingle.
Repeated rows get the same answer each; rows that share an id but not the text are one document with several texts, in
one component with whatever any of them is linked with. Other columns are ignored by `near_duplicates` and kept by `first_of_each`.
Empty tables give no rows. Whole texts are read; a text's shingles are held by one worker at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import TO_LOWER, Scratch, WordHash, byte_texts, components, cut, mixed, pieces_of, private, row_hash, scrambled

SKETCH_BITS, LEAST_FILTER, MOST_FILTER = 1024, 1 << 20, 1 << 27
_hash: dict = {}


def _hashed() -> WordHash:
    return _hash.setdefault(0, WordHash(400_000))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text (A-Z lower-cased)."""
    split = [x.translate(TO_LOWER).split() for x in texts]
    h = _hashed()([w for x in split for w in x])
    out, at = [], 0
    for words in split:
        own = h[at : at + len(words)]
        at += len(words)
        if not len(own):
            out.append(own)
        elif len(own) < width:
            one = scrambled(np.array([len(own)], dtype=np.uint64))
            for x in own:
                one = mixed(one, np.array([x], dtype=np.uint64))
            out.append(one)
        else:
            s = own[: len(own) - width + 1]
            for k in range(1, width):
                s = mixed(s, own[k : len(own) - width + 1 + k])
            s = np.sort(s)
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
    return out


def min_hashes(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest product with each odd factor, modulo 2**64; the hashes are well mixed already."""
    best = None
    with np.errstate(over="ignore"):
        for i in range(0, len(found), 1 << 14):
            least = (factors[:, None] * found[None, i : i + (1 << 14)]).min(axis=1)
            best = least if best is None else np.minimum(best, least)
    return best


def odd_sketch(sample: np.ndarray) -> bytes:
    """Parity bitmap of the sample's (place, value) elements."""
    with np.errstate(over="ignore"):
        at = scrambled(sample + np.arange(1, len(sample) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)
    bits = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def estimate(differ: np.ndarray, sample: int) -> np.ndarray:
    """Similarity from the number of bits in which two odd sketches differ."""
    inside = np.maximum(1 - 2 * differ / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * sample) * np.log(inside)


def _floor(percent: int, sample: int) -> float:
    """Estimates below this rule a pair out: six deviations of the sample and some room for the bitmap's own error."""
    return percent / 100 - 6 * (0.16 / sample) ** 0.5 - 0.03


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, d1, d2, bands, sketch): set size, digest of the set, band keys and odd sketch."""
    factors = np.random.default_rng(11).integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole, 6 << 20):
                n, d1, d2, keys, sketches = [], [], [], [], []
                for found in shingle_sets(byte_texts(batch.column(1)), width):
                    n.append(len(found))
                    if not len(found):
                        d1.append(0), d2.append(0), keys.append(None), sketches.append(None)
                        continue
                    with np.errstate(over="ignore"):
                        again = scrambled(found + np.uint64(0xA5A5A5A5))
                        d1.append(found.sum().astype(np.int64))
                        d2.append(again.sum().astype(np.int64) ^ np.bitwise_xor.reduce(again).astype(np.int64))
                    low = min_hashes(found, factors)
                    key = np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        key = mixed(key, low[r::rows])
                    keys.append(key.view(np.int64))
                    sketches.append(odd_sketch(low))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "n", "d1", "d2", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>, sketch binary")


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(i, s): the shingle sets of the documents with these ids, packed; several for an id with several texts. A bitmap
    with about 16 bits an id (16 MB at most) keeps most other texts from being read into sets; the join afterwards is
    exact."""
    ids = cut(ids.distinct())
    size = min(MOST_FILTER, max(LEAST_FILTER, 1 << (16 * max(1, ids.count())).bit_length()))
    placed = ids.select(F.pmod(F.xxhash64("i"), F.lit(size)).alias("p"))
    words = placed.groupBy(F.expr("cast(p div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("v")).toArrow()
    bitmap = np.zeros(size // 64, dtype=np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("v").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches):
        bits = shared.value
        for whole in batches:
            at = whole.column(2).to_numpy()
            live = (bits[at >> 6] >> (at & 63)) & 1 == 1
            for batch in pieces_of(whole.filter(pa.array(live)), 6 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingle_sets(byte_texts(batch.column(1)), width)], pa.binary())], names=["i", "s"])

    some = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("i"), "text")
    some = some.select("i", "text", F.pmod(F.xxhash64("i"), F.lit(size)).alias("at")).mapInArrow(sets, "i long, s binary")
    return cut(some.join(ids, "i", "left_semi").distinct())


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, sample: int) -> DataFrame:
    """Edges (a, b): those of the pairs that hold on full sets."""
    one = reps.select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))
    two = reps.select(F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))
    joined = pairs.join(one, F.col("a") == F.col("x")).join(two, F.col("b") == F.col("y"))
    joined = joined.where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")).select("a", "b", "sx", "sy")
    floor = _floor(percent, sample)

    def near(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for k in (2, 3))
                batch = batch.filter(pa.array(estimate(np.bitwise_count(x ^ y).sum(axis=1).astype(float), sample) >= floor))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])

    pairs = cut(joined.mapInArrow(near, "a long, b long"))
    full = full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("i")), width)
    one, two = (full.select(F.col("i").alias(k), F.col("s").alias(v)) for k, v in (("x", "sx"), ("y", "sy")))
    joined = pairs.join(one, F.col("a") == F.col("x")).drop("x").join(two, F.col("b") == F.col("y")).select("a", "b", "sx", "sy")

    def holds(batches):
        for whole in batches:
            for batch in pieces_of(whole, 16 << 20):
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                    both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                batch = batch.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])

    return cut(joined.mapInArrow(holds, "a long, b long").distinct())


def _between_parts(labels: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, sample: int, tile: int = 1 << 20) -> DataFrame:
    """Edges (a, b) between members of different parts that share a bucket (labels: key, i, part).

    In each bucket the members outside its largest part meet all its members, by odd sketches and then on full sets, in
    tiles of about `tile` shingles a side; rows are copied once per tile of the other side and never paired. Tiles return a
    spanning forest of what they find."""
    sized = labels.join(reps.select(F.col("rep").alias("r"), "n", "sketch"), F.col("i") == F.col("r")).drop("r")
    per = sized.groupBy("key", "part").agg(F.sum("n").alias("s"))
    keys = per.groupBy(F.col("key").alias("k")).agg(F.max_by("part", F.struct("s", "part")).alias("main"), F.max("s").alias("most"), F.sum("s").alias("all"), F.count(F.lit(1)).alias("c")).where("c > 1")
    keys = keys.select("k", "main", F.ceil(F.col("all") / tile).cast("int").alias("a"), F.ceil((F.col("all") - F.col("most")) / tile).cast("int").alias("b"))
    rows = cut(sized.join(keys, F.col("key") == F.col("k")).drop("k"))
    sets = full_sets(docs, rows.select("i").distinct(), width).withColumnRenamed("i", "w")
    full = rows.join(sets, (F.col("i") == F.col("w")) & (F.octet_length("s") == 8 * F.col("n"))).drop("w")
    floor = _floor(percent, sample)
    at, to = (F.pmod(F.xxhash64(F.lit(x), "i"), F.col(x)).cast("int") for x in ("a", "b"))
    build = full.select("key", "i", "part", "s", "n", "sketch", F.lit(False).alias("probe"), at.alias("ra"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("cb"))
    probe = full.where("part <> main").select("key", "i", "part", "s", "n", "sketch", F.lit(True).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("ra"), to.alias("cb"))

    def meet(key, group):
        probes = group.column("probe").to_pylist()
        ids, parts = group.column("i").to_pylist(), group.column("part").to_pylist()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("s").to_pylist()]
        own = [k for k, p in enumerate(probes) if not p]
        found: list[tuple[int, int]] = []
        if own and len(own) < len(probes):
            size = np.array([len(sets[k]) for k in own])
            bits = np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
            theirs, part_of = bits[own], np.array([parts[k] for k in own])
            for k in (k for k, p in enumerate(probes) if p):
                mine = sets[k]
                differ = np.bitwise_count(theirs ^ bits[k]).sum(axis=1).astype(float)
                some = (part_of != parts[k]) & (100 * np.minimum(size, len(mine)) >= percent * np.maximum(size, len(mine)))
                for m in np.flatnonzero(some & (estimate(differ, sample) >= floor)).tolist():
                    other = sets[own[m]]
                    both = int((other[np.minimum(np.searchsorted(other, mine), len(other) - 1)] == mine).sum())
                    if 100 * both >= percent * (len(other) + len(mine) - both):
                        found.append((ids[k], ids[own[m]]))
        up: dict[int, int] = {}

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        part = dict(zip(ids, parts))
        edges = []
        for x, y in found:
            p, q = top(part[x]), top(part[y])
            if p != q:
                up[max(p, q)] = min(p, q)
                edges.append((x, y))
        a, b = [list(x) for x in zip(*edges)] if edges else ([], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cut(build.unionByName(probe).groupBy("key", "ra", "cb").applyInArrow(meet, "a long, b long").distinct())


def _same_id(sigs: DataFrame, reps: DataFrame) -> DataFrame | None:
    """Edges (a, b) between the representatives of texts that share an id; None if no id has several texts."""
    texts = sigs.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "d1", "d2", "n")
    text = F.struct("d1", "d2", "n")
    several = cut(texts.groupBy(F.col("doc_id").alias("k")).agg(F.min(text).alias("low"), F.max(text).alias("high")).where("low <> high").select("k"))
    if several.isEmpty():
        return None
    texts = texts.join(several, F.col("doc_id") == F.col("k")).distinct()
    own = reps.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n").alias("m"), "rep")
    found = texts.join(own, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") == F.col("m")))
    least = found.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return cut(found.join(least, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct())


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): links hold where 100 * intersection >= percent * union."""
    with Scratch() as scratch:
        own, known = _grouped(docs.select(F.col("doc_id").cast("long"), "text"), shingle_words, percent, bands, rows)
        scratch.keep(own, known)
    same = (F.col("d1") == F.col("r1")) & (F.col("d2") == F.col("r2")) & (F.col("n") == F.col("rn")) & F.col("doc_id").isNotNull()
    out = own.join(known, same, "left")
    component = F.coalesce("part", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _grouped(docs: DataFrame, shingle_words: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Tables of (doc_id, n, d1, d2), a row for each document, and of (r1, r2, rn, part), one for each distinct text."""
    sigs = cut(signatures(docs, shingle_words, bands, rows))
    reps = sigs.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = cut(reps)
    members = reps.select(F.col("rep").alias("i"), F.explode("bands").alias("key"))
    crowd = members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = cut(members.join(crowd.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("i", "key", "c"))
    meets = members.groupBy("i").agg(F.sum("c").alias("met"))
    hubs = members.join(meets.withColumnRenamed("i", "j"), F.col("i") == F.col("j")).groupBy("key").agg(F.max(F.struct("met", (-F.col("i")).alias("m"))).alias("h"))
    hubs = cut(hubs.select(F.col("key").alias("k"), (-F.col("h.m")).alias("hub")))
    stars = members.join(hubs, F.col("key") == F.col("k")).where("i <> hub").select(F.least("i", "hub").alias("a"), F.greatest("i", "hub").alias("b")).distinct()
    edges = _confirmed(cut(stars), reps, docs, shingle_words, percent, bands * rows)
    if (same := _same_id(sigs, reps)) is not None:
        edges = edges.union(same)
    parts = cut(components(edges))
    labels = members.join(parts, F.col("i") == F.col("node"), "left").select("key", "i", F.coalesce("component", "i").alias("part"))
    labels = cut(labels)
    more = _between_parts(labels, reps, docs, shingle_words, percent, bands * rows)
    parts = components(edges.union(more)) if not more.isEmpty() else parts
    known = reps.join(parts, F.col("rep") == F.col("node"), "left").select(F.col("d1").alias("r1"), F.col("d2").alias("r2"), F.col("n").alias("rn"), F.coalesce("component", "rep").alias("part"))
    return cut(sigs.select("doc_id", "n", "d1", "d2")), cut(known)


def first_of_each(docs: DataFrame, **how) -> DataFrame:
    """One row of docs for each group of near-duplicates, with docs' own columns, whatever their names: the one with the
    smallest doc_id, null ids last. Rows are told apart by a number of their own, so repeated rows and rows with a null or
    shared doc_id each take part."""
    p = private(docs)
    row, at = p + "row", p + "at"
    h1, h2 = row_hash(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col(p + "h1").alias("h1"), F.col(p + "h2").alias("h2"), F.col(row).alias("row"))
    with Scratch() as scratch:
        rows = cut(docs.withColumn(p + "h1", h1).withColumn(p + "h2", h2).withColumn(row, F.monotonically_increasing_id()))
        found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), **how).select(F.col("doc_id").alias("at"), F.col("component_id").alias("part"))
        known = cut(rows.select(F.col(row).alias("row"), order.alias("order")).join(found, F.col("row") == F.col("at")).select("at", "part", "order"))
        best = known.groupBy(F.col("part").alias("p")).agg(F.min("order").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
        gone = cut(known.join(best, F.col("part") == F.col("p")).where(F.col("at") != F.col("best.row")).select(F.col("at").alias(at)))
        scratch.keep(rows, gone)
    return rows.join(gone, F.col(row) == F.col(at), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
