r"""Katz backoff language model over all documents: Good-Turing discounted n-gram counts, exactly normalised backoff.

For a context h of words and its shortening h' (without its first word):

    P(w | h) = d(c(h w)) c(h w) / D(h)            if h w was seen in training,
               alpha(h) P(w | h')                  if h was seen, but not h w,
               P(w | h')                           if h was never seen,
    P(w)     = d(c(w)) c(w) / D,  or the mass that is left for an unknown word.

d is the Good-Turing (Katz) discount of counts up to 5, by order. alpha(h) = left(h) / (1 - sum of P(w | h') over
the seen w), left(h) = 1 - sum of P(w | h) over them, so every context sums to one over the known words and the
unknown one. D(h) is the context's count; where none of its successors has a count up to 5, nothing would be left,
and one is added to D(h). Texts begin with `order` - 1 start marks and end with one end token.

Texts become blocks of word numbers, written once. Level by level (words, pairs, triples, ...) a block asks for its
distinct n-grams: a packet for each partition holds them with the block's training counts, the partition adds up
what all blocks send, writes its part of the model, and replies with the counts and, where the block needs them, with
the sums that make the backoff weight. So each level is one shuffle of distinct n-grams and one of replies, scores
are added in the block that holds the text, in double precision, and nothing depends on how many documents there are.
Contexts belong to one partition each; the successors of contexts of more than `hot_share` of all tokens (fewer than
1 / hot_share of them) are dealt over all partitions, and only their sums are gathered.

The model is stored as tables, a row per partition and level: words with counts, contexts with successors and counts,
discounted and backoff masses (`model_tables`). Packets hold about block_tokens * part_tokens / all tokens n-grams;
for corpora of many terabytes raise both with the memory of the executors.

Words are known by 64-bit hashes, n-grams by the numbers of their words. Nulls: a null text is empty (one end token);
a row with a null id trains. Repeated rows train and are scored each. Empty tables give no rows. Texts are read whole;
a text longer than a block is a block of its own. Other columns are ignored.
"""

from __future__ import annotations

import struct
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SPACES, TO_LOWER, Scratch, byte_texts, mixed, pieces_of, scrambled

END = np.uint64(1)  # the end token's hash
START_NO, END_NO, UNKNOWN_NO, FIRST_NO = 0, 1, 2, 3  # word numbers
TOP = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_VALUES = np.random.default_rng(101).integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
CLOSE = 0xFF  # a byte that no text holds: it closes each text and stands for END
_powers: dict = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the step and of its inverse, modulo 2**64."""
    if len(_powers.get(_STEP, ())) < n:
        for base in (_STEP, _BACK):
            run = np.full(n, base, dtype=np.uint64)
            run[0] = 1
            with np.errstate(over="ignore"):
                _powers[base] = np.multiply.accumulate(run)
    return _powers[_STEP][:n], _powers[_BACK][:n]


def word_hashes(texts: list[bytes]) -> np.ndarray:
    """Hashes of all words (A-Z lower-cased) of many texts, END after each text: a polynomial over random byte values
    from one running sum, scrambled. No word is looked up, so memory does not grow with the vocabulary."""
    raw = np.frombuffer(b" \xff ".join([*texts, b""]).translate(TO_LOWER), dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    step, back = _power(len(raw))
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[raw] * step, out=total[1:])
        length = (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        out = scrambled((total[end] - total[start]) * back[start] + length)
    out = np.where(out <= 2, out + np.uint64(3), out)
    out[raw[start] == CLOSE] = END
    return out


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


# ---- numbers as bytes


@cache
def _zstd():
    """One compressor and one decompressor for all calls of a process."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Non-negative whole numbers by byte planes, compressed; rising: their steps instead."""
    if rising and len(x):
        x = np.diff(x, prepend=x.dtype.type(0))
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    size = next(k for k in (1, 2, 4, 8) if width <= k)
    parts = x.astype(f"<u{size}").view(np.uint8).reshape(-1, size)
    planes = np.empty((width, len(x)), dtype=np.uint8)
    for k in range(width):
        planes[k] = parts[:, k]
    body = planes.tobytes()
    pressed = _zstd()[0].compress(body) if len(body) > 64 else body
    small = len(pressed) < len(body)
    return struct.pack("<IBB", len(x), width, small) + (pressed if small else body)


def unpack(raw: bytes, rising: bool = False) -> np.ndarray:
    n, width, small = struct.unpack_from("<IBB", raw)
    body = _zstd()[1].decompress(raw[6:]) if small else raw[6:]
    if not width:
        return np.zeros(n, dtype=np.int64)
    planes = np.frombuffer(body, dtype=np.uint8).reshape(width, n)
    out = planes[0].astype(np.int64)
    for k in range(1, width):
        out |= planes[k].astype(np.int64) << (8 * k)
    return np.cumsum(out) if rising else out


def _doubles(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<f8")


# ---- grouping


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts key, key in that order); key: non-negative numbers, or hashes as uint64.

    Sorting numbers that hold their own position is about three times faster than sorting positions. Hashes lose the low bits
    that the position takes, which seldom decide; positions are sorted where they do and where the numbers are too wide."""
    n = len(key)
    bits, kind = n.bit_length(), key.dtype.type
    if n and key.dtype == np.uint64:
        packed = np.sort((key >> kind(bits) << kind(bits)) | np.arange(n, dtype=np.uint64))
        order = (packed & kind((1 << bits) - 1)).astype(np.int64)
        ranked = key[order]
        if (ranked[1:] >= ranked[:-1]).all():
            return order, ranked
    elif n and int(key.max()).bit_length() + bits < 64:
        packed = np.sort((key << bits) | np.arange(n))
        return packed & ((1 << bits) - 1), packed >> bits
    order = np.argsort(key)
    return order, key[order]


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts key, where each distinct value begins in that order, number of the value of each element, the values)."""
    order, ranked = _ranked(key)
    new = np.ones(len(key), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    of = np.empty(len(key), dtype=np.int64)
    of[order] = np.repeat(np.arange(len(first)), _runs(first, len(key)))
    return order, first, of, ranked[first]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts key, where each distinct value begins in that order, number of the value of each element)."""
    return _numbered(key)[:3]


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`_groups` of the pairs of two columns, in the order of a, then b, and each distinct pair's a and b."""
    bits = int(b.max()).bit_length() if len(b) else 0
    if len(a) and int(a.max()).bit_length() + bits >= 63:
        order, first, of = _groups(_joined([a, b]))
        return order, first, of, a[order[first]], b[order[first]]
    order, first, of, values = _numbered((a << bits) | b)
    return order, first, of, values >> bits, values & ((1 << bits) - 1)


def _joined(columns: list[np.ndarray]) -> np.ndarray:
    """One whole number for each row of the columns, in the same order and equal only for equal rows."""
    key = columns[0]
    for col in columns[1:]:
        wide = int(col.max()) + 1 if len(col) else 1
        if len(key) and (int(key.max()) + 1) * wide >= 1 << 62:
            key = _groups(key)[2]
            if (int(key.max()) + 1) * wide >= 1 << 62:
                col = _groups(col)[2]
                wide = int(col.max()) + 1
        key = key * wide + col
    return key


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


def _runs(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _hash_of(columns: list[np.ndarray]) -> np.ndarray:
    out = scrambled(columns[0].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for col in columns[1:]:
        out = mixed(out, col.astype(np.uint64))
    return out


def _by_place(place: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements by partition, in their order inside it; where each partition begins, and the end)."""
    bits = len(place).bit_length()
    kind = np.uint32 if bits + parts.bit_length() <= 32 else np.uint64
    packed = np.sort((place.astype(kind) << kind(bits)) | np.arange(len(place), dtype=kind))
    cuts = np.searchsorted(packed, np.arange(parts + 1).astype(kind) << kind(bits))
    return (packed & kind((1 << bits) - 1)).astype(np.int64), cuts


def _split(place: np.ndarray, parts: int):
    """(partition, index array) of each partition that has elements; indexes keep their order."""
    order, cuts = _by_place(place, parts)
    return ((p, order[cuts[p] : cuts[p + 1]]) for p in range(parts) if cuts[p] < cuts[p + 1])


def _place(h: np.ndarray, parts: int) -> np.ndarray:
    return (scrambled(h) % np.uint64(parts)).astype(np.int32)


# ---- the model's numbers


def discounts(n: np.ndarray) -> np.ndarray:
    """d_0 .. d_5 from the numbers of types seen 1 to 6 times; where Good-Turing fails, absolute discounting."""
    d = np.ones(TOP + 1)
    if (n[1 : TOP + 2] > 0).all():
        r = np.arange(1, TOP + 1)
        a = (TOP + 1) * n[TOP + 1] / n[1]
        d[1:] = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if a < 1 else 0
        if ((d[1:] > 0) & (d[1:] < 1)).all():
            return d
    less = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    d[1:] = 1 - less / np.arange(1, TOP + 1)
    return np.maximum(d, 1e-3)


class Level:
    """What all tasks know of one order: discounts, and the sums of the few hot contexts of the order above it."""

    def __init__(self, types: np.ndarray):
        self.d = discounts(types)
        self.hot: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # keys, masses, numbers of successors by count

    def seen(self, c: np.ndarray, total: np.ndarray) -> np.ndarray:
        """P of n-grams that were seen c times, total being the context's D."""
        return np.append(self.d, 1.0)[np.minimum(c, TOP + 1)] * c / total

    def left(self, m: np.ndarray, total: np.ndarray) -> np.ndarray:
        """What contexts leave for unseen successors; m[:, r]: how many of theirs were seen r times."""
        r = np.arange(1, TOP + 1)
        mass = (m[:, 1:] * (r * (1 - self.d[1:]))).sum(axis=1)
        return np.where(m[:, 1:].any(axis=1), mass, 1.0) / total

    def find_hot(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.hot[0], keys)


class Shared:
    """Totals, discounts of the levels done so far, and limits; of bounded size."""

    def __init__(self, parts: int, docs: int, train: int, hot_share: float):
        self.parts, self.docs, self.train, self.bar = parts, docs, train, hot_share * train
        self.levels: list[Level] = []
        self.types = 0
        self.total = np.ones(1)  # D of the empty context
        self.unknown = 1.0

    def words_done(self, types: np.ndarray, n_types: int) -> None:
        self.levels = [Level(types)]
        m = types[None, : TOP + 1]
        self.types = n_types
        self.total = np.array([self.train + (0 if m[:, 1:].any() else 1)], dtype=float)
        self.unknown = float(self.levels[0].left(m, self.total)[0])


# ---- blocks

BLOCK = "block long, ids binary, none binary, held binary, n binary, tokens binary, words binary, counts binary, levels array<binary>"
BLOCK_NAMES = ["block", "ids", "none", "held", "n", "tokens", "words", "counts", "levels"]
BLOCK_TYPES = [pa.int64(), *[pa.binary()] * 7, pa.list_(pa.binary())]


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _rows_of(batch: pa.RecordBatch):
    """Rows as dicts, one at a time: they are large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def blocks_of(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Blocks of whole texts: ids, held-out marks and numbers of tokens of the texts, tokens as places among the
    block's distinct words (frequent ones first), and these words' hashes."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        held, texts, tokens, ids, size = [], [], [], [], 0

        def close():
            hashes = np.concatenate(tokens)
            order, first, of = _groups(hashes)
            count = _runs(first, len(hashes))
            by = np.argsort(-count, kind="stable")
            rank = np.empty(len(by), dtype=np.int64)
            rank[by] = np.arange(len(by))
            n = np.diff(np.flatnonzero(hashes == END), prepend=-1)
            none = np.array([x is None for x in ids])
            raw = np.array([0 if x is None else x for x in ids], dtype=np.int64).view(np.uint64)
            words = hashes[order[first]][by]
            return ((task << 32) + made, pack(raw), pack(none), pack(np.array(held)), pack(n), pack(rank[of]), words.tobytes(), None, [])

        for whole in batches:
            for batch in pieces_of(whole, 1 << 20):
                found = word_hashes(byte_texts(batch.column("text")))
                ends = np.flatnonzero(found == END)
                at = 0
                for doc_id, out, end in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), (ends + 1).tolist()):
                    if size and size + end - at > block_tokens:
                        yield _batch([close()], BLOCK_NAMES, BLOCK_TYPES)
                        made += 1
                        held, tokens, ids, size = [], [], [], 0
                    ids.append(doc_id)
                    held.append(out)
                    tokens.append(found[at:end])
                    size += end - at
                    at = end
                tokens = [np.concatenate(tokens)] if tokens else tokens
        if size:
            yield _batch([close()], BLOCK_NAMES, BLOCK_TYPES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    return rows.mapInArrow(run, BLOCK)


class Block:
    """One block, with the n-grams of each level that is known so far."""

    def __init__(self, row: dict):
        self.row = row
        self.n = unpack(row["n"])
        self.held = unpack(row["held"]).astype(bool)
        self.tokens = unpack(row["tokens"])
        self.starts = np.cumsum(self.n) - self.n
        self.learn = ~np.repeat(self.held, self.n)


class Grams:
    """The distinct n-grams of a block at one level.

    of: number of each token's n-gram. context, word, lower: of each n-gram its context (number of the level below; 0 is
    all start marks), its last word, and the n-gram without its first word. columns: the word numbers of each. N-grams are
    in the order of their contexts, then words."""

    def __init__(self, block: Block, level: int, below: "Grams | None", shared: Shared):
        self.block, self.level, self.below, self.shared = block, level, below, shared
        if level == 1:  # places 0: START, then the block's words by number
            self.words = self
            self.numbers = np.concatenate(([START_NO], unpack(block.row["words"])))
            self.c = np.concatenate(([shared.docs], unpack(block.row["counts"])))
            self.of = block.tokens + 1
            return
        context = np.empty_like(below.of)
        context[1:] = below.of[:-1]
        context[block.starts] = 0
        self.words = below.words
        order, first, of, own, word = _pairs(context, self.words.of)
        # n-gram 0 stands for start marks alone
        self.of = of + 1
        self.context, self.word = np.concatenate(([0], own)), np.concatenate(([0], word))
        self.lower = self.word if level == 2 else np.concatenate(([0], below.of[order[first]]))

    @cached_property
    def columns(self) -> list[np.ndarray]:
        if self.level == 1:
            return [self.numbers]
        return [x[self.context] for x in self.below.columns] + [self.words.numbers[self.word]]

    def counts(self) -> np.ndarray:
        """How often each n-gram stands in the block's training texts."""
        return np.bincount(self.of[self.block.learn], minlength=len(self.context))

    def layout(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(n-grams by the partition that is asked for them, where each partition begins and the end, where runs of one
        context in one partition begin, and the run that each partition begins with and the end)."""
        keys, hot, parts = _hash_of(self.below.columns), self.below.c > self.shared.bar, self.shared.parts
        place = _place(keys, parts)[self.context[1:]]
        if hot.any():
            at = np.flatnonzero(hot[self.context[1:]])
            place[at] = _place(mixed(keys[self.context[at + 1]], self.words.numbers[self.word[at + 1]].astype(np.uint64)), parts)
        order, cuts = _by_place(place, parts)
        order += 1
        context = self.context[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = context[1:] != context[:-1]
        new[cuts[cuts < len(order)]] = True
        first = np.flatnonzero(new)
        return order, cuts, first, np.searchsorted(first, cuts)

    def probabilities(self) -> np.ndarray:
        """P of each n-gram's word after its context, once the level is answered (`answer`)."""
        if self.level == 1:
            return np.where(self.c > 0, self.shared.levels[0].seen(self.c, self.shared.total[0]), self.shared.unknown)
        out = self.shared.levels[self.level - 1].seen(self.c, np.maximum(self.totals(), 1)[self.context])
        out[self.c == 0] = self.unseen
        return out

    def totals(self) -> np.ndarray:
        """D of each context."""
        return self.below.c + self.spare

    def stored(self) -> bytes:
        parts = [pack(self.c), pack(self.spare), self.unseen.astype("<f8").tobytes()]
        return b"".join(struct.pack("<I", len(x)) + x for x in parts)

    def restore(self, raw: bytes) -> None:
        parts, at = [], 0
        while at < len(raw):
            size = struct.unpack_from("<I", raw, at)[0]
            parts.append(raw[at + 4 : at + 4 + size])
            at += 4 + size
        self.c, self.spare, self.unseen = unpack(parts[0]), unpack(parts[1]), _doubles(parts[2])

    def answer(self, replies: dict) -> None:
        """Take the partitions' replies: counts, contexts that leave nothing, and masses of those that are needed."""
        level = self.shared.levels[self.level - 1]
        contexts = len(self.below.c)
        order, cuts, first, _ = self.layout()
        asked = [replies[p] for p in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()]
        self.c = np.empty(len(self.context), dtype=np.int64)
        self.c[0] = self.shared.docs
        self.c[order] = np.concatenate([unpack(c) for c, *_ in asked])
        self.spare = np.zeros(contexts, dtype=np.int64)
        heads = self.context[order[first]]
        self.spare[heads] = np.concatenate([unpack(spare) for _, spare, *_ in asked])
        unseen = np.flatnonzero(self.c == 0)
        seen, hot = self.below.c > 0, self.below.c > self.shared.bar
        missing = np.zeros(contexts, dtype=bool)
        missing[self.context[unseen[unseen > 0]]] = True
        need = heads[(missing & seen & ~hot)[heads]]
        mass = np.concatenate([_doubles(s) for *_, s, _ in asked])
        m = np.zeros((len(need), TOP + 1), dtype=np.int64)
        m[:, 1:] = np.concatenate([unpack(few) for *_, few in asked]).reshape(-1, TOP)
        alpha = np.ones(contexts)
        alpha[need] = level.left(m, np.maximum(self.totals()[need], 1)) / (1 - mass)
        followed = np.zeros(contexts, dtype=bool)
        followed[heads] = True
        if (some := np.flatnonzero(hot & followed)).size:
            at = level.find_hot(_hash_of([x[some] for x in self.below.columns]))
            m = level.hot[2][at]
            self.spare[some] = ~m[:, 1:].any(axis=1)
            alpha[some] = level.left(m, self.totals()[some]) / (1 - level.hot[1][at])
        self.unseen = alpha[self.context[unseen]] * self.below.probabilities()[self.lower[unseen]]


# ---- partitions

PACKET = "p int, block long, a binary, b binary, c binary, d binary, e binary, f binary, g binary"
PACKET_NAMES = ["p", "block", *"abcdefg"]
PACKET_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
OUT = "kind string, p int, block long, a binary, b binary, c binary, d binary, e binary, types array<long>"
OUT_NAMES = ["kind", "p", "block", *"abcde", "types"]
OUT_TYPES = [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64())]


def _types(c: np.ndarray) -> list[int]:
    """How many n-grams were seen 0 to 6 times, how many at all, and how many tokens that makes."""
    n = np.bincount(np.minimum(c, TOP + 2), minlength=TOP + 3)[: TOP + 2]
    return [*n.tolist(), int((c > 0).sum()), int(c.sum())]


def _word_packets(blocks: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in _rows_of(batch):
                block = Block(row)
                words = np.frombuffer(row["words"], dtype=np.uint64)
                count = np.bincount(block.tokens[block.learn], minlength=len(words))
                yield _batch([(p, row["block"], words[at].tobytes(), pack(count[at]), *[None] * 5) for p, at in _split(_place(words, parts), parts)], PACKET_NAMES, PACKET_TYPES)

    return blocks.mapInArrow(run, PACKET)


def _answered(packets: DataFrame, parts: int, reply) -> DataFrame:
    """reply(p, packets of the partition) for each partition, as a table by kind."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            for row in _rows_of(batch):
                if row["p"] != now and held:
                    yield from reply(now, held)
                    held = []
                now = row["p"]
                held.append(row)
        if held:
            yield from reply(now, held)

    return packets.repartitionById(parts, F.col("p")).sortWithinPartitions("p", "block").mapInArrow(run, OUT)


def _slices(sizes: list[int]):
    at = 0
    for n in sizes:
        yield slice(at, at + n)
        at += n


def _number_words(parts: int):
    """Partition of words: adds up their counts and numbers the known ones, frequent ones first."""

    def reply(p, packets):
        hashes = np.frombuffer(b"".join(x["a"] for x in packets), dtype=np.uint64)
        counts = [unpack(x["b"]) for x in packets]
        order, first, of = _groups(hashes)
        c = _sums(np.concatenate(counts)[order], first)
        words = hashes[order[first]]
        by = np.lexsort((words, -c))
        number = np.empty(len(c), dtype=np.int64)
        number[by] = np.arange(len(c)) * parts + p + FIRST_NO
        number[c == 0] = UNKNOWN_NO
        number[words == END] = END_NO
        kept = by[c[by] > 0]
        yield _batch([("model", p, -1, words[kept].tobytes(), pack(number[kept]), pack(c[kept]), None, None, _types(c))], OUT_NAMES, OUT_TYPES)
        number, c = number[of], c[of]
        out = [("reply", p, x["block"], pack(number[s]), pack(c[s]), None, None, None, None) for x, s in zip(packets, _slices([len(x) for x in counts]))]
        yield _batch(out, OUT_NAMES, OUT_TYPES)

    return reply


def _gram_packets(blocks: DataFrame, level: int, bound) -> DataFrame:
    """Packets: contexts (word numbers), hot marks, runs, words, training counts, and what their lower n-grams' P needs."""

    def run(batches):
        shared = bound.value
        for batch in batches:
            for row in _rows_of(batch):
                grams = _known(Block(row), level, shared)
                below = grams.below
                order, cuts, first, heads = grams.layout()
                context, lower = grams.context[order[first]], grams.lower[order]
                columns = [x[context] for x in below.columns]
                marks = below.c[context] > shared.bar
                runs = _runs(first, len(order))
                words, counts, low = grams.words.numbers[grams.word[order]], grams.counts()[order], below.c[lower]
                # the lower n-grams of one context's seen successors share their own context
                total = below.totals()[below.context[lower[first]]] if level > 2 else None
                out = []
                for p in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                    at, of = slice(cuts[p], cuts[p + 1]), slice(heads[p], heads[p + 1])
                    names = b"".join(struct.pack("<I", len(x)) + x for x in (pack(col[of], rising=k == 0) for k, col in enumerate(columns)))
                    own = pack(total[of]) if level > 2 else b""
                    out.append((p, row["block"], names, pack(marks[of]), pack(runs[of]), pack(words[at]), pack(counts[at]), pack(low[at]), own))
                yield _batch(out, PACKET_NAMES, PACKET_TYPES)

    return blocks.mapInArrow(run, PACKET)


def _columns(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        size = struct.unpack_from("<I", raw, at)[0]
        out.append(unpack(raw[at + 4 : at + 4 + size], rising=not out))
        at += 4 + size
    return out


def _count_grams(level: int, bound, all_masses: bool):
    """Partition of n-grams: adds up counts, sums the lower P of each context's seen successors, and replies.

    The model's rows: contexts, numbers of successors, successors, counts, and masses (unless all_masses: only of contexts
    with more than one successor; one successor's mass is its own lower P). A hot context's masses are in rows of their own."""

    def reply(p, packets):
        shared = bound.value
        names = [_columns(x["a"]) for x in packets]
        columns = [np.concatenate(x) for x in zip(*names)]
        marks, run, word, count, low = (np.concatenate([unpack(x[k]) for x in packets]) for k in "bcdef")
        runs_of = [len(x[0]) for x in names]
        sizes = [int(r.sum()) for r in np.split(run, np.cumsum(runs_of)[:-1])]
        total = np.concatenate([unpack(x["g"]) for x in packets]) if level > 2 else None
        c_order, c_first, c_of = _groups(_joined(columns))
        # own: rising, as n-grams are in the order of their contexts
        order, first, of, own, own_word = _pairs(np.repeat(c_of, run), word)
        some = order[first]
        c = _sums(count[order], first)
        seen = c > 0
        heads = c_order[c_first]
        n = len(c_first)
        lower = shared.levels[level - 2].seen(low[some], np.maximum(total, 1)[heads][own] if level > 2 else shared.total[0])
        mass = np.bincount(own[seen], weights=lower[seen], minlength=n)
        few = seen & (c <= TOP)
        m = np.bincount(own[few] * (TOP + 1) + c[few], minlength=n * (TOP + 1)).reshape(n, TOP + 1)
        successors = np.bincount(own[seen], minlength=n)
        there = successors > 0
        hot = marks[heads] > 0
        spare = there & ~hot & ~m[:, 1:].any(axis=1)

        kept = np.flatnonzero(there)
        contexts = b"".join(struct.pack("<I", len(x)) + x for x in (pack(col[heads[kept]], rising=k == 0) for k, col in enumerate(columns)))
        many = kept[(all_masses | (successors[kept] > 1)) & ~hot[kept]]
        out = [("model", p, -1, contexts, pack(successors[kept]), pack(own_word[seen]), pack(c[seen]), mass[many].astype("<f8").tobytes(), _types(c))]
        if (some_hot := kept[hot[kept]]).size:
            keys = _hash_of([col[heads[some_hot]] for col in columns])
            out.append(("hot", p, -1, keys.tobytes(), mass[some_hot].astype("<f8").tobytes(), pack(m[some_hot, 1:].reshape(-1)), None, None, None))
        counts, spares = c[of], spare[c_of]
        need = np.logical_or.reduceat(counts == 0, np.cumsum(run) - run) & (there & ~hot)[c_of]
        for x, r, s in zip(packets, _slices(runs_of), _slices(sizes)):
            ask = c_of[r][need[r]]
            out.append(("reply", p, x["block"], pack(counts[s]), pack(spares[r]), mass[ask].astype("<f8").tobytes(), pack(m[ask, 1:].reshape(-1)), None, None))
            if len(out) >= 64:
                yield _batch(out, OUT_NAMES, OUT_TYPES)
                out = []
        yield _batch(out, OUT_NAMES, OUT_TYPES)

    return reply


# ---- blocks and replies


def _known(block: Block, level: int, shared: Shared) -> Grams:
    """The block's n-grams of a level, with all levels below answered; those already stored are restored."""
    grams = Grams(block, 1, None, shared)
    for k in range(2, level + 1):
        grams = Grams(block, k, grams, shared)
        if k - 2 < len(block.row["levels"]):
            grams.restore(block.row["levels"][k - 2])
    return grams


def _with_replies(blocks: DataFrame, answers: DataFrame, tasks: int, use, schema: str) -> DataFrame:
    """use(block's row, replies by partition) for each block."""
    own = blocks.select(F.col("block").alias("at"), F.lit(-1).alias("q"), *BLOCK_NAMES[1:], *[F.lit(None).cast("binary").alias(x) for x in "abcd"])
    got = answers.where("kind = 'reply'")
    none = [F.lit(None).cast("binary").alias(x) for x in BLOCK_NAMES[1:-1]]
    got = got.select(F.col("block").alias("at"), F.col("p").alias("q"), *none, F.lit(None).cast("array<binary>").alias("levels"), *"abcd")
    names = [*BLOCK_NAMES[1:], *"abcd"]

    def run(batches):
        now, replies = None, {}
        for batch in batches:
            for row in _rows_of(batch):
                if row["q"] < 0:
                    if now is not None:
                        yield use(now, replies)
                    now, replies = {"block": row["at"], **{k: row[k] for k in names}}, {}
                else:
                    replies[row["q"]] = tuple(row[x] for x in "abcd")
        if now is not None:
            yield use(now, replies)

    return own.unionByName(got).repartition(tasks, F.col("at")).sortWithinPartitions("at", "q").mapInArrow(run, schema)


def _number_block(parts: int):
    """The block with its distinct words' numbers (in their order) and counts in place of hashes."""

    def use(row, replies):
        words = np.frombuffer(row["words"], dtype=np.uint64)
        number, c = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        for p, at in _split(_place(words, parts), parts):
            number[at], c[at] = unpack(replies[p][0]), unpack(replies[p][1])
        order, first, of = _groups(number)
        some = order[first]
        tokens = of[unpack(row["tokens"])]
        return _batch([(row["block"], *(row[k] for k in ("ids", "none", "held", "n")), pack(tokens), pack(number[some]), pack(c[some]), [])], BLOCK_NAMES, BLOCK_TYPES)

    return use


def _answer_block(level: int, bound):
    def use(row, replies):
        grams = _known(Block(row), level, bound.value)
        grams.answer(replies)
        return _batch([(*(row[k] for k in BLOCK_NAMES[:-1]), [*row["levels"], grams.stored()])], BLOCK_NAMES, BLOCK_TYPES)

    return use


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_block(order: int, bound):
    def use(row, replies):
        shared, block = bound.value, Block(row)
        grams = _known(block, order, shared)
        if order > 1:
            grams.answer(replies)
        score = np.log10(grams.probabilities())[grams.of]
        while grams.below is not None:
            grams = grams.below
        base = (np.log10(grams.c + 0.5) - np.log10(shared.train + 0.5 * (shared.types + 1)))[grams.of]
        known = (grams.c > 0)[grams.of].astype(np.int64)
        sums = [_sums(x, block.starts) for x in (known, base, score)]
        ids = pa.array(unpack(row["ids"]), mask=unpack(row["none"]).astype(bool))
        arrays = [ids, pa.array(block.held), pa.array(block.n), pa.array(sums[0]), pa.array(np.full(len(block.n), shared.train)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCORES.split(", ")])

    return use


def _hot_sums(answers: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, masses and numbers of successors of the hot contexts: fewer than 1 / hot_share of them."""

    def run(batches):
        for batch in batches:
            for a, b, c in zip(*(batch.column(x).to_pylist() for x in "abc")):
                m = unpack(c).reshape(-1, TOP)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, dtype=np.int64)), pa.array(_doubles(b)), *(pa.array(m[:, r]) for r in range(TOP))], names=["k", "x", *(f"m{r + 1}" for r in range(TOP))])

    rows = answers.where("kind = 'hot'").select(*"abc").mapInArrow(run, "k long, x double, " + ", ".join(f"m{r} long" for r in range(1, TOP + 1)))
    found = rows.groupBy("k").agg(F.sum("x").alias("x"), *[F.sum(f"m{r}").alias(f"m{r}") for r in range(1, TOP + 1)]).toArrow()
    keys = found.column("k").to_numpy().view(np.uint64)
    by = np.argsort(keys)
    m = np.stack([np.zeros(len(keys), dtype=np.int64), *(found.column(f"m{r}").to_numpy() for r in range(1, TOP + 1))], axis=1)
    return keys[by], found.column("x").to_numpy()[by], m[by]


def _all_types(answers: DataFrame) -> np.ndarray:
    sums = [F.coalesce(F.sum(F.col("types")[i]), F.lit(0)).alias(f"t{i}") for i in range(TOP + 4)]
    return np.array(answers.where("kind = 'model'").agg(*sums).first(), dtype=np.int64)


def _learnt_and_scored(docs: DataFrame, order: int, block_tokens: int, part_tokens: int, hot_share: float, least_parts: int, keep_model: bool):
    spark, scratch = docs.sparkSession, Scratch()
    tables: list[DataFrame] = []
    blocks = scratch.cut(blocks_of(docs, block_tokens))

    def sizes(batches):
        for batch in batches:
            for held, n in zip(batch.column("held").to_pylist(), batch.column("n").to_pylist()):
                held, n = unpack(held).astype(bool), unpack(n)
                yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([int(n[~held].sum())]), pa.array([int((~held).sum())])], names=["n", "train", "docs"])

    found = blocks.select("held", "n").mapInArrow(sizes, "n long, train long, docs long")
    n, train, n_docs, n_blocks = found.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("n", "train", "docs")], F.count(F.lit(1))).first()
    parts = max(least_parts, -(-int(n) // part_tokens))
    tasks = max(spark.sparkContext.defaultParallelism, -(-int(n_blocks) // 2))
    shared = Shared(parts, int(n_docs), int(train), hot_share)

    answers = scratch.cut(_answered(_word_packets(blocks, parts), parts, _number_words(parts)), "kind")
    types = _all_types(answers)
    shared.words_done(types[: TOP + 2].astype(float), int(types[TOP + 2]))
    tables.append(answers)
    more = scratch.cut(_with_replies(blocks, answers, tasks, _number_block(parts), BLOCK))
    scratch.drop(blocks, *([] if keep_model or order == 1 else tables))
    blocks = more
    for level in range(2, order + 1):
        bound = spark.sparkContext.broadcast(shared)
        answers = scratch.cut(_answered(_gram_packets(blocks, level, bound), parts, _count_grams(level, bound, keep_model)), "kind")
        shared.levels.append(Level(_all_types(answers)[: TOP + 2].astype(float)))
        shared.levels[-1].hot = _hot_sums(answers)
        tables.append(answers)
        if level < order:
            bound = spark.sparkContext.broadcast(shared)
            more = scratch.cut(_with_replies(blocks, answers, tasks, _answer_block(level, bound), BLOCK))
            scratch.drop(blocks, *([] if keep_model else tables))
            blocks = more
    bound = spark.sparkContext.broadcast(shared)
    out = scratch.cut(_with_replies(blocks, answers, tasks, _score_block(order, bound), SCORES))
    scratch.keep(out, *(tables if keep_model else []))
    return out, tables, shared


def scores(docs: DataFrame, order: int = 3, block_tokens: int = 1_000_000, part_tokens: int = 1_500_000, hot_share: float = 1e-5, least_parts: int = 16) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), logarithms to base 10."""
    return _learnt_and_scored(docs, order, block_tokens, part_tokens, hot_share, least_parts, False)[0]


def model_tables(docs: DataFrame, order: int = 3, block_tokens: int = 1_000_000, part_tokens: int = 1_500_000, hot_share: float = 1e-5, least_parts: int = 16) -> list[tuple[DataFrame, DataFrame]]:
    """For each level (n-grams, contexts) of the stored model, unpacked.

    n-grams: context (word numbers), word (its number), count. contexts: context, seen (sum of P of its successors), alpha.
    The first level has n-grams with the empty context, and the word's hash as `hash`."""
    _, tables, shared = _learnt_and_scored(docs, order, block_tokens, part_tokens, hot_share, least_parts, True)
    return [(_unpacked(t, k, shared), _weights(t, k, shared)) for k, t in enumerate(tables, 1)]


def _unpacked(table: DataFrame, level: int, shared: Shared) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, b, c, d in zip(*(batch.column(x).to_pylist() for x in "abcd")):
                if level == 1:
                    hashes, word, count = np.frombuffer(a, dtype=np.int64), unpack(b), unpack(c)
                    context = pa.array([[]] * len(word), pa.list_(pa.int64()))
                else:
                    word, count, of = unpack(c), unpack(d), np.repeat(np.arange(len(unpack(b))), unpack(b))
                    hashes = np.zeros(len(word), dtype=np.int64)
                    context = pa.array(np.stack(_columns(a), axis=1)[of].tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([context, pa.array(word), pa.array(count), pa.array(hashes)], names=["context", "word", "count", "hash"])

    return table.where("kind = 'model'").select(*"abcd").mapInArrow(run, "context array<long>, word long, count long, hash long")


def _weights(table: DataFrame, level: int, shared: Shared) -> DataFrame:
    """Contexts of one level with the probability of what was seen after them and their backoff weight."""
    if level == 1:
        return table.sparkSession.createDataFrame([([], 1 - shared.unknown, 1.0)], "context array<long>, seen double, alpha double")
    rule = shared.levels[level - 1]

    def run(batches):
        for batch in batches:
            for a, b, c, d, e in zip(*(batch.column(x).to_pylist() for x in "abcde")):
                columns, n, count, mass = _columns(a), unpack(b), unpack(d), _doubles(e)
                starts = np.cumsum(n) - n
                total = _sums(count, starts)
                m = np.stack([_sums((count == r).astype(np.int64), starts) for r in range(TOP + 1)], axis=1)
                own = ~(total > shared.bar) if len(mass) < len(n) else np.ones(len(n), dtype=bool)
                d_of = total + ~m[:, 1:].any(axis=1)
                left = rule.left(m, d_of)
                keep = np.flatnonzero(own)
                alpha = left[keep] / (1 - mass)
                names = pa.array(np.stack(columns, axis=1)[keep].tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([names, pa.array(1 - left[keep]), pa.array(alpha)], names=["context", "seen", "alpha"])

    return table.where("kind = 'model'").select(*"abcde").mapInArrow(run, "context array<long>, seen double, alpha double")
