"""Best-two-fit packing of token pieces into sequences of bounded length.

Pieces are whole numbers long, so the plan needs only how many pieces there are of each length: at most
`capacity` numbers, whatever the corpus. The driver plans over these counts; a piece finds its sequence and
offset from its rank among the pieces of its length, which a salted prefix sum gives without hot tasks.

Nulls: a null text is empty; a null doc_id is an id like any other. Texts longer than the capacity are cut.
Repeated rows each get their own place. Other columns of the input are dropped by `token_pieces` and kept by
`best_two_fit`, except that columns named sequence_id and offset are replaced. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import byte_texts, cut, pieces_of, private, salted_prefix
from weftline.llm.tokens import VOCABULARY, TextIds, vocabulary_path

_ids: dict[str, TextIds] = {}
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids): each text's ids and a closing id, cut at the capacity only if longer.

    ids is binary, little-endian unsigned 32-bit. vocabulary: path of the tokenizer's file."""
    path = vocabulary or vocabulary_path(VOCABULARY)
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def run(batches):
        if path not in _ids:
            _ids[path] = TextIds(path)
        for whole in batches:
            for batch in pieces_of(whole, 4 << 20):
                doc, piece, start, length, out = [], [], [], [], []
                for doc_id, ids in zip(batch.column(0).to_pylist(), _ids[path](byte_texts(batch.column(1)))):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        doc.append(doc_id)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        out.append(part)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def plan_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(first sequence, how many alike, [(length, pieces of it in each)]) for all pieces.

    A bin opens with the longest piece left and is filled greedily with the longest that fits. Then its
    smallest piece gives way to the two unpacked ones that fill its gap best, if they fill more of it.
    The bin is repeated as often as the counts allow, so the plan has few entries however many pieces."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    axis, out, first = np.arange(capacity + 1), [], 0
    mask = sum(1 << int(i) for i in np.flatnonzero(left))
    while mask:
        used: dict[int, int] = {}
        gap = capacity
        fit = mask
        while gap and (fit := fit & ((1 << (gap + 1)) - 1)):
            length = fit.bit_length() - 1
            n = int(min(left[length], gap // length))
            used[length] = n
            gap -= n * length
            fit &= ~(1 << length)
        if gap and len(used) + next(iter(used.values())) > 2:
            small = min(used)
            room = gap + small
            free = left[: room + 1].copy()
            for length, n in used.items():
                if length <= room:
                    free[length] -= n
            top = np.maximum.accumulate(np.where(free > 0, axis[: room + 1], 0))
            one = np.flatnonzero(free > 0)
            if len(one):
                other = top[room - one]
                same = (other == one) & (free[one] < 2)
                other[same] = np.where(one[same] > 0, top[np.maximum(one[same] - 1, 0)], 0)
                total = np.where(other > 0, one + other, 0)
                best = int(np.argmax(total))
                if total[best] > small:
                    used[small] -= 1
                    for length in (int(one[best]), int(other[best])):
                        used[length] = used.get(length, 0) + 1
                    used = {k: n for k, n in used.items() if n}
        times = int(min(left[k] // n for k, n in used.items()))
        out.append((first, times, sorted(used.items(), reverse=True)))
        first += times
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                mask &= ~(1 << k)
    return out


def best_two_fit(pieces: DataFrame, capacity: int = 4096, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces (with a column length, 1 to capacity) and where each goes: sequence_id, offset.

    order: columns that, with length, tell pieces apart. Sequences are gapless from offset 0."""
    pieces = pieces.drop("sequence_id", "offset")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    if any(not 1 <= k <= capacity for k in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    rank_name = private(pieces) + "rank"
    keys, firsts, each, bases = [], [], [], []
    seen = dict.fromkeys(counts, 0)
    for first, times, used in plan_two_fit(counts, capacity):
        base = 0
        for length, n in used:
            keys.append((length << 50) + seen[length])
            firsts.append(first)
            each.append(n)
            bases.append(base)
            seen[length] += n * times
            base += n * length
    by = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    keys, firsts, each, bases = (np.array(x, dtype=np.int64)[by] for x in (keys, firsts, each, bases))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", rank_name))
            at = np.searchsorted(keys, (length << 50) + rank, "right") - 1
            past = rank - (keys[at] & ((1 << 50) - 1))
            keep = [i for i, n in enumerate(batch.schema.names) if n != rank_name]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(firsts[at] + past // each[at]), pa.array(bases[at] + past % each[at] * length)], names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    ranked = salted_prefix(pieces, ["length"], F.lit(1), list(order), rank_name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed pieces of each sequence joined; a sequence is bounded by the capacity."""
    row = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("h"))))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.unhex(F.array_join(F.transform(row, lambda x: x["h"]), "")).alias("ids"))


def pack(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """Pieces of all documents with ids_crc32, sequence_id and offset. The pieces' digests are written to the shared
    folder once, so that ranks never depend on a second tokenisation."""
    digests = token_pieces(docs, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return best_two_fit(cut(digests), capacity, ("doc_id", "piece", "start", "ids_crc32"))
