"""Quality rules from tokeniser fertility.

Two public vocabularies read every word: one with byte fallback, one byte-level. A text's characters per
token in each, its share of byte-fallback tokens and the entropy of its tokens are compared with bands per
language; the bands come from all documents of the language that pass the base rules (fences at a multiple of
the spread beyond the quartiles), so no value is fitted to one corpus.

A language with few documents borrows from the others, the more the fewer it has, and no count switches it over:
its quartiles' distances from the median are shrunk towards those inside the other languages, and its median
towards the languages' centre as far as its own error exceeds the spread between languages. So its band is about
as wide as one language's at any size, never as wide as all languages together.

Nulls: a null text has no words and fails; a null language is a language of its own. Repeated rows are judged alike, each in its own
row; empty tables give no rows. Whole texts are read, however long. `judged` returns its own
columns only; `keep_good` returns the input's columns as they are, whatever their names.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SPACES, WordHash, byte_texts, cut, pieces_of, private, scrambled
from weftline.llm.tokens import vocabulary_path

PIECE_MODEL, BYTE_RANKS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
SYMBOLS = b"#*$%&|<>"
INSIDE = bytes(range(0x80, 0xC0))
MEASURES = ["piece_chars", "bpe_chars", "byte_share", "entropy"]
ROWS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, piece_chars double, bpe_chars double, byte_share double, entropy double"
_tools: dict = {}


class Vocabularies:
    """Per word: its ids in the piece vocabulary as 16-bit numbers, and its number of byte-level tokens."""

    def __init__(self, piece_path: str, rank_path: str, most: int = 300_000):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(rank_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = self.piece.get_piece_size()
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(size)])
        self.size, self.most, self.known = size, most, {}

    def learn(self, split: list[list[bytes]]) -> None:
        if len(self.known) > self.most:
            self.known = {}
        new = list(set().union(*split) - self.known.keys())
        texts = [w.decode("utf-8", "replace") for w in new]
        for i in range(0, len(new), 5000):
            found = self.piece.encode(texts[i : i + 5000], num_threads=1)
            for w, t, ids in zip(new[i : i + 5000], texts[i : i + 5000], found):
                self.known[w] = (np.array(ids, dtype="<u2").tobytes(), len(self.bpe.encode_ordinary(" " + t)))


def repeat_words(hashes: np.ndarray, starts: np.ndarray, width: int = 8) -> np.ndarray:
    """For texts laid end to end: how many of each one's words lie in a window that the text holds twice or more."""
    n, ends = len(hashes), np.append(starts[1:], len(hashes))
    out = np.zeros(len(starts), dtype=np.int64)
    if n < width:
        return out
    text = np.repeat(np.arange(len(starts)), ends - starts)
    with np.errstate(over="ignore"):
        window = scrambled(text.astype(np.uint64) + np.uint64(1))[: n - width + 1]
        for k in range(width):
            window = scrambled(window + hashes[k : n - width + 1 + k])
    inside = text[: n - width + 1] == text[width - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return out
    _, back, count = np.unique(window[at], return_inverse=True, return_counts=True)
    again = at[count[back] > 1]
    if len(again):
        cover = np.zeros(n + 1, dtype=np.int32)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + width, -1)
        covered = np.cumsum(cover[:n]) > 0
        out = np.bincount(text[covered], minlength=len(starts)).astype(np.int64)
    return out


def measured(docs: DataFrame, piece_path: str | None = None, rank_path: str | None = None, carry: str | None = None) -> DataFrame:
    """One row per document with base counts and token measures of its whole text.

    carry: docs' own columns come along under this beginning of names and their number."""
    paths = (piece_path or vocabulary_path(PIECE_MODEL), rank_path or vocabulary_path(BYTE_RANKS))
    carried = [f"{carry}{i}" for i in range(len(docs.columns))] if carry else []

    def run(batches):
        if paths not in _tools:
            _tools[paths] = (Vocabularies(*paths), WordHash(300_000))
        vocab, hashed = _tools[paths]
        for whole in batches:
            for batch in pieces_of(whole, 4 << 20):
                texts = byte_texts(batch.column("text"))
                split = [x.split() for x in texts]
                vocab.learn(split)
                counts = np.array([len(x) for x in split])
                starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
                repeats = repeat_words(hashed([w for x in split for w in x]), starts)
                rows = []
                for raw, words in zip(texts, split):
                    found = [vocab.known[w] for w in words]
                    ids = np.frombuffer(b"".join([x[0] for x in found]), dtype="<u2")
                    chars = len(raw.translate(None, SPACES + INSIDE))
                    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
                    n = len(ids)
                    if n:
                        seen = np.bincount(ids, minlength=vocab.size)
                        fallback = seen[vocab.is_byte].sum() / n
                        seen = seen[seen > 0]
                        share = seen / n
                        entropy = float(-(share * np.log2(share)).sum()) / max(1.0, float(np.log2(n)))
                        more = (chars / n, chars / sum(x[1] for x in found), float(fallback), entropy)
                    else:
                        more = (None,) * 4
                    rows.append((len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), n, *more))
                cols = list(zip(*rows))
                arrays = [*(batch.column(k) for k in ("doc_id", "lang")), *(pa.array(x, pa.int64()) for x in cols[:4]), pa.array(repeats, pa.int64()), pa.array(cols[4], pa.int64()), *(pa.array(x, pa.float64()) for x in cols[5:]), *(batch.column(3 + i) for i in range(len(carried)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *MEASURES, *carried])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, carried)]
    kinds = "".join(f", {n} {f.dataType.simpleString()}" for n, f in zip(carried, docs.schema))
    return docs.select(F.col("doc_id").cast("long"), lang.alias("lang"), "text", *own).mapInArrow(run, ROWS + kinds)


def _bands(own: DataFrame, reach: float, least: int) -> DataFrame:
    """band (the language) with low, high and mid of each measure; own: lang, n and the quartiles of each measure.

    Distances from the median to the quartiles are means of the language's own, weighing n, and of the pooled ones,
    weighing `least`; languages count in the pool as n - 1 (one document shows no spread). Medians are shrunk by
    empirical Bayes: own error (1.57 of the squared deviation over n) against the variance between languages, where
    a language weighs n / (n + least), so that a stray one hardly counts."""
    over = lambda x, w: F.coalesce(F.sum(x * w) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.0))
    n = F.col("n").cast("double")
    weight, inside = n / (n + least), (n - 1.0)
    parts = {m: (F.col(m)[1] - F.col(m)[0], F.col(m)[1], F.col(m)[2] - F.col(m)[1]) for m in MEASURES}
    pool = own.agg(*[x for m, (down, mid, up) in parts.items() for x in (over(down, inside).alias(f"{m}_down"), over(up, inside).alias(f"{m}_up"), over(mid, weight).alias(f"{m}_centre"), over(mid * mid, weight).alias(f"{m}_square"))], over(1.57 / n, weight).alias("share"))
    pooled = pool.first()
    both = own.select("*", *[F.lit(pooled[c]).alias(c) for c in pool.columns])
    out = [F.col("lang").alias("band")]
    for m, (down, mid, up) in parts.items():
        centre = F.col(f"{m}_centre")
        deviation = F.greatest(F.col(f"{m}_down") + F.col(f"{m}_up"), 0.02 * F.abs(centre), F.lit(0.002)) / 1.349
        between = F.greatest(F.lit(0.0), F.col(f"{m}_square") - centre * centre - F.col("share") * deviation * deviation)
        trust = between / (between + 1.57 * deviation * deviation / n)
        middle = trust * mid + (1.0 - trust) * centre
        low, high = (middle + sign * (n * x + least * F.col(f"{m}_{name}")) / (n + least) for sign, x, name in ((-1.0, down, "down"), (1.0, up, "up")))
        spread = F.greatest(high - low, 0.02 * F.abs(middle), F.lit(0.002)) * reach
        out += [(low - spread).alias(f"{m}_low"), (high + spread).alias(f"{m}_high"), middle.alias(f"{m}_mid")]
    return both.select(*out)


def judged(docs: DataFrame, reach: float = 4.0, least: int = 50, prior: float = 100.0, carry: str | None = None) -> DataFrame:
    """measured() with base_failed and kept.

    A document is kept if the base rules pass and each measure lies in its language's band
    [q1 - reach * iqr, q3 + reach * iqr]; byte share and entropy have one open side (more fallback and less
    variety are bad). `least` is the number of documents at which a language's own spread and the pooled one weigh the
    same (_bands). Spreads count as 2% of the median at least, so that a uniform corpus rejects nothing. Short
    texts vary more: `prior` tokens at the language's median are added to each text before it is compared."""
    rows = cut(measured(docs, carry=carry).withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")))
    quarts = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(2000)).alias(m) for m in MEASURES]
    own = cut(rows.where(~F.col("base_failed")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *quarts))
    bands = cut(_bands(own, reach, least))
    sides = [f"{m}_{x}" for m in MEASURES for x in ("low", "high", "mid")]
    both = rows.join(bands, F.col("lang").eqNullSafe(F.col("band")), "left")
    side = {x: F.col(x) for x in sides}
    held = {m: (F.col(m) * F.col("n_tokens") + side[f"{m}_mid"] * prior) / (F.col("n_tokens") + prior) for m in MEASURES}
    good = (held["piece_chars"] >= side["piece_chars_low"]) & (held["piece_chars"] <= side["piece_chars_high"])
    good &= (held["bpe_chars"] >= side["bpe_chars_low"]) & (held["bpe_chars"] <= side["bpe_chars_high"])
    good &= (held["byte_share"] <= side["byte_share_high"]) & (held["entropy"] >= side["entropy_low"])
    return both.withColumn("kept", ~F.col("base_failed") & F.coalesce(good, F.lit(False))).drop("band", *sides)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judged() keeps, with docs' own columns, whatever their names. The rows go through the table of
    measures, so no text is shuffled and repeated ids with different texts are each judged."""
    carry = private(docs)
    good = judged(docs, carry=carry).where("kept")
    return good.select(*[F.col(f"{carry}{i}").alias(c) for i, c in enumerate(docs.columns)])
