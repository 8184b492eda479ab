"""Hashed features of texts for the small models: word n-grams and skip-grams as bucket numbers."""

from __future__ import annotations

import numpy as np

from weftline.llm.common import TO_LOWER, WordHash, mixed

_edge = bytes.maketrans(b"!\"'(),.:;?[]{}", b" " * 14)


def words_of(texts: list[bytes], strip: bool = False) -> list[list[bytes]]:
    """Lower-cased (A-Z) words; strip: common punctuation counts as white space."""
    if strip:
        return [x.translate(TO_LOWER).translate(_edge).split() for x in texts]
    return [x.translate(TO_LOWER).split() for x in texts]


def gram_buckets(split: list[list[bytes]], hashed: WordHash, bits: int, pairs: tuple[int, ...] = (1,)) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text numbers) of all words and of all pairs of words that stand `pairs` places apart."""
    counts = np.array([len(x) for x in split], dtype=np.int64)
    h = hashed([w for x in split for w in x])
    text = np.repeat(np.arange(len(split)), counts)
    found, of = [h], [text]
    for gap in pairs:
        if len(h) > gap:
            same = text[:-gap] == text[gap:]
            salt = np.uint64(gap)
            found.append(mixed(h[:-gap][same], h[gap:][same] + salt))
            of.append(text[:-gap][same])
    with np.errstate(over="ignore"):
        bucket = (np.concatenate(found) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    return bucket.astype(np.int64), np.concatenate(of)


def distinct_buckets(buckets: np.ndarray, of: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, bucket) pairs in order, as two arrays."""
    both = np.sort((of << np.int64(bits)) | buckets)
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return both >> bits, both & ((1 << bits) - 1)
