import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import katz

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


class Brute:
    """The model as written in the docstring, word by word."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [Counter() for _ in range(order + 1)]
        for i, t in texts:
            if not held(i):
                padded = ["<s>"] * (order - 1) + t
                for k in range(1, order + 1):
                    self.counts[k].update(tuple(padded[j - k + 1 : j + 1]) for j in range(order - 1, len(padded)))
        self.d = [None] + [katz.discounts(np.array([0] + [sum(c == r for c in self.counts[k].values()) for r in range(1, 7)], dtype=float)) for k in range(1, order + 1)]
        self.after = defaultdict(list)
        for k in range(1, order + 1):
            for g in self.counts[k]:
                self.after[g[:-1]].append(g[-1])
        self.total = {h: sum(self.counts[len(h) + 1][h + (w,)] for w in ws) for h, ws in self.after.items()}
        self.total = {h: t + all(self.counts[len(h) + 1][h + (w,)] > 5 for w in self.after[h]) for h, t in self.total.items()}
        self.alphas = {}

    def alpha(self, h):
        if h not in self.alphas:
            left = 1 - sum(self.p(h, w) for w in self.after[h])
            self.alphas[h] = left if not h else left / (1 - sum(self.p(h[1:], w) for w in self.after[h]))
        return self.alphas[h]

    def p(self, h, w):
        c = self.counts[len(h) + 1][h + (w,)]
        if c:
            return (self.d[len(h) + 1][c] if c <= 5 else 1) * c / self.total[h]
        if not h:
            return self.alpha(())
        return (self.alpha(h) if h in self.after else 1) * self.p(h[1:], w)

    def score(self, t):
        padded = ["<s>"] * (self.order - 1) + t
        return sum(np.log10(self.p(tuple(padded[j - self.order + 1 : j]), padded[j])) for j in range(self.order - 1, len(padded)))


@pytest.mark.parametrize(("order", "how"), [(1, {}), (2, {"hot_share": 1e-9}), (3, {}), (3, {"hot_share": 3e-3, "block_tokens": 300, "least_parts": 4}), (4, {"hot_share": 0.5, "block_tokens": 5000, "part_tokens": 3000})])
def test_katz_equals_brute_force(spark, docs, rows, order, how):
    got = defaultdict(list)
    for r in katz.scores(docs, order=order, **how).collect():
        got[r.doc_id].append(r)
    texts = [(r[0], WORD.findall((r[1] or "").translate(UP)) + ["</s>"]) for r in rows]
    model = Brute(texts, order)
    uni = model.counts[1]
    n, v = sum(uni.values()), len(uni)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in texts:
        for r in got[i]:
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(uni[(w,)] > 0 for w in t), n, held(i))
            assert r.base_score == pytest.approx(sum(np.log10((uni[(w,)] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-10)
            assert r.score == pytest.approx(model.score(t), rel=1e-10)


def test_every_context_sums_to_one(spark, docs, rows):
    levels = katz.model_tables(docs, least_parts=3, hot_share=1.0)
    grams = [{(tuple(r["context"]), r["word"]): r["count"] for r in g.collect()} for g, _ in levels]
    alphas = [{tuple(r["context"]): (r["seen"], r["alpha"]) for r in c.collect()} for _, c in levels]
    discounts = [katz.discounts(np.array([0] + [sum(c == r for c in g.values()) for r in range(1, 7)], dtype=float)) for g in grams]
    totals = [Counter() for _ in levels]
    for k, g in enumerate(grams):
        for (h, _), c in g.items():
            totals[k][h] += c
        low = {h for (h, _), c in g.items() if c <= 5}
        for h in totals[k]:
            totals[k][h] += h not in low
    unknown = 1 - alphas[0][()][0]

    def p(h, w):
        c = grams[len(h)].get((h, w))
        if c:
            return (discounts[len(h)][c] if c <= 5 else 1) * c / totals[len(h)][h]
        if not h:
            return unknown
        return alphas[len(h)][h][1] * p(h[1:], w) if h in alphas[len(h)] else p(h[1:], w)

    words = [w for _, w in grams[0]] + [katz.UNKNOWN_NO]
    some = [h for k in (1, 2) for h in sorted(alphas[k])[::25]]
    assert len(some) > 50 and sum(p((), w) for w in words) == pytest.approx(1, abs=1e-12)
    for h in some:
        assert sum(p(h, w) for w in words) == pytest.approx(1, abs=1e-9)


def test_katz_small_tables(spark, docs, empty):
    assert katz.scores(empty).count() == 0
    out = next(i for i in range(60) if held(i))
    alone = katz.scores(docs.where(f"doc_id = {out}").limit(1)).collect()  # nothing is learnt
    assert [(r.held_out, r.train_tokens, r.n_known, r.score) for r in alone] == [(True, 0, 0, 0.0)]
    same = katz.scores(docs.where("doc_id = 0").withColumn("score", docs.text)).collect()
    assert len(same) == 1 and same[0].n_known == same[0].n_tokens


def test_numbers_as_bytes():
    rng = np.random.default_rng(7)
    for x in ([], [0], [0, 0, 5], [1 << 40, 3], rng.integers(0, 1 << 17, 5000), np.full(1000, 7)):
        x = np.array(x, dtype=np.int64)
        assert (katz.unpack(katz.pack(x)) == x).all()
        assert (katz.unpack(katz.pack(np.sort(x), rising=True), rising=True) == np.sort(x)).all()


def test_ranks_of_numbers_too_wide_and_of_like_hashes():
    rng = np.random.default_rng(5)
    wide = rng.integers(0, 1 << 62, 300)
    like = (np.uint64(1 << 63) + rng.integers(0, 50, 300).astype(np.uint64))  # they differ in the low bits only
    for key in (np.array([], dtype=np.int64), np.zeros(1, dtype=np.int64), rng.integers(0, 9, 1000), np.append(wide, wide), np.append(like, rng.integers(0, 1 << 64, 300, dtype=np.uint64))):
        order, first, of, values = katz._numbered(key)
        assert (np.sort(order) == np.arange(len(key))).all() and (key[order] == np.sort(key)).all()
        assert (values == np.unique(key)).all() and (values[of] == key).all() and (key[order[first]] == values).all()
    for a, b in ((rng.integers(0, 5, 400), rng.integers(0, 7, 400)), (rng.integers(0, 300, 400), rng.integers(0, 1 << 62, 400) // 3 * 3), (wide[:0], wide[:0])):
        order, first, of, own, word = katz._pairs(a, b)
        assert list(zip(own.tolist(), word.tolist())) == sorted(set(zip(a.tolist(), b.tolist())))
        assert (own[of] == a).all() and (word[of] == b).all() and (a[order[first]] == own).all()


def test_block_is_grouped_without_sorting_positions(monkeypatch):
    """Keys are sorted with their positions in them, and one compressor serves a whole process."""
    zstandard = pytest.importorskip("zstandard")
    made, sorts = [], []
    compressor, argsort = zstandard.ZstdCompressor, np.argsort
    monkeypatch.setattr(zstandard, "ZstdCompressor", lambda **how: made.append(1) or compressor(**how))
    monkeypatch.setattr(np, "argsort", lambda *x, **how: sorts.append(1) or argsort(*x, **how))
    rng = np.random.default_rng(11)
    n, numbers = np.array([2, 700, 1, 1300]), np.sort(rng.choice(5000, 40, replace=False)) + katz.FIRST_NO
    tokens, held = rng.integers(0, 40, n.sum()), np.array([0, 1, 0, 0])
    counts = np.full(40, 100)
    block = katz.Block({"n": katz.pack(n), "held": katz.pack(held), "tokens": katz.pack(tokens), "words": katz.pack(numbers), "counts": katz.pack(counts)})
    shared = katz.Shared(7, 3, 4000, 1 / 80)  # contexts of over 50 are hot: all words are
    words = katz.Grams(block, 1, None, shared)
    pairs = katz.Grams(block, 2, words, shared)
    pairs.c = np.append(3, np.full(len(pairs.context) - 1, 2))
    triples = katz.Grams(block, 3, pairs, shared)
    assert not sorts and len(made) <= 1
    for grams in (pairs, triples):
        order, cuts, first, heads = grams.layout()
        assert sorted(order.tolist()) == list(range(1, len(grams.context))) and cuts[-1] == len(order) and heads[-1] == len(first)
        for p in range(7):  # runs of one context end where their partition does
            runs = grams.context[order[first[heads[p] : heads[p + 1]]]]
            assert (np.diff(runs) > 0).all() and len(runs) == len(set(grams.context[order[cuts[p] : cuts[p + 1]]].tolist()))
    assert not sorts
    padded = [([0] * 2 + numbers[t].tolist(), h) for t, h in zip(np.split(tokens, np.cumsum(n)[:-1]), held)]
    for k, grams in ((2, pairs), (3, triples)):
        want = Counter(tuple(t[j - k + 1 : j + 1]) for t, h in padded if not h for j in range(2, len(t)))
        got = dict(zip(zip(*(x.tolist() for x in grams.columns)), grams.counts().tolist()))
        assert {g: c for g, c in got.items() if c} == dict(want)
