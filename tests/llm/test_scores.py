"""Verdicts of op2, log ratios of op8 and scores of op9 against plain loops."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken

from weftline.llm import fertility, resampling, toxicity
from weftline.llm.common import WordHash, mixed
from weftline.llm.tokens import vocabulary_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def bucket(h, bits):
    return (int(h) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - bits)


def features(text, bits, gaps, strip):
    text = text.translate(LOWER)
    if strip:
        for c in "!\"'(),.:;?[]{}":
            text = text.replace(c, " ")
    words = words_of(text)
    hashed = WordHash()
    h = hashed([w.encode() for w in words]) if words else []
    out = [bucket(x, bits) for x in h]
    for gap in gaps:
        for a, b in zip(h, h[gap:]):
            out.append(bucket(mixed(np.array([a]), np.array([b + np.uint64(gap)]))[0], bits))
    return out


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(12)
    plain, bad = [f"p{i}," for i in range(60)], ["Idiot", "stinker", "fool."]
    rows, labels = [], []
    for i in range(240):
        w = list(rng.choice(plain, int(rng.integers(3, 40))))
        if i % 4 == 0:
            w[0] = str(rng.choice(bad))
        rows.append((i, " ".join(w) if i % 7 else "\n".join(w)))
        labels.append((i, int(i % 3 != 0), int(i % 4 == 0)))
    rows += [(240, None), (241, ""), (None, "p1, p2,"), (242, "p5, " * 20000), (3, rows[3][1])]
    labels += [(None, 1, 1), (1, None, None), (2, 1, 7), (242, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_log_ratios_equal_brute_force(small):
    docs, labels, rows, marks = small
    bits, good_ids = 12, {i for i, q, _ in marks if q == 1 and i is not None}
    raw, good = Counter(), Counter()
    for i, t in rows:
        found = features(t or "", bits, (1,), False)
        raw.update(found)
        if i in good_ids:
            good.update(found)
    size = 1 << bits
    n, m = sum(raw.values()), sum(good.values())
    value = {b: math.log((good[b] + 1) / (m + size)) - math.log((raw[b] + 1) / (n + size)) for b in raw}
    want = sorted((str(i), sum(value[b] for b in features(t or "", bits, (1,), False))) for i, t in rows)
    got = sorted((str(r.doc_id), r.log_ratio) for r in resampling.resample(docs, labels, bits=bits).collect())
    assert [x[0] for x in got] == [x[0] for x in want]
    assert [x[1] for x in got] == pytest.approx([x[1] for x in want], rel=1e-9, abs=1e-9)


def test_keys_are_log_ratios_with_gumbel_noise(small):
    docs, labels, *_ = small
    got = resampling.resample(docs, labels, share=0.5).collect()
    noise = np.array([r.key - r.log_ratio for r in got if r.doc_id is not None and r.doc_id < 240])
    assert abs(noise.mean() - 0.5772) < 0.3 and abs(noise.std() - math.pi / math.sqrt(6)) < 0.3
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(round(r.key - r.log_ratio, 9))
    assert all(len(x) == 1 for x in by_id.values())  # repeated rows draw alike


class Steps:
    """FTRL-proximal coordinate by coordinate (McMahan et al. 2013, algorithm 1), with plain dictionaries."""

    def __init__(self, alpha=1.0, beta=1.0, l1=8.0, l2=0.1):
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = defaultdict(float), defaultdict(float), alpha, beta, l1, l2

    def weight(self, i):
        l1 = 0.0 if i == "bias" else self.l1
        if abs(self.z[i]) <= l1:
            return 0.0
        return -(self.z[i] - math.copysign(l1, self.z[i])) / ((self.beta + math.sqrt(self.n[i])) / self.alpha + self.l2)

    def learn(self, features, y):
        own = {i: self.weight(i) for i in features}
        p = 1 / (1 + math.exp(-max(-35, min(35, sum(own.values())))))
        g = p - y
        for i, w in own.items():
            sigma = (math.sqrt(self.n[i] + g * g) - math.sqrt(self.n[i])) / self.alpha
            self.z[i] += g - sigma * w
            self.n[i] += g * g


def test_ftrl_scores_equal_brute_force(small):
    docs, labels, rows, marks = small
    bits = 14
    learn = {(i, t) for i, _, t in marks if i is not None and t in (0, 1) and zlib.crc32(str(i).encode()) % 5}
    examples = sorted({(i, np.array(sorted(set(features(t or "", bits, (1, 2), True))), dtype="<i4").tobytes()) for i, t in rows if i is not None and any(i == k for k, _ in learn)})
    marks_of = defaultdict(list)
    for i, t in sorted(learn):
        marks_of[i].append(t)
    order = [(np.frombuffer(at, dtype="<i4").tolist(), y) for i, at in examples for y in marks_of[i]]
    model, rng = Steps(), np.random.default_rng(5)
    for _ in range(4):
        for k in rng.permutation(len(order)):
            model.learn([*order[k][0], "bias"], order[k][1])
    want = sorted((str(i), 1 / (1 + math.exp(-sum(model.weight(f) for f in [*set(features(t or "", bits, (1, 2), True)), "bias"])))) for i, t in rows)
    got = sorted((str(r.doc_id), r.score) for r in toxicity.scored(docs, labels, bits=bits).collect())
    assert [x[0] for x in got] == [x[0] for x in want]
    assert [x[1] for x in got] == pytest.approx([x[1] for x in want], rel=1e-7)
    assert len({round(x[1], 6) for x in got}) > 2


class Measures:
    """Token measures of a text, word by word."""

    def __init__(self):
        import base64

        import sentencepiece
        from public_tokenizers import PATTERN

        self.piece = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(fertility.PIECE_MODEL))
        with open(vocabulary_path(fertility.BYTE_RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text):
        ids, other, chars = [], 0, 0
        for w in words_of(text):
            ids += self.piece.encode(w)
            other += len(self.bpe.encode_ordinary(" " + w))
            chars += len(w)
        n = len(ids)
        if not n:
            return n, None
        shares = [c / n for c in Counter(ids).values()]
        entropy = -sum(s * math.log2(s) for s in shares) / max(1.0, math.log2(n))
        return n, (chars / n, chars / other, sum(self.piece.is_byte(i) for i in ids) / n, entropy)


def verdicts(rows, measured, failed, reach=4.0, least=50, prior=100.0):
    """Which rows stay, by the bands as the docstrings describe them. rows: languages."""
    by = defaultdict(list)
    for k, lang in enumerate(rows):
        if not failed[k]:
            by[lang].append(measured[k][1])
    own = {}
    for lang, values in by.items():
        columns = [sorted(x) for x in zip(*values)]
        own[lang] = (len(values), [[c[max(0, math.ceil(q * len(c)) - 1)] for q in (0.25, 0.5, 0.75)] for c in columns])
    bands = {lang: [] for lang in own}
    for m in range(4):
        inside = sum(n - 1 for n, _ in own.values())
        down = sum((q[m][1] - q[m][0]) * (n - 1) for n, q in own.values()) / inside if inside else 0.0
        up = sum((q[m][2] - q[m][1]) * (n - 1) for n, q in own.values()) / inside if inside else 0.0
        weight = {lang: n / (n + least) for lang, (n, _) in own.items()}
        whole = sum(weight.values())
        centre = sum(weight[x] * own[x][1][m][1] for x in own) / whole
        square = sum(weight[x] * own[x][1][m][1] ** 2 for x in own) / whole
        share = sum(weight[x] * 1.57 / own[x][0] for x in own) / whole
        deviation = max(down + up, 0.02 * abs(centre), 0.002) / 1.349
        between = max(0.0, square - centre**2 - share * deviation**2)
        for lang, (n, q) in own.items():
            trust = between / (between + 1.57 * deviation**2 / n)
            middle = trust * q[m][1] + (1 - trust) * centre
            low = middle - (n * (q[m][1] - q[m][0]) + least * down) / (n + least)
            high = middle + (n * (q[m][2] - q[m][1]) + least * up) / (n + least)
            spread = max(high - low, 0.02 * abs(middle), 0.002) * reach
            bands[lang].append((low - spread, high + spread, middle))
    out = []
    for k, lang in enumerate(rows):
        n, values = measured[k]
        if failed[k] or values is None or lang not in bands:
            out.append(False)
            continue
        held = [(v * n + b[2] * prior) / (n + prior) for v, b in zip(values, bands[lang])]
        b = bands[lang]
        out.append(b[0][0] <= held[0] <= b[0][1] and b[1][0] <= held[1] <= b[1][1] and held[2] <= b[2][1] and held[3] >= b[3][0])
    return out


def test_fertility_verdicts_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    en = "the of and house water garden window people company number great small under over between morning".split()
    de = "Geschwindigkeit Wissenschaft Verantwortung Unternehmen Gesellschaft zwischen Entscheidung Nachbarschaft und der die wir".split()
    rows = [(" ".join(rng.choice(en if i % 3 else de, int(rng.integers(15, 90)))), "en" if i % 3 else "de") for i in range(120)]
    rows += [(" ".join("Q%x#" % x for x in rng.integers(16**6, 16**7, 120)), "en"), (" ".join(["\U0001f9ff"] * 60), "de"), (None, "en"), ("", None), (" ".join(rng.choice(en, 40)), None), ("word " * 30000, "en"), (" ".join(rng.choice(en, 20_000)), "en")]
    frame = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in fertility.judged(frame).collect()}
    measure = Measures()
    measured = [measure(t or "") for t, _ in rows]
    for i, (n, values) in enumerate(measured):
        assert got[i].n_tokens == n
        if values:
            assert [got[i][m] for m in fertility.MEASURES] == pytest.approx(values, rel=1e-9)
    want = verdicts([lang for _, lang in rows], measured, [got[i].base_failed for i in range(len(rows))])
    assert [got[i].kept for i in range(len(rows))] == want
    assert not all(want[:122]) and sum(want) > 90 and not want[120] and not want[121]
