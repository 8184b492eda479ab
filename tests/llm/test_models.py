import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import fertility, mixing, resampling, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_fertility_base_counts(spark, docs, rows, empty):
    texts = [r[1] or "" for r in rows] + ["a b c d e f g h a b c d e f g h x y", "x " * 30, "l1 w\nl1 w\n \n \n#$ l1"]
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in fertility.judged(frame, least=5).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        at = defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        cover = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)}
        seen, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
        assert not (r.base_failed and r.kept)
    assert fertility.judged(empty).count() == 0 and fertility.keep_good(empty).count() == 0


def test_fertility_rejects_what_stands_out(spark):
    rng = np.random.default_rng(1)
    clean = [" ".join(rng.choice("the of and house water garden window people company number great small under over".split(), 60)) for _ in range(80)]
    odd = [" ".join(w.upper() + "***&&&" for w in clean[0].split()), " ".join(["\U0001f9ff"] * 60)]
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + odd)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in fertility.keep_good(frame).collect()}
    assert len(kept & set(range(80))) >= 79 and not kept & {80, 81}


LANGUAGES = {
    "en": "the of and house water garden window people company number great small under over between morning",
    "de": "Geschwindigkeit Wissenschaft Verantwortung Unternehmen Gesellschaft zwischen Entscheidung Nachbarschaft und der die wir",
    "zh": "中国 人民 大学 城市 时间 工作 问题 社会 发展 经济 世界 学生 生活 国家",
    None: "0 1 2 3 4 5 6 7 8 9 a b c d e f g h",
}


def test_fertility_of_rare_languages(spark):
    def bad_kept(size):
        rng = np.random.default_rng(8)
        rows, bad = [], set()
        for k, (lang, words) in enumerate(LANGUAGES.items()):
            rows += [(1000 * k + i, " ".join(rng.choice(words.split(), 80)), lang) for i in range(size - 2)]
            if lang in ("en", "de"):  # as short as the words of the other two
                rows.append((1000 * k + 900, " ".join("Q%x#" % x for x in rng.integers(16**6, 16**7, 120)), lang))
                bad.add(1000 * k + 900)
        kept = {r.doc_id for r in fertility.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
        return len(kept - bad) / (len(rows) - len(bad)), sorted(kept & bad)

    for size in (12, 49, 50):
        good, bad = bad_kept(size)
        assert good >= 0.97 and not bad, (size, good, bad)


def test_mixing_meets_targets(spark, docs, rows, empty):
    got = mixing.taken_words(docs, block_words=8).collect()
    assert len(got) == len(rows)
    again = mixing.taken_words(docs, block_words=8).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    names = sorted({r[3] for r in rows}, key=lambda x: (x is None, x or ""))
    size = {s: sum(len(WORD.findall(r[1] or "")) for r in rows if r[3] == s) for s in names}
    assert all(r.taken <= 3 * r.size for r in got)
    by = defaultdict(int)
    for r in got:
        by[(r.source_size, round(r.target, 6))] += r.taken
    assert set(by) == {(size[s], round(t, 6)) for s, t in zip(names, mixing.targets([(s, size[s]) for s in names], (1, 2, 3), 3))}
    assert all(abs(n - t) <= 16 for (_, t), n in by.items())
    assert mixing.taken_words(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixing_gives_small_sources_their_words(spark):
    rows = [(100 * s + k, " ".join(f"w{s}_{k}_{j}" for j in range(n)), f"s{s:02d}") for s in range(30) for k, n in enumerate((30, 45, 25 + 60 * (s % 4)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by, target = Counter(), {}
    for r in mixing.taken_words(frame).collect():
        by[r.doc_id // 100] += r.taken
        target[r.doc_id // 100] = r.target
    assert len(by) == 30 and all(0 < t for t in by.values())
    assert all(abs(by[s] - target[s]) <= 0.5 for s in by)
    texts = Counter()
    for r in mixing.mixed_documents(frame).collect():
        texts[r.doc_id // 100] += len(WORD.findall(r.text))
    assert texts == by


def test_slot_plan_meets_every_count_of_words():
    size = np.repeat([1, 7, 8, 9, 100, 257], 40)
    want = np.minimum(np.tile(np.arange(40) * 7, 6), 3 * size)
    quota, last = mixing.slot_plan(size, want, 8, 17)
    blocks = -(-size // 8)
    for i in range(len(size)):
        at = np.arange(quota[i])
        block = mixing.permuted(at % blocks[i], np.full(len(at), blocks[i]), np.full(len(at), i + 1 + 17 * 1000003)) if len(at) else at
        words = np.minimum(8, size[i] - block * 8)
        words[-1:] = np.minimum(words[-1:], last[i])
        assert words.sum() == want[i] and (words > 0).all()


def test_targets_stop_at_the_cap():
    assert mixing.targets([("a", 10), ("b", 100), ("c", 10)], (1, 2, 3), 3) == pytest.approx([30, 60, 30])
    out = mixing.targets([("a", 100), ("b", 10)], (1.0, 2.0, 3.0), 3)
    assert out == pytest.approx([80, 30])


def test_mixed_texts_are_the_words_taken(spark, docs):
    counts = Counter()
    for r in mixing.taken_words(docs, block_words=8).collect():
        counts[r.doc_id] += r.taken
    texts = Counter()
    for r in mixing.mixed_documents(docs, block_words=8).collect():
        assert r.n_chars == len(r.text) and r.piece == "y"
        texts[r.doc_id] += len(WORD.findall(r.text))
    assert texts == +counts


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000):
        at = np.arange(n)
        assert sorted(mixing.permuted(at, np.full(n, n), np.full(n, 5))) == list(range(n))


def test_permutation_has_its_inverse():
    for n in (1, 2, 3, 17, 1000):
        at, size, seed = np.arange(n), np.full(n, n), np.full(n, 5)
        assert (mixing.permuted(mixing.permuted(at, size, seed), size, seed, back=True) == at).all()


@pytest.fixture(scope="module")
def marked(spark):
    rng = np.random.default_rng(2)
    plain, bad = [f"p{i}" for i in range(300)], ["idiot", "stinker", "fool"]
    out, labels = [], []
    for i in range(400):
        w = list(rng.choice(plain, 40))
        toxic = i % 4 == 0
        if toxic:
            w[int(rng.integers(40))] = str(rng.choice(bad))
        if i % 5 == 0:
            w = [x + "###" for x in w]
        out.append((i, " ".join(w)))
        labels.append((i, int(i % 5 != 0), int(toxic)))
    out += [(400, None), (401, ""), (None, "p1 p2"), (0, out[0][1])]
    labels += [(None, 1, 1), (5, None, None)]
    return spark.createDataFrame(out, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_on_held_out_rows(spark, marked):
    docs, labels, raw = marked
    got = toxicity.scored(docs, labels, bits=16).collect()
    assert len(got) == 404
    truth = {i: t for i, _, t in raw if i is not None and t is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.scored(docs.where("false"), labels.where("false")).count() == 0


def test_resampling_prefers_the_target(spark, marked):
    docs, labels, _ = marked
    got = resampling.resample(docs, labels).collect()
    assert len(got) == 404
    kept = [r for r in got if r.kept]
    assert len(kept) == round(0.8 * 404)
    assert sum(1 for r in kept if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 5 == 0) <= 12
    top = sorted(got, key=lambda r: (-round(r.key * 1e9), r.doc_id if r.doc_id is not None else -(1 << 62)))[: len(kept)]
    assert sorted(str(r) for r in top) == sorted(str(r) for r in kept)
    assert resampling.resample(docs.where("false"), labels.where("false")).count() == 0
