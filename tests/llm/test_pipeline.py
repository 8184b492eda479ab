"""Every stage of the pipeline against plain loops over its own input, and run() against the stages."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_duplicates import joined
from test_scores import Measures, verdicts

import corpus_pipeline
from weftline.llm import mixing
from weftline.llm.tokens import TextIds, vocabulary_path

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone string, r1 string, copies string"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(documents, rows after each stage but the last, pieces of the last, pieces of run())."""
    rng = random.Random(21)
    vocabulary = "the of and house water garden window people company number great small under over between morning".split()
    shared = "this very common line stands in many documents of the corpus"
    texts = []
    for i in range(90):
        words = [rng.choice(vocabulary) + str(rng.randrange(60)) for _ in range(rng.randrange(5, 90))]
        texts.append(" ".join(words[:30]) + ("\n" + shared + "\n" if i % 3 == 0 else " ") + " ".join(words[30:]))
        if i % 5 == 0:
            texts.append(texts[-1])  # a copy
        if i % 4 == 0 and len(words) > 60:
            texts.append(texts[-1].replace(words[40], "other", 1))  # a near copy
    texts += [None, "", " \n\t ", "one", "Q%x# " * 3, " ".join("Q%x#" % rng.randrange(16**6, 16**7) for _ in range(120)), " ".join(rng.choice(vocabulary) + str(rng.randrange(900)) for _ in range(9000))]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 4}" if i % 7 else None, len(t or ""), "g", "r", "c") for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[7], "en", "s1", len(texts[7]), "g", "r", "c")]
    folder = tmp_path_factory.mktemp("pipeline")
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    frame.write.parquet(str(folder / "documents.parquet"))
    docs, after = frame, [rows]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(folder))
        assert docs.columns == frame.columns
        docs.write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        after.append([tuple(r) for r in docs.collect()])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(folder)).collect()
    return after, pieces, corpus_pipeline.run(spark, str(folder)).collect()


def same(a, b):
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_quality_rules(stages):
    before, after = stages[0][0], stages[0][1]
    measure, measured, failed = Measures(), [], []
    for r in before:
        w = WORD.findall(r[1] or "")
        at = defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        cover = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)}
        failed.append(len(w) < 20 or 100 * len(cover) > 30 * len(w))
        measured.append(measure(r[1] or ""))
    kept = verdicts([r[2] for r in before], measured, failed)
    same(after, [r for r, k in zip(before, kept) if k])
    assert 50 < len(after) < len(before)


def test_line_dedup(stages):
    before, after = stages[0][1], stages[0][2]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    where = defaultdict(set)
    for r in before:
        for x in (r[1] or "").split("\n"):
            if r[0] is not None and len(key(x)) >= 20:
                where[key(x)].add(r[0])
    want = []
    for r in before:
        text = "\n".join(x for x in (r[1] or "").split("\n") if not (len(where[key(x)]) >= 3 and r[0] != max(where[key(x)])))
        want.append((*r[:1], text, *r[2:4], len(text), *r[5:]))
    same(after, want)
    assert after != before


def test_near_duplicates(stages):
    before, after = stages[0][2], stages[0][3]
    sets = []
    for r in before:
        w = WORD.findall((r[1] or "").translate(UP))
        sets.append({tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set())
    n = range(len(before))
    part = joined(len(before), [(a, b) for a in n for b in n if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    best = {}
    for k in sorted(n, key=lambda k: (before[k][0] is None, before[k][0] or 0)):
        best.setdefault(part[k], k)
    want = Counter(before[k][0] for k in best.values())
    assert Counter(r[0] for r in after) == want and len(after) < len(before) and not Counter(map(str, after)) - Counter(map(str, before))


def test_mixing(stages):
    before, after = stages[0][3], stages[0][4]
    names = sorted({r[3] for r in before}, key=lambda x: (x is None, x or ""))
    size = {s: sum(len(WORD.findall(r[1] or "")) for r in before if r[3] == s) for s in names}
    target = dict(zip(names, mixing.targets([(s, size[s]) for s in names], (1, 2, 3), 3)))
    taken, source = Counter(), Counter()
    words = {r[0]: WORD.findall(r[1] or "") for r in before}
    for r in after:
        own = WORD.findall(r[1])
        taken[r[0]] += len(own)
        source[r[3]] += len(own)
        whole = words[r[0]]
        assert own and len(own) <= 3 * len(whole) and r[4] == len(r[1]) and r[5:] == ("g", "r", "c")
        for line in r[1].split("\n") if "\n" not in " ".join(whole) else []:
            part = WORD.findall(line)
            assert any(whole[k : k + len(part)] == part for k in range(len(whole) - len(part) + 1))
    assert all(abs(source[s] - target[s]) <= 1 for s in names)


def test_packing_and_run(stages):
    before, pieces, whole = stages[0][4], stages[1], stages[2]
    tokenizer = TextIds(vocabulary_path("word_bpe_49k.json")).tokenizer
    want = Counter()
    for r in before:
        ids = np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            want[(r[0], n, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))] += 1
    for found in (pieces, whole):
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    room = defaultdict(list)
    for r in whole:
        room[r.sequence_id].append((r.offset, r.length))
    for x in room.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and sum(n for _, n in x) <= 4096
