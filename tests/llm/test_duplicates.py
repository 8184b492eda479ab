import re

import numpy as np

from weftline.llm import neardup, vectors
from weftline.llm.common import components

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def joined(n, linked):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (7, 7), (200, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 3, 3: 3, 9: 3, 200: 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def check(spark, docs, rows, width):
    got = neardup.near_duplicates(docs, shingle_words=width).collect()
    assert len(got) == len(rows)
    sets = {}
    for r in rows:
        w = WORD.findall((r[1] or "").translate(UP))
        sets[r[0]] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    ids = sorted(i for i in sets if i is not None)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = joined(max(ids) + 1, linked)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.doc_id is None and r.kept or (r.component_id, r.kept) == (comp[r.doc_id], comp[r.doc_id] == r.doc_id)
    return linked


def test_near_duplicates_equal_brute_force(spark, docs, rows, empty):
    assert check(spark, docs, rows, 2)
    assert check(spark, docs, rows, 5)
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.first_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 1


def test_one_row_of_each_group_stays(spark):
    texts = [" ".join(f"{k}_{i}" for i in range(40)) for k in "abcd"]
    rows = [(4, texts[0]), (4, texts[0]), (3, texts[0] + " more"), (None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[3]), (None, ""), (11, None)]
    kept = neardup.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(3, texts[0] + " more"), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, ""), (11, None)]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def test_chain_of_near_copies_without_a_hub(spark):
    rng = np.random.default_rng(4)
    base = [f"a{i}" for i in rng.permutation(100)]
    texts = [list(base)]
    for k in range(12):
        nxt = list(texts[-1])
        for j in range(4):
            nxt[8 * k % 96 + j] = f"n{k}_{j}"
        texts.append(nxt)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows, 2)


def test_one_id_with_several_texts_is_one_document(spark):
    texts = [" ".join(f"{k}_{i}" for i in range(40)) for k in "abc"]
    rows = [(5, texts[0]), (5, texts[1]), (8, texts[0] + " x"), (9, texts[1] + " y"), (2, texts[2]), (3, texts[2]), (5, texts[0]), (7, ""), (7, texts[2])]
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect())
    assert got == [(2, 2), (3, 2), (5, 5), (5, 5), (5, 5), (7, 2), (7, 7), (8, 5), (9, 5)]


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 240, dtype=np.uint64)
    b = a.copy()
    b[:48] += np.uint64(1)
    x, y = (np.frombuffer(neardup.odd_sketch(v), dtype=np.uint64) for v in (a, b))
    assert abs(neardup.estimate(np.array([np.bitwise_count(x ^ y).sum()]), 240)[0] - 0.8) < 0.05


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 16))
    near = base[:40] + rng.normal(size=(40, 16)) * 0.12
    chain = [base[0] + 0.25 * k * base[1] for k in range(6)]
    x = np.vstack([base, near, chain, base[3:6], base[7:8] * 4]).astype(np.float32)
    table = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    n = len(table)
    table += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [1.0] * 4, 1), (n + 4, [1.0] * 15 + [None], 1), (n + 5, [], 1)]
    other = [(n + 6, [1.0, 2.0, 3.0], 1), (n + 7, [1.0, 2.0, 3.0], 1), (n + 8, [1.0, 2.0, 3.5], 1)]  # a length of their own
    table += other
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>, n_links int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    comp = joined(n, [(a, b) for a, b in zip(*np.nonzero(close)) if a < b])
    for how in ({}, {"most_pivots": 2}, {"tile": 8}, {"most_pivots": 16, "tile": 16}):
        got = {r.vec_id: r for r in vectors.near_vectors(frame, **how).collect()}
        assert len(got) == n + 9
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (close[i].sum(), comp[i], comp[i] == i) for i in range(n))
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(n, n + 6))
        assert all((got[i].n_links, got[i].component_id) == (2, n + 6) for i in range(n + 6, n + 9))
    assert vectors.near_vectors(frame.where("false")).count() == 0


def test_doubles_stay_doubles(spark):
    # as floats, the two are the same vector
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1e-9]), (3, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert vectors.classes(frame, "vec_id", "embedding")[1].count() == 3
    assert sorted(tuple(r) for r in vectors.near_vectors(frame).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_pivot_cells_part_the_work(spark):
    """Far fewer guests where space parts; on the given vectors, which point everywhere alike, more than one cell still."""
    rng = np.random.default_rng(6)
    x = np.vstack([c + rng.normal(size=(60, 8)) * 0.02 for c in rng.normal(size=(16, 8))]).astype("<f4")
    _, groups = vectors.classes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    pivots = vectors.plan_pivots(groups, 0.99, 64, 100)
    assert len(pivots[8]) > 4 and vectors.members(groups, pivots, 0.99).count() < 1.5 * len(x)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    _, groups = vectors.classes(table, "vec_id", "embedding")
    assert all(len(p) > 1 for p in vectors.plan_pivots(groups, 0.9, 256, 4096).values())
