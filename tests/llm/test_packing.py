import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import packing
from weftline.llm.tokens import TextIds, vocabulary_path


def test_pack_places_every_piece_once_and_gapless(spark, docs, rows):
    got = packing.pack(docs, 512).collect()
    tok = TextIds(vocabulary_path("word_bpe_49k.json")).tokenizer
    want = Counter()
    for r in rows:
        ids = np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for n, at in enumerate(range(0, len(ids), 512)):
            want[(r[0], n, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= -(-sum(r.length for r in got) // 512) + 1


def test_empty(spark, empty):
    assert packing.pack(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plan_uses_all_counts(counts):
    left = Counter(counts)
    for first, times, used in packing.plan_two_fit(counts, 64):
        assert sum(k * n for k, n in used) <= 64
        for k, n in used:
            left[k] -= n * times
    assert not any(left.values())


def test_two_replace_the_smallest():
    # greedy fills 6 + 3 of 10; 3 gives way to 2 + 2
    plan = packing.plan_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0][2] == [(6, 1), (2, 2)]


def test_sequences(spark, docs):
    pieces = packing.token_pieces(docs, 512)
    made = packing.sequences(packing.best_two_fit(pieces.withColumn("k", pieces.start), 512)).collect()
    assert all(len(r.ids) == 4 * r.n_tokens <= 2048 for r in made)


@pytest.mark.parametrize("text", ["it's <|endoftext|> İstanbul ΣΑΣ!!", "é̂ 'sab 漢字 x1y2", "naïve\xa0x ŉ ſ ﬁ", "don't!!! 'tis", ""])
def test_ids_equal_the_tokenizer(text):
    t = TextIds(vocabulary_path("word_bpe_49k.json"))
    assert t([text.encode()])[0] == np.array(t.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
