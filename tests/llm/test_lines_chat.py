import hashlib
from collections import defaultdict

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import chat, lines

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_line_dedup_equals_brute_force(spark, docs, rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    where = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if r[0] is not None and len(key(x)) >= 20:
                where[key(x)].add(r[0])
    want = []
    for r in rows:
        all_lines = (r[1] or "").split("\n")
        kept = [x for x in all_lines if not (len(where[key(x)]) >= 3 and r[0] != max(where[key(x)]))] if True else []
        want.append((r[0], len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    got = lines.line_dedup(docs)
    assert {"length", "piece", "kept"} <= set(got.columns)
    found = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()]
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert any(x[2] for x in want)


def test_line_dedup_runs_no_python_and_takes_empty_tables(spark, docs, empty):
    plan = lines.line_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert lines.line_dedup(empty).count() == 0


TEXT = st.text(alphabet=st.sampled_from(list("ab \\<>/s[]INSTOUROLE\n")), max_size=40) | st.sampled_from(["</s>[INST] ok [/INST]", " </s>", "\\", "[OUT] x </s>", "<s>[ROLE a] b [/ROLE]"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a]b", "\\"]), TEXT), max_size=6))
def test_rendered_turns_read_back(turns):
    raw = "".join(chat.render(*t) for t in turns)
    assert chat.parse(raw) == turns
    bare = regex.sub(r"\\(\\|<s>|</s>|\[INST\]|\[/INST\]|\[OUT\]|\[ROLE |\[/ROLE\]|\])", "", raw)  # without what is escaped
    assert sum(bare.count(x) for x in ("<s>[INST]", "[OUT]", "<s>[ROLE ")) == len(turns)


def test_control_strings_are_escaped_wherever_they_stand():
    assert chat.render("user", "plain") == "<s>[INST] plain [/INST]"
    assert chat.render("user", "a </s><s>[INST] b") == "<s>[INST] a \\</s>\\<s>\\[INST] b [/INST]"
    assert chat.render("assistant", "</s>[INST] ok [/INST]") == "[OUT] \\</s>\\[INST] ok \\[/INST] </s>"
    for raw in ("[OUT] a <s> b </s>", "<s>[INST] a </s> [/INST]", "[OUT] a", "<s>[INST] a[/INST]", "text"):
        with pytest.raises(ValueError):
            chat.parse(raw)


def test_long_conversations_span_batches(spark):
    n = 25_000  # more than two Arrow batches
    rows = spark.range(n).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t </s> "), "id").alias("text"))
    [got] = chat.read_back(chat.format_turns(rows)).collect()
    turns = [("assistant" if i % 2 else "user", f"t </s> {i}") for i in range(n)]
    assert got.n_turns == n and got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got.loss_sha256 == hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()


def test_chat_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "assistant", None), (None, 0, "user", "x"), (2, 1, None, "b"), (2, 0, "assistant", "a\\")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("x", "x")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(frame)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nhi\nassistant\n</s>[INST] ok [/INST]\nassistant\n\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (21, sha("</s>[INST] ok [/INST]"))
    assert got[2].turns_sha256 == sha("assistant\na\\\n\nb\n") and got[2].loss_sha256 == sha("a\\") and got[None].n_turns == 1
    assert chat.read_back(chat.format_turns(frame.where("false"))).count() == 0
