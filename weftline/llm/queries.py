"""Registered queries of the training-data operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.llm import chat, fertility, katz, lines, mixing, neardup, packing, resampling, toxicity, vectors
from weftline.llm.common import read


def op1_best_two_fit_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), 4096)


def op2_tokeniser_fertility(spark, sf_dir):
    found = fertility.judged(read(spark, sf_dir, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*base, "n_tokens", *fertility.MEASURES)


def op3_source_mixing(spark, sf_dir):
    return mixing.taken_words(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op4_katz_backoff(spark, sf_dir):
    return katz.scores(read(spark, sf_dir, "documents"))


def op6_minhash_odd_sketch(spark, sf_dir):
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=2)


def op7_metric_range_join(spark, sf_dir):
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op8_importance_resampling(spark, sf_dir):
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_ftrl_toxicity(spark, sf_dir):
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_line_dedup(spark, sf_dir):
    found = lines.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
o AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.doc_id, k.pos, k.line, (o.key IS NOT NULL AND k.doc_id <> o.keeper) AS gone
  FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op10_chat_grammar_round_trip(spark, sf_dir):
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.read_back(chat.format_turns(turns.unionByName(own)))


_OWN = "(SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')"
_ESCAPES = " + ".join(f"(length(text) - length(replace(text, {c}, ''))) // {n}" for c, n in [("chr(92)", 1), *((f"'{x}'", len(x)) for x in chat.CONTROL)])
OP10_SQL = f"""
WITH t AS (
  SELECT *, CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 11 ELSE 19 + length(role) END AS frame, {_ESCAPES} AS escapes
  FROM {_OWN} x)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(frame + length(text) + escapes) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP6_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS s FROM t),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
h AS (SELECT g.doc_id, g.s, n.n FROM g JOIN n ON g.doc_id = n.doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n - count(*) AS whole, count(*) AS common FROM h a JOIN h b ON a.s = b.s AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS (SELECT a, b FROM p WHERE 100 * common >= 80 * whole UNION ALL SELECT b, a FROM p WHERE 100 * common >= 80 * whole),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM r LEFT JOIN n ON r.a = n.doc_id GROUP BY r.a
"""

OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a, n b
  WHERE a.vec_id <> b.vec_id AND a.s > 0 AND b.s > 0 AND list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT r.a AS vec_id, CAST(coalesce(max(k.links), 0) AS BIGINT) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM r LEFT JOIN k ON r.a = k.a GROUP BY r.a
"""

QUERIES = {
    "op1_best_two_fit_packing": op1_best_two_fit_packing,
    "op2_tokeniser_fertility": op2_tokeniser_fertility,
    "op3_source_mixing": op3_source_mixing,
    "op4_katz_backoff": op4_katz_backoff,
    "op5_line_dedup": op5_line_dedup,
    "op6_minhash_odd_sketch": op6_minhash_odd_sketch,
    "op7_metric_range_join": op7_metric_range_join,
    "op8_importance_resampling": op8_importance_resampling,
    "op9_ftrl_toxicity": op9_ftrl_toxicity,
    "op10_chat_grammar_round_trip": op10_chat_grammar_round_trip,
}
ORACLES = {"op5_line_dedup": OP5_SQL, "op6_minhash_odd_sketch": OP6_SQL, "op7_metric_range_join": OP7_SQL, "op10_chat_grammar_round_trip": OP10_SQL}
