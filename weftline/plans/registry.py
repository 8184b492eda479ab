"""Registered queries of the engine and, for each that SQL can express, its DuckDB oracle.

Every query runs over its whole tables. Searches take as questions every row whose id is divisible by 50."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import Agent, Config, Scope
from weftline.functions import media as M
from weftline.functions import text as T
from weftline.functions import urls as U
from weftline.operators import agent, assets, chunking, encoding, frontier, parsing, retrieval
from weftline.plans import jobs
from weftline.sources.models import ExtractiveLlm

QUERIES: dict = {}
ORACLES: dict = {}

# DuckDB parts: trimmed white space, sentences, buckets of words
_TRIM = "trim({}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"
_SENTENCES = f"""list_filter(list_transform(string_split(regexp_replace({_TRIM.format('text')}, '([.!?।])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_TRIM.format('x')}), lambda x: x <> '')"""
_WORDS = "list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> '')"
_PART = "CAST('0x' || substr(md5(w), {}, 8) AS BIGINT)"
_R1 = f"({_PART.format(1)} % 100000)"
_R2 = f"(({_R1} * 67296 + {_PART.format(9)}) % 100000)"
_R3 = f"(({_R2} * 67296 + {_PART.format(17)}) % 100000)"
_BUCKET = f"CAST(({_R3} * 67296 + {_PART.format(25)}) % 100000 AS INTEGER)"


def _sparse(name: str, ident: str, table: str, text: str = "text") -> str:
    return f"""
{name}_w AS (SELECT {ident}, unnest(CASE WHEN len(ws) = 0 THEN [''] ELSE ws END) AS w FROM (SELECT {ident}, {_WORDS.format(f"coalesce({text}, '')")} AS ws FROM {table}) x),
{name}_c AS (SELECT {ident}, CASE WHEN w = '' THEN 0 ELSE {_BUCKET} END AS token_id, sum(CASE WHEN w = '' THEN 0 ELSE 1 END) AS tf FROM {name}_w GROUP BY ALL),
{name} AS (SELECT {ident}, token_id, CASE WHEN max(tf) OVER (PARTITION BY {ident}) > 0 THEN CAST(tf AS DOUBLE) / max(tf) OVER (PARTITION BY {ident}) ELSE 0.0 END AS weight FROM {name}_c)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(f"""
WITH s AS (SELECT doc_id, {_SENTENCES} AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS pos, unnest(p) AS sentence FROM s
""")
def sentence_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"""
WITH RECURSIVE s AS (SELECT row_number() OVER () AS k, doc_id, {_SENTENCES} AS p FROM documents WHERE text IS NOT NULL),
r AS (
  SELECT k, 1 AS i, '' AS buf, 0 AS filled, '' AS tail, CAST([] AS VARCHAR[]) AS chunks FROM s
  UNION ALL
  SELECT r.k, i + 1,
    CASE WHEN i > len(p) THEN '' WHEN length(p[i]) > 1000 AND buf = '' THEN '' WHEN buf <> '' AND filled + length(p[i]) + 1 > 1000 THEN p[i]
         WHEN buf = '' THEN p[i] ELSE buf || ' ' || p[i] END,
    CASE WHEN i > len(p) THEN 0 WHEN length(p[i]) > 1000 AND buf = '' THEN 0 WHEN buf <> '' AND filled + length(p[i]) + 1 > 1000 THEN length(p[i]) + 1
         ELSE filled + length(p[i]) + 1 END,
    CASE WHEN i > len(p) THEN tail WHEN length(p[i]) > 1000 AND buf = '' THEN right(p[i], 150) WHEN buf <> '' AND filled + length(p[i]) + 1 > 1000 THEN right(buf, 150) ELSE tail END,
    CASE WHEN i > len(p) THEN CASE WHEN buf <> '' THEN list_append(chunks, {_TRIM.format("tail || ' ' || buf")}) ELSE chunks END
         WHEN length(p[i]) > 1000 AND buf = '' THEN list_append(chunks, {_TRIM.format("tail || ' ' || p[i]")})
         WHEN buf <> '' AND filled + length(p[i]) + 1 > 1000 THEN list_append(chunks, {_TRIM.format("tail || ' ' || buf")}) ELSE chunks END
  FROM r JOIN s ON r.k = s.k WHERE i <= len(p) + 1),
f AS (SELECT s.doc_id, list_filter(chunks, lambda x: length(x) >= 50) AS c FROM r JOIN s ON r.k = s.k WHERE r.i = len(s.p) + 2)
SELECT doc_id, CAST(unnest(range(len(c))) AS INTEGER) AS chunk_index, CAST(len(c) AS INTEGER) AS total_chunks, unnest(c) AS text FROM f
""")
def chunk_pack(spark, sf_dir):
    return chunking.chunk_texts(table(spark, sf_dir, "documents").where("text IS NOT NULL"))


@query("WITH " + _sparse("t", "doc_id", "documents") + " SELECT doc_id, token_id, round(weight, 9) AS weight FROM t")
def sparse_encode(spark, sf_dir):
    return encoding.sparse_terms(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 9))


@query("WITH " + _sparse("q", "item_id", "(SELECT item_id, text FROM benchmark WHERE item_id % 50 = 0)") + "," + _sparse("d", "doc_id", "documents") + """,
s AS (SELECT q.item_id AS query_id, d.doc_id AS id, round(sum(d.weight * q.weight), 9) AS score FROM d JOIN q ON d.token_id = q.token_id GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)
SELECT query_id, id, score, rank FROM r WHERE rank <= 20""")
def sparse_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    questions = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.sparse_topk(encoding.sparse_terms(docs, "id"), encoding.sparse_terms(questions, "query_id")).select("query_id", "id", "score", "rank")


_DENSE = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings {where}),
qs AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(q.v, e.v), 9) AS score FROM e, qs q),
dense AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 20)"""


def _dense(spark, sf_dir, where=None):
    e = table(spark, sf_dir, "embeddings")
    points = (e if where is None else e.where(where)).select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    questions = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("dense"))
    return retrieval.dense_topk(points, questions)


@query("WITH " + _DENSE.format(where="") + " SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM dense")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("WITH " + _DENSE.format(where="WHERE label = 3") + " SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM dense")
def filtered_topk(spark, sf_dir):
    return _dense(spark, sf_dir, F.col("label") == 3).withColumn("score", F.round("score", 6))


_HYBRID = "WITH " + _DENSE.format(where="") + "," + _sparse("q", "doc_id", "(SELECT doc_id, text FROM documents WHERE doc_id % 50 = 0)") + "," + _sparse("d", "doc_id", "documents") + """,
ss AS (SELECT q.doc_id AS query_id, d.doc_id AS id, round(sum(d.weight * q.weight), 9) AS score FROM d JOIN q ON d.token_id = q.token_id GROUP BY ALL),
sparse AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ss QUALIFY rank <= 20),
u AS (SELECT query_id, id, 1.0::DOUBLE / (2 + rank - 1) AS s FROM dense UNION ALL SELECT query_id, id, 1.0::DOUBLE / (2 + rank - 1) FROM sparse),
f AS (SELECT query_id, id, round(sum(s), 9) AS score FROM u GROUP BY ALL),
g AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 20)
SELECT query_id, id, score, rank FROM g"""


def _hybrid(spark, sf_dir):
    """All documents and all vectors are searched; a question with only a text or only a vector has one list."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    questions = docs.where("id % 50 = 0").select(F.col("id").alias("query_id"), "text")
    sparse = retrieval.sparse_topk(encoding.sparse_terms(docs, "id"), encoding.sparse_terms(questions, "query_id"))
    return retrieval.rrf(_dense(spark, sf_dir), sparse).select("query_id", "id", "score", "rank")


@query(_HYBRID)
def rrf_hybrid(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@query(_HYBRID + " WHERE score >= 0.3")
def score_floor(spark, sf_dir):
    return retrieval.floored(_hybrid(spark, sf_dir))


# addresses in `pages` have no ports, users, parameters or blank query values, so patterns serve as the oracle
_BASE = "regexp_extract(url, '^([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '\\?([^#]*)', 1)"
_NORM = f"""(lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || CASE WHEN rtrim(regexp_extract({_BASE}, '^[a-zA-Z]+://[^/]*(.*)$', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract({_BASE}, '^[a-zA-Z]+://[^/]*(.*)$', 1), '/') END
 || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split({_QUERY}, '&')), '&') END)"""
_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1))"
_LABELS = f"string_split({_HOST}, '.')"
_ROOT = f"""CASE WHEN len({_LABELS}) >= 3 AND {_LABELS}[-2] IN ('gov', 'co', 'org', 'net', 'edu', 'ac') THEN array_to_string({_LABELS}[-3:], '.')
 WHEN len({_LABELS}) >= 2 THEN array_to_string({_LABELS}[-2:], '.') ELSE {_HOST} END"""


@query(f"SELECT page_id, {_NORM} AS norm FROM pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalize_url("url").alias("norm"))


@query(f"SELECT page_id, substr(md5({_NORM}), 1, 12) AS url_hash, 'page_' || substr(md5({_NORM}), 1, 12) AS doc_id FROM pages")
def url_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", U.normalize_url("url").alias("norm"))
    return rows.select("page_id", U.url_hash(F.col("norm")).alias("url_hash"), U.doc_id(F.col("norm")).alias("doc_id"))


@query(f"SELECT page_id, {_HOST} AS host, {_ROOT} AS root FROM pages")
def root_domain(spark, sf_dir):
    host = U.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), U.root_domain(host).alias("root"))


@query(f"SELECT page_id, url FROM pages WHERE {_ROOT} = 'example.com'")
def scope_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(frontier.in_scope(U.host(F.col("url")), ["example.com"])).select("page_id", "url")


@query(f"""SELECT page_id, CASE WHEN NOT ({_ROOT} IN ('example.com', 'example.net')) THEN 'scope' WHEN regexp_matches(url, '.*/en/.*', 'i') THEN 'excluded' END AS reason FROM pages""")
def exclude_filter(spark, sf_dir):
    scope = Scope(url_patterns_exclude=(*Scope().url_patterns_exclude, r".*/en/.*"))
    rows = frontier.addressed(table(spark, sf_dir, "pages").select("page_id", "url"))
    return rows.select("page_id", frontier.reject_reason(scope, ["example.com", "example.net"]).alias("reason"))


@query(f"SELECT page_id, host FROM (SELECT page_id, {_HOST} AS host, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS n FROM pages) x WHERE n <= 5")
def domain_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"))
    return frontier.within_budget(rows, 5, seq="page_id").select("page_id", "host")


@query("""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages),
g AS (SELECT page_id AS i, unnest([(2 * page_id + 1) % n, (3 * page_id + 2) % n, (page_id + 7) % n]) AS j FROM pages, n),
r AS (SELECT CAST(0 AS BIGINT) AS page_id, 0 AS depth UNION SELECT g.j, r.depth + 1 FROM r JOIN g ON g.i = r.page_id WHERE r.depth < 5)
SELECT page_id, min(depth) AS depth FROM r GROUP BY page_id
""")
def bfs_levels(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id")
    n = pages.count()

    def expand(rows):
        i = F.regexp_extract("url", r"/p(\d+)$", 1).cast("long")
        to = F.array((2 * i + 1) % n, (3 * i + 2) % n, (i + 7) % n)
        links = rows.select("pop_order", F.posexplode(to).alias("pos", "j")).join(pages, F.col("j") == F.col("page_id"), "left_semi")
        return links.select("pop_order", "pos", F.concat(F.lit("http://graph.example.com/p"), F.col("j")).alias("url"), F.lit("").alias("anchor_text"))

    config = Config()
    config = replace(config, crawl=replace(config.crawl, max_depth=5, max_pages=1 << 30, max_pages_per_domain=1 << 30))
    pops, _, _ = frontier.crawl(spark, ["http://graph.example.com/p0"], expand, config)
    return pops.select(F.regexp_extract("url", r"/p(\d+)$", 1).cast("long").alias("page_id"), "depth")


_TITLE = "trim(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&'))"


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_title(spark, sf_dir):
    return parsing.parse_pages(table(spark, sf_dir, "pages"), fields=("title",)).select("page_id", "title")


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS language FROM pages")
def page_lang(spark, sf_dir):
    return parsing.parse_pages(table(spark, sf_dir, "pages"), fields=("language",)).select("page_id", "language")


@query("""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS label,
  unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">', 1)))) AS pos FROM pages),
b AS (SELECT page_id, pos, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || replace(href, '&amp;', '&') AS link, trim(replace(label, '&amp;', '&')) AS text FROM a),
c AS (SELECT page_id, pos, link, text, row_number() OVER (PARTITION BY page_id, link ORDER BY pos) AS n FROM b)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, link, text FROM c WHERE n = 1
""")
def page_links(spark, sf_dir):
    parsed = parsing.parse_pages(table(spark, sf_dir, "pages"), fields=("internal_links", "external_links"))
    return parsed.select("page_id", F.posexplode(F.concat("internal_links", "external_links")).alias("pos", "l")).select("page_id", "pos", F.col("l.url").alias("link"), F.col("l.text").alias("text"))


_KEY = "rtrim(replace(replace(url, 'https://www.', 'https://'), 'http://www.', 'http://'), '/')"


@query(f"SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY {_KEY} ORDER BY page_id) AS n FROM pages) x WHERE n = 1")
def citation_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "pages").select(F.lit(0).alias("query_id"), F.col("page_id").alias("rank"), "url", "page_id")
    return agent.citation_dedup(docs).select("page_id", "url")


@query(f"""
WITH k AS (SELECT page_id, url, {_HOST} AS host, {_KEY} AS key FROM pages),
d AS (SELECT *, row_number() OVER (PARTITION BY host, key ORDER BY page_id) AS n FROM k)
SELECT host, CAST(row_number() OVER (PARTITION BY host ORDER BY page_id) AS INTEGER) AS index, url, 1.0::DOUBLE / (1 + page_id) AS score FROM d WHERE n = 1
""")
def citation_list(spark, sf_dir):
    docs = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("host"), F.col("page_id"), "url")
    kept = agent.citation_dedup(docs, "host", "page_id")
    doc = F.struct("page_id", F.lit("").alias("text"), "url", F.lit("").alias("title"), F.lit("").alias("section"), (1.0 / (1 + F.col("page_id"))).alias("score"))
    lists = kept.groupBy("host").agg(F.sort_array(F.collect_list(doc)).alias("docs"))
    return lists.select("host", F.explode(agent.citations(F.col("docs"))).alias("c")).select("host", "c.index", "c.url", "c.score")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) x WHERE n <= 4")
def chat_memory(spark, sf_dir):
    return agent.remembered(table(spark, sf_dir, "conversations"), 4)


@query("""
WITH o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT event_id, CAST(i * 1500000 + max(t - i * 1500000) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS starts FROM o
""")
def rate_schedule(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return frontier.schedule(events, 1_500_000, "user_id", "t", "event_id").select("event_id", F.col("starts").cast("long").alias("starts"))


@query("""
SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id,
  row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate FROM documents WHERE text IS NOT NULL
""")
def asset_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", U.content_hash(F.col("text").cast("binary")).alias("content_hash"))
    return assets.deduplicated(docs.withColumn("first_id", F.col("doc_id")), seq="doc_id", path="first_id").select("doc_id", "content_hash", "first_id", "duplicate")


@query("""
WITH p AS (SELECT p_partkey, p_size * 37 AS w, CAST(p_retailprice AS INTEGER) % 1200 + 1 AS h, lower(p_name) AS n FROM part)
SELECT p_partkey, CASE WHEN w <= 64 OR h <= 64 THEN 'icon' WHEN w <= 200 AND h <= 200 THEN 'icon' WHEN CAST(w AS DOUBLE) / greatest(h, 1) > 3 THEN 'banner'
  WHEN CAST(w AS DOUBLE) / greatest(h, 1) < 0.4 THEN 'poster_vertical' WHEN w >= 800 AND h >= 600 THEN 'photo_or_poster' ELSE 'image_unknown' END AS by_size,
 CASE WHEN regexp_matches(n, 'icon|logo|favicon|sprite|thumb') THEN 'icon_or_logo' WHEN regexp_matches(n, 'banner|hero|header|cover') THEN 'banner'
  WHEN regexp_matches(n, 'poster|notice|circular|flyer|scheme') THEN 'poster' WHEN regexp_matches(n, 'photo|image|img|pic|gallery') THEN 'photo'
  WHEN regexp_matches(n, 'chart|graph|infographic|diagram') THEN 'infographic_or_chart' ELSE 'image_unknown' END AS by_url FROM p
""")
def image_class(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37).alias("w"), (F.rint("p_retailprice").cast("int") % 1200 + 1).alias("h"), "p_name")
    return parts.select("p_partkey", M.kind_by_size(F.col("w"), F.col("h")).alias("by_size"), M.kind_by_url(F.col("p_name")).alias("by_url"))


@query("""
SELECT doc_id, round(CASE WHEN length(replace(text, ' ', '')) > 0 THEN CAST(len(regexp_extract_all(text, '[ऀ-ॿ]')) AS DOUBLE) / length(replace(text, ' ', '')) ELSE 0.0 END, 9) AS share,
 CASE WHEN len(regexp_extract_all(text, '[ऀ-ॿ]')) * 2 > length(replace(text, ' ', '')) THEN 'hi' WHEN len(regexp_extract_all(text, '[ऀ-ॿ]')) > 0 THEN 'mixed' ELSE 'en' END AS language
FROM documents WHERE text IS NOT NULL
""")
def language_share(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.round(T.devanagari_share(F.col("text")), 9).alias("share"), T.language_of(F.col("text")).alias("language"))


@query(f"""
WITH h AS (SELECT {_HOST} AS host, page_id FROM pages), c AS (SELECT host, count(*) AS n FROM h GROUP BY host)
SELECT CAST(sum(n) AS BIGINT) AS pages, count(*) AS domains, max(n) AS most, array_to_string(list(host || '=' || n ORDER BY host), ',') AS by_domain FROM c
""")
def crawl_summary(spark, sf_dir):
    from weftline.sources import store

    index = table(spark, sf_dir, "pages").select("url", U.host(F.col("url")).alias("domain"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("error"))
    one = store.crawl_summary(index)
    listed = F.transform(F.sort_array(F.map_entries("domains")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return one.select("pages", F.size("domains").cast("long").alias("domains"), F.array_max(F.map_values("domains")).alias("most"), F.array_join(listed, ",").alias("by_domain"))


@query(f"""
WITH t AS (SELECT page_id, {_TITLE} AS title, trim(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&amp;', '&')) AS h1 FROM pages)
SELECT page_id, CAST(1 AS INTEGER) AS level, left(h1, 200) AS heading, left(h1, 200) AS path FROM t WHERE length(h1) >= 2
""")
def page_headings(spark, sf_dir):
    parsed = parsing.parse_pages(table(spark, sf_dir, "pages"), fields=("headings", "heading_hierarchy"))
    rows = parsed.select("page_id", F.posexplode(F.arrays_zip("headings", "heading_hierarchy")).alias("i", "x"))
    return rows.select("page_id", F.col("x.headings.level").alias("level"), F.col("x.headings.text").alias("heading"), F.col("x.heading_hierarchy").alias("path"))


@query()
def page_chunks(spark, sf_dir):
    """Pages parsed, cleaned and chunked end to end."""
    return chunking.chunk_pages(_records(spark, sf_dir)).drop("depth")


def _records(spark, sf_dir):
    parsed = parsing.parse_pages(table(spark, sf_dir, "pages"))
    norm = U.normalize_url("url")
    return parsed.withColumn("doc_id", U.doc_id(norm)).withColumn("domain", U.netloc(F.col("url"))).withColumn("depth", F.lit(0))


@query(f"""
SELECT doc_id, {_TRIM.format("regexp_replace(regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), '[ \\t\\r\\x0b\\x0c]+\\n', chr(10), 'g')")} AS cleaned
FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\\r\\x0b\\x0c\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{2028}}\\x{{2029}}]')
""")
def clean_plaintext(spark, sf_dir):
    """X-12, over texts whose only white space is blanks, tabs and line feeds (the two engines' classes agree there)."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & ~F.col("text").rlike("[\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u2028\\u2029]"))
    return docs.select("doc_id", T.clean_plaintext(F.col("text")).alias("cleaned"))


@query("SELECT doc_id FROM documents WHERE length(coalesce(text, '')) >= 100 AND coalesce(lang, '') <> 'fr'")
def chunkable_pages(spark, sf_dir):
    error = F.struct(F.when(F.col("lang") == "fr", "failed").otherwise("").alias("error"))
    pages = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body_text"), error.alias("rag_status"))
    return chunking.chunkable(pages).select("doc_id")


_HEADS = """h AS (SELECT p_partkey, p_partkey % 7 <> 0 AS ok, CASE p_partkey % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'Text/HTML; charset=x' WHEN 2 THEN NULL ELSE 'image/jpeg' END AS kind,
  p_size * 997 AS length, 'http://e.com/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.JPG?v=1' WHEN 1 THEN '' ELSE '.txt' END AS url,
  CASE WHEN p_partkey % 11 = 0 THEN 404 ELSE 200 END AS status, p_size * 503 AS size FROM part)"""


def _heads(spark, sf_dir):
    key = F.col("p_partkey")
    kind = F.when(key % 5 == 0, "image/png").when(key % 5 == 1, "Text/HTML; charset=x").when(key % 5 == 2, None).otherwise("image/jpeg")
    url = F.concat(F.lit("http://e.com/"), key, F.when(key % 3 == 0, ".JPG?v=1").when(key % 3 == 1, "").otherwise(".txt"))
    return table(spark, sf_dir, "part").select("p_partkey", (key % 7 != 0).alias("head_ok"), kind.alias("head_type"), (F.col("p_size") * 997).cast("long").alias("head_length"), url.alias("url"), F.when(key % 11 == 0, 404).otherwise(200).alias("status_code"), F.repeat(F.lit("x"), (F.col("p_size") * 503).cast("int")).cast("binary").alias("body"))


@query(f"""
WITH {_HEADS}
SELECT p_partkey, CASE WHEN NOT ok THEN 'HEAD request failed' WHEN length > 0 AND length < 5120 THEN NULL WHEN coalesce(kind, '') <> '' AND kind NOT LIKE 'image/%' AND url NOT LIKE '%.JPG?v=1' THEN NULL
  WHEN status <> 200 THEN 'HTTP ' || status END AS error,
 CASE WHEN NOT ok THEN '' WHEN length > 0 AND length < 5120 THEN 'Too small (' || length || 'B < 5120B)' WHEN coalesce(kind, '') <> '' AND kind NOT LIKE 'image/%' AND url NOT LIKE '%.JPG?v=1' THEN 'Not an image: text/html'
  WHEN status <> 200 THEN '' WHEN size < 5120 THEN 'Too small after download (' || size || 'B)' ELSE '' END AS skip FROM h
""")
def image_gate(spark, sf_dir):
    error, skip = assets.image_gate()
    return _heads(spark, sf_dir).select("p_partkey", error.alias("error"), skip.alias("skip"))


@query(f"""
WITH {_HEADS}
SELECT p_partkey, CASE kind WHEN 'image/png' THEN '.png' WHEN 'image/jpeg' THEN '.jpg' ELSE CASE p_partkey % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpg' ELSE '.txt' END END AS extension FROM h
""")
def asset_extension(spark, sf_dir):
    return _heads(spark, sf_dir).select("p_partkey", M.extension(assets.mime(F.col("head_type")), F.col("url")).alias("extension"))


@query("""
SELECT p_partkey, CAST(CASE WHEN p_size % 4 > 0 THEN p_size % 4 WHEN p_partkey % 2 = 0 THEN p_partkey % 100 ELSE 0 END AS INTEGER) AS pages FROM part
""")
def pdf_page_count(spark, sf_dir):
    body = F.concat(F.lit("%PDF-1.4 "), F.repeat(F.lit("/Type /Page\n"), F.col("p_size").cast("int") % 4), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/Count 3 /Count "), F.col("p_partkey") % 100)).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", M.pdf_pages(body.cast("binary")).cast("int").alias("pages"))


@query("""
WITH i AS (SELECT p_partkey, p_size * 11 AS width, CAST(p_retailprice AS INTEGER) % 700 AS height, p_size * 90 AS size FROM part)
SELECT 'doc' || (p_partkey % 20) || '_p' || lpad(CAST(p_partkey % 90 AS VARCHAR), 3, '0') || '_img' || lpad(CAST(p_partkey % 50 AS VARCHAR), 2, '0') || '.png' AS file, p_partkey, round(size / 1024.0::DOUBLE, 1) AS size_kb
FROM i WHERE width >= 200 AND height >= 200 AND size >= 2048
""")
def pdf_images(spark, sf_dir):
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("doc"), key % 20, F.lit(".pdf")).alias("pdf"), (key % 90).cast("int").alias("page"), (key % 50).cast("int").alias("img_index"), (F.col("p_size") * 11).alias("width"), (F.rint("p_retailprice").cast("int") % 700).alias("height"), (F.col("p_size") * 90).alias("size_bytes"), F.lit("png").alias("format"))
    return assets.filtered_pdf_images(rows).select("file", "p_partkey", "size_kb")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) x WHERE n = 1")
def keep_last(spark, sf_dir):
    from weftline.sources import store

    return store.latest(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def not_crawled(spark, sf_dir):
    from weftline.sources import store

    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").cast("string").alias("url"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("url"))
    return store.not_crawled(rows, done).select("o_orderkey")


@query("SELECT doc_id, sha256(doc_id || chr(31) || (doc_id % 7)) AS id FROM documents")
def point_ids(spark, sf_dir):
    from weftline.sources import store

    return store.with_point_id(table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7).alias("chunk_index"))).select("doc_id", "id")


@query("SELECT page_id, substr(regexp_replace(url, '[^\\p{L}\\p{N}_\\-.]', '_', 'g'), 1, 30) AS folder FROM pages")
def folder_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.sanitized(F.col("url"), 30).alias("folder"))


@query(f"""
WITH k AS (SELECT page_id, url, {_HOST} AS host, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'Page ' || page_id END AS title, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS n FROM pages)
SELECT host, string_agg('[' || n || '] Source: ' || CASE WHEN title = '' THEN url ELSE title END || chr(10) || 'URL: ' || url || chr(10) || 'Section: s' || n || chr(10) || chr(10) || 'text ' || page_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context
FROM k WHERE n <= 5 GROUP BY host
""")
def context_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("host"), "page_id", "url")
    rows = frontier.within_budget(rows, 5, seq="page_id")
    title = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("Page "), "page_id"))
    doc = F.struct("page_id", F.concat(F.lit("text "), "page_id").alias("text"), "url", title.alias("title"))
    lists = rows.groupBy("host").agg(F.sort_array(F.collect_list(doc)).alias("docs"))
    named = F.transform("docs", lambda d, i: d.withField("section", F.concat(F.lit("s"), i + 1)))
    return lists.select("host", agent.context_block(named).alias("context"))


@query(f"""
WITH t AS (SELECT page_id, url, {_TITLE} AS title FROM pages)
SELECT page_id, 'Page Title: ' || title AS text, 'Page Summary' AS section FROM t WHERE length('Page Title: ' || title || chr(10)) >= 50
""")
def page_summaries(spark, sf_dir):
    """C-6 over whole pages: their title, as they have no description."""
    chunks = chunking.chunk_pages(_records(spark, sf_dir).withColumn("doc_id", F.col("page_id").cast("string")))
    return chunks.where("source_type = 'meta'").select(F.col("doc_id").cast("long").alias("page_id"), "text", "section")


# the offline embedder and reranker in SQL: signed hashing of words, and the share of the question's words that a text holds
_TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_HEX = " || ".join(f"substr(md5(w), {15 - 2 * i}, 2)" for i in range(8))


def _embedded(name: str, ident: str, source: str, text: str) -> str:
    return f"""
{name}_w AS (SELECT {ident}, CAST('0x' || {_HEX} AS UBIGINT) AS h FROM (SELECT {ident}, unnest({_TOKENS.format(text)}) AS w FROM {source}) x),
{name}_s AS (SELECT {ident}, h % 768 AS k, sum(CASE WHEN h >= 9223372036854775808 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}_w GROUP BY ALL),
{name}_e AS (SELECT {ident}, k, CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY {ident})) AS FLOAT) AS DOUBLE) AS v FROM {name}_s QUALIFY sum(v * v) OVER (PARTITION BY {ident}) > 0)"""


_RERANKED = f"""
t AS (SELECT c.*, {_TOKENS.format("d.text")} AS have, list_distinct({_TOKENS.format("b.text")}) AS want FROM cand c JOIN documents d ON d.doc_id = c.id JOIN benchmark b ON b.item_id = c.query_id),
o AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY query_id) > 1 THEN len(list_intersect(want, have))::DOUBLE / greatest(1, len(want)) + 1.0::DOUBLE / (1000 + len(have)) END AS raw FROM t),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC NULLS LAST, rank) AS final_rank FROM o QUALIFY final_rank <= 5)"""
_ASKED = "(SELECT item_id, text FROM benchmark WHERE item_id % 50 = 0)"
_SPARSE_20 = """
ss AS (SELECT q.item_id AS query_id, d.doc_id AS id, round(sum(d.weight * q.weight), 9) AS score FROM d JOIN q ON d.token_id = q.token_id GROUP BY ALL),
sparse AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM ss QUALIFY rank <= 20)"""


@query("WITH " + _sparse("q", "item_id", _ASKED) + "," + _sparse("d", "doc_id", "documents") + "," + _SPARSE_20 + ", cand AS (SELECT * FROM sparse)," + _RERANKED + " SELECT query_id, id, rank, round(raw, 9) AS rerank_score, CAST(final_rank AS INTEGER) AS final_rank FROM z")
def rerank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    found = retrieval.sparse_topk(encoding.sparse_terms(docs, "id"), encoding.sparse_terms(asked, "query_id", "question"))
    full = found.join(docs.where("text IS NOT NULL"), "id").join(asked, "query_id")
    return retrieval.reranked(full).select("query_id", "id", "rank", F.round("rerank_score", 9).alias("rerank_score"), "final_rank")


@query(
    "WITH " + _sparse("q", "item_id", _ASKED) + "," + _sparse("d", "doc_id", "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)") + "," + _embedded("a", "item_id", _ASKED, "text") + "," + _embedded("p", "doc_id", "documents", "text") + "," + _SPARSE_20
    + """,
every AS (SELECT i.item_id AS query_id, n.doc_id AS id FROM (SELECT DISTINCT item_id FROM a_e) i, (SELECT doc_id FROM documents WHERE text IS NOT NULL) n),
dots AS (SELECT a_e.item_id AS query_id, p_e.doc_id AS id, sum(a_e.v * p_e.v) AS v FROM a_e JOIN p_e ON a_e.k = p_e.k GROUP BY ALL),
ds AS (SELECT every.query_id, every.id, round(coalesce(v, 0), 9) AS score FROM every LEFT JOIN dots ON every.query_id = dots.query_id AND every.id = dots.id),
dense AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ds QUALIFY rank <= 20),
u AS (SELECT query_id, id, 1.0::DOUBLE / (1 + rank) AS s FROM dense UNION ALL SELECT query_id, id, 1.0::DOUBLE / (1 + rank) FROM sparse),
f AS (SELECT query_id, id, round(sum(s), 9) AS score FROM u GROUP BY ALL),
cand AS (SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 20) x WHERE score >= 0.3),"""
    + _RERANKED
    + " SELECT query_id, id, (SELECT source FROM documents d WHERE d.doc_id = z.id) AS domain, score AS retrieval_score, round(raw, 9) AS rerank_score, rank, CAST(final_rank AS INTEGER) AS final_rank FROM z"
)
def hybrid_retrieve(spark, sf_dir):
    """Benchmark questions against documents through encoding, both searches, fusion, floor and reranking."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text", F.lit("").alias("url"), F.lit("").alias("title"), F.col("source").alias("domain"), F.lit("").alias("section"))
    asked = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    model = encoding.dense_udf()
    points = frontier.cut(docs.withColumn("dense", model("text")))
    found = retrieval.retrieve(points, encoding.sparse_terms(docs, "id"), asked.withColumn("dense", model("question")), encoding.sparse_terms(asked, "query_id", "question"))
    return found.select("query_id", "id", "domain", "retrieval_score", F.round("rerank_score", 9).alias("rerank_score"), "rank", "final_rank")


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(ExtractiveLlm.stop)) + "]"
_GRADED = "WITH " + _sparse("q", "item_id", _ASKED) + "," + _sparse("d", "doc_id", "documents") + "," + _SPARSE_20 + f""",
g AS (SELECT s.query_id, s.id, list_filter({_TOKENS.format("left(d.text, 400)")}, lambda x: NOT list_contains({_STOP}, x)) AS have, list_filter({_TOKENS.format("b.text")}, lambda x: NOT list_contains({_STOP}, x)) AS want
  FROM sparse s JOIN documents d ON d.doc_id = s.id JOIN benchmark b ON b.item_id = s.query_id WHERE d.text IS NOT NULL)"""


def _graded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("rewritten"))
    found = retrieval.sparse_topk(encoding.sparse_terms(docs, "id"), encoding.sparse_terms(asked, "query_id", "rewritten"))
    doc = F.struct(F.col("rank"), "text", F.col("id").cast("string").alias("url"))
    state = found.join(docs.where("text IS NOT NULL"), "id").groupBy("query_id").agg(F.sort_array(F.collect_list(doc)).alias("docs"))
    return agent.graded(state.join(asked, "query_id"), ExtractiveLlm(), Agent(min_relevant=20))


@query(_GRADED + " SELECT query_id, id FROM g WHERE len(list_intersect(want, have)) > 0")
def relevant_documents(spark, sf_dir):
    return _graded(spark, sf_dir).select("query_id", F.explode("relevant").alias("d")).select("query_id", F.col("d.url").cast("long").alias("id"))


@query(_GRADED + " SELECT query_id, count(*) FILTER (WHERE len(list_intersect(want, have)) > 0) >= 20 AS sufficient FROM g GROUP BY query_id")
def relevance_routes(spark, sf_dir):
    return _graded(spark, sf_dir).select("query_id", "sufficient")


@query("SELECT doc_id FROM documents WHERE source = 'src7' AND lang = 'en'")
def payload_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumns({"domain": F.col("source"), "source_type": F.col("lang")})
    return rows.where(retrieval.payload_filter("src7", "en")).select("doc_id")


@query()
def question_answers(spark, sf_dir):
    """Benchmark questions answered over chunks of pages, with the rewrite loop."""
    points, postings = jobs.ingest(_records(spark, sf_dir))
    asked = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    points = frontier.cut(points)
    postings = frontier.cut(postings)
    return jobs.ask(points, postings, asked).select("query_id", "language", "intent", "rewrite_count", "answer", "hallucination_grade", "answer_grade", F.size("sources").alias("n_sources"))
