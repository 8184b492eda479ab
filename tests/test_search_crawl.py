import random
from collections import deque
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from weftline.config import Agent, Assets, Config, Scope, merged, required
from weftline.operators import agent, assets, encoding, frontier, retrieval
from weftline.plans import jobs
from weftline.sources import store
from weftline.sources.models import ExtractiveLlm
from weftline.sources.transport import TooManyRedirects, archived, fetched, named_error


def test_config():
    c = merged(Config(), {"crawl": {"max_pages": 7, "odd": 1}, "scope": {"external_sites_whitelist": ["a"]}, "none": {}})
    assert c.crawl.max_pages == 7 and c.crawl.max_depth == 3 and c.scope.external_sites_whitelist == ("a",) and Config().crawl.max_pages == 500
    with pytest.raises(ValueError, match="b, c"):
        required({"a": 1, "b": ""}, ["a", "b", "c"])


def test_sparse_terms(spark):
    rows = encoding.sparse_terms(spark.createDataFrame([(1, "A a b"), (2, ""), (3, None)], "doc_id long, text string")).collect()
    by = {i: sorted(r.weight for r in rows if r.doc_id == i) for i in (1, 2, 3)}
    assert by == {1: [0.5, 1.0], 2: [0.0], 3: [0.0]} and {r.token_id for r in rows if r.doc_id != 1} == {0}


def test_dense_and_plan(spark):
    model = encoding.dense_udf()
    frame = spark.createDataFrame([(0, "red house"), (1, "blue sky"), (2, None)], "id long, text string").withColumn("dense", model("text"))
    q = spark.createDataFrame([(9, "the red house")], "query_id long, q string").withColumn("dense", model("q")).drop("q")
    got = retrieval.dense_topk(frame, q, 2).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.rank)][0] == 0 and len(got) == 2
    tiled = retrieval.dense_topk(frame, q, 2, tile=(1, 1)).collect()
    assert sorted(map(str, tiled)) == sorted(map(str, got))
    assert "WindowGroupLimit" in retrieval.dense_topk(frame, q, 2)._jdf.queryExecution().executedPlan().toString()


def test_sparse_tiles_equal_a_join(spark):
    rng = random.Random(5)
    postings = [(i, t, rng.choice([0.25, 0.5, 1.0])) for i in range(60) for t in rng.sample(range(30), 8)]
    terms = [(q, t, rng.choice([0.5, 1.0])) for q in range(7) for t in rng.sample(range(40), 5)] + [(9, 77, 1.0)]
    p = spark.createDataFrame(postings, "id long, token_id int, weight double")
    t = spark.createDataFrame(terms, "query_id long, token_id int, weight double")
    want = {}
    for q in range(7):
        score = {}
        for i, k, w in postings:
            for qq, kk, v in terms:
                if q == qq and k == kk:
                    score[i] = score.get(i, 0) + w * v
        want[q] = [(i, s) for i, s in sorted(score.items(), key=lambda x: (-x[1], x[0]))][:10]
    for tiles in (None, (1, 1), (5, 3)):
        got = {}
        for r in retrieval.sparse_topk(p, t, 10, tiles=tiles).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.score))
        assert got == want
    assert retrieval.sparse_topk(p.where("false"), t).count() == retrieval.sparse_topk(p, t.where("false")).count() == 0


def shuffled(spark):
    """Rows that stages have written for a shuffle so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_searches_copy_neither_side(spark):
    rng = random.Random(6)
    p = spark.createDataFrame([(i, t, rng.random()) for i in range(300) for t in rng.sample(range(40), 10)], "id long, token_id int, weight double").coalesce(1)
    t = spark.createDataFrame([(q, t, rng.random()) for q in range(200) for t in rng.sample(range(40), 3)], "query_id long, token_id int, weight double").coalesce(1)
    before = shuffled(spark)
    found = retrieval.sparse_topk(p, t, 2, tiles=(4, 40)).count()
    assert found == 400 and shuffled(spark) - before < 300 * 10 + 200 * 3
    v = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(400)], "id long, dense array<double>").coalesce(1)
    before = shuffled(spark)
    found = retrieval.dense_topk(v, v.select(F.col("id").alias("query_id"), "dense"), 1, tile=(400, 20)).count()
    assert found == 400 and shuffled(spark) - before < 2 * 400


def test_equal_scores_weights_of_zero_and_split_keys(spark):
    copies = [(i, t, 0.1 * t) for i in range(500, 0, -1) for t in (1, 2, 3, 7)]
    p = spark.createDataFrame([*copies, (0, 0, 0.0), (501, 1, 0.5), (600, 9, 1.0), (501, 1, 0.25)], "id long, token_id int, weight double").repartition(7)
    t = spark.createDataFrame([(1, 1, 0.5), (1, 3, 0.7), (2, 0, 0.0), (3, 4, 1.0), (2, 9, -1.0)], "query_id long, token_id int, weight double")
    for block in ((250_000, 150_000), (5, 1)):
        got = [(r.query_id, r.id, r.score) for r in retrieval.sparse_topk(p, t, 3, block=block).orderBy("query_id", "rank").collect()]
        assert got == [(1, 501, 0.375), (1, 1, 0.26), (1, 2, 0.26), (2, 0, 0.0), (2, 600, -1.0)]


def ranked(spark, *ids):
    return spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids)], "query_id long, id long, rank int")


def test_rank_fusion_and_floor(spark):
    both = retrieval.rrf(ranked(spark, 10, 11, 12), ranked(spark, 20, 11), k=2)
    assert {r.id: r.score for r in both.collect()} == {10: 0.5, 11: 0.666666667, 20: 0.5, 12: 0.25}
    assert {r.id for r in retrieval.floored(both).collect()} == {10, 11, 20}
    assert retrieval.floored(retrieval.rrf(ranked(spark, 10), ranked(spark, 10), k=60)).count() == 0


def test_rerank(spark):
    rows = [(1, "red house", "a red house", 1), (1, "red house", "sky", 2), (1, "red house", "the house", 3), (2, "lone", "lone", 1)]
    got = retrieval.reranked(spark.createDataFrame(rows, "query_id long, question string, text string, rank int"), 2).collect()
    assert [(r.query_id, r.rank, r.final_rank) for r in sorted(got, key=lambda r: (r.query_id, r.final_rank))] == [(1, 1, 1), (1, 3, 2), (2, 1, 1)]
    assert [r.rerank_score for r in got if r.query_id == 2] == [None]


def test_payload_filter():
    assert retrieval.payload_filter() is None and "domain" in str(retrieval.payload_filter("a", "meta"))


def test_schedule(spark):
    rng = random.Random(2)
    rows = [(i, f"h{rng.randrange(3)}", rng.uniform(0, 20)) for i in range(60)]
    got = {r.seq: r.starts for r in frontier.schedule(spark.createDataFrame(rows, "seq long, host string, arrives double"), 1.5).collect()}
    free = {}
    for i, h, a in rows:
        at = max(a, free.get(h, -1e9) + 1.5)
        free[h] = at
        assert got[i] == pytest.approx(at)


def by_queue(links, seeds, depth, pages, per_host):
    """A plain first-in-first-out crawl; hosts are the first letter."""
    queue, seen, counts, out, skipped = deque(), set(), {}, [], 0

    def push(u, d):
        nonlocal skipped
        if u in seen:
            return
        if counts.get(u[0], 0) >= per_host:
            skipped += 1
            return
        counts[u[0]] = counts.get(u[0], 0) + 1
        queue.append((u, d))

    for u in seeds:
        push(u, 0)
    while queue and len(out) < pages:
        u, d = queue.popleft()
        if u in seen:
            continue
        seen.add(u)
        out.append((u, d))
        if d < depth:
            for v in links.get(u, []):
                push(v, d + 1)
    return out, sum(counts.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_crawl_equals_a_queue(spark, seed):
    rng = random.Random(seed)
    names = [f"{h}{i}" for h in "abc" for i in range(6)]
    links = {u: [rng.choice(names) for _ in range(rng.randrange(5))] for u in names}
    url = lambda u: f"http://{u[0]}.e.com/{u}"
    table = spark.createDataFrame([(url(u), i, url(v)) for u, vs in links.items() for i, v in enumerate(vs)], "src string, pos int, url string").cache()
    expand = lambda rows: rows.select("pop_order", "url").withColumnRenamed("url", "src").join(table, "src").select("pop_order", "pos", "url", F.lit("x").alias("anchor_text"))
    config = Config()
    limits = {"max_depth": 3, "max_pages": rng.randrange(4, 16), "max_pages_per_domain": rng.randrange(3, 9)}
    config = replace(config, crawl=replace(config.crawl, **limits))
    pops, enqueued, counters = frontier.crawl(spark, [url("a0"), url("b0")], expand, config)
    want, n = by_queue(links, ["a0", "b0"], 3, limits["max_pages"], limits["max_pages_per_domain"])
    assert [(r.url, r.depth) for r in pops.orderBy("pop_order").collect()] == [(url(u), d) for u, d in want]
    assert counters["popped"] == len(want)
    if limits["max_pages"] > len(want):
        assert counters["enqueued"] == n


def test_scope_and_reasons(spark):
    scope = Scope(internal_only=False, external_sites_whitelist=("ok.org",), url_patterns_include=(r"/p",))
    urls = ["", "mailto:a@b", "ftp://e.com/p", "http://bad.net/p", "http://x.ok.org/p", "http://sub.e.com/p/a.css", "http://e.com/q", "http://e.com/p"]
    rows = frontier.addressed(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i long, url string"))
    got = [r.r for r in rows.select("i", frontier.reject_reason(scope, ["e.com"]).alias("r")).orderBy("i").collect()]
    assert got == ["blank", "not_fetched", "scheme", "scope", None, "excluded", "not_included", None]


def test_asset_gates(spark):
    rows = [
        (0, "image", "http://e/a.png", "e.com", False, None, None, 200, "image/png", bytearray(9000), None, None),
        (1, "image", "http://e/a.png", "e.com", True, "image/png", 5119, 200, "image/png", bytearray(9000), None, None),
        (2, "image", "http://e/a.png", "e.com", True, "image/png", 20 * 2**20 + 1, 200, "image/png", bytearray(9000), None, None),
        (3, "image", "http://e/a.txt", "e.com", True, "text/html; x", 0, 200, "text/html", bytearray(9000), None, None),
        (4, "image", "http://e/logo.png", "e.com", True, "text/html", 0, 200, "image/webp", bytearray(b"z" * 5120), None, None),
        (5, "image", "http://e/b.png", "e.com", True, "image/png", 5120, 404, None, None, None, None),
        (6, "image", "http://e/c.png", "e.com", True, "image/png", 0, 200, "image/png", bytearray(b"z" * 5120), 800, 600),
        (7, "pdf", "http://e/d.pdf", "e.com", False, None, None, 200, "application/pdf", bytearray(b"%PDF /Count 4"), None, None),
        (8, "pdf", "http://e/d.pdf", "e.com", True, None, 0, 200, "application/pdf", bytearray(b"nope"), None, None),
    ]
    schema = "seq long, kind string, url string, domain string, head_ok boolean, head_type string, head_length long, status_code int, content_type string, body binary, width int, height int"
    got = {r.seq: r for r in assets.downloaded(spark.createDataFrame(rows, schema), Assets()).collect()}
    assert got[0].error == "HEAD request failed" and got[1].skip_reason == "Too small (5119B < 5120B)" and got[2].skip_reason == "Too large (>20MB)"
    assert got[3].skip_reason == "Not an image: text/html" and got[5].error == "HTTP 404" and got[8].skip_reason.startswith("Not a valid PDF")
    assert got[4].success and got[4].extension == ".webp" and got[4].image_type == "icon_or_logo"
    assert got[6].success and got[6].duplicate and got[6].file_path == got[4].file_path and got[6].skip_reason == "Duplicate (hash match)"
    assert got[7].success and got[7].pdf_page_count == 4 and got[7].file_path.startswith("pdfs/e.com/")


def test_pdf_images(spark):
    rows = [("a.pdf", 1, 0, 199, 300, 5000, "png"), ("a.pdf", 1, 1, 200, 200, 2047, "png"), ("a.pdf", 2, 0, 200, 200, 2048, "png")]
    kept = assets.filtered_pdf_images(spark.createDataFrame(rows, "pdf string, page int, img_index int, width int, height int, size_bytes long, format string"))
    assert [r.file for r in kept.collect()] == ["a_p002_img00.png"] and assets.pdf_image_summary(kept).first().images == 1


class Broken:
    def open(self, config):
        self.tries = 0

    def get(self, url):
        self.tries += 1
        if "slow" in url:
            raise TimeoutError()
        if "loop" in url:
            raise TooManyRedirects()
        return {"status_code": 503 if self.tries < 3 and "busy" in url else 404 if "gone" in url else 200, "content_type": "Application/PDF" if "pdf" in url else "text/odd", "body": b"x"}

    def close(self):
        pass


def test_fetch_errors(spark):
    frame = spark.createDataFrame([(f"http://e/{x}",) for x in ("slow", "loop", "busy", "gone", "pdf")], "url string").coalesce(1)
    got = {r.url.rsplit("/", 1)[1]: r for r in fetched(frame, Broken(), pause=lambda s: None).collect()}
    assert [got[k].error for k in ("slow", "loop", "gone", "pdf")] == ["Timeout", "TooManyRedirects", "HTTP 404", None]
    assert got["busy"].success and got["pdf"].kind == "pdf" and got["busy"].kind == "html"
    assert named_error(ConnectionError("x" * 200)) == "ConnectionError: " + "x" * 100 and named_error(KeyError("a")) == "UnexpectedError: 'a'"


PAGES = [
    ("http://e.com/", "<title>Home page of the scheme portal</title><h1>Home</h1><p>" + "Welcome to the portal of the housing scheme. " * 4 + "<a href='/cost'>c</a><a href='/gone'>g</a>"),
    ("http://e.com/cost", "<title>Cost of the scheme and who pays it</title><h1>Cost</h1><p>" + "The premium costs nothing for families on the list. " * 4 + "<a href='/'>h</a>"),
]


def test_crawl_ingest_ask(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    records, errors, counters = jobs.crawl_archive(spark, pages, ["http://e.com/"])
    assert {r.url for r in records.collect()} == {u for u, _ in PAGES} and counters["popped"] == 3
    assert [(r.url, r.error) for r in errors.collect()] == [("http://e.com/gone", "HTTP 404")]
    store.write_pages(records, str(tmp_path / "json"), as_json=True)
    (tmp_path / "json" / "bad.json").write_text("{nope")
    good, bad = store.read_pages_json(spark, str(tmp_path / "json"))
    assert good.count() == 2 and bad.count() == 1
    index = store.crawl_index(records, errors)
    summary = store.crawl_summary(index).first()
    assert (summary.pages, summary.errors, summary.domains) == (2, 1, {"e.com": 2})
    assert store.not_crawled(spark.createDataFrame([("http://e.com/",), ("http://e.com/new",)], "url string"), index).count() == 1
    made = [jobs.ingest_into(spark, records, str(tmp_path / "c")) for _ in range(2)]
    n = made[0]["points"]
    assert [m["batch"] for m in made] == [0, 1] and n == store.collection_info(spark, str(tmp_path / "c/points")).first().points > 0
    assert jobs.ingest_into(spark, records.where("false"), str(tmp_path / "none"))["points"] == 0 and not (tmp_path / "none").exists()
    points, postings = jobs.stored(spark, str(tmp_path / "c"))
    assert points.count() == n == postings.select("id").distinct().count()
    out = jobs.chat_request(spark, {"question": "what does the premium cost"}, points, postings)
    assert "premium" in out["answer"] and out["sources"][0]["url"] == "http://e.com/cost"
    more = jobs.chat_request(spark, {"question": "and who pays", "history": out["history"]}, points, postings)
    assert [m["role"] for m in more["history"]] == ["user", "assistant"] * 2
    with pytest.raises(ValueError):
        jobs.chat_request(spark, {"question": "abc"}, points, postings)
    with pytest.raises(ValueError):
        jobs.ingest_request(spark, {"url": "ftp://x"}, pages)


def test_archive_matches_normalised(spark):
    pages = spark.createDataFrame([("http://e.com/a/", "x")], "url string, html string")
    got = archived(spark.createDataFrame([("http://E.com/a#f",), ("http://e.com/b",)], "url string"), pages).collect()
    assert sorted((r.status_code, r.success) for r in got) == [(200, True), (404, False)]


class Never(ExtractiveLlm):
    def relevant(self, question, text):
        return "no"


def found(rows):
    return rows.select("query_id", F.lit(1).alias("rank"), F.lit("some text").alias("text"), F.lit("http://e.com").alias("url"), F.lit("t").alias("title"), F.lit("s").alias("section"), F.lit(0.5).alias("score"))


def test_loop_is_bounded(spark):
    q = spark.createDataFrame([(1, "some question")], "query_id long, question string")
    calls = []
    row = agent.answer_questions(q, lambda rows: calls.append(1) or found(rows), Never()).first()
    assert (len(calls), row.rewrite_count, len(row.relevant)) == (3, 2, 0) and row.answer and len(row.history) == 2
    none = agent.answer_questions(q, lambda rows: found(rows).where("false"), config=Agent(max_rewrites=0)).first()
    assert none.answer == agent.NO_ANSWER and none.answer_grade in ("answers", "does_not_answer") and none.sources == []


def test_min_relevant(spark):
    q = spark.createDataFrame([(1, "some text")], "query_id long, question string")
    for least, rewrites in ((1, 0), (2, 2)):
        assert agent.answer_questions(q, found, config=Agent(min_relevant=least)).first().rewrite_count == rewrites


def test_memory(spark):
    h = [("user", str(i)) for i in range(20)]
    frame = spark.createDataFrame([(h, "q", "a"), (None, "q", "a")], f"h array<{agent.MESSAGE}>, q string, a string")
    got = [r[0] for r in frame.select(agent.memory(F.col("h"), F.col("q"), F.col("a"))).collect()]
    assert len(got[0]) == 20 and got[0][0].content == "2" and got[0][-1].content == "a" and len(got[1]) == 2


def test_citations_and_context(spark):
    docs = [(1, "t1", "https://www.e.com/a/", "", "s", None), (2, "t2", "https://e.com/a", "T", None, 0.2)]
    frame = spark.createDataFrame([(docs,)], f"d array<{agent.DOC}>")
    row = frame.select(agent._deduped(F.col("d")).alias("u"), agent.context_block(F.col("d")).alias("c"), agent.citations(F.col("d")).alias("s")).first()
    assert len(row.u) == 1 and row.s[1].score == 0.2 and row.s[0].score == 0.0
    assert row.c == "[1] Source: https://www.e.com/a/\nURL: https://www.e.com/a/\nSection: s\n\nt1\n\n---\n\n[2] Source: T\nURL: https://e.com/a\nSection: \n\nt2"


def test_stream(spark, tmp_path):
    from weftline.streaming import ingestion

    pages = spark.createDataFrame(PAGES, "url string, html string")
    records, _, _ = jobs.crawl_archive(spark, pages, ["http://e.com/"])
    records.write.parquet(str(tmp_path / "in"))
    ingestion.start(ingestion.chunk_stream(ingestion.page_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert store.collection(spark, str(tmp_path / "out")).count() >= 2


def test_hybrid_searches_documents_without_vectors(spark, tmp_path):
    from weftline.plans import registry

    docs = [(0, "red house"), (1, "blue sky"), (50, "green tree"), (100, "red green house"), (777, "green tree"), (778, None)]
    vectors = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (150, [0.0, 1.0])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in registry.rrf_hybrid(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == {
        0: [(1, 0, 1.0), (2, 1, 0.333333333), (3, 100, 0.333333333), (4, 150, 0.25)],
        50: [(1, 50, 0.5), (2, 777, 0.333333333), (3, 100, 0.25)],
        100: [(1, 100, 0.5), (2, 0, 0.333333333), (3, 50, 0.25), (4, 777, 0.2)],
        150: [(1, 1, 0.5), (2, 150, 0.333333333), (3, 0, 0.25)],
    }
    assert {(r.query_id, r.id) for r in registry.score_floor(spark, str(tmp_path)).collect()} == {(q, i) for q, x in got.items() for _, i, s in x if s >= 0.3}


def test_registry_is_importable():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
