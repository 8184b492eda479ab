from pyspark.sql import functions as F

from weftline.config import Extraction
from weftline.operators import chunking, parsing
from weftline.sources.html import markdown, parse, tree

HTML = """<!DOCTYPE html><html lang="en"><head><title> A &amp; B </title><meta name="description" content="first"><meta name="description" content="About  it">
<meta property="og:type" content="article"><link rel="canonical" href="http://e.com/c"><script type="application/ld+json">{"@type": "Org"}</script>
<script type="application/ld+json">{bad</script><script>var t="</p>";</script></head><body><div class="topbar">noise</div><ol class="breadcrumb-list"><li>crumb</li></ol>
<a href="#main">Skip to content</a><div style="display: none">hidden</div><h1>Schemes</h1><p>Text with <b>bold</b> and <a href="/x">link</a>.<br>next
<h2 id="h">Housing</h2><div>Some longer context text around here<figure><img data-src="/i.png" alt="an &amp;amp; alt"><figcaption>Cap</figcaption></figure></div>
<h3>Eligibility</h3><ul><li>one<li>two</ul><h2>Other</h2><table><caption>Fees</caption><thead><tr><th>Name<th>Cost</tr></thead><tr><td>a<td>1<tr><td> <td> </tr><tr><td>b|c<td>2</table>
<a href="/doc.PDF">Doc</a><a href="/pdf/x" rel="nofollow me">P</a><a href="http://sub.e.com/y">sub</a><a href="http://other.org/">out</a><a href="/x">again</a><a href="mailto:a@b">m</a>
<!-- comment --><span></span><p><img src="data:abc"></p></body></html>"""


def page():
    return parse(HTML, "http://e.com/a/b")


def test_metadata_and_structure():
    p = page()
    assert (p["title"], p["meta_description"], p["page_type"], p["canonical_url"], p["language"]) == ("A & B", "About  it", "article", "http://e.com/c", "en")
    assert [(h["level"], h["text"]) for h in p["headings"]] == [(1, "Schemes"), (2, "Housing"), (3, "Eligibility"), (2, "Other")]
    assert p["schema_org"] == ['{"@type": "Org"}']
    (image,) = p["images"]
    assert (image["url"], image["alt"], image["caption"], image["nearest_heading"]) == ("http://e.com/i.png", "an & alt", "Cap", "Housing")
    assert image["context_text"].startswith("Some longer context")
    assert [x["url"] for x in p["pdfs"]] == ["http://e.com/doc.PDF", "http://e.com/pdf/x"]
    assert [x["url"] for x in p["links"]] == ["http://e.com/x", "http://e.com/pdf/x", "http://sub.e.com/y", "http://other.org/"]
    assert p["tables"] == [{"caption": "Fees", "headers": ["Name", "Cost"], "rows": [["a", "1"], ["b|c", "2"]]}]


def test_markdown_golden():
    text = page()["markdown"]
    for gone in ("noise", "crumb", "hidden", "Skip", "comment", "var t"):
        assert gone not in text
    assert "# Schemes" in text and "**bold** and link." in text and "\\\nnext" in text and "- one\n- two" in text and "| Name | Cost |\n| --- | --- |\n| a | 1 |" in text
    assert markdown(tree("<ol><li>a<ul><li>b</ul><li>c</ol>")).strip() == "1. a\n   - b\n2. c"
    assert markdown(tree("<pre>x  y\n z</pre>")).strip() == "```\nx  y\n z\n```"


def test_selectors():
    config = Extraction(noise_selectors=("[class*='social']", "#cookie", "nav.pager", ".a.b", "???"))
    html = "<div class='my-social-x'>1</div><div id='cookie'>2</div><nav class='pager'>3</nav><div class='pager'>4</div><p class='b c a'>5</p><nav>6</nav>"
    assert parse(html, "http://e.com", config)["markdown"].split() == ["4", "6"]


def test_parse_pages_native_parts(spark):
    frame = spark.createDataFrame([(1, "http://e.com/a/b", HTML), (2, "http://e.com/z", "<p>short"), (3, "http://e.com/n", None)], "page_id long, url string, html string")
    parsed = parsing.parse_pages(frame)
    plan = parsed.where("title <> ''").select(F.explode("internal_links"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    rows = {r.page_id: r for r in parsed.collect()}
    assert rows[1].heading_hierarchy == ["Schemes", "Schemes → Housing", "Schemes → Housing → Eligibility", "Schemes → Other"]
    assert [x.url for x in rows[1].internal_links] == ["http://e.com/x", "http://e.com/pdf/x", "http://sub.e.com/y"]
    assert [x.url for x in rows[1].external_links] == ["http://other.org/"]
    assert rows[1].tables[0].markdown == "| Name | Cost |\n| --- | --- |\n| a | 1 |\n| b|c | 2 |" and rows[1].tables[0].row_count == 2
    assert rows[2].body_text == "short" and rows[2].extraction_warnings[0].startswith("Short body text (5 chars)")


def test_heading_paths_follow_a_stack(spark):
    import random

    rng, outlines = random.Random(1), []
    for _ in range(200):
        outlines.append([(rng.randint(1, 6), f"h{k}", "") for k in range(rng.randint(0, 9))])
    got = spark.createDataFrame([(o,) for o in outlines], "h array<struct<level:int,text:string,id:string>>").select(parsing.heading_paths(F.col("h")).alias("p")).collect()
    for o, r in zip(outlines, got):
        stack, want = [], []
        for level, text, _ in o:
            stack = [x for x in stack if x[0] < level] if all(a[0] < b[0] for a, b in zip(stack, stack[1:])) else stack
            stack.append((level, text))
            want.append(" → ".join(t for _, t in stack))
        assert r.p == want


def test_pack_boundaries():
    s = ["a" * 499 + ".", "b" * 498 + "."]  # 501 + 500 with separators
    assert len(chunking.pack(s)) == 2 and chunking.pack(["a" * 499 + ".", "b" * 497 + "."]) == ["a" * 499 + ". " + "b" * 497 + "."]
    s[1] = "b" * 499 + "."
    first, second = chunking.pack(s)
    assert first == s[0] and second == s[0][-150:] + " " + s[1]
    assert chunking.pack(s, compat=True)[1] == s[0][-150] + " " + s[1]
    long = "c" * 1001
    assert chunking.pack([long, "d" * 60]) == [long, long[-150:] + " " + "d" * 60]
    assert chunking.pack(["x" * 49]) == [] and chunking.pack(["x" * 50]) == ["x" * 50]


def test_chunk_pages(spark):
    body = "Intro sentence that is long enough to be kept as a chunk of its own, surely.\n# Cost\nThe total cost is given here in a sentence that is long enough to be kept as well."
    table = {"caption": "Fees", "headers": ["a"], "row_count": 1, "markdown": "| a |\n| --- |\n| " + "v" * 50 + " |"}
    rec = {"doc_id": "page_1", "url": "http://e.com/", "title": "Title that makes the summary long enough", "domain": "e.com", "depth": 0, "heading_hierarchy": ["A → Total Cost"], "meta_description": "about", "body_text": body, "tables": [table]}
    empty = rec | {"doc_id": "page_2", "body_text": "x" * 99}
    schema = "doc_id string, url string, title string, domain string, depth int, heading_hierarchy array<string>, meta_description string, body_text string, tables array<struct<caption:string,headers:array<string>,row_count:int,markdown:string>>"
    rows = sorted(chunking.chunk_pages(spark.createDataFrame([rec, empty], schema)).collect(), key=lambda r: r.chunk_index)
    assert [r.source_type for r in rows] == ["meta", "webpage", "webpage", "table"] and {r.total_chunks for r in rows} == {4}
    assert rows[0].text == "Page Title: Title that makes the summary long enough\nSummary: about" and rows[1].section == ""
    assert rows[2].section == "A → Total Cost" and rows[2].text.startswith("[Section: A → Total Cost]\n\nThe total")
    assert rows[3].text.startswith("Table: Fees\n\n| a |") and rows[3].section == "Table: Fees"


def test_pages_are_parsed_and_chunked_in_slices(spark):
    import pyarrow as pa

    from weftline.functions.slices import sliced

    texts = ["x" * n for n in (10, 10, 50, 200, 1, 1, 1, 1)] + [None, "é" * 30]
    got = list(sliced([pa.array(texts), pa.array([], pa.string())], rows=3, size=100))
    assert [t for (s,) in got for t in s] == texts
    assert [len(s) for (s,) in got] == [3, 1, 3, 3] and all(len(s) == 1 or sum(len((t or "").encode()) for t in s) <= 100 for (s,) in got)
    frame = spark.createDataFrame([(i, f"http://e.com/{i}", HTML.replace("Schemes", f"Schemes {i}")) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    parsed = parsing.parse_pages(frame)
    chunks = chunking.chunk_pages(parsed.withColumns({"doc_id": F.col("page_id").cast("string"), "domain": F.lit(""), "depth": F.lit(0)}))
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == plan.count("], 251") == 2  # both take Arrow batches in and give slices out
    assert [r.heading_hierarchy[0] for r in parsed.orderBy("page_id").collect()] == [f"Schemes {i}" for i in range(300)]
