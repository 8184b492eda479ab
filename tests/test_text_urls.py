from urllib.parse import urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import media as M
from weftline.functions import text as T
from weftline.functions import urls as U

ALPHABET = st.sampled_from(list("aZ9#.!?।-_*=[]() \t\n\r\x0b\x85\xa0 é") + ["Click here", "View all", "Read more about x", "Read more", "Subscribe to", "Next page", "Published Date: 01-02-2020", "## "])


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    return [r[0] for r in spark.createDataFrame(list(zip(*values)), names).select(expr).collect()]


# (text, cleaned), by hand
CLEANED = [
    # runs of empty lines, and lines of white space alone, go
    ("one\n\n\n\ntwo", "one\ntwo"),
    ("one\n \t \n\x0b\ntwo", "one\ntwo"),
    # headings without a word
    ("# \ntext\n######\nmore", "text\nmore"),
    ("## ***\ntext\n## a*", "text\n## a*"),
    ("####### seven", "####### seven"),
    # runs of blanks become one, ends of lines lose theirs
    ("a \t  b   \n\tc\t", "a b\n c"),
    ("a\x0bb\x85c", "a\nb\nc"),
    # rules
    ("a\n---\nb\n=====\nc\n***\n___\n--\nd", "a\nb\nc\n--\nd"),
    # links without a label
    ("see [ ](http://x) and [](y)z [t](u)", "see  and z [t](u)"),
    # phrases of navigation, as whole lines only
    ("Click here\nClick here now\nView all \nRead more\nऔर पढ़े\nSubscribe to\nx", "Click here now\nx"),
    ("Read more about schemes\nRead more about", "Read more about"),
    ("1 2 Next page 3 4\nLast » end\nNext › x\nCurrent page 7", "1 2"),
    ("Published Date: 1-02-2020\nPublished Date: 01-2-2020\n  Published Date:31-12-1999 ", "Published Date: 01-2-2020"),
    # lines of hash tags
    ("#one #two_3\n#one two\n#é", "#one two"),
    ("", ""),
    (" \n\t\r\n", ""),
    ("plain text.", "plain text."),
]


def test_markdown_cleanup(spark):
    assert one(spark, T.clean_markdown(F.col("c0")), [x for x, _ in CLEANED]) == [x for _, x in CLEANED]


@settings(max_examples=2, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=60, max_size=120))
def test_cleaned_text_holds_no_empty_lines_and_no_new_words(spark, texts):
    for before, after in zip(texts, one(spark, T.clean_markdown(F.col("c0")), texts)):
        lines = after.split("\n")
        assert after == after.strip() and (after == "" or all(x.strip() for x in lines))
        assert len(after) <= len(before) and not set(after) - set(before) - {"\n", " "}


@settings(max_examples=2, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=60, max_size=120))
def test_sentences_keep_every_character_but_white_space(spark, texts):
    for before, found in zip(texts, one(spark, T.sentences(F.col("c0")), texts)):
        assert all(x and x == x.strip() for x in found)
        assert "".join("".join(found).split()) == "".join(before.split())
        assert all(x[-1] in ".!?।" for x in found[:-1])


def test_sentence_goldens(spark):
    assert one(spark, T.sentences(F.col("c0")), ["एक। दो। e.g. x", "", "a.b c? d"]) == [["एक।", "दो।", "e.g.", "x"], [], ["a.b c?", "d"]]


def test_language(spark):
    assert one(spark, T.language_of(F.col("c0")), ["कअ ab", "कअग ab", "", "abc"]) == ["mixed", "hi", "en", "en"]


@pytest.mark.parametrize("url,want", [
    ("HTTP://User@Example.com:80/a/?b=2&a=1#x", "http://example.com/a?a=1&b=2"),
    ("https://e.com:443", "https://e.com/"),
    ("https://e.com:8443/a;p=1", "https://e.com:8443/a"),
    ("http://e.com:99999/x", "http://e.com:99999/x"),
    ("http://e.com/?q=&z=a b", "http://e.com/?q=&z=a+b"),
])
def test_normalized(spark, url, want):
    assert U.normalized(url) == want
    assert one(spark, U.normalize_url("c0"), [url, None, url]) == [want, None, want]


def test_hosts_and_roots(spark):
    hosts = ["sub.example.gov.in", "a.b.com", "localhost", "x.co.uk", "co.uk"]
    assert one(spark, U.root_domain(F.col("c0")), hosts) == ["example.gov.in", "b.com", "localhost", "x.co.uk", "co.uk"]
    urls = ["http://A.b:80/x?y", "https://u:p@h.com#z", "nothing"]
    assert one(spark, U.host(F.col("c0")), urls) == [(urlsplit(u).hostname or "") for u in urls]
    assert one(spark, U.citation_key(F.col("c0")), ["https://www.scheme.example.in/about", "https://scheme.example.in/about//"]) == ["https://scheme.example.in/about"] * 2


def test_buckets_and_hashes(spark):
    import hashlib

    words = ["the", "", "योजना", "é", "x" * 50]
    assert one(spark, U.token_bucket(F.col("c0")), words) == [int(hashlib.md5(w.encode()).hexdigest(), 16) % 100_000 for w in words]
    assert one(spark, U.url_hash(F.col("c0")), words) == [hashlib.md5(w.encode()).hexdigest()[:12] for w in words]


def test_image_kinds(spark):
    sizes = [(64, 1000), (65, 65), (200, 200), (201, 201), (600, 200), (601, 200), (399, 1000), (400, 1000), (800, 600)]
    assert one(spark, M.kind_by_size(F.col("c0"), F.col("c1")), *map(list, zip(*sizes))) == ["icon", "icon", "icon", "image_unknown", "image_unknown", "banner", "poster_vertical", "image_unknown", "photo_or_poster"]
    assert one(spark, M.kind_by_url(F.col("c0")), ["http://x/banner/icon.png", "http://x/HERO.jpg", "http://x/a"]) == ["icon_or_logo", "banner", "image_unknown"]
    assert one(spark, M.extension(F.col("c0"), F.col("c1")), ["image/png", "x", "x", "x"], ["http://a/b.gif", "http://a/b.GIF?x=1", "http://a/b", "http://a/.hidden"]) == [".png", ".gif", ".jpg", ".jpg"]


def test_pdf_pages(spark):
    pdfs = [bytearray(b"%PDF /Type /Page\n x /Type/Page\n /Count 9"), bytearray(b"/Count 3 .. /Count 7"), bytearray(b"\xff\xfe")]
    assert one(spark, M.pdf_pages(F.col("c0")), pdfs) == [2, 7, 0]
