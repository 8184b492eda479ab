"""A crawl by a transport: pages, failures, images, PDFs, contents, indexes, a second crawl over the same output."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from weftline.config import Config, Crawl
from weftline.functions.media import size_of
from weftline.operators import assets
from weftline.plans import cli, jobs
from weftline.sources import store
from weftline.sources.transport import fetched

PNG = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", 900, 700) + b"z" * 6000
PDF = b"%PDF-1.4 /Type /Page\n /Type /Page\n"
SITE = {
    "/": ("text/html", ("<title>Start page of the portal</title><h1>Start</h1><p>" + "Some words about the portal. " * 9 + "<img src='/a.png' width='300' height='300'><img src='/b.png' width='300' height='300'><a href='/more'>more</a><a href='/direct'>d</a><a href='/paper.pdf'>paper</a><a href='/gone'>g</a></p>").encode()),
    "/more": ("text/html", ("<title>More of the portal here</title><h1>More</h1><p>" + "Other words about the portal. " * 9 + "<img src='/a.png' width='300' height='300'></p>").encode()),
    "/a.png": ("image/png", PNG),
    "/b.png": ("image/png", PNG),
    "/direct": ("application/pdf", PDF + b"direct"),
    "/paper.pdf": ("application/pdf", PDF),
}


class Site:
    def open(self, config):
        pass

    def get(self, url):
        kind, body = SITE.get(url.removeprefix("http://e.com"), ("text/html", None))
        return {"status_code": 200 if body is not None else 404, "content_type": kind, "body": body, "content_length": len(body or b"")}

    head = get

    def close(self):
        pass


def test_crawl_with_assets(spark, tmp_path):
    config = Config(crawl=Crawl(delay_between_requests_sec=0.0))
    out = str(tmp_path / "out")
    found = jobs.crawl_web(spark, ["http://e.com/"], Site(), config, output=out)
    records = {r.url: r for r in found.records.collect()}
    assert set(records) == {"http://e.com/", "http://e.com/more"}
    assert [(r.url, r.error) for r in found.errors.collect()] == [("http://e.com/gone", "HTTP 404")]
    first, second = records["http://e.com/"].images
    assert first.download.success and not first.download.skipped and (first.download.width, first.download.height, first.download.image_type) == (900, 700, "photo_or_poster")
    assert second.download.skip_reason == "Duplicate (hash match)" and second.download.file_path == first.download.file_path
    assert records["http://e.com/more"].images[0].download.file_path == first.download.file_path
    assert [(p.url, p.download.success, p.download.pdf_page_count) for p in records["http://e.com/"].pdfs] == [("http://e.com/paper.pdf", True, 2)]
    contents = spark.read.parquet(f"{out}/contents").collect()
    assert sorted(bytes(r.body) for r in contents) == sorted([PNG, PDF, PDF + b"direct"])
    assert {n: spark.read.parquet(f"{out}/{n}").count() for n in ("crawl_index", "image_index", "pdf_index")} == {"crawl_index": 3, "image_index": 1, "pdf_index": 2}
    again = jobs.crawl_web(spark, ["http://e.com/"], Site(), config, output=out)
    assert again.records.count() == 0 and again.counters["popped"] == 1


def test_workers_wait_between_starts_and_before_retries(spark):
    class Busy(Site):
        def open(self, config):
            self.now, self.waits, self.tries = 0.0, [], 0

        def get(self, url):
            self.tries += 1
            return {"status_code": 503, "content_type": "", "body": json.dumps(self.waits).encode()}

    busy = Busy()

    def pause(seconds):
        busy.waits.append(round(seconds, 3))

    rows = spark.createDataFrame([("http://e.com/1",), ("http://e.com/2",)], "url string")
    got = fetched(rows, busy, Crawl(delay_between_requests_sec=50.0, max_retries=3), pause=pause, clock=lambda: 0.0).collect()
    waits = [json.loads(bytes(r.body)) for r in sorted(got, key=lambda r: r.url)]
    assert waits[0] == [2.0, 4.0, 8.0] and waits[1] == [2.0, 4.0, 8.0, 50.0, 2.0, 4.0, 8.0]
    assert all(r.error == "HTTP 503" for r in got)


def test_image_heads():
    jpeg = b"\xff\xd8\xff\xe0\x00\x10" + b"j" * 14 + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"x"
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6)
    assert [size_of(x) for x in (PNG, b"GIF89a" + struct.pack("<HH", 7, 8), bmp, jpeg, b"", b"\xff\xd8\xff", b"text")] == [(900, 700), (7, 8), (5, 6), (40, 30), None, None, None]


def test_pdf_images_by_an_injected_decoder(spark):
    def decode(content):
        if content == b"bad":
            raise ValueError
        return [{"page": 1, "img_index": i, "width": 100 * (i + 1), "height": 300, "format": "png", "colorspace": "rgb", "size_bytes": 4000} for i in range(3)]

    pdfs = spark.createDataFrame([("/x/a.pdf", bytearray(b"ok")), ("/x/b.pdf", bytearray(b"bad"))], "path string, content binary")
    kept = assets.filtered_pdf_images(assets.pdf_images(pdfs, decode)).orderBy("file").collect()
    assert [r.file for r in kept] == ["a_p001_img01.png", "a_p001_img02.png"]


def test_batches_replace_and_may_be_written_again(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v int")
    assert store.upsert(rows(("a", 1), ("b", 1), ("b", 1)), path) == 0 and store.upsert(rows(("b", 2)), path) == 1
    assert sorted(map(tuple, store.collection(spark, path).collect())) == [("a", 1), ("b", 2)]
    store.upsert(rows(("b", 3), ("c", 3)), path, 1)
    assert sorted(map(tuple, store.collection(spark, path).collect())) == [("a", 1), ("b", 3), ("c", 3)]


def test_flags(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"seeds": ["http://s.com"], "crawl": {"max_pages": 9, "max_depth": 8}}))
    config, seeds, args = cli.settings(["--config", str(tmp_path / "c.json"), "--depth", "2", "--no-pdfs", "--allow-external"])
    assert (config.crawl.max_pages, config.crawl.max_depth, seeds) == (9, 2, ["http://s.com"]) and args.log_level == "INFO"
    assert config.assets.download_images and not config.assets.download_pdfs and not config.scope.internal_only
    assert cli.settings(["--url", "http://a", "--urls", "http://b"])[1] == ["http://a", "http://b"]
    with pytest.raises(ValueError):
        cli.settings([])


def test_dry_run(spark):
    got = cli.main(spark, Site(), ["--url", "http://e.com/", "--dry-run", "--delay", "0"])
    assert got.select("url").orderBy("pop_order").first().url == "http://e.com/" and got.where(F.col("depth") == 1).count() == 3
