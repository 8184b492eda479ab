"""Images and PDFs: download gates as ordered conditions, deduplication by content, records of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import Assets
from weftline.functions import media as M
from weftline.functions import text as T
from weftline.functions import urls as U

MB = 1024 * 1024


def mime(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def _verdict(error: Column | None = None, skip: Column | str = "") -> Column:
    return F.struct((F.lit(None) if error is None else error).cast("string").alias("error"), (F.lit(skip) if isinstance(skip, str) else skip).alias("skip"))


def image_gate(config: Assets = Assets()) -> tuple[Column, Column]:
    """A-1: (error, skip_reason) of a row with head_ok, head_type, head_length, url, status_code, body; the first test that holds."""
    least, most = config.min_image_size_bytes, config.max_image_size_mb
    kind, length, size = mime(F.col("head_type")), F.coalesce("head_length", F.lit(0)), F.coalesce(F.length("body"), F.lit(0))
    known = M.suffix(F.col("url")).isin(*config.image_extensions)
    step = (
        F.when(~F.coalesce("head_ok", F.lit(False)), _verdict(F.lit("HEAD request failed")))
        .when((length > 0) & (length < least), _verdict(skip=F.format_string(f"Too small (%dB < {least}B)", length)))
        .when(length > most * MB, _verdict(skip=f"Too large (>{most}MB)"))
        .when((kind != "") & ~F.startswith(kind, F.lit("image/")) & ~known, _verdict(skip=F.concat(F.lit("Not an image: "), kind)))
        .when(F.col("status_code") != 200, _verdict(F.format_string("HTTP %d", F.col("status_code"))))
        .when(size < least, _verdict(skip=F.format_string("Too small after download (%dB)", size)))
        .otherwise(_verdict())
    )
    return step["error"], step["skip"]


def pdf_gate(config: Assets = Assets()) -> tuple[Column, Column]:
    """(error, skip_reason); a failed HEAD does not stop a PDF."""
    most = config.max_pdf_size_mb
    length, size = F.coalesce("head_length", F.lit(0)), F.coalesce(F.length("body"), F.lit(0))
    large = _verdict(skip=f"Too large (>{most}MB)")
    step = (
        F.when(F.coalesce("head_ok", F.lit(False)) & (length > most * MB), large)
        .when(F.col("status_code") != 200, _verdict(F.format_string("HTTP %d", F.col("status_code"))))
        .when(~F.coalesce(F.startswith(F.col("body"), F.lit(b"%PDF")), F.lit(False)), _verdict(skip="Not a valid PDF (missing %PDF header)"))
        .when(size > most * MB, large)
        .otherwise(_verdict())
    )
    return step["error"], step["skip"]


def deduplicated(assets: DataFrame, content: str = "content_hash", seq: str = "seq", path: str = "file_path") -> DataFrame:
    """A-2: per content the first row by seq keeps its path; later ones point there and are marked as duplicates.

    One partial minimum per content and a join, so a content found everywhere is no single task's."""
    place = F.struct(F.col(seq).alias("seq"), F.col(path).alias("path"))
    first = assets.groupBy(F.col(content).alias("__c")).agg(F.min(place).alias("__first"))
    out = assets.join(first, F.col(content) == F.col("__c")).withColumn("duplicate", place > F.col("__first"))
    return out.withColumn(path, F.col("__first.path")).select(*assets.columns, "duplicate")


def downloaded(responses: DataFrame, config: Assets = Assets(), bodies: bool = False) -> DataFrame:
    """S12, S13, A-1 to A-7: asset records of responses (seq, kind, url, domain, head_ok, head_type, head_length,
    status_code, content_type, body, width, height); width and height are null where no decoder could read the image.

    Images and PDFs share one set of contents. Bodies stay out of the result, unless asked for."""
    image = F.col("kind") == "image"
    ie, isk = image_gate(config)
    pe, ps = pdf_gate(config)
    rows = responses.withColumn("error", F.when(image, ie).otherwise(pe)).withColumn("skip_reason", F.when(image, isk).otherwise(ps))
    ok = F.col("error").isNull() & (F.col("skip_reason") == "")
    rows = rows.withColumn("content_hash", F.when(ok, U.content_hash(F.col("body")))).withColumn("file_size_bytes", F.when(ok, F.length("body")).otherwise(0))
    rows = rows.withColumn("extension", F.when(image, M.extension(mime(F.coalesce("content_type", "head_type")), F.col("url"))).otherwise(".pdf"))
    folder = F.concat(F.when(image, "images/").otherwise("pdfs/"), F.coalesce(F.nullif(T.sanitized(F.col("domain"), 50), F.lit("")), F.lit("unknown")))
    rows = rows.withColumn("file_path", F.when(ok, F.concat_ws("/", folder, F.concat("content_hash", "extension"))))
    kind = F.when(F.col("width").isNotNull(), M.kind_by_size(F.col("width"), F.col("height"))).otherwise(M.kind_by_url(F.col("url")))
    rows = rows.withColumn("image_type", F.when(ok & image, kind).otherwise("")).withColumn("pdf_page_count", F.when(ok & ~image, M.pdf_pages(F.col("body"))).otherwise(0))
    rows = rows if bodies else rows.drop("body")
    good = deduplicated(rows.where(F.col("content_hash").isNotNull())).withColumn("skip_reason", F.when(F.col("duplicate"), "Duplicate (hash match)").otherwise(""))
    out = good.unionByName(rows.where(F.col("content_hash").isNull()).withColumn("duplicate", F.lit(False)))
    return out.withColumn("success", F.col("content_hash").isNotNull()).withColumn("skipped", F.col("skip_reason") != "")


def linked(parsed: DataFrame, order: str = "pop_order", config: Assets = Assets()) -> DataFrame:
    """(seq, kind, url, domain): the addresses of images and PDFs on parsed pages, each once, in the order of pages."""
    parts = []
    for kind, wanted in (("image", config.download_images), ("pdf", config.download_pdfs)):
        if wanted:
            place = F.struct(F.col(order).cast("long").alias("page"), F.lit(kind).alias("kind"), F.col("pos").alias("pos"))
            rows = parsed.select(order, U.host(F.col("url")).alias("domain"), F.posexplode(F.transform(f"{kind}s", lambda x: x["url"])).alias("pos", "url"))
            parts.append(rows.where("url <> ''").select(place.alias("seq"), F.lit(kind).alias("kind"), "url", "domain"))
    if not parts:
        return parsed.sparkSession.createDataFrame([], "seq struct<page:long,kind:string,pos:int>, kind string, url string, domain string")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    first = both.groupBy("url", "kind").agg(F.min(F.struct("seq", "domain")).alias("f"))
    return first.select("f.seq", "kind", "url", "f.domain")


def answered(addresses: DataFrame, heads: DataFrame, gets: DataFrame) -> DataFrame:
    """Rows for `downloaded` from the responses to HEAD and GET of the addresses; images' sides as their heads tell them."""
    head = heads.select(F.col("url").alias("__h"), F.col("success").alias("head_ok"), F.col("content_type").alias("head_type"), F.col("content_length").alias("head_length"))
    get = gets.select(F.col("url").alias("__g"), "status_code", "content_type", "body")
    rows = addresses.join(head, F.col("url") == F.col("__h"), "left").join(get, F.col("url") == F.col("__g"), "left").drop("__h", "__g")
    size = M.image_size("body")
    return rows.withColumn("__s", size).select("*", "__s.width", "__s.height").drop("__s")


def contents(records: DataFrame) -> DataFrame:
    """(file_path, content_hash, body) of every content that is kept, once; records: `downloaded` with bodies."""
    return records.where("success AND NOT duplicate").select("file_path", "content_hash", "body")


def pdf_images(pdfs: DataFrame, decode: Callable[[bytes], list[dict]]) -> DataFrame:
    """Images inside PDFs (path, content), by an injected decoder; a PDF that it can't read gives none.

    decode: returns page, img_index, width, height, format, colorspace and size_bytes of each image."""
    names = ["page", "img_index", "width", "height", "format", "colorspace", "size_bytes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [[path.rsplit("/", 1)[-1], *(x[n] for n in names)] for x in decode(bytes(content))]
                except Exception:
                    continue
            yield pd.DataFrame(rows, columns=["pdf", *names])

    return pdfs.select("path", "content").mapInPandas(run, "pdf string, page int, img_index int, width int, height int, format string, colorspace string, size_bytes long")


def filtered_pdf_images(images: DataFrame, least_side: int = 200, least_bytes: int = 2048) -> DataFrame:
    """Decoded images (pdf, page, img_index, width, height, size_bytes, format, colorspace) that are large enough, with their file names."""
    large = (F.col("width") >= least_side) & (F.col("height") >= least_side) & (F.col("size_bytes") >= least_bytes)
    name = F.format_string("%s_p%03d_img%02d.%s", F.regexp_replace("pdf", r"\.pdf$", ""), F.col("page"), F.col("img_index"), F.col("format"))
    return images.where(large).withColumn("file", name).withColumn("size_kb", F.round(F.col("size_bytes") / 1024, 1))


def pdf_image_summary(images: DataFrame) -> DataFrame:
    """J-6: images and kilobytes by PDF."""
    return images.groupBy("pdf").agg(F.count(F.lit(1)).alias("images"), F.round(F.sum("size_kb"), 1).alias("total_kb"), F.countDistinct("page").alias("pages"))
