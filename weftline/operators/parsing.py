"""Pages: one Arrow UDF parses each page once; paths, tables, clean-up and links follow as built-in expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from weftline.config import Extraction
from weftline.functions import text as T
from weftline.functions import urls as U
from weftline.functions.slices import sliced
from weftline.schemas import PARSED
from weftline.sources.html import COSTLY


def heading_paths(headings: Column) -> Column:
    """X-3: for each heading, its open ancestors joined by arrows. An earlier heading is an ancestor if every
    heading from it on, up to and with this one, has a deeper level."""
    levels = F.transform(headings, lambda h: h["level"])

    def path(h, j):
        before = F.filter(F.sequence(F.lit(0), j), lambda k: (k == j) | (F.get(levels, k.cast("int")) < F.array_min(F.slice(levels, k.cast("int") + 2, F.greatest(j - k.cast("int"), F.lit(1))))))
        return F.array_join(F.transform(before, lambda k: F.get(headings, k.cast("int"))["text"]), " → ")

    return F.when(F.size(headings) > 0, F.transform(headings, path)).otherwise(F.array().cast("array<string>"))


def table_markdown(table: Column) -> Column:
    """X-7: a table's rows as Markdown; pipes inside cells are left as they are."""
    def row(cells):
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(table["headers"])), " | "), F.lit(" |"))
    head = F.when(F.size(table["headers"]) > 0, F.array(row(table["headers"]), rule)).otherwise(F.array().cast("array<string>"))
    return F.struct(table["caption"].alias("caption"), table["headers"].alias("headers"), F.size(table["rows"]).alias("row_count"), F.array_join(F.concat(head, F.transform(table["rows"], row)), "\n").alias("markdown"))


#: What each derived column is made of.
PARTS = {"heading_hierarchy": "headings", "internal_links": "links", "external_links": "links", "body_text": "markdown", "body_text_length": "markdown", "extraction_warnings": "markdown"}


def parse_pages(pages: DataFrame, config: Extraction = Extraction(), fields: tuple[str, ...] | None = None) -> DataFrame:
    """pages (url, html and others) with the parsed fields in place of html; fields: only these, and no work for others."""
    wanted = frozenset(COSTLY if fields is None else (PARTS.get(f, f) for f in fields)) & frozenset(COSTLY)

    kind = to_arrow_type(StructType.fromDDL("p " + PARSED)[0].dataType)

    @F.arrow_udf(PARSED)
    def parsed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from weftline.sources.html import parse

        for url, html in sliced(batches):
            yield pa.array([parse(h or "", u or "", config, wanted) for u, h in zip(url, html)], kind)

    one = pages.withColumn("__p", parsed.asNondeterministic()("url", "html")).drop("html")
    keep = [n for n in one.columns if n != "__p"]
    p = F.col("__p")
    own = U.netloc(F.col("url"))
    inside = lambda x: (U.netloc(x["url"]) == own) | F.endswith(U.netloc(x["url"]), F.concat(F.lit("."), own))
    plain = ["title", "meta_description", "meta_keywords", "og_title", "og_description", "og_image", "canonical_url", "language", "page_type", "raw_html_length", "headings", "images", "pdfs", "schema_org"]
    out = one.select(*keep, *[p[n].alias(n) for n in plain], heading_paths(p["headings"]).alias("heading_hierarchy"), F.filter(p["links"], inside).alias("internal_links"), F.filter(p["links"], lambda x: ~inside(x)).alias("external_links"), F.transform(p["tables"], table_markdown).alias("tables"), T.clean_markdown(p["markdown"]).alias("body_text"), p["warnings"].alias("__w"))
    length = F.char_length("body_text")
    short = F.format_string("Short body text (%d chars) — may be JS-rendered or mostly images", length)
    warned = F.when(length < config.min_text_length_chars, F.concat("__w", F.array(short))).otherwise(F.col("__w"))
    out = out.withColumn("body_text_length", length).withColumn("extraction_warnings", warned).drop("__w")
    return out if fields is None else out.select(*keep, *fields)
