"""Chunks of texts and page records. Packing is a sequential fold, so it runs in Arrow batches; the rest is built in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import Chunking
from weftline.functions import text as T
from weftline.functions.slices import sliced

_ends = re.compile(r"(?<=[.!?।])\s+")
_heading = re.compile(r"^(#{1,6})\s+(.+)$", re.M)


def split_sentences(text: str) -> list[str]:
    return [p for p in (x.strip() for x in _ends.split(text.strip())) if p]


def pack(sentences: list[str], size: int = 1000, overlap: int = 150, least: int = 50, compat: bool = False) -> list[str]:
    """C-2: sentences filled greedily up to size; each chunk but the first starts with the tail of the one before.

    A sentence above size stands alone if nothing is open. compat: the tail of a full chunk is its one character
    `overlap` places from the end, as the rule was first written."""
    chunks: list[str] = []
    buffer: list[str] = []
    filled, tail = 0, ""

    def close(body: str) -> None:
        chunks.append(f"{tail} {body}".strip() if tail else body)

    for s in sentences:
        if len(s) > size and not buffer:
            close(s)
            tail = s[-overlap:]
            continue
        if buffer and filled + len(s) + 1 > size:
            body = " ".join(buffer)
            close(body)
            tail = body if len(body) <= overlap else body[-overlap] if compat else body[-overlap:]
            buffer, filled = [], 0
        buffer.append(s)
        filled += len(s) + 1
    if buffer:
        close(" ".join(buffer))
    return [c for c in chunks if len(c) >= least]


def sections(body: str) -> list[tuple[str, str]]:
    """C-3: (heading, text under it); text before the first heading has none."""
    found = list(_heading.finditer(body))
    if not found:
        return [("", body)]
    out = [("", body[: found[0].start()].strip())] if found[0].start() else []
    ends = [m.start() for m in found[1:]] + [len(body)]
    return out + [(m[2].strip(), body[m.end() : end].strip()) for m, end in zip(found, ends)]


def pack_udf(config: Chunking = Chunking(), compat: bool = False):
    @F.arrow_udf("array<string>")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (texts,) in sliced(batches):
            yield pa.array([pack(split_sentences(t or ""), config.chunk_size, config.overlap, config.min_chunk_size, compat) for t in texts], pa.list_(pa.string()))

    return packed.asNondeterministic()


def breadcrumb(paths: Column, heading: Column) -> Column:
    """C-4: the first path that ends with the heading, else the heading."""
    return F.coalesce(F.get(F.filter(paths, lambda p: F.endswith(p, heading)), F.lit(0)), heading)


def chunk_texts(docs: DataFrame, ident: str = "doc_id", config: Chunking = Chunking(), compat: bool = False) -> DataFrame:
    """(ident, chunk_index, total_chunks, text) of plain texts."""
    chunks = docs.select(ident, pack_udf(config, compat)("text").alias("c")).select(ident, F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "text"))
    return chunks.select(ident, "chunk_index", "total_chunks", "text")


def without_error(pages: DataFrame) -> DataFrame:
    return pages.where(F.coalesce(F.col("rag_status.error"), F.lit("")) == "") if "rag_status" in pages.columns else pages


def chunkable(pages: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """C-10: pages without error and with a body long enough, measured as stored."""
    return without_error(pages).where(F.char_length(F.coalesce("body_text", F.lit(""))) >= config.min_body_chars)


def chunk_pages(pages: DataFrame, config: Chunking = Chunking(), compat: bool = False) -> DataFrame:
    """C-0: one row per chunk of each page record: summary, sections of the body, tables, numbered in that order."""

    @F.arrow_udf("array<struct<heading:string,text:string>>")
    def body_chunks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def of(text):
            text = text or ""
            if len(text) < config.min_body_chars:  # C-10, here so that the body is read once
                return None
            return [
                {"heading": heading, "text": chunk}
                for heading, part in sections(text.strip())
                if part.strip()
                for chunk in pack(split_sentences(part), config.chunk_size, config.overlap, config.min_chunk_size, compat)
            ]

        for (bodies,) in sliced(batches):
            yield pa.array([of(b) for b in bodies], pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string())])))

    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    title, about = empty("title"), T.strip(empty("meta_description"))
    meta = F.concat(F.when(title != "", F.concat(F.lit("Page Title: "), title, F.lit("\n"))).otherwise(""), F.when(about != "", F.concat(F.lit("Summary: "), about)).otherwise(""))
    piece = "struct<text:string,section:string,source_type:string>"
    none = F.array().cast(f"array<{piece}>")

    def made(text, section, kind):
        return F.struct(text.alias("text"), section.alias("section"), F.lit(kind).alias("source_type")).cast(piece)

    first = F.when(F.char_length(meta) >= config.min_chunk_size, F.array(made(T.strip(meta), F.lit("Page Summary"), "meta"))).otherwise(none)

    def of_section(x):
        crumb = F.when(x["heading"] == "", F.lit("")).otherwise(breadcrumb(F.col("heading_hierarchy"), x["heading"]))
        text = F.when(crumb == "", x["text"]).otherwise(F.concat(F.lit("[Section: "), crumb, F.lit("]\n\n"), x["text"]))
        return made(text, F.when(crumb == "", x["heading"]).otherwise(crumb), "webpage")

    def of_table(x):
        md, caption = T.strip(x["markdown"]), F.coalesce(x["caption"], F.lit(""))
        named = caption != ""
        return made(F.when(named, F.concat(F.lit("Table: "), caption, F.lit("\n\n"), md)).otherwise(md), F.when(named, F.concat(F.lit("Table: "), caption)).otherwise(F.lit("Table")), "table")

    tables = F.filter(F.coalesce("tables", F.array().cast("array<struct<caption:string,headers:array<string>,row_count:int,markdown:string>>")), lambda x: F.char_length(T.strip(x["markdown"])) >= config.min_chunk_size)
    parts = without_error(pages).withColumn("__b", body_chunks.asNondeterministic()("body_text")).where("__b IS NOT NULL")
    parts = parts.withColumn("__c", F.concat(first, F.transform("__b", of_section), F.transform(tables, of_table)))
    parts = parts.select("url", "title", "domain", "depth", "doc_id", F.size("__c").alias("total_chunks"), F.posexplode("__c").alias("chunk_index", "c"))
    return parts.select("c.text", "url", "title", "domain", "depth", "c.section", "chunk_index", "total_chunks", "c.source_type", "doc_id")
