"""Asset expressions: kinds of images, extensions, PDF page counts."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# fixed values
MIME_EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif", "image/bmp": ".bmp"}
URL_KINDS = (
    ("icon_or_logo", ("icon", "logo", "favicon", "sprite", "thumb")),
    ("banner", ("banner", "hero", "header", "cover")),
    ("poster", ("poster", "notice", "circular", "flyer", "scheme")),
    ("photo", ("photo", "image", "img", "pic", "gallery")),
    ("infographic_or_chart", ("chart", "graph", "infographic", "diagram")),
)


def size_of(body: bytes) -> tuple[int, int] | None:
    """(width, height) as the head of a PNG, GIF, BMP or JPEG file tells them, else None."""
    try:
        if body.startswith(b"\x89PNG\r\n\x1a\n"):
            return struct.unpack(">II", body[16:24])
        if body[:4] == b"GIF8":
            return struct.unpack("<HH", body[6:10])
        if body[:2] == b"BM":
            width, height = struct.unpack("<ii", body[18:26])
            return abs(width), abs(height)
        if body[:2] == b"\xff\xd8":
            at = 2
            while body[at] == 0xFF:
                if 0xC0 <= body[at + 1] <= 0xCF and body[at + 1] not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", body[at + 5 : at + 9])
                    return width, height
                at += 2 + struct.unpack(">H", body[at + 2 : at + 4])[0]
    except (struct.error, IndexError):
        pass
    return None


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def image_size(body: pd.Series) -> pd.DataFrame:
    """The sides of images; null where the head does not tell them."""
    return pd.DataFrame([size_of(bytes(x)) or (None, None) if x is not None else (None, None) for x in body], columns=["width", "height"], dtype="Int32")


def kind_by_size(width: Column, height: Column) -> Column:
    """A-4; the bounds are fixed values."""
    ratio = width / F.greatest(height, F.lit(1))
    return (
        F.when((width <= 64) | (height <= 64), "icon")
        .when((width <= 200) & (height <= 200), "icon")
        .when(ratio > 3, "banner")
        .when(ratio < 0.4, "poster_vertical")
        .when((width >= 800) & (height >= 600), "photo_or_poster")
        .otherwise("image_unknown")
    )


def kind_by_url(url: Column) -> Column:
    """A-5: the first group with a key word in the address."""
    out = None
    for kind, words in URL_KINDS:
        test = F.lower(url).rlike("|".join(words))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("image_unknown")


def suffix(url: Column) -> Column:
    """The lower-case extension of the address' path, with its dot; empty if it has none."""
    name = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def extension(content_type: Column, url: Column) -> Column:
    """A-3: by MIME type, else by address, else .jpg."""
    by_type = F.create_map(*[F.lit(x) for kv in MIME_EXTENSIONS.items() for x in kv])[content_type]
    return F.coalesce(by_type, F.nullif(suffix(url), F.lit("")), F.lit(".jpg"))


def pdf_pages(content: Column) -> Column:
    """A-6: page objects, else the last /Count, else 0."""
    text = F.decode(content, "ISO-8859-1")
    pages = sum((F.regexp_count(text, F.lit(p)) for p in ("/Type /Page\n", "/Type/Page\n", "/Type /Page\r")), F.lit(0))
    counts = F.regexp_extract_all(text, F.lit(r"/Count[ \t\n\r\f\x0b]+([0-9]+)"), 1)
    return F.when(pages > 0, pages).otherwise(F.coalesce(F.try_element_at(counts, F.lit(-1)).cast("int"), F.lit(0)))
