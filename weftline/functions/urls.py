"""URL expressions. Normalising re-encodes queries, which no built-in does, so it runs in an Arrow UDF; the rest is built in."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: second-level labels under which organisations register
PUBLIC_LABELS = ("gov", "co", "org", "net", "edu", "ac")
DEFAULT_PORTS = {"http": 80, "https": 443}


def normalized(url: str) -> str:
    """U-1: lower-case scheme and host, no default port, user, fragment, path parameters or closing slash; query keys in order."""
    try:
        parts = urlsplit(url.strip())
        scheme, host, port = parts.scheme.lower(), (parts.hostname or "").lower(), parts.port
        if ":" in host:
            host = f"[{host}]"
        if port and DEFAULT_PORTS.get(scheme) != port:
            host = f"{host}:{port}"
        head, slash, last = parts.path.rpartition("/")
        path = head + slash + last.split(";", 1)[0]
        path = path.rstrip("/") or "/"
        query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
        return urlunsplit((scheme, host, path, query, ""))
    except Exception:
        return url


@F.pandas_udf(StringType())
def normalize_url(url: pd.Series) -> pd.Series:
    return url.map(normalized, na_action="ignore")


def url_hash(norm: Column) -> Column:
    """U-2, of a normalised URL."""
    return F.substring(F.md5(norm.cast("binary")), 1, 12)


def doc_id(norm: Column) -> Column:
    return F.concat(F.lit("page_"), url_hash(norm))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^([a-z][a-z0-9+.\-]*):", 1))


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def root_domain(host_name: Column) -> Column:
    """U-4: the last two labels, or three under a public second-level label."""
    labels = F.split(host_name, r"\.", -1)
    n = F.size(labels)
    three = (n >= 3) & F.get(labels, n - 2).isin(*PUBLIC_LABELS)
    return F.when(three, F.array_join(F.slice(labels, n - 2, F.lit(3)), ".")).when(n >= 2, F.array_join(F.slice(labels, n - 1, F.lit(2)), ".")).otherwise(host_name)


def citation_key(url: Column) -> Column:
    """U-7: without www. and closing slashes."""
    url = F.replace(F.replace(url, F.lit("https://www."), F.lit("https://")), F.lit("http://www."), F.lit("http://"))
    return F.regexp_replace(url, r"/+\z", "")


def content_hash(content: Column) -> Column:
    """U-5."""
    return F.substring(F.sha2(content, 256), 1, 16)


def token_bucket(word: Column, buckets: int = 100_000) -> Column:
    """U-9: the 128-bit md5 of a word modulo buckets, by Horner's rule over its four 32-bit parts."""
    digest = F.md5(word.cast("binary"))
    out = F.lit(0).cast("long")
    for i in range(4):
        part = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        out = (out * F.lit((1 << 32) % buckets) + part) % F.lit(buckets)
    return out.cast("int")
