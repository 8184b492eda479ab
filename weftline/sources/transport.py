"""Fetching: an injected transport inside mapInPandas, or an archive of pages joined by normalised address."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import Crawl
from weftline.functions import urls as U
from weftline.schemas import RESPONSE

FIELDS = ["url", "final_url", "status_code", "content_type", "body", "redirect_chain", "response_time_ms", "error", "content_length"]
RETRIED = (429, 500, 502, 503, 504)


class TooManyRedirects(Exception):
    pass


class Transport(Protocol):
    """One session per worker; get and head return a dict of FIELDS (without error)."""

    def open(self, config: Crawl) -> None: ...
    def get(self, url: str) -> dict: ...
    def head(self, url: str) -> dict: ...
    def close(self) -> None: ...


def named_error(e: Exception) -> str:
    """S3: the taxonomy of failures."""
    if isinstance(e, TimeoutError):
        return "Timeout"
    if isinstance(e, TooManyRedirects):
        return "TooManyRedirects"
    if isinstance(e, ConnectionError):
        return f"ConnectionError: {str(e)[:100]}"
    return f"UnexpectedError: {str(e)[:100]}"


def fetched(addresses: DataFrame, transport: Transport, config: Crawl = Crawl(), method: str = "get", pause: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """One response per row of `addresses` (url); failures are rows with an error, never exceptions.

    A host's addresses go to one worker, which waits between starts (S4) and, longer each time, before it tries again."""

    def respond(url: str) -> dict:
        row = dict.fromkeys(FIELDS) | {"url": url, "final_url": url, "status_code": 0, "content_type": "", "redirect_chain": [], "response_time_ms": 0, "content_length": 0}
        for attempt in range(config.max_retries + 1):
            if attempt:
                pause(config.retry_backoff_sec * 2 ** (attempt - 1))
            try:
                row |= getattr(transport, method)(url)
                row["error"] = None
            except Exception as e:
                row["error"] = named_error(e)
                break
            if row["status_code"] not in RETRIED:
                break
        return row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transport.open(config)
        host, free = None, 0.0
        try:
            for batch in batches:
                rows = []
                for url, name in zip(batch["url"], batch["host"]):
                    if name == host and free > clock():
                        pause(free - clock())
                    host, free = name, clock() + config.delay_between_requests_sec
                    rows.append(respond(url))
                yield pd.DataFrame(rows, columns=FIELDS)
        finally:
            transport.close()

    by_host = addresses.select("url", U.host(F.col("url")).alias("host")).repartition(F.col("host")).sortWithinPartitions("host", "url")
    return with_status(by_host.mapInPandas(run, RESPONSE))


def with_status(responses: DataFrame) -> DataFrame:
    """error for every status but 200, success, and the kind of content; unknown kinds are read as HTML."""
    error = F.coalesce("error", F.when(F.col("status_code") != 200, F.format_string("HTTP %d", F.col("status_code"))))
    return responses.withColumn("error", error).withColumn("success", F.col("error").isNull()).withColumn("kind", kind(F.col("content_type")))


def kind(content_type: Column) -> Column:
    of = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(F.contains(of, F.lit("application/pdf")), "pdf").when(F.startswith(of, F.lit("image/")), "image").otherwise("html")


def archived(addresses: DataFrame, pages: DataFrame) -> DataFrame:
    """The offline transport: `pages` (url, html) answer for the addresses that normalise alike; all others are HTTP 404."""
    known = pages.select(U.normalize_url("url").alias("__n"), F.col("url").alias("final_url"), F.col("html"))
    rows = addresses.withColumn("__a", U.normalize_url("url")).join(known, F.col("__a") == F.col("__n"), "left")
    hit = F.col("html").isNotNull()
    out = rows.select("url", F.coalesce("final_url", "url").alias("final_url"), F.when(hit, 200).otherwise(404).alias("status_code"), F.lit("text/html").alias("content_type"), F.encode("html", "UTF-8").alias("body"), F.array().cast("array<string>").alias("redirect_chain"), F.lit(0).alias("response_time_ms"), F.lit(None).cast("string").alias("error"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("content_length"))
    return with_status(out)
