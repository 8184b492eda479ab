"""The URL frontier, a level at a time, with the results of a first-in-first-out queue.

FIFO order is (depth, parent's pop order, position of the link). A link found on the page popped i-th is
enqueued unless its address was popped by then; pop order inside a level is known before it is expanded, so
budgets are running counts and the visited test is one anti-join. The loop runs once per depth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.config import Config, Crawl, Scope
from weftline.functions import urls as U
from weftline.sources.scratch import Scratch, cut

NOT_FETCHED = ("javascript:", "mailto:", "tel:", "data:", "#")


def schedule(fetches: DataFrame, delay: float, host: str = "host", arrives: str = "arrives", seq: str = "seq") -> DataFrame:
    """When each fetch starts so that starts on a host lie at least delay apart: i * d + max over j <= i of (arrival j - j * d).

    Fetches lie in ranges of (host, seq), so a busy host's are in many; a range is scheduled on its own and shifted by
    what the ranges before it hold of its first host."""
    ranged = cut(fetches.repartitionByRange(F.col(host), F.col(seq)).withColumn("__p", F.spark_partition_id()))
    order = Window.partitionBy("__p", host).orderBy(seq)
    inside = ranged.withColumn("__i", F.row_number().over(order) - 1).withColumn("__s", F.col(arrives) - F.col("__i") * F.lit(delay))
    inside = inside.withColumn("__m", F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = inside.groupBy(F.col("__p").alias("__q"), F.col(host).alias("__h")).agg(F.count(F.lit(1)).alias("__n"), F.max("__s").alias("__t"))
    before = Window.partitionBy("__h").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    ranges = ranges.withColumn("__b", F.max(F.col("__t") - F.col("__o") * F.lit(delay)).over(before)).select("__q", "__h", "__o", "__b")
    both = inside.join(ranges, (F.col("__p") == F.col("__q")) & F.col(host).eqNullSafe(F.col("__h")))
    most = F.greatest(F.col("__m") - F.col("__o") * F.lit(delay), F.col("__b"))
    return both.withColumn("starts", (F.col("__i") + F.col("__o")) * F.lit(delay) + most).drop("__p", "__i", "__s", "__m", "__q", "__h", "__o", "__b")


def in_scope(host: Column, roots: list[str], scope: Scope = Scope()) -> Column:
    """F-4: hosts under a seed's root domain; else, if external pages are allowed, root domains on the whitelist.

    Subdomains of a seed's root share that root, so they pass whatever allow_subdomains says."""
    root = U.root_domain(host)
    inside = root.isin(*roots) if roots else F.lit(False)
    if scope.allow_subdomains and roots:
        # the host's proper endings, of which one look-up in the set of roots serves however many seeds
        labels = F.split(host, r"\.", -1)
        endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k + 1, F.size(labels)), "."))
        inside = inside | F.exists(endings, lambda x: x.isin(*roots))
    if not scope.internal_only and scope.external_sites_whitelist:
        inside = inside | root.isin(*scope.external_sites_whitelist)
    return inside


def reject_reason(scope: Scope, roots: list[str]) -> Column:
    """F-3: why a link (columns url, norm, host) is not enqueued, in the order of the tests; null if it may be."""
    url = F.trim(F.col("url"))
    out = F.when(url.isNull() | (url == ""), "blank").when(url.rlike("^(" + "|".join(NOT_FETCHED) + ")"), "not_fetched").when(~U.scheme(F.col("norm")).isin("http", "https"), "scheme").when(~in_scope(F.col("host"), roots, scope), "scope")
    for p in scope.url_patterns_exclude:
        out = out.when(url.rlike(f"(?i){p}"), "excluded")
    if scope.url_patterns_include:
        named = F.lit(False)
        for p in scope.url_patterns_include:
            named = named | url.rlike(f"(?i){p}")
        out = out.when(~named, "not_included")
    return out


def seeds(spark: SparkSession, urls: list[str]) -> DataFrame:
    """F-1: queue rows at depth 0, in order."""
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "pos int, url string")
    return addressed(rows).select(_place(0, F.lit(0), F.col("pos")).alias("seq"), "url", "norm", "host", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"), F.lit("").alias("anchor_text"), U.url_hash(F.col("norm")).alias("url_hash"))


def _place(depth: int, by: Column, pos: Column) -> Column:
    """A row's place in the queue: depth, pop order of the page that it was found on, and place there."""
    return F.struct(F.lit(depth).alias("depth"), by.cast("long").alias("by"), pos.cast("int").alias("pos"))


def addressed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("norm", U.normalize_url("url")).withColumn("host", U.host(F.col("norm")))


def within_budget(rows: DataFrame, most: int, before: DataFrame | None = None, host: str = "host", seq: str = "seq") -> DataFrame:
    """F-5: rows whose running number on their host, after those enqueued before, does not pass most.

    The limit on the number alone comes first, so that each task cuts its part of a busy host before the shuffle."""
    ordered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(host).orderBy(seq))).where(F.col("__n") <= most)
    if before is not None:
        ordered = ordered.join(before.select(F.col(host).alias("__h"), F.col("n").alias("__p")), F.col(host) == F.col("__h"), "left").drop("__h")
        ordered = ordered.where(F.col("__n") + F.coalesce("__p", F.lit(0)) <= most).drop("__p")
    return ordered.drop("__n")


def popped(queue: DataFrame, visited: DataFrame | None, budget: int, first: int) -> DataFrame:
    """F-6, F-7: the queue's rows in order, each address once and never one popped before, up to budget; pop_order counts from first."""
    once = queue.withColumn("__r", F.row_number().over(Window.partitionBy("norm").orderBy("seq"))).where("__r = 1").drop("__r")
    if visited is not None:
        once = once.join(visited.select("norm"), "norm", "left_anti")
    once = numbered(once, "seq", "pop_order")
    return once.where(F.col("pop_order") <= budget).withColumn("pop_order", F.col("pop_order") + F.lit(first))


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows with their place (from 1) in the order of `by`: range partitions are numbered on their own and shifted by
    the sizes of those before them, so no task sees all rows."""
    ranged = cut(rows.repartitionByRange(F.col(by)).withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(F.col("__p").alias("__k")).count().withColumn("__o", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(by))
    return ranged.withColumn("__i", inside).join(sizes, F.col("__p") == F.col("__k")).withColumn(name, F.col("__i") + F.col("__o")).drop("__p", "__k", "__i", "__o")


def crawl(spark: SparkSession, urls: list[str], expand: Callable[[DataFrame], DataFrame], config: Config = Config(), known: DataFrame | None = None, progress: Callable[[dict], None] | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """F-9: (popped pages, enqueued rows, counters).

    expand: takes popped rows and returns (pop_order, pos, url, anchor_text) of their links in order; rows that
    failed to load return none. known: raw addresses (url) from an earlier crawl; they are popped and counted but
    not expanded again, and their stored links should come from expand's caller. progress: is told the counters after each level."""
    limits: Crawl = config.crawl
    scratch = Scratch()
    level = scratch.cut(seeds(spark, urls))
    roots = sorted(r["r"] for r in level.select(U.root_domain(F.col("host")).alias("r")).distinct().collect())  # of the caller's own list
    reason = reject_reason(config.scope, roots)
    checked = level.withColumn("reason", reason)
    level = scratch.cut(within_budget(checked.where("reason IS NULL").drop("reason"), limits.max_pages_per_domain))
    enqueued, counters, pops, done = level, {"skipped": 0, "levels": 0}, None, 0
    given = []  # what expand was given stays, as its caller may read it later
    for depth in range(limits.max_depth + 1):
        now = scratch.cut(popped(level, pops, limits.max_pages - done, done))
        given.append(now)
        n = now.count()
        counters["levels"] += 1
        pops = now if pops is None else scratch.cut(pops.unionByName(now))
        done += n
        if not n or depth == limits.max_depth:
            break
        fresh = now if known is None else now.join(known.select("url").distinct(), "url", "left_anti")
        links = expand(fresh).join(now.select("pop_order", F.col("url").alias("parent_url")), "pop_order")
        links = addressed(links).withColumn("seq", _place(depth + 1, F.col("pop_order"), F.col("pos")))
        marked = links.withColumn("reason", reason).join(pops.select("norm", F.col("pop_order").alias("__at")), "norm", "left")
        # written before anything reads it, so that expand runs once, whatever it does
        marked = scratch.cut(marked.where(F.col("__at").isNull() | (F.col("__at") > F.col("pop_order"))).drop("__at"))
        before = enqueued.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        rows = marked.where("reason IS NULL").select("seq", "url", "norm", "host", F.lit(depth + 1).alias("depth"), "parent_url", F.substring(F.coalesce("anchor_text", F.lit("")), 1, 200).alias("anchor_text"), U.url_hash(F.col("norm")).alias("url_hash"))
        level = scratch.cut(within_budget(rows, limits.max_pages_per_domain, before))
        seen, fits = marked.agg(F.count_if(F.col("reason").isin("scope", "excluded", "not_included")), F.count_if(F.col("reason").isNull())).first()
        counters["skipped"] += seen + fits - level.count()
        enqueued = scratch.cut(enqueued.unionByName(level))
        scratch.drop(marked)
        if progress is not None:
            progress({"depth": depth, "popped": done, "enqueued": enqueued.count()})
    counters |= {"popped": done, "enqueued": enqueued.count()}
    scratch.keep(pops, enqueued, *given)
    return pops, enqueued, counters


def dry_run(spark: SparkSession, urls: list[str], expand, config: Config = Config(), most: int = 50) -> DataFrame:
    """F-10: the addresses a crawl would fetch, at most `most`, in order."""
    from dataclasses import replace

    small = replace(config, crawl=replace(config.crawl, max_pages=min(most, config.crawl.max_pages)))
    return crawl(spark, urls, expand, small)[0].select("pop_order", "url", "depth")
