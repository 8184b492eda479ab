"""The crawl's command line."""

from __future__ import annotations

import argparse

from weftline.config import Config, load, merged


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="weftline", description="Crawl pages into records, contents and indexes.")
    out.add_argument("--url", help="where to start")
    out.add_argument("--urls", nargs="+", default=[], help="more places to start")
    out.add_argument("--config", help="JSON file laid over the defaults")
    out.add_argument("--depth", type=int)
    out.add_argument("--max-pages", type=int)
    out.add_argument("--delay", type=float, help="seconds between requests to a host")
    out.add_argument("--output", help="folder for records, contents and indexes")
    out.add_argument("--no-images", action="store_true")
    out.add_argument("--no-pdfs", action="store_true")
    out.add_argument("--allow-external", action="store_true", help="follow links to the sites that the scope lists")
    out.add_argument("--dry-run", action="store_true", help="only list the addresses")
    out.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    return out


def settings(argv: list[str]) -> tuple[Config, list[str], argparse.Namespace]:
    """(configuration, seeds, all flags): flags over the file over the defaults; raises ValueError without seeds."""
    args = parser().parse_args(argv)
    config, seeds = load(args.config)
    crawl = {"max_depth": args.depth, "max_pages": args.max_pages, "delay_between_requests_sec": args.delay}
    over = {"crawl": {k: v for k, v in crawl.items() if v is not None}, "assets": {}, "scope": {}}
    if args.no_images:
        over["assets"]["download_images"] = False
    if args.no_pdfs:
        over["assets"]["download_pdfs"] = False
    if args.allow_external:
        over["scope"]["internal_only"] = False
    own = [x for x in [args.url, *args.urls] if x]
    if not (own or seeds):
        raise ValueError("no place to start: give --url, or seeds in the configuration")
    return merged(config, over), own or seeds, args


def main(spark, transport, argv: list[str]):
    """Run a crawl; a dry run returns the addresses instead."""
    from weftline.operators.frontier import dry_run
    from weftline.operators.parsing import parse_pages
    from weftline.plans import jobs, log
    from weftline.sources.scratch import cut
    from weftline.sources.transport import fetched
    from pyspark.sql import functions as F

    config, seeds, args = settings(argv)
    log.setup(args.log_level)
    if not args.dry_run:
        return jobs.crawl_web(spark, seeds, transport, config, output=args.output)

    def expand(rows):
        pages = cut(fetched(rows, transport, config.crawl)).where("success AND kind = 'html'").select("url", F.decode("body", "UTF-8").alias("html"))
        links = parse_pages(pages, config.extraction, fields=("internal_links", "external_links"))
        links = links.select("url", F.posexplode(F.concat("internal_links", "external_links")).alias("pos", "l"))
        return rows.select("pop_order", "url").join(links, "url").select("pop_order", "pos", F.col("l.url").alias("url"), F.col("l.text").alias("anchor_text"))

    return dry_run(spark, seeds, expand, config)
