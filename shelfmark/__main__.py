"""python -m shelfmark query NAME --data DIR [--out DIR] | report --data DIR --out FILE | plan --data DIR [--settings FILE] [--max-products N] [--fresh]"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import config
from .plans import registry
from .plans.sources import crawl_queue
from .session import get_session
from .sources import exports

REPORTS = ("entity_counts", "product_completeness", "variant_completeness", "provenance_share", "top_brands", "category_rollup", "variants_per_product", "crawl_status_counts")


def planned(spark: SparkSession, data: str, settings: config.Settings, resume: bool = True) -> DataFrame:
    """The urls of a run under its settings, in the order they are taken."""
    return crawl_queue(spark, data, settings.max_retries, resume, settings.max_products)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="shelfmark", description=__doc__)
    what = parser.add_subparsers(dest="what", required=True)
    one = what.add_parser("query")
    one.add_argument("name", choices=sorted(registry.QUERIES))
    every = what.add_parser("report")
    plan = what.add_parser("plan")
    plan.add_argument("--settings", help="a .json or .toml file")
    plan.add_argument("--max-products", type=int, help="over the settings' own limit")
    plan.add_argument("--max-retries", type=int)
    plan.add_argument("--fresh", action="store_true", help="take up urls that are done, too")
    for p in (one, every, plan):
        p.add_argument("--data", required=True)
        p.add_argument("--out")
        p.add_argument("--master")
    args = parser.parse_args(argv)
    if args.what == "plan":
        for name in ("max_products", "max_retries"):
            if (getattr(args, name) or 0) < 0 or (name == "max_products" and args.max_products == 0):
                parser.error(f"--{name.replace('_', '-')} is out of range")
    spark = get_session(args.master)
    if args.what == "plan":
        settings = config.load(args.settings) if args.settings else config.Settings()
        settings = settings.with_changes(max_products=args.max_products, max_retries=args.max_retries)
        found = planned(spark, args.data, settings, resume=not args.fresh)
        found.write.mode("overwrite").parquet(args.out) if args.out else found.show(50, truncate=False)
    elif args.what == "query":
        found = registry.QUERIES[args.name](spark, args.data)
        if args.out:
            found.write.mode("overwrite").parquet(args.out)
        else:
            found.show(50, truncate=False)
    else:
        page = exports.dashboard("Catalogue report", {n: registry.QUERIES[n](spark, args.data) for n in REPORTS})
        Path(args.out or "report.html").write_text(page, encoding="utf-8")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
