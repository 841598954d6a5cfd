"""spark-submit reviewloom/__main__.py {list|store|collect|curate} PATH..."""
from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from reviewloom.plans import jobs  # noqa: E402
from reviewloom.sources.pages import write_page_store  # noqa: E402


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="reviewloom")
    sub = parser.add_subparsers(dest="job", required=True)
    p = sub.add_parser("list", help="listing pages to a places CSV")
    p.add_argument("pages")
    p.add_argument("places")
    p = sub.add_parser("store", help="stored pages to pages bucketed by URL, for collect")
    p.add_argument("pages")
    p.add_argument("store")
    p.add_argument("--buckets", type=int, required=True)
    p = sub.add_parser("collect", help="places and stored pages to documents")
    p.add_argument("places")
    p.add_argument("pages")
    p.add_argument("documents")
    p.add_argument("--card-cap", type=int, default=jobs.CARD_CAP, help="reviews kept per page")
    p.add_argument("--newest", help="column of the pages; of several versions of a page the greatest counts")
    p.add_argument("--unusable", help="write places without name, URL or key here")
    p = sub.add_parser("curate", help="documents to the final CSV")
    p.add_argument("documents")
    p.add_argument("final")
    p.add_argument("--layout", choices=["auto", "file", "line"], default="auto")
    p.add_argument("--as-of", help="count relative times back from here (default: now); 'modified': from each file's time")
    p.add_argument("--cap", type=int, default=jobs.SAMPLE_CAP)
    p.add_argument("--seed", default="42")
    p.add_argument("--rejects", help="write rejected documents and reasons here")
    p.add_argument("--raw-rating", action="store_true", help="add the ratings as they were given")
    a = parser.parse_args(argv)

    spark = SparkSession.builder.appName(f"reviewloom {a.job}").getOrCreate()
    if a.job == "store":
        write_page_store(spark.read.parquet(a.pages), a.store, a.buckets)
        return 0
    if a.job == "list":
        outcome = jobs.list_job(spark, a.pages, a.places)
    elif a.job == "collect":
        outcome = jobs.collect_job(
            spark, a.places, a.pages, a.documents, card_cap=a.card_cap, newest=a.newest, unusable_path=a.unusable
        )
    else:
        outcome = jobs.curate_job(
            spark, a.documents, a.final, layout=a.layout, as_of=F.col("modified") if a.as_of == "modified" else a.as_of, cap=a.cap, seed=a.seed, rejects_path=a.rejects,
            raw_rating=a.raw_rating,
        )
    print(f"{outcome.n_rows} rows, {'written' if outcome.written else 'nothing written'}")
    for name, n in outcome.counts.items():
        print(f"{name}: {n}")
    outcome.report.show(20, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
