"""The three jobs end to end: list places, collect documents, curate reviews.

What is counted is counted while it is written; no job reads anything again for a number.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators.assemble import skip_done, with_doc_key
from reviewloom.operators.dedup import keep_first
from reviewloom.operators.extract import CARD_CAP
from reviewloom.operators.tables import preview, value_distribution
from reviewloom.plans.collect import collect_pages, list_places
from reviewloom.plans.curate import SAMPLE_CAP, curate_large_documents, final_rows, sampled_documents
from reviewloom.sources import sinks
from reviewloom.sources.documents import REASONS, duplicate_keys_allowed, rejected, scan_documents
from reviewloom.sources.pages import read_pages
from reviewloom.sources.places import COMPLETE, read_places, write_places_copy
from reviewloom.sources.store import DocumentStore


@dataclass(frozen=True)
class Outcome:
    """What a job did: whether it wrote anything, how many rows, a small table to look at, and its
    counts by name."""

    written: bool
    n_rows: int
    report: DataFrame
    counts: dict[str, int] = field(default_factory=dict)


def list_job(spark: SparkSession, pages_path: str, places_path: str) -> Outcome:
    """Listing pages (Parquet: url, html) to a places CSV in the order of page and place on it, with a copy that
    `collect_job` reads in parallel; the report is its first five rows."""
    pages, n = sinks.stage_counted(spark.read.parquet(pages_path).select("url", "html"), "listing", pages=F.count("*"))
    places, m = sinks.stage_counted(list_places(pages), "places", places=F.count("*"))
    written = sinks.write_places(places, places_path, order=["url", "pos"], n_rows=m["places"])
    if written:
        write_places_copy(places, places_path, ["url", "pos"])
    return Outcome(written, m["places"], preview(places, "url", "pos").drop("url", "pos"), {**n, **m})


def collect_job(
    spark: SparkSession, places_path: str, pages_path: str, documents_path: str, *, card_cap: int = CARD_CAP,
    newest: str | None = None, unusable_path: str | None = None,
) -> Outcome:
    """Places list and stored pages (Parquet, or a store of `write_page_store`) to documents, added as one batch to the `DocumentStore` at ``documents_path``.

    The batch becomes visible with its last write, so a job that is stopped anywhere and run again gives each key once.
    Places without a name, a URL or a key go to ``unusable_path`` with the reason, and are counted in any case;
    ``places_to_do`` counts places not done yet, those alike in key and URL once.
    """
    store = DocumentStore(spark, documents_path)
    reason = F.when(~F.expr(COMPLETE), "incomplete").when(F.col("doc_key") == "", "no_key")
    listed = with_doc_key(read_places(spark, places_path)).withColumn("reason", reason)
    listed, n = sinks.stage_counted(listed, "places", places=F.count("*"), unusable_places=F.count("reason"))
    if unusable_path:
        listed.where("reason is not null").select("place_name", "gmaps_url", "reason").write.mode("overwrite").parquet(unusable_path)
    todo = keep_first(skip_done(listed.where("reason is null").drop("reason"), store.keys()), ["doc_key", "gmaps_url"], ["pos"])
    todo, m = sinks.stage_counted(todo, "to-do", places_to_do=F.count("*"))
    documents = collect_pages(todo, read_pages(spark, pages_path), card_cap=card_cap, newest=newest)
    documents, found = sinks.stage_counted(documents, "documents", documents=F.count("*"), reviews=F.sum(F.size("reviews")))
    written = store.commit(documents, counts=found)
    return Outcome(written, found["documents"], documents.selectExpr("doc_key", "size(reviews) as n_reviews"), {**n, **m, **found})


def curate_job(
    spark: SparkSession,
    documents_path: str,
    final_path: str,
    *,
    layout: str = "auto",
    as_of: Column | datetime | date | str | None = None,
    cap: int = SAMPLE_CAP,
    seed: int | str = 42,
    rejects_path: str | None = None,
    raw_rating: bool = False,
) -> Outcome:
    """Documents to the final CSV; the report is the rating distribution, the counts hold documents,
    reviews, places in the result, and rejected documents by reason."""
    raw = scan_documents(spark, documents_path, layout=layout)
    final, rejects, counts = curated(raw, as_of=as_of, cap=cap, seed=seed, raw_rating=raw_rating)
    if rejects_path:
        rejects.write.mode("overwrite").parquet(rejects_path)
    written = sinks.write_final(final, final_path, n_rows=counts["rows"])
    return Outcome(written, counts.pop("rows"), value_distribution(final, "user_rating"), counts)


def curated(
    raw: DataFrame,
    *,
    as_of: Column | datetime | date | str | None = None,
    cap: int = SAMPLE_CAP,
    seed: int | str = 42,
    raw_rating: bool = False,
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Scanned documents to the staged final table, the rejects (file, reject_reason), and the counts.

    Documents are parsed once; samples and rejects both come from the staged result. Those that were too large for it, if
    there are any, are read again by type and go through the table path.
    """
    spark = raw.sparkSession
    by_reason = {f"rejected_{r}": F.count_if(F.col("reject_reason") == r) for r in REASONS}
    seen = {"documents": F.count("*"), "reviews": F.sum("n_reviews"), "places": F.count_if(F.size("reviews") > 0), **by_reason}
    with duplicate_keys_allowed(spark):
        sampled, counts = sinks.stage_counted(sampled_documents(raw, cap=cap, seed=seed), "sampled", **seen)
        final, rejects = final_rows(sampled, as_of, raw_rating=raw_rating), rejected(sampled)
        if counts["rejected_too_large"]:
            large = raw.join(rejects.where("reject_reason = 'too_large'").select("file").distinct(), "file", "left_semi")
            rows, documents = curate_large_documents(large, as_of=as_of, cap=cap, seed=seed, keep_ids=True, raw_rating=raw_rating)
            rows = sinks.stage(rows, "large-final")
            final = final.unionByName(rows.drop("file", "pos"))
            rejects = rejects.where("reject_reason <> 'too_large'").union(rejected(documents))
            again = documents.agg(F.coalesce(F.sum("n_reviews"), F.lit(0)).alias("reviews"), *[c.alias(k) for k, c in by_reason.items()]).first()
            counts = {**counts, **{k: again[k] + (counts[k] if k != "rejected_too_large" else 0) for k in ("reviews", *by_reason)}}
            counts["places"] += rows.select("file").distinct().count()
        final, n = sinks.stage_counted(final, "final", rows=F.count("*"))
    reasons = {k: counts.pop(k) for k in by_reason}
    counts["rejected"] = sum(reasons.values())
    return final, rejects, {**counts, **{k: v for k, v in reasons.items() if v}, **n}
