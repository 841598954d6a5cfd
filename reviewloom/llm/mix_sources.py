"""Mixing sources to target weights by hash-threshold histograms (operator 4).

1. Words per document, then per source (map-side sums).
2. Sources in code-point order, null last, get the repeating ``weights`` and share ``share`` of all words. A target stops
   at ``most`` times its source's size; what is over is shared again by weight until no target is above.
3. Per source, whole passes cover ``floor(target / size)``; the rest is a budget. Each document has a fixed 120-bit hash: 60
   bits of its id, then 60 bits of its text. Words are summed by source and hash bucket (4096 nested buckets a level), the
   bucket in which the budget ends is refined alone on the next level, and in the end a document is in if its hash lies
   below its source's threshold. No document is sorted; a source of any size is a sum of partial sums and at most 4096
   rows a level.
4. Rows alike in id and text share a hash. Where the budget ends among such rows, they are stored, dealt over parts and counted
   by part, and as many of them are taken as the budget holds.

The document at the threshold is taken if that brings the source nearer to its target, so a source's taken words are off by
at most half of one document's size, whatever ids repeat. Hashes come from ``doc_id`` and text alone, so reruns agree.
Null text has size 0 and is never taken; null sources are one source; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.scratch import partitions, stage
from reviewloom.llm.text import WORD

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
LEVEL_BITS, LEVELS = 12, 5


#: Parts over which rows alike in id and text are dealt to be numbered.
PARTS = 1024


def hash60(value):
    """First 15 hex digits of the MD5 of the value as text, null as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _ranked(sources: DataFrame, spark) -> DataFrame:
    """Adds ``rank`` (0, 1, ...) in code-point order, null last, without bringing all sources into one task."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = stage(
        sources.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "mix-sources"
    )
    per_part = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per partition
    within = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return within.join(before, "part").select("source", "source_size", (F.col("before") + F.col("nth") - 1).alias("rank"))


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size) -> with target: the shares by weight, none above ``most`` times the source's size."""
    spark = sources.sparkSession
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = stage(_ranked(sources, spark).withColumn("weight", turn), "mix-weights")
    top = F.col("source_size") * F.lit(float(most))
    budget = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = top < F.col("weight") * level
        capped, free = weighed.agg(F.sum(F.when(full, top)), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            break
        raised = (budget - (capped or 0.0)) / free
        if raised <= level:
            break
        level = raised
    return weighed.select("source", "source_size", F.least(top, F.col("weight") * level).alias("target"))


def _sized(docs: DataFrame, *keep) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*keep, "source", size.alias("size"), hash60(F.col("doc_id")).alias("h1"), hash60(F.col("text")).alias("h2"))


def thresholds(sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """Per source of ``sized`` (source, size, h1, h2; a stored table): name, source_size, target, passes, and what gets one pass
    more: rows with (h1, h2) below (b1, b2), and ``m`` of the ``n`` rows at it."""
    goal = stage(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goal.select(
        "source", (F.col("target") - passes * F.col("source_size")).alias("budget"), F.lit(0).cast("double").alias("base"), F.lit(0).cast("long").alias("first"),
        F.lit(0).cast("long").alias("path"), F.lit(None).cast("double").alias("edge"), F.lit(None).cast("long").alias("n"),
    ).where("budget > 0")
    counted = sized.where("size > 0")
    for level in range(2 * LEVELS):
        if level == LEVELS:  # one id: on to the text
            state = state.select("source", "budget", "base", F.col("path").alias("first"), F.lit(0).cast("long").alias("path"), "edge", "n")
        shift = LEVEL_BITS * (LEVELS - 1 - level % LEVELS)
        h = F.col("d.h1") if level < LEVELS else F.col("d.h2")
        same = F.col("d.source").eqNullSafe(F.col("s.source")) & (F.shiftright(h, shift + LEVEL_BITS) == F.col("s.path"))
        if level >= LEVELS:
            same &= F.col("d.h1") == F.col("s.first")
        left = counted.alias("d").join(state.alias("s"), same)
        histogram = left.groupBy("s.source", "budget", "base", "first", F.shiftright(h, shift).alias("path")).agg(
            F.sum("size").cast("double").alias("words"), F.count("*").alias("n")
        )
        running = F.sum("words").over(Window.partitionBy("source").orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
        state = stage(
            histogram.withColumn("upto", F.col("base") + running)
            .where("upto >= budget and upto - words < budget")
            .select("source", "budget", (F.col("upto") - F.col("words")).alias("base"), "first", "path", F.col("words").alias("edge"), "n"),
            "mix-level",
        )
        if state.where("n > 1").isEmpty():
            break
    # How many rows at the threshold bring the source nearest to its target; in halves, the fewer.
    nearest = F.ceil((F.col("budget") - F.col("base")) / (F.col("edge") / F.col("n")) - 0.5).cast("long")
    begin = F.shiftleft("path", shift)
    if level == 2 * LEVELS - 1:  # rows of one hash; on other levels there is one row, whose whole bucket is in or out
        ends = [F.col("first"), begin, nearest, F.col("n")]
    else:
        limit = F.shiftleft(F.col("path") + (nearest > 0).cast("long"), shift)
        none = F.lit(0).cast("long")
        ends = [F.col("first"), limit, none, none] if level >= LEVELS else [limit, none, none, none]
    plan = goal.alias("g").join(state.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source")), "left")
    zero = F.lit(0).cast("long")
    return plan.select(
        F.col("g.source").alias("name"), "source_size", "target", passes.alias("passes"), *(F.coalesce(e, zero).alias(k) for e, k in zip(ends, ("b1", "b2", "m", "n")))
    )


def take(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` rows (source, size, h1, h2 and more) with source_size, target and ``copies``."""
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("name")))
    at = (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2"))
    below = (F.col("h1") < F.col("b1")) | (F.col("h1") == F.col("b1")) & (F.col("h2") < F.col("b2"))
    some = (F.col("m") > 0) & (F.col("m") < F.col("n"))  # rows at the threshold of which some are taken
    more = below | at & (F.col("m") >= F.col("n")) & (F.col("m") > 0)
    copies = F.when(F.col("size") > 0, F.col("passes") + more.cast("long")).otherwise(F.lit(0).cast("long"))
    kept = [*sized.columns, "source_size", "target"]
    if plan.where(some).isEmpty():
        return joined.select(*kept, copies.alias("copies"))
    split = stage(joined.where(at & some & (F.col("size") > 0)).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))), "mix-alike")
    sizes = split.groupBy("source", "part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("source").orderBy("part")) - F.col("rows")  # at most PARTS rows a source
    starts = stage(sizes.select(F.col("source").alias("of"), F.col("part").alias("in"), before.alias("before")), "mix-parts")
    nth = F.row_number().over(Window.partitionBy("source", "part").orderBy(F.lit(0))) + F.col("before")
    numbered = split.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in"))).withColumn("nth", nth)
    numbered = numbered.select(*kept, (F.col("passes") + (F.col("nth") <= F.col("m")).cast("long")).alias("copies"))
    return joined.where(~(at & some & (F.col("size") > 0))).select(*kept, copies.alias("copies")).unionByName(numbered)


def mix_sources(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies and taken = copies * size."""
    sized = stage(_sized(docs, "doc_id"), "mix-sizes")
    taken = take(sized, thresholds(sized, weights, share, most))
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """The rows of ``docs`` that the mix takes, all columns as they are, and last the number of times: ``copies``, with ``_mixed``
    added to that name as long as ``docs`` has it. Texts are read twice and not shuffled, unless sources are too many to broadcast.
    """
    plan = stage(thresholds(stage(_sized(docs), "mix-sizes"), weights, share, most), "mix-plan")
    name = "copies"
    while name in docs.columns:
        name += "_mixed"
    taken = take(_sized(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), plan).where("copies > 0")
    return taken.select(*(F.col(f"row.`{c}`") for c in docs.columns), F.col("copies").cast("int").alias(name))


#: The same over tables of any engine with window functions; %s is the table of documents.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h1, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h2
  FROM %s),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) %% 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
b AS (SELECT *, 2.0::DOUBLE * source_size / weight AS full_at, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w),
c AS (SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY full_at, source_size, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER (ORDER BY full_at, source_size, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM b),
l AS (SELECT max((budget - capped) / free) FILTER ((budget - capped) / free <= full_at) AS level FROM c),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * level) AS target FROM b, l),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
r AS (SELECT d.*, k.source_size, k.target, k.passes, k.target - k.passes * k.source_size AS rest,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY h1, h2) - sum(d.size) OVER (PARTITION BY d.source, h1, h2))::DOUBLE AS before,
             row_number() OVER (PARTITION BY d.source, h1, h2) AS nth
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE passes + CASE WHEN rest > 0 AND nth <= ceil((rest - before) / size - 0.5::DOUBLE) THEN 1 ELSE 0 END END * size)::BIGINT AS taken
FROM r
"""
