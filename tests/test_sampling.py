import hashlib
import json
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from reviewloom.operators.dedup import first_positions, keep_first, signature
from reviewloom.operators.sample import choose_sample, fetch_stored, first_n, may_hold, stratified_sample
from reviewloom.plans.curate import curate_documents, curate_reviews
from reviewloom.sources.documents import accepted, document_reviews, parse_documents, place_fields

SCHEMA = "file string, pos bigint, rating_bucket int"


def rows_of(sizes, file="f"):
    """sizes = rows in buckets 1, 2, 3, 4, 5, 0."""
    out = []
    for star, n in zip((1, 2, 3, 4, 5, 0), sizes):
        out += [(file, len(out) + k, star) for k in range(n)]
    return out


def key(purpose, file, pos, seed=42):
    return hashlib.md5(f"{seed}:{purpose}:{file}:{pos}".encode()).hexdigest(), pos


def brute_force(rows, cap, seed=42):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    out = set()
    for file, group in groups.items():
        if len(group) <= cap:
            out |= {(f, p) for f, p, _ in group}
            continue
        core = set()
        for star in range(1, 6):
            own = sorted(key("core", file, p, seed) for _, p, s in group if s == star)
            core |= {p for _, p in own[: cap // 5]}
        rest = sorted(key("fill", file, p, seed) for _, p, _ in group if p not in core)
        out |= {(file, p) for p in core} | {(file, p) for _, p in rest[: cap - len(core)]}
    return out


def sample(spark, rows, cap, parts=3, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return {(r.file, r.pos) for r in choose_sample(df, "file", "rating_bucket", "pos", cap, **kw).collect()}


@pytest.mark.parametrize(
    "cap,sizes,stars",
    [
        (150, (10, 10, 10, 10, 10, 100), (10, 10, 10, 10, 10, 100)),
        (150, (40, 40, 40, 40, 40, 0), (30, 30, 30, 30, 30, 0)),
        (150, (5, 5, 5, 5, 300, 0), (5, 5, 5, 5, 130, 0)),
        (150, (0, 0, 0, 0, 0, 200), (0, 0, 0, 0, 0, 150)),
        (150, (100, 0, 0, 0, 0, 100), (30, 0, 0, 0, 0, None)),
        (4, (10, 0, 0, 0, 0, 0), (4, 0, 0, 0, 0, 0)),
        (0, (3, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0)),
    ],
)
def test_sample_sizes(spark, cap, sizes, stars):
    rows = rows_of(sizes)
    got = sample(spark, rows, cap)
    assert len(got) == min(cap, len(rows))
    by_star = Counter(s for f, p, s in rows if (f, p) in got)
    for star, n in zip((1, 2, 3, 4, 5, 0), stars):
        if n is not None:
            assert by_star[star] >= n
    assert got == brute_force(rows, cap)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 25), min_size=6, max_size=6), min_size=1, max_size=4), st.integers(1, 40))
def test_sample_against_brute_force(spark, groups, cap):
    rows = [r for i, sizes in enumerate(groups) for r in rows_of(sizes, f"f{i}")]
    if rows:
        assert sample(spark, rows, cap) == brute_force(rows, cap)


def test_sample_does_not_depend_on_partitions(spark):
    rows = rows_of((300, 10, 60, 0, 900, 50)) + rows_of((1, 2, 3, 4, 5, 6), "g")
    expected = brute_force(rows, 50)
    for parts in (1, 7, 16):
        assert sample(spark, rows, 50, parts=parts) == expected
    assert sample(spark, rows, 50, seed=1) == brute_force(rows, 50, seed=1) != expected


def test_hot_group_is_cut_before_the_shuffle(spark):
    """One file with nearly all rows: each map task passes on at most `cap` rows per list."""
    from pyspark.sql import functions as F

    df = spark.range(60000, numPartitions=4).select(
        F.when(F.col("id") % 50 == 0, F.lit("small")).otherwise(F.lit("hot")).alias("file"),
        F.col("id").alias("pos"),
        (F.col("id") % 6).cast("int").alias("rating_bucket"),
    )
    out = stratified_sample(df, "file", "rating_bucket", "pos", 100)
    assert {r.file: r["count"] for r in out.groupBy("file").count().collect()} == {"hot": 100, "small": 100}
    chosen = choose_sample(df, "file", "rating_bucket", "pos", 100)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_collect_top_k" in plan


def shuffled_bytes(spark, df):
    """Bytes that the write of ``df`` shuffles, from Spark's own metrics of its stages."""
    store = spark._jsc.sc().statusStore()
    known = {s.stageId() for s in iterate(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
    df.write.format("noop").mode("overwrite").save()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    stages = iterate(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))
    return sum(s.shuffleWriteBytes() for s in stages if s.stageId() not in known)


def iterate(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_rows_that_cannot_win_are_not_shuffled(spark):
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 256) for k in range(40)])
        reviews = spark.range(20_000, numPartitions=4).select(
            F.concat(F.lit("f"), (F.col("id") % 5).cast("string")).alias("file"), F.col("id").alias("pos"), F.lit("u").alias("user_name"),
            text.alias("text"), F.lit("").alias("time"), F.lit(3).alias("rating"), F.lit(3).alias("rating_bucket"),
        )
        out = curate_reviews(reviews, as_of="2024-01-30", cap=150, keep_ids=True)
        rows = out.collect()
        assert len(rows) == 750
        assert shuffled_bytes(spark, out) < 2 * sum(len(r.review_text) for r in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_filter_loses_nothing_and_lets_little_through(spark):
    from pyspark.sql import functions as F

    df = spark.range(200_000).select((F.col("id") % 1000).cast("string").alias("file"), F.when(F.col("id") > 0, F.col("id")).alias("pos"))
    for chosen in (df.where("pos % 40 = 3"), df.where("pos is null"), df.limit(0)):
        n = chosen.count()
        kept = may_hold(df, chosen, ["file", "pos"], n)
        assert kept.join(chosen, (kept.file == chosen.file) & kept.pos.eqNullSafe(chosen.pos), "left_semi").count() == n
        assert kept.count() <= n + 200
        exact = {tuple(r) for r in chosen.collect()}
        for limit in (0, 1 << 20):
            assert {tuple(r) for r in fetch_stored(df, chosen, ["file", "pos"], n, filter_bytes=limit).collect()} == exact


def test_keep_first(spark):
    rows = [("a", "t", 3, "c"), ("a", "t", 1, "x"), ("a", "T", 2, "y"), ("b", "t", 9, "z"), ("b", "t", 10, None)]
    df = spark.createDataFrame(rows, "file string, text string, pos bigint, other string").repartition(3)
    once = keep_first(df, ["file", "text"], ["pos"])
    got = {tuple(r) for r in once.collect()}
    assert got == {rows[1], rows[2], rows[3]}
    assert {tuple(r) for r in keep_first(once, ["file", "text"], ["pos"]).collect()} == got
    narrow = first_positions(df, ["file", "text"], "pos")
    assert {tuple(r) for r in narrow.collect()} == {r[:3] for r in got}


def test_keep_first_with_null_first_row(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5)], "k string, pos bigint, v int")
    assert first_positions(df, ["k"], "pos", ["v"]).collect()[0].asDict() == {"k": "a", "pos": 1, "v": None}


def test_signature_keeps_texts_apart(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("a:1", "b"), ("", "abc")], "a string, b string")
    assert df.select(signature(F.col("a"), F.col("b"))).distinct().count() == 4


def test_first_n_beyond_the_limit_splits_a_hot_group(spark):
    df = spark.range(20000).selectExpr("if(id % 10 = 0, null, 'hot') as g", "id as pos")
    got = first_n(df, ["g"], ["pos"], 5000)
    assert [tuple(r) for r in got.groupBy("g").agg({"pos": "max", "*": "count"}).select("g", "count(1)", "max(pos)").orderBy("g").collect()] == [
        (None, 2000, 19990), ("hot", 5000, 5555)
    ]
    assert "_split" in got._jdf.queryExecution().optimizedPlan().toString()


def test_null_groups_and_ids_stay(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, None, 3), ("a", None, 1), ("a", 2, 2)], "file string, pos long, star int")
    assert stratified_sample(df, "file", "star", "pos", 150).count() == 4


def test_first_n(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 5)], "g string, pos bigint")
    assert {tuple(r) for r in first_n(df, ["g"], ["pos"], 2).collect()} == {("a", 0), ("a", 1), ("b", 5)}


def make_documents():
    docs = []
    for d in range(6):
        reviews = [
            {"user_name": f"U{i % 7}", "text": f"text  {i % (40 * d + 1)}", "rating": (i * 7 + d) % 8, "time": f"{i} hari"}
            for i in range(d * 60)
        ]
        docs.append((f"doc{d}", json.dumps({"place_info": {"name": f"P{d}"}, "reviews": reviews})))
    return docs


@pytest.mark.parametrize("cap", [3, 20, 150])
def test_nested_and_table_paths_agree(spark, cap):
    raw = spark.createDataFrame(make_documents(), "file string, value string")
    docs = accepted(parse_documents(raw))
    place_columns = [c for c in place_fields(docs).columns if c.startswith("place_")]
    places = place_fields(docs).select("file", *place_columns)
    kw = dict(as_of="2024-01-30 01:00:00", cap=cap, keep_ids=True)
    nested = curate_documents(raw, **kw)
    tall = curate_reviews(document_reviews(docs), places, **kw)
    assert nested.columns == tall.columns
    assert nested.schema.simpleString() == tall.schema.simpleString()
    left, right = ({tuple(r) for r in df.collect()} for df in (nested, tall))
    assert left == right and len(left) > 3 * cap
    assert "Exchange" not in nested._jdf.queryExecution().executedPlan().toString()
