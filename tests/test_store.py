"""Collected documents: a stopped job leaves nothing that counts, and a rerun gives each key once."""
import json

import pytest
from pyspark.sql import DataFrame, DataFrameWriter

from reviewloom.plans import jobs
from reviewloom.plans.curate import curate_documents, curate_large_documents
from reviewloom.sources import places, sinks
from reviewloom.sources.documents import parse_documents, scan_documents
from reviewloom.sources.store import DocumentStore
from reviewloom.streaming.incremental import batch_writer, curate_new_documents
from tests.test_documents import AS_OF, CASES, review
from tests.test_extract import card, pages, place


class Stopped(Exception):
    pass


@pytest.fixture
def collected(spark, tmp_path):
    stored = str(tmp_path / "pages")
    pages(spark, place(card()), place(card(text="x") + card(text="y")), place(card(text="z"))).write.parquet(stored)
    listed = spark.createDataFrame([(i, f"P{i}", f"https://m/{i}") for i in range(3)], "pos bigint, place_name string, gmaps_url string")
    sinks.write_places(listed, str(tmp_path / "places"))
    return lambda: jobs.collect_job(spark, str(tmp_path / "places"), stored, str(tmp_path / "docs"), unusable_path=str(tmp_path / "no"))


def writes(monkeypatch, stop_at=None):
    """Count writes; the one numbered ``stop_at`` is the last that happens."""
    done = []
    for name in ("parquet", "json"):
        original = getattr(DataFrameWriter, name)

        def write(self, path, *args, _original=original, **kw):
            _original(self, path, *args, **kw)
            done.append(path)
            if len(done) == stop_at:
                raise Stopped

        monkeypatch.setattr(DataFrameWriter, name, write)
    return done


N_WRITES = 8  # places, unusable, to-do, pages, documents; then the batch: documents, keys, manifest


@pytest.mark.parametrize("stop_at", range(1, N_WRITES + 1))
def test_stopped_after_any_write_and_run_again(spark, tmp_path, monkeypatch, collected, stop_at):
    with monkeypatch.context() as m, pytest.raises(Stopped):
        writes(m, stop_at)
        collected()
    store = DocumentStore(spark, str(tmp_path / "docs"))
    assert store.keys().count() == (3 if stop_at == N_WRITES else 0)
    assert len(store.leftovers()) == max(0, min(stop_at, N_WRITES - 1) - 5) * (stop_at < N_WRITES)
    again = collected()
    assert again.written == (stop_at < N_WRITES)
    for rebuild in (False, True):
        assert sorted(r.doc_key for r in store.keys(rebuild=rebuild).collect()) == ["P0", "P1", "P2"]
    out = jobs.curate_job(spark, str(tmp_path / "docs"), str(tmp_path / "final"), as_of=AS_OF)
    assert out.counts == {"documents": 3, "reviews": 4, "rejected": 0, "places": 3} and out.n_rows == 4


def test_number_of_writes_and_no_job_only_counts(spark, tmp_path, monkeypatch, collected):
    def refuse(*_):
        raise AssertionError("a job that only counts")

    with monkeypatch.context() as m:
        done = writes(m)
        m.setattr(DataFrame, "count", refuse)
        m.setattr(DataFrame, "isEmpty", refuse)
        out = collected()
        assert len(done) == N_WRITES
        assert out.counts == {"places": 3, "unusable_places": 0, "places_to_do": 3, "documents": 3, "reviews": 4}
        assert jobs.curate_job(spark, str(tmp_path / "docs"), str(tmp_path / "final"), as_of=AS_OF).n_rows == 4
        assert not collected().written


def test_batches_with_an_id_and_files_from_elsewhere(spark, tmp_path):
    path = str(tmp_path / "docs")
    store = DocumentStore(spark, path)
    assert store.keys().collect() == [] and store.batches() == []

    def documents(*keys):
        rows = [(k, {"name": k}, [(k, "t")]) for k in keys]
        return spark.createDataFrame(rows, "doc_key string, place_info struct<name:string>, reviews array<struct<user_name:string,text:string>>")

    sinks.write_documents(documents("old"), path)
    assert store.keys().collect() == [("old",)] and store.visible_paths() == [path]
    assert store.commit(documents("a", "b"), batch="1") and not store.commit(documents("a", "b"), batch="1")
    assert not store.commit(documents(), batch="2")
    sinks.write_documents(documents("lost"), f"{path}/batch=3")  # as a stopped job leaves it
    (tmp_path / "docs" / "alone.json").write_text(json.dumps({"reviews": [review()]}, indent=1))
    assert sorted(r.doc_key for r in store.keys().collect()) == ["a", "b", "old"]
    assert [r.asDict() for r in store.committed().collect()] == [{"batch": "1", "n_documents": 2, "n_reviews": 2}]
    files = {r.file.rsplit("/", 1)[-1] for r in parse_documents(scan_documents(spark, path)).collect()}
    assert files == {"a", "b", "old", "alone.json"}
    assert [p.rsplit("/", 1)[1] for p in store.leftovers()] == ["batch=3"]
    assert store.commit(documents("c"), batch="3") and store.leftovers() == []
    assert sorted(r.doc_key for r in store.keys().collect()) == ["a", "b", "c", "old"]
    with pytest.raises(ValueError, match="pattern"):
        scan_documents(spark, path, pattern="*")


def test_copy_of_the_places(spark, tmp_path):
    rows = [(f"https://l/{i}", "".join(f'<a class="hfpxzc" aria-label="p{i}_{k}" href="u"></a>' for k in range(20))) for i in range(8)]
    spark.createDataFrame(rows, "url string, html string").write.parquet(str(tmp_path / "listing"))
    path = str(tmp_path / "places")
    jobs.list_job(spark, str(tmp_path / "listing"), path)
    from_csv, copy = places.scan_places(spark, path), places.read_places(spark, path)
    names = [[r.place_name for r in df.orderBy("pos").collect()] for df in (from_csv, copy)]
    assert names[0] == names[1] and len(names[0]) == 160
    assert "csv" not in copy.inputFiles()[0] and copy.rdd.getNumPartitions() > 1
    sinks.write_places(copy.limit(3), path)  # the list is another one now
    assert places.read_places(spark, path).count() == 3
    assert places.read_places(spark, path).inputFiles()[0].endswith(".csv")


# ---- names of lines, large documents, the stream ---------------------------------------------


def test_same_sample_from_any_files(spark, tmp_path):
    lines = [json.dumps({"reviews": [review(user=f"u{d}_{i}", text=f"t{i}", rating=i % 6) for i in range(40)]}) for d in range(6)]
    lines += [lines[0], lines[0], json.dumps({"doc_key": 5, "reviews": [review()]})]
    got = []
    for n in (1, 3, 7):
        path = str(tmp_path / f"docs{n}")
        spark.createDataFrame([(x,) for x in lines], "value string").repartition(n).write.text(path)
        raw = scan_documents(spark, path, layout="line", pattern="*.txt")
        assert "get_json_object" not in raw._jdf.queryExecution().toString()
        out = curate_documents(raw, as_of=AS_OF, cap=10, keep_ids=True)
        assert "get_json_object" not in out._jdf.queryExecution().toString()
        got.append(sorted(map(str, out.collect())))
        assert len(got[-1]) == 8 * 10 + 1
    assert got[0] == got[1] == got[2]


def test_copies_are_numbered(spark):
    from reviewloom.operators.dedup import number_copies

    df = spark.createDataFrame([(k, k) for k in "abacacaa"] + [(None, "n")], "key string, v string")
    df = sinks.stage(df.repartition(3), "copies")
    for splits in (1, 2, 256):
        got = sorted((str(r.key), r.v) for r in number_copies(df, "key", splits=splits).collect())
        assert got == [("None", "n"), ("a", "a"), *((f"a#{i}", "a") for i in range(2, 6)), ("b", "b"), ("c", "c"), ("c#2", "c")]


@pytest.fixture
def every_case(spark):
    rows = [(name, text) for name, (text, _, _) in CASES.items()]
    rows += [("many", json.dumps({"place_info": {"name": "N", "avg_rating": 4}, "reviews": [review(user=f"u{i % 90}", text=f"t{i % 70}", rating=i % 7) for i in range(400)]}))]
    rows += [("line:1", json.dumps({"doc_key": "k", "reviews": [review()]})), ("spaced", '{"reviews": { }}'), ("blank", '{"reviews": ""}')]
    return spark.createDataFrame(rows, "file string, value string")


def test_large_documents_are_read_alike(spark, every_case):
    want = sorted(map(str, curate_documents(every_case, as_of=AS_OF, keep_ids=True, raw_rating=True).collect()))
    final, documents = curate_large_documents(every_case, as_of=AS_OF, keep_ids=True, raw_rating=True)
    assert sorted(map(str, final.collect())) == want and len(want) > 150
    small, large = (sorted((r.file, str(r.reject_reason)) for r in df.select("file", "reject_reason").collect()) for df in (parse_documents(every_case), documents))
    assert large == small
    twice, documents = curate_large_documents(every_case.where("file = 'many'").union(every_case.where("file = 'many'")), as_of=AS_OF, keep_ids=True)
    assert {r["file"]: r["count"] for r in twice.groupBy("file").count().collect()} == {"many": 150, "many#2": 150}


def test_too_large_documents_go_through_the_table_path(spark, tmp_path, monkeypatch, every_case):
    """With the first reader made to refuse everything."""
    want, _, counts = jobs.curated(every_case, as_of=AS_OF)
    plain = jobs.sampled_documents

    def refusing(raw, **options):
        from pyspark.sql import functions as F

        refused = plain(raw, **options)
        lost = (F.col("reject_reason").isNull() & F.col("file").isin("many", "good")) | (F.col("file") == "array")
        return refused.withColumns({
            "reject_reason": F.when(lost, "too_large").otherwise(F.col("reject_reason")), "reviews": F.when(~lost, F.col("reviews")), "n_reviews": F.when(lost, 0).otherwise(F.col("n_reviews")),
        })

    monkeypatch.setattr(jobs, "sampled_documents", refusing)
    got, rejects, again = jobs.curated(every_case, as_of=AS_OF)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and again == counts
    assert ("array", "not_an_object") in [tuple(r) for r in rejects.collect()]


def test_stream_writes_rejects_and_replays_add_nothing(spark, tmp_path):
    docs, final, no, checkpoint = tmp_path / "docs", str(tmp_path / "final"), str(tmp_path / "no"), str(tmp_path / "cp")
    docs.mkdir()
    seen = []

    def run():
        curate_new_documents(spark, str(docs), final, checkpoint, rejects_path=no, as_of=AS_OF, on_counts=lambda b, c: seen.append((b, c))).awaitTermination(120)
        return spark.read.parquet(final).count(), sorted((r.file.rsplit("/", 1)[1], r.reject_reason) for r in spark.read.parquet(no).collect())

    (docs / "a.json").write_text(json.dumps({"reviews": [review(), review(text="b")]}))
    (docs / "bad.json").write_text('{"reviews": [')
    (docs / "twice.json").write_text('{"reviews": [], "reviews": [{"text": "last"}]}')
    first = run()
    assert first == (3, [("bad.json", "malformed_json")]) and seen[-1][1]["documents"] == 3
    (docs / "list.json").write_text("[1]")
    second = run()
    assert second == (3, [("bad.json", "malformed_json"), ("list.json", "not_an_object")])
    batch_writer(final, no, as_of=AS_OF)(scan_documents(spark, str(docs / "list.json"), layout="file"), seen[-1][0])  # the last batch once more
    assert run() == second


def test_stream_takes_committed_batches(spark, tmp_path, collected):
    collected()
    docs, final, checkpoint = str(tmp_path / "docs"), str(tmp_path / "final"), str(tmp_path / "cp")
    sinks.write_documents(spark.read.json(f"{docs}/batch=*"), f"{docs}/batch=lost")

    def run():
        curate_new_documents(spark, docs, final, checkpoint, layout="store", as_of=AS_OF).awaitTermination(120)
        return spark.read.parquet(final).count()

    assert run() == run() == 4


def test_pages_of_a_store_are_not_shuffled(spark, tmp_path):
    from reviewloom.plans.collect import collect_documents, places_to_do, wanted_pages
    from reviewloom.sources.pages import read_pages, write_page_store

    stored, path = pages(spark, *[place(card(text=f"t{i}")) for i in range(30)]), str(tmp_path / "store")
    stored.write.parquet(str(tmp_path / "plain"))
    listed = spark.createDataFrame([(i, f"P{i}", f"https://m/{i}") for i in range(0, 30, 3)], "pos bigint, place_name string, gmaps_url string")
    write_page_store(stored, path, 4)
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("pages_")]:
        spark.sql(f"DROP TABLE {name}")  # as another session finds it
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, plain = read_pages(spark, path), read_pages(spark, str(tmp_path / "plain"))
        exchanged = []
        for table in (got, plain):
            plan = wanted_pages(places_to_do(listed), table)._jdf.queryExecution().executedPlan().toString()
            exchanged.append(plan.count("Exchange hashpartitioning"))
        assert exchanged == [1, 2] and "Bucketed: true" in wanted_pages(places_to_do(listed), got)._jdf.queryExecution().toString()
        assert sorted(map(str, collect_documents(listed, got).collect())) == sorted(map(str, collect_documents(listed, plain).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sinks.write_places(listed, str(tmp_path / "places"))
    assert jobs.collect_job(spark, str(tmp_path / "places"), path, str(tmp_path / "docs")).n_rows == 10
    spark.sql(f"DROP TABLE {[t.name for t in spark.catalog.listTables() if t.name.startswith('pages_')][0]}")
