import glob
import json

import pytest
from pyspark.errors import AnalysisException

from reviewloom.operators.tables import FINAL_COLUMNS, project_order, run_counts, union_all, value_distribution
from reviewloom.plans.collect import collect_documents
from reviewloom.plans.jobs import collect_job, curate_job, list_job
from reviewloom.sources import sinks
from reviewloom.sources.places import complete_places, incomplete_places, scan_places
from reviewloom.sources.store import DocumentStore
from reviewloom.streaming.incremental import curate_new_documents
from tests.test_extract import LISTING, card, pages, place

AS_OF = "2024-01-30 01:00:00"


def places_of(spark, *rows):
    return spark.createDataFrame([(i, n, u) for i, (n, u) in enumerate(rows)], "pos bigint, place_name string, gmaps_url string")


def csv_bytes(path):
    return b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/part-*")))


AWKWARD = [(' "Pantai", A ', "https://m/1"), ("two\nlines", "u,v"), ("café – 水", 'q"q'), ("back\\slash", "x")]


def test_places_csv_roundtrip(spark, tmp_path):
    path = str(tmp_path / "places")
    assert sinks.write_places(places_of(spark, *AWKWARD).coalesce(1), path)
    got = scan_places(spark, path).orderBy("pos").collect()
    assert [(r.place_name, r.gmaps_url) for r in got] == AWKWARD
    import pandas as pd

    expected = pd.DataFrame(AWKWARD, columns=["place_name", "gmaps_url"]).to_csv(index=False)
    assert csv_bytes(path).decode() == expected


def test_places_keep_their_order_over_part_files(spark, tmp_path):
    path = str(tmp_path / "places")
    names = [f"place {i:03} {'x' * (i % 50)}" for i in range(100)]
    sinks.write_places(places_of(spark, *[(n, "u") for n in names]).repartitionByRange(7, "pos"), path)
    assert [r.place_name for r in scan_places(spark, path).orderBy("pos").collect()] == names


def test_missing_places_file(spark, tmp_path):
    with pytest.raises(AnalysisException):
        scan_places(spark, str(tmp_path / "none"))


def test_incomplete_places(spark, tmp_path):
    (tmp_path / "p.csv").write_text("place_name,gmaps_url\nA,https://m/1\n,https://m/2\nB,\n")
    places = scan_places(spark, str(tmp_path / "p.csv"))
    assert [r.place_name for r in complete_places(places).collect()] == ["A"]
    assert incomplete_places(places).count() == 2


def test_final_csv_has_mark_and_pandas_layout(spark, tmp_path):
    row = ("7c9", 5, 'bagus, "sekali"', "", "P", "", "c", "a, b", "", 12, 4.5)
    types = {"user_rating": "int", "place_total_reviews_gmaps": "bigint", "place_avg_rating": "double"}
    schema = ", ".join(f"{c} {types.get(c, 'string')}" for c in FINAL_COLUMNS)
    final = spark.createDataFrame([row, (*row[:1], None, *row[2:])], schema).coalesce(1)
    path = str(tmp_path / "final")
    assert sinks.write_final(final, path)
    line = '"bagus, ""sekali""",,P,,c,"a, b",,12,4.5\n'
    assert csv_bytes(path).decode() == "\ufeff" + ",".join(FINAL_COLUMNS) + "\n7c9,5," + line + "7c9,," + line
    assert {tuple(r) for r in sinks.read_final(spark, path, schema).collect()} == {tuple(r) for r in final.collect()}


def test_empty_input_leaves_old_output(spark, tmp_path):
    path = str(tmp_path / "places")
    sinks.write_places(places_of(spark, ("A", "u")), path)
    assert not sinks.write_places(places_of(spark, ("A", "u")).limit(0), path)
    assert scan_places(spark, path).count() == 1


def test_first_place_with_a_page_wins(spark):
    stored = pages(spark, place(card()), "<p>not a place</p>", place(card(text="x")))
    listed = places_of(
        spark,
        ("Same!", "https://m/1"),  # its page does not qualify
        ("Same?", "https://m/0"),
        ("Same", "https://m/2"),
        ("Other", "https://m/2"),
        ("Gone", "https://m/9"),
        ("", "https://m/0"),
    )
    got = {r.doc_key: r for r in collect_documents(listed, stored).collect()}
    assert {k: r.place_info.name for k, r in got.items()} == {"Same": "Same?", "Other": "Other"}
    assert [x.text for x in got["Same"].reviews] == ["bagus"]
    done = spark.createDataFrame([("Same",)], "doc_key string")
    assert [r.doc_key for r in collect_documents(listed, stored, done).collect()] == ["Other"]


def test_jobs_end_to_end(spark, tmp_path):
    listing, stored = str(tmp_path / "listing"), str(tmp_path / "pages")
    pages(spark, LISTING).write.parquet(listing)
    pages(spark, "<p>x</p>", place(card() + card() + card(text="lain", stars=2))).write.parquet(stored)
    places, docs, final = (str(tmp_path / n) for n in ("places", "docs", "final"))

    listed = list_job(spark, listing, places)
    assert (listed.written, listed.n_rows, listed.report.count()) == (True, 2, 2)
    collected = collect_job(spark, places, stored, docs)
    assert (collected.written, collected.n_rows) == (True, 1)
    again = collect_job(spark, places, stored, docs)
    assert (again.written, again.n_rows) == (False, 0)
    line = json.loads(csv_bytes(f"{docs}/batch=*"))
    assert line["doc_key"] == "Pantai  Co" and len(line["reviews"]) == 3
    assert "Pantai & Co" in csv_bytes(f"{docs}/batch=*").decode()

    assert collected.counts == {"places": 2, "unusable_places": 0, "places_to_do": 2, "documents": 1, "reviews": 3}
    store = DocumentStore(spark, docs)
    assert store.keys().collect() == store.keys(rebuild=True).collect() == [("Pantai  Co",)]

    rejects = str(tmp_path / "rejects")
    out = curate_job(spark, docs, final, as_of=AS_OF, rejects_path=rejects)
    assert out.counts == {"documents": 1, "reviews": 3, "rejected": 0, "places": 1}
    assert (out.written, out.n_rows) == (True, 2)
    assert [tuple(r) for r in out.report.collect()] == [(2, 1), (4, 1)]
    assert spark.read.parquet(rejects).count() == 0
    assert csv_bytes(final).startswith("\ufeffuser_id,".encode())


def test_both_layouts_in_one_folder_and_rejects_counted(spark, tmp_path):
    docs, review = tmp_path / "docs", {"user_name": "Ann", "text": "bagus", "rating": 4.5, "time": "1 hari lalu"}
    lines = [json.dumps({"doc_key": f"k{i}", "reviews": [review]}) for i in range(20)]
    spark.createDataFrame([(x,) for x in [*lines, "{", ""]], "value string").coalesce(1).write.text(str(docs))
    for f in docs.glob("part-*.txt"):
        f.rename(str(f).replace(".txt", ".json"))
    (docs / "single.json").write_text(json.dumps({"reviews": [review, {**review, "rating": 9999999999, "text": "x"}]}, indent=2))
    (docs / "twice.json").write_text('{"reviews": [], "reviews": [{"text": "last"}]}')
    (docs / "bad.json").write_text("{}]")
    out = curate_job(spark, str(docs), str(tmp_path / "final"), as_of=AS_OF, raw_rating=True)
    assert out.n_rows == 23 and out.counts == {"documents": 24, "reviews": 23, "rejected": 2, "rejected_malformed_json": 2, "places": 22}
    rows = spark.read.csv(str(tmp_path / "final"), header=True)
    assert {r.user_rating_raw for r in rows.collect()} == {"4.5", "9999999999", None} and rows.where("user_rating = '0'").count() == 1


def test_listing_order_is_kept(spark, tmp_path):
    rows = [(f"https://l/{i}", "".join(f'<a class="hfpxzc" aria-label="p{i}_{k}" href="u"></a>' for k in range(1 + 9 * i))) for i in range(4)]
    spark.createDataFrame(rows, "url string, html string").repartition(4).write.parquet(str(tmp_path / "listing"))
    out = list_job(spark, str(tmp_path / "listing"), str(tmp_path / "places"))
    want = [f"p{i}_{k}" for i in range(4) for k in range(1 + 9 * i)]
    assert [r.place_name for r in out.report.collect()] == want[:5] and out.counts == {"pages": 4, "places": len(want)}
    assert [r.place_name for r in scan_places(spark, str(tmp_path / "places")).orderBy("pos").collect()] == want


def test_versions_of_a_page_and_unusable_places(spark, tmp_path):
    versions = [("https://m/0", place(card(text=t)), n) for t, n in (("old", 1), ("new", 3), ("middle", 2))] + [("https://m/0", "<p>none</p>", 9)]
    for order in (versions, versions[::-1]):
        stored = spark.createDataFrame(order, "url string, html string, fetched int").repartition(2)
        got = collect_documents(places_of(spark, ("A", "https://m/0")), stored, newest="fetched").collect()
        assert [x.text for r in got for x in r.reviews] == ["new"]
    assert len({str(collect_documents(places_of(spark, ("A", "https://m/0")), spark.createDataFrame(o, "url string, html string, fetched int")).collect()) for o in (versions, versions[::-1])}) == 1
    sinks.write_places(places_of(spark, ("A", "https://m/0"), ("?!", "https://m/0"), ("", "https://m/1"), ("B", "")), str(tmp_path / "places"))
    stored.write.parquet(str(tmp_path / "pages"))
    out = collect_job(spark, str(tmp_path / "places"), str(tmp_path / "pages"), str(tmp_path / "docs"), unusable_path=str(tmp_path / "no"))
    assert out.n_rows == 1 and out.counts["unusable_places"] == 3
    assert sorted(r.reason for r in spark.read.parquet(str(tmp_path / "no")).collect()) == ["incomplete", "incomplete", "no_key"]


def test_only_wanted_pages_are_read(spark):
    stored = pages(spark, place(card()), place(card()))
    done = spark.createDataFrame([("Same",)], "doc_key string")
    from reviewloom.plans.collect import places_to_do, wanted_pages
    from reviewloom.operators.extract import place_pages

    plan = place_pages(wanted_pages(places_to_do(places_of(spark, ("Same", "https://m/0"), ("B", "https://m/1")), done), stored))
    tree = plan._jdf.queryExecution().executedPlan().toString()
    assert 0 <= tree.index("MapInArrow") < tree.index("LeftSemi")


def test_stream_takes_each_file_once(spark, tmp_path):
    docs, final, checkpoint = tmp_path / "docs", str(tmp_path / "final"), str(tmp_path / "cp")
    docs.mkdir()
    review = {"user_name": "Ann", "text": "bagus", "rating": 5, "time": "1 hari lalu"}

    def run():
        curate_new_documents(spark, str(docs), final, checkpoint, as_of=AS_OF).awaitTermination(120)
        return spark.read.parquet(final).count()

    (docs / "a.json").write_text(json.dumps({"reviews": [review, review]}))
    assert run() == 1
    (docs / "b.json").write_text(json.dumps({"reviews": [review, {**review, "text": "lagi"}]}))
    assert run() == 3
    assert run() == 3


def test_small_table_steps(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (1, "x")], "v int, t string")
    b = spark.createDataFrame([("x", 1)], "t string, v int")
    both = union_all(a, b)
    assert both.count() == 4
    assert [tuple(r) for r in value_distribution(both, "v").collect()] == [(1, 3)]
    assert run_counts(both, n_t="t").first().asDict() == {"n_rows": 4, "n_t": 2}
    assert project_order(both, ["t", "nope", "v"]).columns == ["t", "v"]
