import hashlib
import json

import pytest

from reviewloom.operators.tables import FINAL_COLUMNS
from reviewloom.plans.curate import curate_documents
from reviewloom.sources.documents import accepted, document_reviews, parse_documents, place_fields, rejected, scan_documents

AS_OF = "2024-01-30 01:00:00"

INFO = {
    "name": " Pantai  A ",
    "category": "Pantai",
    "avg_rating": "4,5",
    "total_reviews_text": "1.234 ulasan",
    "address": "Jl. X\nBandung",
    "description": "",
    "attributes": "Parking: Free |  | - WC",
}


def review(user="Ann", text="bagus", rating=5, time="3 hari lalu"):
    return {"user_name": user, "text": text, "rating": rating, "time": time}


def doc(*reviews, **info):
    return json.dumps({"place_info": {**INFO, **info}, "reviews": list(reviews)}, ensure_ascii=False, indent=4)


GOOD = doc(review())
CASES = {
    "good": (GOOD, None, 1),
    "truncated": (GOOD[:-20], "malformed_json", 0),
    "bom": ("\ufeff" + GOOD, "malformed_json", 0),
    "trailing": (GOOD + " x", "malformed_json", 0),
    "trailing2": (GOOD + " x}", "malformed_json", 0),
    "two": (GOOD + "," + GOOD, "malformed_json", 0),
    "passed_once": (GOOD + "] x}", "malformed_json", 0),
    "passed_once2": (GOOD + "]}", "malformed_json", 0),
    "sentinel": (GOOD + ',"' + "0" * 64, "malformed_json", 0),
    "blank": (" \n", "malformed_json", 0),
    "array": ("[1]", "not_an_object", 0),
    "scalar": ("3", "not_an_object", 0),
    "info_null": ('{"place_info": null, "reviews": []}', "place_info_not_object", 0),
    "info_list": ('{"place_info": [], "reviews": []}', "place_info_not_object", 0),
    "reviews_null": ('{"place_info": {}, "reviews": null}', "reviews_not_array", 0),
    "reviews_object": ('{"place_info": {}, "reviews": {"a": 1}}', "reviews_not_array", 0),
    "reviews_no_object": ('{"reviews": [{"text": "a"}, 3]}', "review_not_object", 0),
    "reviews_empty": ('{"reviews": []}', None, 0),
    "reviews_empty_object": ('{"reviews": {}}', None, 0),
    "reviews_empty_text": ('{"reviews": ""}', None, 0),
    "no_reviews": ('{"place_info": {"name": "N"}}', None, 0),
    "no_info": (json.dumps({"reviews": [review()]}), None, 1),
    "no_fields": ('{"reviews": [{}]}', None, 1),
    "spaces_around": ("\n  " + GOOD + "  \n", None, 1),
}


@pytest.fixture
def folder(tmp_path):
    for name, (text, _, _) in CASES.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    (tmp_path / "bad_bytes.json").write_bytes(b'{"place_info": {"name": "\xff"}}')
    (tmp_path / "other.txt").write_text(GOOD)
    return str(tmp_path)


def stem(path):
    return path.rsplit("/", 1)[1].removesuffix(".json")


def test_quarantine(spark, folder):
    parsed = parse_documents(scan_documents(spark, folder))
    reasons = {stem(r.file): r.reject_reason for r in parsed.collect()}
    expected = {name: reason for name, (_, reason, _) in CASES.items()} | {"bad_bytes": "invalid_utf8"}
    assert reasons == expected
    n_rejected = sum(r is not None for r in expected.values())
    assert rejected(parsed).count() == n_rejected
    tall = document_reviews(accepted(parsed))
    counts = {}
    for r in tall.collect():
        counts[stem(r.file)] = counts.get(stem(r.file), 0) + 1
    assert counts == {name: n for name, (_, _, n) in CASES.items() if n}


def test_place_fields(spark, folder):
    rows = {stem(r.file): r for r in place_fields(accepted(parse_documents(scan_documents(spark, folder)))).collect()}
    good = rows["good"]
    assert (good.place_name, good.place_address, good.place_attributes) == ("Pantai A", "Jl. X Bandung", "Parking: Free, WC")
    assert (good.place_total_reviews_gmaps, good.place_avg_rating) == (1234, 4.5)
    none = rows["no_info"]
    assert (none.place_name, none.place_description, none.place_total_reviews_gmaps, none.place_avg_rating) == ("", "", 0, 0.0)


@pytest.mark.parametrize("avg,expected", [(4.5, 4.5), (4, 4.0), ("4,5", 4.5), (None, 0.0), (True, 0.0), ([1], 0.0), ("x", 0.0), (1e3, 1000.0)])
def test_avg_rating_of_any_type(spark, tmp_path, avg, expected):
    (tmp_path / "a.json").write_text(doc(avg_rating=avg, name=42, total_reviews_text=12))
    row = place_fields(accepted(parse_documents(scan_documents(spark, str(tmp_path))))).first()
    assert (row.place_avg_rating, row.place_name, row.place_total_reviews_gmaps) == (expected, "", 0)


def curated(spark, tmp_path, text, **kw):
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    docs = scan_documents(spark, str(tmp_path))
    return curate_documents(docs, as_of=AS_OF, **kw)


def test_curated_rows(spark, tmp_path):
    text = doc(
        review(rating=5),
        review(rating=1),
        review(user="ann"),
        review(text="  "),
        review(user=42, text="x"),
        {"text": "no rating"},
        review(user="Bob", rating=None, time=3),
        review(user="", text="bagus  \n sekali", rating="4"),
    )
    out = curated(spark, tmp_path, text)
    assert out.columns == FINAL_COLUMNS
    got = sorted((r.user_id, r.user_rating, r.review_text, r.review_time) for r in out.collect() if r.user_rating is not None)
    ann = hashlib.md5(b"ann").hexdigest()[:10]
    bob = hashlib.md5(b"bob").hexdigest()[:10]
    assert got == sorted(
        [
            (ann, 5, "bagus", "2024-01-27"),
            (ann, 5, "bagus", "2024-01-27"),
            ("anonymous", 5, "x", "2024-01-27"),
            ("anonymous", 0, "no rating", ""),
            ("anonymous", 4, "bagus sekali", "2024-01-27"),
        ]
    )
    nulls = [r for r in out.collect() if r.user_rating is None]
    assert [(r.user_id, r.review_time) for r in nulls] == [(bob, "")]
    assert {(r.place_name, r.place_avg_rating) for r in out.collect()} == {("Pantai A", 4.5)}


def test_groups_are_files_not_names(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(doc(review(), review()))
    out = curate_documents(scan_documents(spark, str(tmp_path)), as_of=AS_OF)
    assert out.count() == 2


def test_line_layout(spark, tmp_path):
    lines = [json.dumps({"doc_key": k, **json.loads(GOOD)}) for k in ("a", "b")] + [json.dumps(json.loads(GOOD))]
    (tmp_path / "part.json").write_text("\n".join(lines) + "\n{broken\n")
    raw = scan_documents(spark, str(tmp_path), layout="line")
    assert {"a", "b"} <= {r.file for r in parse_documents(raw).collect()}
    assert curate_documents(raw, as_of=AS_OF).count() == 3
    assert [r.reject_reason for r in rejected(parse_documents(raw)).collect()] == ["malformed_json"]


def test_text_of_over_20_million_characters(spark):
    from pyspark.sql import functions as F

    lead, tail = json.dumps({"place_info": INFO, "reviews": [review(), review(text="@@")]}).split("@@")
    rows = spark.createDataFrame([("whole", "a", tail), ("cut", "a", tail[:-1]), ("junk", "a", tail + " x")], "file string, unit string, tail string")
    raw = rows.select("file", F.concat(F.lit(lead), F.expr("repeat(unit, 20000001)"), "tail").alias("value"))
    assert {r.file: r.reject_reason for r in rejected(parse_documents(raw)).collect()} == dict.fromkeys(["cut", "junk"], "malformed_json")
    got = curate_documents(raw.where("file = 'whole'"), as_of=AS_OF).select(F.length("review_text")).collect()
    assert sorted(r[0] for r in got) == [5, 20000001]
