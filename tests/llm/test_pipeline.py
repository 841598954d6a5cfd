import os

import pytest

import corpus_pipeline
from tests.conftest import SF_DIR
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_minhash_dedup import brute as components
from tests.llm.test_suffix_dedup import brute as repeats

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not there")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = function(spark, docs, SF_DIR)
        rows = spark.createDataFrame(out.collect(), out.schema)
        after = {r["doc_id"]: r for r in rows.collect()}
        assert len(after) == rows.count() and set(after) <= set(before)
        if name != "mix_sources":
            assert out.columns == docs.columns
        pairs = sorted((k, r["text"]) for k, r in before.items())
        if name == "language_id":
            assert len(after) >= 0.97 * len(before)
        if name == "minhash_dedup":
            assert set(after) == {r[0] for r in components(pairs, 80) if r[3]}
        if name == "suffix_dedup":
            want = {r[0]: r for r in repeats(pairs, 200)}
            for k, r in after.items():
                left = len(r["text"].encode())
                assert r["n_chars"] == len(r["text"]) and 0 <= left - (want[k][1] - want[k][2]) <= 6 * want[k][3]
        if name == "decontaminate":
            assert set(after) == set(before) - {pairs[d][0] for d, _ in contaminated(pairs, items)}
        if name == "mix_sources":
            assert all(1 <= r["copies"] <= 2 for r in after.values())
        kept[name], docs = len(after), rows
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.columns[-1] == "copies" and got.count() == kept["mix_sources"]


def test_odd_rows(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    text = "the quick brown fox jumps over the lazy dog again and again "
    rows = [(1, text, "en", "a", 3, "x"), (1, text, "en", "a", 3, "x"), (None, text + "end", None, None, None, None), (2, None, "en", "a", None, "y"), (3, "", "en", "b", 0, "z")]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, function in corpus_pipeline.STAGES:
            docs = function(spark, docs, str(tmp_path))
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() == (1 if some else 0)  # the others have no letter or are near copies


def test_columns_of_any_name_and_no_labels(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["copies", "__k1", "hits", "row", "node", "h1", "key"]
    rows = [(i, f"text number {i} of its own with other words {i * 7} {i * 13}", None, "s", 3, *range(7)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in names))
    for name, function in corpus_pipeline.STAGES:
        before, docs = docs, function(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == [*before.columns, *(["copies_mixed"] if name == "mix_sources" else [])]
    got = docs.collect()
    assert len(got) == 40 and all(tuple(r[c] for c in names) == tuple(range(7)) and r["copies_mixed"] in (1, 2) for r in got)
