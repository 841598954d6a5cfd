import os
from collections import defaultdict

import pytest

from reviewloom.llm import token_counts as t
from reviewloom.llm.queries import VOCABULARY
from tests.conftest import SF_DIR

ROWS = [(1, "a b", "x", "en"), (2, "a  b\nc", "x", None), (3, None, None, "en"), (4, "", "y", "en"), (4, "", "y", "en"), (5, "w " * 3000, "x", "en")]


def letters():
    return t.Tokenizer("letters", lambda: lambda texts: [len(x) for x in texts])


def sums(rows):
    out = defaultdict(lambda: [0, 0])
    for _, text, source, lang in rows:
        for version, n in (("words/1", len((text or "").split())), ("letters", len(text or ""))):
            out[source, lang, version][0] += 1
            out[source, lang, version][1] += n
    return {k: tuple(v) for k, v in out.items()}


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}


def test_inserts_deletes_revisions_and_redelivery(spark, tmp_path):
    counted = lambda rows: t.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), [letters()])
    rollup = t.Rollup(spark, str(tmp_path / "r"))
    assert totals(rollup) == {}
    assert rollup.commit("a", t.signed(after=counted(ROWS))) and totals(rollup) == sums(ROWS)
    assert not rollup.commit("a", t.signed(after=counted(ROWS))) and totals(rollup) == sums(ROWS)
    assert rollup.commit("b", t.signed(before=counted(ROWS[:2]))) and totals(rollup) == sums(ROWS[2:])
    new = [(5, "now short", "x", "fr")]
    assert rollup.commit("c", t.signed(counted(ROWS[5:]), counted(new)))
    want = sums(ROWS[2:5] + new)
    assert totals(rollup) == want
    rollup.compact("d")
    assert totals(rollup) == want and not rollup.commit("b", t.signed(before=counted(ROWS[:2])))
    rollup.compact("e")
    assert rollup.commit("f", t.signed(after=counted([]))) and totals(rollup) == want
    # A batch that broke off before its mark does not count, and is replaced when it comes again.
    t.signed(after=counted(ROWS)).write.parquet(str(tmp_path / "r/sums/batch=g"))
    assert totals(rollup) == want
    assert rollup.commit("g", t.signed(after=counted(ROWS[:1]))) and totals(rollup) == sums(ROWS[2:5] + new + ROWS[:1])


@pytest.mark.skipif(not os.path.isdir(SF_DIR) or not os.path.exists(VOCABULARY), reason="test tables or vocabulary not there")
def test_query_is_the_sum_over_all_documents(spark):
    from reviewloom.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "source", "lang").collect()]
    count = t.bpe_tokenizer(VOCABULARY).make()
    want = {k: v for k, v in sums(rows).items() if k[2] == "words/1"}
    for _, text, source, lang in rows:
        key = source, lang, "byte_bpe_50k/1"
        n, total = want.get(key, (0, 0))
        want[key] = n + 1, total + count([text or ""])[0]
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in QUERIES["op10_token_counts"](spark, SF_DIR).collect()}
    assert got == want
