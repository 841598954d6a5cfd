import json
import os

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from reviewloom.llm import chat_format as chat
from tests.conftest import SF_DIR

pieces = st.lists(st.one_of(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "|", "\n", "<|im", "_end|>"]), st.text(max_size=4)), max_size=8).map("".join)


@given(st.lists(st.tuples(pieces, pieces), max_size=5))
def test_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    for control in chat.CONTROLS:
        assert text.count(control) == (len(turns) if control in (chat.TURN, chat.SPLIT, chat.END) else 0)


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "tool", "content": None, "id": 4}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": 5}], "extra": {"x": [1]}},
        {"instruction": "do", "input": "it", "output": "done"},
        {"system": "s", "prompt": "p", "completion": "c"},
        {"chat": {"turns": [{"speaker": "bot", "text": "hi"}]}},
        {"question": "q", "answer": "a"},
        {"what": 1},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, None), (91, "{"), (92, "[1]"), (93, "")]
    df = spark.createDataFrame(rows, "id long, record string").repartition(3)
    got = {r["id"]: r for r in chat.format_chats(df).collect()}
    turns = {i: [tuple(t) for t in got[i]["turns"]] if got[i]["turns"] is not None else got[i]["reason"] for i in got}
    assert turns == {
        0: [("user", "a"), ("tool", "")], 1: [("user", "a"), ("assistant", "5")], 2: [("user", "do"), ("user", "it"), ("assistant", "done")],
        3: [("system", "s"), ("user", "p"), ("assistant", "c")], 4: [("assistant", "hi")], 5: [("user", "q"), ("assistant", "a")], 6: "unknown schema",
        90: "no object", 91: "no object", 92: "no object", 93: "no object",
    }
    assert chat.format_chats(df.where("false")).collect() == []


def test_conversations_against_sql(spark):
    rows = [
        (1, 0, "user", "</s>"), (1, 1, "assistant", "\\<s>é"), (2, 0, "system", None), (2, 1, "user", "x"), (2, 2, "assistant", ""), (4, 1, "assistant", "b"),
        (4, 0, "user", "a"), (4, 2, "user", "<|im_end|><<SYS>>"), (5, 0, "tool", "t"), (5, 0, "tool", "t"), (6, None, None, "n"), (None, 0, "user", "u"), (8, 0, "human", "<<s>"),
    ]
    rows += [(-7, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, chat.digests(chat.format_chats(chat.as_records(df)), "conv_id").collect()), key=repr)
    duck = duckdb.connect()
    duck.execute("CREATE TABLE c (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO c VALUES (?, ?, ?, ?)", rows[:-2])
    assert got == sorted(duck.sql(chat.SQL % "c").fetchall(), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not there")
def test_query_against_sql(spark):
    from reviewloom.llm.queries import ORACLE, QUERIES
    from tools.check import same

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF_DIR}/conversations.parquet'")
    assert same(QUERIES["op8_chat_format"](spark, SF_DIR).toPandas(), duck.sql(ORACLE["op8_chat_format"]).df()).startswith("ok")
