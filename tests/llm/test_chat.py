"""Linking, order, validation and canonical JSON of tool events."""

import json

import duckdb
import pytest

from veilscan.llm import chat, chat_events
from veilscan.llm.queries import ORACLES, QUERIES

SCHEMA = (
    "conv_id long, turn long, kind string, call_id string, name string, arguments string, after string, content string, "
    "depth string, status string, conv_key int, position string"
)


def event(conv, turn, kind, call_id=None, name=None, arguments=None, after=None, content=None):
    return (conv, turn, kind, call_id, name, arguments, after, content, "x", "y", 1, "z")


def linked(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return chat.link_tool_calls(frame, chat.schema_table(spark)).collect()


def test_links_and_order(spark):
    good = '{"query": "q", "limit": 3}'
    rows = [
        event(1, 5, "call", "c", "search", good, after="b"),
        event(1, 3, "call", "b", "search", good, after="a"),
        event(1, 7, "call", "a", "search", good),
        event(1, 9, "result", "a", content="first"), event(1, 8, "result", "a", content="second"),
        event(1, 2, "result", "nobody", content="lost"),
        event(1, 1, "message", content="hello"),
        event(1, 4, "call", "b", "search", good),  # bears a name that is taken
        event(1, 10, "call", "x", "search", good, after="y"), event(1, 11, "call", "y", "search", good, after="x"),
        event(1, 12, "call", "z", "search", good, after="y"), event(1, 13, "call", "s", "search", good, after="s"),
        event(1, 14, "call", None, "search", good), event(1, 15, "result", None, content="none"),
        event(2, 1, "call", "a", "search", good, after="gone"),
        event(None, 1, "call", "a", "search", good), event(None, 2, "result", "a", content="r"),
        event(1, 7, "call", "a", "search", good),  # repeated row
    ]
    got = {(r.conv_id, r.turn): r for r in linked(spark, rows)}
    assert len(got) == len(rows) - 1
    order = sorted((r for r in got.values() if r.conv_id == 1), key=lambda r: r.position)
    assert [r.position for r in order] == list(range(len(order)))
    at = {r.turn: r.position for r in order}
    assert at[1] < at[7] < at[8] < at[9] < at[3] < at[5]
    status = {t: got[1, t].status for t in at}
    assert status[7] == "answered" and status[3] == status[5] == "unanswered" and status[4] == "duplicate"
    assert status[2] == "orphan" and status[15] == "orphan" and status[1] == "plain" and status[8] == "linked"
    assert status[10] == status[11] == status[12] == status[13] == "cycle" and status[14] == "unanswered"
    assert {t: got[1, t].depth for t in (7, 3, 5, 9)} == {7: 0, 3: 1, 5: 2, 9: 0}
    assert all(got[1, t].depth is None and at[t] > at[5] for t in (10, 11, 12, 13, 2, 14))
    assert got[2, 1].depth == 0
    assert got[None, 1].status == "answered" and got[None, 2].status == "linked"


def test_a_long_chain_takes_few_rounds(spark):
    n = 300
    rows = [event(1, n - k, "call", f"c{k}", "search", "{}", after=f"c{k - 1}" if k else None) for k in range(n)]
    got = linked(spark, rows)
    assert sorted((r.depth, r.call_id) for r in got) == sorted((k, f"c{k}") for k in range(n))
    assert [r.call_id for r in sorted(got, key=lambda r: r.position)] == [f"c{k}" for k in range(n)]


@pytest.mark.parametrize(("name", "arguments", "errors"), [
    ("search", '{"limit": 2, "query": "x"}', ""),
    ("search", '{"limit": 2.5, "query": 3}', "type:limit,type:query"),
    ("search", '{"query": "x", "more": 1}', "missing:limit,unknown:more"),
    ("search", "[1]", "not_an_object"), ("search", "{", "invalid_json"), ("search", None, "invalid_json"),
    ("search", '{"a": 1, "a": 2}', "invalid_json"), ("nothing", "{}", "unknown_tool"), (None, "{}", "unknown_tool"),
    ("summarise", '{"text": "x", "ratio": 1}', ""), ("summarise", '{"text": "x", "ratio": 0.5}', ""),
    ("summarise", '{"text": null}', "type:text"),
])
def test_arguments_are_checked(spark, name, arguments, errors):
    (row,) = linked(spark, [event(1, 1, "call", "a", name, arguments)])
    assert row.errors == errors
    assert json.loads(row.message)["valid"] == (errors == "")


def test_json_is_canonical(spark):
    texts = ['{"z": 1, "a": {"d": [1, 2.50, true, null], "c": "é\\n\\u0041/"}, "Z": ""}', '{ "Z":"", "a":{"c":"é\\nA/","d":[1,2.5,true,null]},"z":1 }']
    first, second = (linked(spark, [event(1, 1, "call", "i", "draw", t)])[0].message for t in texts)
    assert first == second == (
        '{"arguments":{"Z":"","a":{"c":"é\\nA/","d":[1,2.5,true,null]},"z":1},"id":"i","name":"draw","role":"assistant","type":"tool_call","valid":false}'
    )


def test_empty(spark):
    assert linked(spark, []) == []


def test_whole_table_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op1_chat_tool_links"](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    cur = con.execute(ORACLES["op1_chat_tool_links"])
    assert [d[0] for d in cur.description] == rows.columns
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(cur.fetchall(), key=str)


def test_events_of_null_rows(spark):
    frame = spark.createDataFrame([(1, 1, "assistant", None), (1, 2, "user", None), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert len(chat.link_tool_calls(chat_events.conversation_events(frame), chat.schema_table(spark)).collect()) == 3
