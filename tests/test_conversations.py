"""Chunked conversation operators against a plain loop, with one very long conversation."""

import pytest
from pyspark.sql import functions as F

from ledgerlane.operators import conversations as c

ROLES = ["user", "assistant", "user", "system"]


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(conv, turn, ROLES[(conv + turn * 7) % 4], f"t{conv}.{turn}")
            for conv, n in ((0, 500), (1, 3), (2, 1), (3, 40))
            for turn in range(n) if not (conv == 0 and 100 < turn < 180)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


def by_conversation(turns):
    held = {}
    for row in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn)):
        held.setdefault(row.conv_id, []).append(row)
    return held


@pytest.mark.parametrize("span", [4, 64, 65536])
def test_context(turns, span):
    expected = {
        (conv, row.turn): (i, said[i - 1].role if i else None)
        for conv, said in by_conversation(turns).items()
        for i, row in enumerate(said)
        if row.role == "user"
    }
    got = {(r.conv_id, r.turn): (r.history_len, r.last_role) for r in c.conversation_context(turns, span).collect()}
    assert got == expected


@pytest.mark.parametrize("span", [4, 65536])
def test_question_numbers(turns, span):
    expected = {}
    for conv, said in by_conversation(turns).items():
        asked = [row.turn for row in said if row.role == "user"]
        expected.update({(conv, t): (i + 1, len(asked) - i) for i, t in enumerate(asked)})
    got = {(r.conv_id, r.turn): (r.question_no, r.newest_first) for r in c.question_numbers(turns, span).collect()}
    assert got == expected


@pytest.mark.parametrize("span", [4, 65536])
def test_history_and_calls_hold_the_whole_conversation(turns, span):
    held = by_conversation(turns)
    rows = {(r.conv_id, r.position): (r.role, r.content) for r in c.history(turns, span).collect()}
    assert len(rows) == sum(map(len, held.values()))
    calls = c.model_calls(turns, F.lit("sys"), span).collect()
    assert len(calls) == sum(row.role == "user" for said in held.values() for row in said)
    for call in calls:
        before = [rows[call.conv_id, k] for k in range(1, call.position)]
        said = [(r.role, r.text) for r in held[call.conv_id] if r.turn <= call.turn]
        assert [*before, ("user", call.user_message)] == said
        assert call.n_messages == len(said) + 1 and call.system_prompt == "sys"


def test_long_and_hot_conversations(spark):
    long = spark.range(300).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "'x' AS text")
    many = spark.range(500).selectExpr("id + 100 AS conv_id", "0L AS turn", "'user' AS role", "'y' AS text")
    calls = c.model_calls(long.union(many), F.lit("s"), span=16).collect()
    assert max(r.n_messages for r in calls) == 300 and len(calls) == 650
