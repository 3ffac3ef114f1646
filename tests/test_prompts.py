"""Prompt tables and the caller's completion function."""

import pytest
from pyspark.sql import functions as F

from ledgerlane.operators import prompts as p
from ledgerlane.sources import dims


def test_template_counts():
    rows = dims.template_rows()
    assert len(rows) == 9 and len(dims.TEMPLATES) == 5
    assert sum(len(r[-1]) for r in rows) == 63
    assert all(len(options) == 5 for r in rows for _, options in r[-1])


def test_render(spark):
    requests = spark.createDataFrame(
        [
            (1, "credit_cards", 0, None),
            (2, "credit_cards", 1, None),
            (3, "nothing", 0, None),
            (4, "personal_loans", 0, {"tone": "{rate}", "rate": "9"}),
        ],
        "request_id long, category string, template_index int, custom_variables map<string,string>",
    )
    got = {r.request_id: r for r in p.render_prompts(requests, dims.template_table(spark)).collect()}
    assert got[1].error is None and "{" not in got[1].prompt and len(got[1].variables_used) == 8
    assert (got[2].prompt, got[2].error) == (None, "Template not found")
    assert (got[3].prompt, got[3].error) == (None, "Category not found")
    assert got[4].prompt.startswith("Write a {rate} ") and "from 9%" in got[4].prompt
    again = {r.request_id: r.prompt for r in p.render_prompts(requests.repartition(3), dims.template_table(spark)).collect()}
    assert again == {k: r.prompt for k, r in got.items()}


def test_suggestions(spark):
    rows = [(i, t, "students", "build awareness") for i, t in enumerate(dims.LOAN_TYPES)]
    got = p.suggestions(spark.createDataFrame(rows, "request_id int, loan_type string, audience string, goal string"))
    n = {r.request_id: r["count"] for r in got.groupBy("request_id").count().collect()}
    assert n == {0: 8, 1: 8, 2: 8, 3: 5, 4: 5}
    assert got.where(F.col("suggestion").contains("{")).count() == 0


def test_unknown_stage_has_a_default(spark):
    accounts = spark.createDataFrame(
        [(1, "Ada", "a@x", "LOAN1", 10.5, 3, "other", "Friendly", False)],
        "id long, customer string, email string, loan_id string, outstanding_amount double, days_overdue int,"
        " collection_stage string, tone string, offer_plan boolean",
    )
    row = p.collection_emails(accounts).first()
    assert dims.DEFAULT_STAGE_PROMPT in row.system_prompt and "€10.50" in row.system_prompt
    assert "payment plan" not in row.system_prompt


def test_service_prompt_with_and_without_customer(spark, lending):
    messages = spark.createDataFrame([(1, 1, "hi"), (2, None, "yo"), (3, -1, "hm")], "id long, customer_id long, message string")
    profiles = spark.createDataFrame([(1, "Ada")], "customer_id long, customer string")
    got = {r.id: r.user_prompt for r in p.service_replies(messages, profiles).collect()}
    assert got[1] == 'Customer context: {"customer_id":1,"customer":"Ada"}\n\nCustomer message: hi'
    assert got[2] == "\n\nCustomer message: yo" and got[3] == "\n\nCustomer message: hm"


def test_complete(spark):
    def answer(texts):
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "id int, user_prompt string").repartition(3)
    got = {r.id: (r.reply, r.error) for r in p.complete(df, answer).collect()}
    assert got == {i: (f"P{i}", None) for i in range(20)}


@pytest.mark.parametrize("kind", ["raises", "short"])
def test_failed_batch_carries_its_error(spark, kind):
    def answer(texts):
        if kind == "raises":
            raise RuntimeError("no service")
        return texts[:-1]

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, user_prompt string").coalesce(1)
    rows = p.complete(df, answer).collect()
    assert all(r.reply is None and r.error for r in rows) and len(rows) == 2


def test_only_the_failed_call_loses_its_rows(spark):
    def answer(texts):
        if "p5" in texts:
            raise RuntimeError("no service")
        return list(texts)

    df = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "id int, user_prompt string").coalesce(1)
    rows = p.complete(df, answer, batch_size=4).collect()
    assert sorted(r.id for r in rows if r.error) == [4, 5, 6, 7] and sum(r.reply is not None for r in rows) == 8


def test_sentiment_prompts(spark):
    row = p.sentiment_prompts(spark.createDataFrame([(1, "bad day")], "id int, message string")).first()
    assert row.user_prompt == "bad day" and row.max_tokens == 200


def sent_log(folder):
    """An answer that leaves a file per prompt it is asked, and so tells how often each was sent."""
    import os
    import uuid

    def answer(texts):
        if "fails" in texts:
            raise RuntimeError("no service")
        for t in texts:
            open(os.path.join(folder, f"{t}.{uuid.uuid4().hex}"), "w").close()
        return [t.upper() for t in texts]

    return answer


def test_equal_prompts_are_sent_once_and_a_rerun_sends_none(spark, tmp_path):
    log, kept = tmp_path / "log", str(tmp_path / "kept")
    log.mkdir()
    rows = [(i, f"p{i % 5}" if i % 3 else "hot") for i in range(300)] + [(900, None)]
    df = spark.createDataFrame(rows, "id int, user_prompt string").repartition(6)
    for _ in range(2):
        got = {r.id: r.reply for r in p.complete_once(df, sent_log(str(log)), kept, parts=3).collect()}
        assert got == {i: t.upper() if t else None for i, t in rows}
        assert sorted(f.name.split(".")[0] for f in log.iterdir()) == ["hot", "p0", "p1", "p2", "p3", "p4"]
    more = spark.createDataFrame([(1, "p1"), (2, "new")], "id int, user_prompt string")
    assert {r.reply for r in p.complete_once(more, sent_log(str(log)), kept, parts=3).collect()} == {"P1", "NEW"}
    assert len(list(log.iterdir())) == 7
    assert p.complete_once(df.limit(0), sent_log(str(log)), kept, parts=3).collect() == []


def test_a_failed_call_keeps_nothing_and_is_sent_again(spark, tmp_path):
    log, kept = tmp_path / "log", str(tmp_path / "kept")
    log.mkdir()
    df = spark.createDataFrame([(1, "fails"), (2, "fine")], "id int, user_prompt string")
    for _ in range(2):
        got = {r.id: r.reply for r in p.complete_once(df, sent_log(str(log)), kept, batch_size=1, parts=1).collect()}
        assert got == {1: None, 2: "FINE"}
    assert len(list(log.iterdir())) == 1
    healed = p.complete_once(df, lambda texts: [t.title() for t in texts], kept, parts=1)
    assert {r.id: r.reply for r in healed.collect()} == {1: "Fails", 2: "FINE"}
    with pytest.raises(ValueError):
        p.complete_once(df.withColumn("reply", df.id), sent_log(str(log)), kept)
