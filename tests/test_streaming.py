"""The message stream on files, with everything available at the start."""

import datetime

from ledgerlane.streaming import interactions as i


def message(n, minute, score, customer=1, day=1):
    reply = f'{{"score": {score}, "explanation": "x"}}'
    return (n, customer, f"m{n}", "ok", reply, datetime.datetime(2024, 1, day, 10 + minute // 60, minute % 60))


def write(spark, path, *rows):
    spark.createDataFrame(list(rows), i.MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_append_once_per_message(spark, tmp_path):
    source, sink, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    write(spark, source, message(1, 0, -0.9), message(2, 1, 0.9), message(1, 2, -0.9), message(3, 3, 0.0, customer=None))
    flagged = i.flagged(i.read_messages(spark, source))
    i.store_messages(i.as_interactions(flagged), sink, mark).awaitTermination()
    rows = spark.read.parquet(sink).orderBy("id").collect()
    assert [(r.id, r.sentiment_score, r.resolution_status) for r in rows] == [(1, -0.9, "resolved"), (2, 0.9, "resolved")]
    write(spark, source, message(4, 4, "oops"), message(2, 5, 0.9))
    i.store_messages(i.as_interactions(i.flagged(i.read_messages(spark, source))), sink, mark).awaitTermination()
    rows = spark.read.parquet(sink).orderBy("id").collect()
    assert [(r.id, r.sentiment_score) for r in rows] == [(1, -0.9), (2, 0.9), (4, 0.0)]


def test_late_messages_are_stored_once(spark, tmp_path):
    source, sink, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))

    def run():
        i.store_messages(i.as_interactions(i.flagged(i.read_messages(spark, source))), sink, mark).awaitTermination()

    write(spark, source, message(1, 0, 0.5, day=9))
    run()
    write(spark, source, message(2, 0, 0.5, day=2), message(1, 0, 0.5, day=9), message(2, 0, 0.5, day=2))
    run()
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 2]
    assert {r.id: r.batch for r in spark.read.parquet(sink).collect()} == {1: 0, 2: 1}
    # a batch that runs again replaces itself, and one that was lost half way comes back
    again = i.as_interactions(i.flagged(spark.read.schema(i.MESSAGE_SCHEMA).parquet(source)))
    i.append_batch(again.where("id = 2"), 1, sink)
    i.append_batch(again, 2, sink)
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 2]


def test_alerts_per_window(spark, tmp_path):
    source, sink, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    write(spark, source, *[message(n, n, -0.9 if n % 2 else 0.6) for n in range(60)])
    write(spark, source, message(99, 0, 0.0, day=3))
    counts = i.alert_counts(i.flagged(i.read_messages(spark, source, files_per_batch=1)))
    i.append_to(counts, sink, mark).awaitTermination()
    rows = {(r.window_start.hour, r.sentiment_category): (r.n, r.n_escalated) for r in spark.read.parquet(sink).collect()}
    assert rows[10, "Negative"] == (30, 30) and rows[10, "Positive"] == (30, 0)
