"""Quality audits, defaults, ids, appends, updates, export, catalog."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlane.operators import quality as q
from ledgerlane.sources import catalog, keys, sinks
from ledgerlane.sources.schemas import DDL, DOMAINS, FACTORS, conform

def now():
    return F.lit("2001-12-31 10:00:00").cast("timestamp_ntz")


@pytest.mark.parametrize("partitions", [1, 7])
def test_ids_have_no_gaps(spark, partitions):
    df = spark.range(1000).where("id % 3 <> 1").select(F.col("id").alias("v")).repartition(partitions)
    rows = q.assign_ids(df, after=40).collect()
    assert sorted(r.id for r in rows) == list(range(41, 41 + len(rows)))
    assert sorted(r.v for r in rows) == [v for v in range(1000) if v % 3 != 1]


def test_defaults_fill_absent_columns_only(spark):
    rows = q.apply_defaults(spark.createDataFrame([(1, None)], "id long, status string"), "marketing_campaigns", now())
    assert rows.first().status is None
    rows = q.apply_defaults(spark.createDataFrame([(1,)], "id long"), "customer_service", now()).first()
    assert (rows.resolution_status, rows.priority) == ("open", "medium")
    assert rows.created_at == datetime.datetime(2001, 12, 31, 10)


def test_audits(spark):
    df = spark.createDataFrame([(1, "kyc", "approved"), (2, "x", None), (3, None, "lost")],
                               "id long, verification_type string, verification_status string")
    bad = {r.column_name: r.n_bad for r in q.enum_violations(df, "kyc_kyb_data", DOMAINS["kyc_kyb_data"]).collect()}
    assert bad == {"verification_type": 1, "verification_status": 1}
    assert q.null_violations(df, "kyc_kyb_data", ["verification_type"]).first().n_null == 1
    scores = spark.createDataFrame([(299,), (300,), (850,), (851,), (None,)], "score int")
    assert sorted(r.score for r in q.range_violations(scores, "score", 300, 850).collect()) == [299, 851]


def test_orphans(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(1,), (9,), (9,), (None,), (8,)], "customer_id long")
    clean = spark.createDataFrame([(2,)], "customer_id long")
    got = {r.table_name: (r.n_orphans, r.n_orphan_keys) for r in q.orphan_keys({"a": child, "b": clean}, parents).collect()}
    assert got == {"a": (3, 2), "b": (0, 0)}


def test_append_round_trip(spark, tmp_path):
    path = str(tmp_path / "campaigns")
    requests = spark.createDataFrame([("Mortgages", "Students", "web", "text")],
                                     "campaign_type string, target_audience string, channel string, ai_generated_content string")
    drafts = sinks.campaign_drafts(requests, F.lit("2001-12-31").cast("date"))
    sinks.append_rows(drafts, "marketing_campaigns", path, now=now())
    sinks.append_rows(drafts, "marketing_campaigns", path, now=now())
    rows = spark.read.parquet(path).orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2]
    assert rows[0].campaign_name == "Mortgages - Students" and rows[0].status == "draft" and rows[0].budget is None
    assert spark.read.parquet(path).columns == [f.split()[0] for f in DDL["marketing_campaigns"].split(", ")]


def test_append_refuses_a_bad_row(spark, tmp_path):
    path = str(tmp_path / "campaigns")
    bad = spark.createDataFrame([(1, "n", "multi-channel")], "id long, campaign_name string, channel string")
    with pytest.raises(Exception, match="channel not allowed"):
        sinks.append_rows(bad, "marketing_campaigns", path, now=now())
    good = spark.createDataFrame([(1, "n", "web")], "id long, campaign_name string, channel string")
    sinks.append_rows(good, "marketing_campaigns", path, now=now())
    assert spark.read.parquet(path).count() == 1


@pytest.mark.parametrize("table", list(DDL))
def test_every_table_can_be_appended(spark, lending, tmp_path, table):
    path = str(tmp_path / table)
    rows = lending.view(table)
    sinks.append_rows(rows, table, path, now=now())
    back = spark.read.parquet(path)
    assert back.count() == rows.count()
    assert back.schema.simpleString() == conform(rows, table).schema.simpleString()
    assert back.select("id").distinct().count() == rows.count()


def test_chats_become_resolved_interactions(spark, tmp_path):
    chats = spark.createDataFrame([(1, "hi", "hello", 0.2), (None, "who", "me", 0.0)],
                                  "customer_id long, message string, ai_response string, sentiment_score double")
    path = str(tmp_path / "service")
    sinks.append_rows(sinks.chat_interactions(chats), "customer_service", path, now=now())
    row = spark.read.parquet(path).collect()
    assert len(row) == 1 and (row[0].subject, row[0].resolution_status, row[0].priority) == ("General Inquiry", "resolved", "medium")


def test_email_updates_and_swap(spark, tmp_path):
    base = spark.createDataFrame([(1, "old", "t0"), (2, None, "t0"), (3, "keep", "t0")],
                                 "id long, ai_generated_email string, updated_at string")
    updates = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None), (9, 1, "z")],
                                    "id long, version int, email_content string")
    changed = sinks.apply_email_updates(base, updates, F.lit("t1"))
    got = {r.id: (r.ai_generated_email, r.updated_at) for r in changed.collect()}
    assert got == {1: ("b", "t1"), 2: (None, "t0"), 3: ("keep", "t0")}
    path = str(tmp_path / "accounts")
    base.write.parquet(path)
    assert sinks.current_path(spark, path) == path
    sinks.swap_table(changed, path)
    assert spark.read.parquet(sinks.current_path(spark, path)).where("id = 1").first().ai_generated_email == "b"
    sinks.swap_table(base, path)
    assert spark.read.parquet(sinks.current_path(spark, path)).where("id = 1").first().ai_generated_email == "old"
    assert spark.read.parquet(path).count() == 3


def test_a_saved_email_is_there_for_the_next_reader(spark, tmp_path):
    from ledgerlane.sources.views import StoredLending

    path = str(tmp_path / "collections")
    rows = spark.createDataFrame([(7, "L1"), (8, "L2")], "customer_id long, loan_id string")
    sinks.append_rows(rows, "collections", path, now=now())
    book = StoredLending(spark, str(tmp_path))
    updates = spark.createDataFrame([(1, 1, "hello")], "id long, version int, email_content string")
    sinks.swap_table(sinks.apply_email_updates(book.collections, updates, now()).select(*book.collections.columns), path)
    sinks.append_rows(spark.createDataFrame([(9, "L3")], "customer_id long, loan_id string"), "collections", path, now=now())
    held = {r.id: r.ai_generated_email for r in StoredLending(spark, str(tmp_path)).collections.collect()}
    assert held == {1: "hello", 2: None, 3: None}


def test_unique_emails_and_ids(spark, tmp_path):
    path = str(tmp_path / "customers")

    def add(*rows, columns="customer_type string, email string"):
        sinks.append_rows(spark.createDataFrame(list(rows), columns), "customers", path, now=now())

    add(("individual", "a@x"), ("business", "b@x"))
    for bad in ([("individual", "a@x")], [("individual", "c@x"), ("business", "c@x")]):
        with pytest.raises(ValueError, match="email"):
            add(*bad)
    with pytest.raises(ValueError, match="id 2"):
        add((2, "individual", "d@x"), columns="id long, customer_type string, email string")
    add(("individual", "e@x"))
    assert sorted((r.id, r.email) for r in spark.read.parquet(path).collect()) == [(1, "a@x"), (2, "b@x"), (3, "e@x")]


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "id int, t string")
    sinks.export_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("id").collect()
    assert [r.id for r in back] == ["1", "2"] and back[1].t is None


def test_catalog(spark, lending):
    assert len(catalog.table_names()) == 7
    email = [c for c in catalog.table_columns("customers") if c["name"] == "email"][0]
    assert email == {"name": "email", "type": "string", "nullable": False, "primary_key": False}
    exact = catalog.column_profile(lending.customers, "customers")
    rough = catalog.column_profile(lending.customers, "customers", approximate=True)
    for a, b in zip(exact.orderBy("column_name").collect(), rough.orderBy("column_name").collect()):
        assert a.column_name == b.column_name
        assert (a.n_rows, a.n_null) == (b.n_rows, b.n_null) and abs(a.n_distinct - b.n_distinct) <= 0.1 * a.n_distinct + 1


def test_factor_json(spark):
    text = '{"payment_history": "good", "credit_utilization": "23%", "length_of_credit": "7 years", "credit_mix": "diverse"}'
    parsed = spark.createDataFrame([(text,)], "factors string").select(F.from_json("factors", FACTORS).alias("f")).first().f
    assert (parsed.credit_utilization, parsed.length_of_credit) == ("23%", "7 years")


def test_json_columns_are_written_and_read_back(spark):
    from ledgerlane.functions import exprs as x
    from ledgerlane.sources.schemas import RISK_INDICATORS

    df = spark.createDataFrame([(2, 1, True, False)], "o int, r int, g boolean, i boolean").withColumn(
        "risk_indicators",
        x.json_text(RISK_INDICATORS, overdrafts="o", returned_payments="r", gambling_transactions="g", irregular_income="i"),
    )
    row = df.select("risk_indicators", x.parse_indicators().alias("p")).first()
    assert row.risk_indicators.startswith('{"overdrafts":2,') and tuple(row.p) == (2, 1, True, False)


def test_checkpoint_dir_comes_from_the_session(spark):
    from ledgerlane.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    first = spark.sparkContext.getCheckpointDir()
    ensure_checkpoint_dir(spark)
    assert first and spark.sparkContext.getCheckpointDir() == first


def test_queries_run_on_stored_tables(spark, lending, tmp_path):
    """Write the seven tables as such; every query runs on them and gives the same rows."""
    from ledgerlane.plans import QUERIES
    from ledgerlane.sources.schemas import DDL
    from ledgerlane.sources.views import StoredLending

    for table in DDL:
        sinks.append_rows(lending.view(table), table, str(tmp_path / table), now=now())
    lending.conversations.write.parquet(str(tmp_path / "conversations"))
    stored = StoredLending(spark, str(tmp_path))
    same = [
        "collections_worklist", "collections_totals", "customer_360", "credit_features", "scorecard_scores",
        "statement_trends", "latest_score", "q_avg_score", "q_scores_below_600", "recent_interactions_10",
        "rendered_prompts", "service_kpis", "onboarding_messages", "score_histogram", "statement_transactions",
    ]
    for name in same:
        a, b = QUERIES[name](stored), QUERIES[name](lending)
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect())), name
    # those that write tables of their own are tested in their own files
    apart = {"batch_scoring", "fit_gradient", "append_ids", "append_unique", "streamed_interactions", "alert_windows",
             "sketched_profile"}
    for name in set(QUERIES) - set(same) - apart:
        QUERIES[name](stored).limit(5).collect()


def customers(spark, *rows):
    return spark.createDataFrame([(i, "individual", e) for i, e in rows], "id long, customer_type string, email string")


def test_repeated_keys_are_refused_by_the_index_alone(spark, tmp_path):
    path = str(tmp_path / "customers")
    sinks.append_rows(customers(spark, (1, "a"), (2, "b")), "customers", path, now())
    sinks.append_rows(customers(spark, (4, "c"), (5, "d")), "customers", path, now())
    for bad in ([(9, "a")], [(2, "z")], [(10, "y"), (11, "y")], [(12, "x"), (12, "w")]):
        with pytest.raises(ValueError, match="held already"):
            sinks.append_rows(customers(spark, *bad), "customers", path, now())
    assert spark.read.parquet(path).count() == 4
    # the id goes on from the largest one in the log, though no table row is read for it
    sinks.append_rows(customers(spark, (0, "e")).drop("id"), "customers", path, now())
    assert spark.read.parquet(path).where("email = 'e'").first().id == 6


def test_only_the_buckets_of_new_keys_are_read(spark, tmp_path):
    path = str(tmp_path / "customers")
    sinks.append_rows(customers(spark, *[(k, f"m{k}") for k in range(500)]), "customers", path, now())
    index = spark.read.parquet(f"{path}/_keys/values")
    assert index.where("name = 'email'").count() == index.where("name = 'id'").count() == 500
    bucket = spark.range(1).select(keys.bucket_of(F.lit("m7"))).first()[0]
    read = keys.held_values(spark, path, "email", [bucket])
    assert "m7" in [r.value for r in read.collect()] and read.count() < 20
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(bucket,{bucket})" in plan and "EqualTo(name,email)" in plan
    # each file is in order of column and bucket, so its pages hold a few buckets each
    for file in index.select(F.input_file_name().alias("f")).distinct().collect():
        rows = spark.read.parquet(file.f).collect()
        assert [(r.name, r.bucket) for r in rows] == sorted((r.name, r.bucket) for r in rows)
    # with more buckets than are named the whole column is read
    assert keys.held_values(spark, path, "email", range(keys.BUCKETS)).count() == 500


def test_an_append_that_failed_before_its_index_is_made_good(spark, tmp_path):
    path = str(tmp_path / "customers")
    sinks.append_rows(customers(spark, (1, "a")), "customers", path, now())
    # rows that reached the table without the index, as after a crash
    spark.read.parquet(path).withColumns({"id": F.lit(40).cast("long"), "email": F.lit("lost")}).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="'lost' is held already"):
        sinks.append_rows(customers(spark, (2, "lost")), "customers", path, now())
    sinks.append_rows(customers(spark, (0, "b")).drop("id"), "customers", path, now())
    assert spark.read.parquet(path).where("email = 'b'").first().id == 41


def test_a_new_version_brings_its_own_index(spark, tmp_path):
    path = str(tmp_path / "customers")
    sinks.append_rows(customers(spark, (1, "a"), (2, "b")), "customers", path, now())
    sinks.swap_table(spark.read.parquet(path).where("id = 1"), path)
    sinks.append_rows(customers(spark, (2, "b")), "customers", path, now())
    with pytest.raises(ValueError, match="'a' is held already"):
        sinks.append_rows(customers(spark, (3, "a")), "customers", path, now())


def test_writers_of_one_number_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    real, calls = sinks._versions, []

    def stale(*args, **kw):
        calls.append(1)
        # the first look misses a version that another writer has just made
        return [] if len(calls) == 1 else real(*args, **kw)

    sinks.swap_table(spark.range(3), path)
    monkeypatch.setattr(sinks, "_versions", stale)
    sinks.swap_table(spark.range(5), path)
    monkeypatch.undo()
    assert [spark.read.parquet(f"{path}/_versions/{n}").count() for n in (1, 2)] == [3, 5]
