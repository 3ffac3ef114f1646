"""Numbers within hot keys, reply contexts in pieces, profiles from sketches."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from ledgerlane.operators import customer360 as c360
from ledgerlane.operators.numbering import number_within
from ledgerlane.sources import catalog


def test_numbers_within_keys_of_any_size(spark):
    rnd = random.Random(2)
    rows = [(None if k % 50 == 0 else 7 if k % 3 == 0 else k % 11, rnd.randint(0, 40), k) for k in range(3000)]
    rnd.shuffle(rows)
    found = number_within(spark.createDataFrame(rows, "key int, at int, id int").repartition(6), "key", ["at", "id"])
    wanted, seen = {}, Counter()
    for key, at, id_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])):
        seen[key] += 1
        wanted[id_] = (key, at, seen[key])
    assert {r.id: (r.key, r.at, r.position) for r in found.collect()} == wanted
    assert number_within(found.drop("position").limit(0), "key", ["at", "id"]).collect() == []


def test_a_key_with_a_third_of_all_rows_is_numbered_without_gaps(spark):
    rows = spark.range(20_000).selectExpr("IF(id % 3 = 0, -1, id) AS key", "id")
    found = number_within(rows, "key", ["id"])
    hot = found.where("key = -1")
    assert hot.agg(F.max("position"), F.count_distinct("position")).first()[0:2] == (6667, 6667)


def test_contexts_hold_every_record_in_pieces(spark, lending):
    hot, n = 3, 1234
    rows = [(10_000 + k, hot, "kyc", "approved", k / 2000, f"2001-{1 + k % 12:02d}-{1 + k % 28:02d}") for k in range(n)]
    schema = "id long, customer_id long, verification_type string, verification_status string, risk_score double, created_at string"
    extra = spark.createDataFrame(rows, schema).withColumn("created_at", F.to_date("created_at"))
    other = lending.kyc.where("customer_id <> 5")
    kyc = other.unionByName(extra.select(*other.columns)).repartition(9)
    got = c360.service_contexts(lending.states, kyc, size=100).collect()
    pieces = {(r.customer_id, r.piece): (r.n_records, json.loads(r.context)) for r in got}
    mine = [pieces[hot, k] for k in range(1, 14)]
    assert (hot, 14) not in pieces and [size for size, _ in mine] == [100] * 12 + [n + 1 - 1200]
    ids = [(r["created_at"], r["id"]) for _, context in mine for r in context["kyc_data"]]
    assert ids == sorted(ids) and len(ids) == n + 1
    # the person, the score and the statement are told once
    assert mine[0][1]["customer"]["id"] == hot and mine[0][1]["customer"]["email"] == "c3@example.com"
    assert all(context["customer"] is None and context["bank_statement"] is None for _, context in mine[1:])
    assert pieces[5, 1][0] == 0 and pieces[5, 1][1]["kyc_data"] == []
    assert len({r.customer_id for r in got}) == lending.customers.count()


def test_sketches_of_loads_unite(spark, tmp_path):
    rows = spark.range(30_000).selectExpr(
        "id", "id % 700 AS few", "IF(id % 4 = 0, NULL, concat('t', id % 9000)) AS text", "CAST(NULL AS DATE) AS none"
    )
    path = str(tmp_path / "sketches")
    for low in (0, 10_000, 20_000):
        part = rows.where(F.col("id").between(low, low + 9_999 + 2_000))
        catalog.profile_sketch(part, "t").write.mode("append").parquet(path)
    got = {r.column_name: r for r in catalog.united_profile(spark.read.parquet(path)).collect()}
    # two loads overlap by 2,000 rows: these count twice as rows, once as values
    assert got["id"].n_rows == 34_000 and got["text"].n_null == 8_500 and got["none"].n_null == 34_000
    for name, exact in {"id": 30_000, "few": 700, "text": 6_750, "none": 0}.items():
        assert abs(got[name].n_distinct - exact) <= 0.03 * exact
    # a sketch has the same size however many rows it stands for
    sizes = spark.read.parquet(path).where("column_name = 'id'").select(F.length("sketch").alias("n")).collect()
    assert max(r.n for r in sizes) <= 1.1 * 2**catalog.SKETCH_BITS


def test_profile_counts_columns_of_every_kind(spark):
    rows = spark.createDataFrame(
        [(1, 1.5, "a", True), (1, -0.0, "b" * 40, None), (2, 0.0, "b" * 40, False), (None, None, None, None)],
        "n int, x double, t string, b boolean",
    ).withColumns({"d": F.to_date(F.lit("2001-01-01")), "ts": F.lit("2001-01-01 10:00:00").cast("timestamp_ntz")})
    got = {r.column_name: (r.n_rows, r.n_null, r.n_distinct) for r in catalog.column_profile(rows, "t").collect()}
    assert got == {"n": (4, 1, 2), "x": (4, 1, 2), "t": (4, 1, 2), "b": (4, 2, 2), "d": (4, 0, 1), "ts": (4, 0, 1)}
    empty = catalog.column_profile(rows.limit(0), "t").collect()
    assert len(empty) == 6 and all((r.n_rows, r.n_null, r.n_distinct) == (0, 0, 0) for r in empty)
