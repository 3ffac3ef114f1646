import corpus_pipeline
from oracle_check import connect, difference

from ledgerlane.llm import queries

SMALL = "/root/testdata/sf0.001"
CONTRACT = {
    "op1": ["vec_id", "n_links", "component_id", "kept"],
    "op2": ["doc_id", "fingerprint", "component_id"],
    "op3": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op4": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op5": ["doc_id", "contaminated"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op8": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op9": ["doc_id", "held_out", "score", "predicted"],
    "op10": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op11": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12": [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ],
    "op13": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
}


def test_every_query_gives_a_row_per_input_row(spark):
    for name, run in queries.QUERIES.items():
        found = run(spark, SMALL)
        wanted = CONTRACT[name.split("_")[0]]
        assert found.columns[: len(wanted)] == wanted
        if name.startswith("op12_"):
            # a row per node; the root and the conversations' ends are among them
            assert found.where("depth = 0 AND parent_conv_id IS NULL").count() == 1
            continue
        source = "embeddings" if name.startswith("op1_") else "documents"
        assert found.count() == spark.read.parquet(f"{SMALL}/{source}.parquet").count()
    assert sorted(CONTRACT) == sorted(n.split("_")[0] for n in queries.QUERIES)


def test_queries_equal_their_sql(spark):
    for root in (SMALL, "/root/testdata/sf0.1"):
        for name, sql in queries.ORACLE_SQL.items():
            assert difference(queries.QUERIES[name](spark, root), connect(root), sql) is None


def test_stages_take_odd_rows_and_keep_the_columns(spark):
    rows = [
        (1, "word " * 3000, "en", "s", 5, "x"), (2, None, None, None, None, None), (None, "a b c d", "de", "s", 1, "y"),
        (3, "", "en", "s", 0, "z"), (4, "write to jo@mail.example.com now please", "en", "s", 9, "x"),
        (4, "write to jo@mail.example.com now please", "en", "s", 9, "x"), (5, "entirely different words here", "en", "s", 1, "w"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SMALL).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 2, 4, 5, None]
    redacted = {r["doc_id"]: r for r in corpus_pipeline.redact_private(spark, docs, SMALL).collect()}
    assert redacted[4]["text"] == "write to [email] now please" and redacted[4]["n_chars"] == 27 and redacted[2]["text"] is None
    assert corpus_pipeline.tokens(spark, docs, SMALL).count() == len(rows)


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, SMALL)
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert 0.6 * n < out.count() < n
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
