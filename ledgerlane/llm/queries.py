"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm import (
    bpe,
    decontamination,
    exact,
    periodic,
    pii,
    quality,
    repair,
    sharding,
    simhash,
    suffixes,
    toxicity,
    trie,
    vectors,
)
from ledgerlane.llm.common import table, written

SHARDS = 8


def vector_groups(spark: SparkSession, root: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, root, "embeddings"), threshold=0.93)


def simhash_groups(spark: SparkSession, root: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, root, "documents"), width=3, max_bits=2)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shards(spark: SparkSession, root: str) -> DataFrame:
    return sharding.assign(
        table(spark, root, "documents"), sharding.even_tree(SHARDS), grown=sharding.even_tree(SHARDS + 1)
    )


def private_spans(spark: SparkSession, root: str) -> DataFrame:
    return pii.digests(table(spark, root, "documents"))


def benchmark_passages(spark: SparkSession, root: str) -> DataFrame:
    return decontamination.report(table(spark, root, "documents"), table(spark, root, "benchmark"))


def quality_scores(spark: SparkSession, root: str) -> DataFrame:
    return quality.scored(table(spark, root, "documents"), table(spark, root, "labels"))


def repeated_strings(spark: SparkSession, root: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, root, "documents"))


def repair_round_trip(spark: SparkSession, root: str) -> DataFrame:
    return repair.round_trip(table(spark, root, "documents"))


def toxicity_scores(spark: SparkSession, root: str) -> DataFrame:
    return toxicity.scored(table(spark, root, "documents"), table(spark, root, "labels"))


def bpe_digests(spark: SparkSession, root: str) -> DataFrame:
    return bpe.digests(table(spark, root, "documents"))


def periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    return periodic.report(periodic.with_planted_run(table(spark, root, "documents")))


def conversation_trie(spark: SparkSession, root: str) -> DataFrame:
    turns = written(trie.ordered(table(spark, root, "conversations")), "turns")
    return trie.trie(*trie.with_borrowed_heads(turns))


def exact_groups(spark: SparkSession, root: str) -> DataFrame:
    return exact.groups(table(spark, root, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_collision_counting": vector_groups,
    "op2_simhash": simhash_groups,
    "op3_hash_tree": shards,
    "op4_semi_markov_pii": private_spans,
    "op5_latent_decontamination": benchmark_passages,
    "op6_quality": quality_scores,
    "op7_suffix_sort": repeated_strings,
    "op8_repair": repair_round_trip,
    "op9_toxicity": toxicity_scores,
    "op10_bpe": bpe_digests,
    "op11_periodic_runs": periodic_runs,
    "op12_conversation_trie": conversation_trie,
    "op13_exact_dedup": exact_groups,
}

#: The other queries need hashes, merges, models or byte strings that DuckDB's SQL does not have, or (op11) too long on
#: whole tables: every lag of every text.
ORACLE_SQL: dict[str, str] = {
    "op1_collision_counting": """
        WITH RECURSIVE usable AS (
          SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
        reached(a, b) AS (
          SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
        components AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN components c ON c.a = e.vec_id LEFT JOIN counts k ON k.a = e.vec_id""",
    "op12_conversation_trie": """
        WITH crc_steps AS (
          SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS step),
        turns AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
          FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (
          SELECT conv_id, conv_id - conv_id % 100 AS base,
            xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
              list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
              lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8))) % 6 AS h
          FROM (SELECT DISTINCT conv_id FROM turns), crc_steps),
        rebuilt AS (
          SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
          UNION ALL
          SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
        paths AS (
          SELECT conv_id, row_number() OVER w AS depth, length(text) AS size,
            list({'role': role, 'text': text}) OVER w AS path
          FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
          UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
        placed AS (
          SELECT *, dense_rank() OVER (ORDER BY depth, path) AS node, max(depth) OVER (PARTITION BY conv_id) AS ends_at
          FROM paths),
        nodes AS (
          SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(size) AS size,
            coalesce(string_agg(CASE WHEN depth = ends_at THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
          FROM placed GROUP BY node),
        parents AS (
          SELECT n.node, p.node AS parent FROM nodes n JOIN placed p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
        children AS (SELECT parent, count(*) AS n_children FROM parents GROUP BY parent),
        subtrees AS (
          SELECT p.node, count(*) FILTER (WHERE k.parent IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved
          FROM nodes n LEFT JOIN children k ON k.parent = n.node
          JOIN placed p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node)
        SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
          s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM nodes n JOIN subtrees s USING (node) LEFT JOIN parents p USING (node) LEFT JOIN nodes up ON up.node = p.parent
        LEFT JOIN children k ON k.parent = n.node""",
    "op13_exact_dedup": """
        WITH hashed AS (
          SELECT doc_id, length(coalesce(text, '')) AS size,
            sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
          row_number() OVER w = 1 AS kept, text_sha256
        FROM hashed WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST)""",
}
