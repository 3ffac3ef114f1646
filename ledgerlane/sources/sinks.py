"""Appending, updating and exporting lending tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.operators import quality
from ledgerlane.sources import keys
from ledgerlane.sources.schemas import DDL, DOMAINS, REQUIRED, SCORE_RANGE, UNIQUE, conform


def violations(df: DataFrame, table: str) -> Column:
    """Names of the constraints a row breaks; an empty array for a good row."""
    checks = []
    for column in REQUIRED.get(table, []):
        checks.append(F.when(F.col(column).isNull(), f"{column} is null"))
    for column, allowed in DOMAINS.get(table, {}).items():
        checks.append(F.when(~F.col(column).isin(allowed), f"{column} not allowed"))
    if table == "credit_scores":
        checks.append(F.when(~F.col("score").between(*SCORE_RANGE), "score out of range"))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def prepare_rows(df: DataFrame, table: str, after: int = 0, now: Column | None = None) -> DataFrame:
    """Defaults, ids where they are missing, and the declared column order."""
    filled = quality.apply_defaults(df, table, now)
    if "id" not in filled.columns:
        filled = quality.assign_ids(filled, after)
    return conform(filled, table)


def append_rows(df: DataFrame, table: str, path: str, now: Column | None = None) -> None:
    """Append rows in the declared shape. One bad row fails the job, as a constraint would.

    Missing ids go on from the largest one stored, given ones and unique columns must be
    new. Both are looked up in the key index beside the table, of which the buckets of the
    new keys are read; the table itself is not. The check of single rows runs inside the
    write: the failing row stops its task and the commit protocol leaves the table as it was.
    """
    spark = df.sparkSession
    target = current_path(spark, path)
    schema = conform(spark.createDataFrame([], DDL[table]), table).schema
    unique = ["id", *UNIQUE.get(table, [])]
    after = keys.cover(spark, target, schema, unique)
    given = "id" in df.columns
    rows = prepare_rows(df, table, after, now)
    for column in unique if given else unique[1:]:
        first = keys.clashes(rows, target, column).take(1)
        if first:
            value = int(first[0][0]) if column == "id" else first[0][0]
            raise ValueError(f"{table}: {column} {value!r} is held already")
    broken = violations(rows, table)
    checked = rows.where(
        F.when(F.size(broken) > 0, F.raise_error(F.concat(F.lit(f"{table}: "), F.array_join(broken, ", "))).cast("boolean"))
        .otherwise(F.lit(True))
    )
    checked.write.mode("append").parquet(target)
    keys.cover(spark, target, schema, unique)


def campaign_drafts(requests: DataFrame, start_date: Column) -> DataFrame:
    """Draft campaigns from generated content."""
    return requests.select(
        F.concat("campaign_type", F.lit(" - "), "target_audience").alias("campaign_name"),
        "target_audience",
        "channel",
        F.lit("AI Generated Content").alias("content"),
        "ai_generated_content",
        start_date.alias("start_date"),
        F.lit("draft").alias("status"),
    )


def chat_interactions(chats: DataFrame) -> DataFrame:
    """Answered chat messages as service interactions. Only chats of a known customer are kept."""
    return chats.where(F.col("customer_id").isNotNull()).select(
        "customer_id",
        F.lit("chat").alias("interaction_type"),
        F.lit("General Inquiry").alias("subject"),
        "message",
        "ai_response",
        "sentiment_score",
        F.lit("resolved").alias("resolution_status"),
    )


def apply_email_updates(collections: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Collections with saved e-mails: (id, version, email_content) updates, the last version winning.

    Updates without content change nothing, unknown ids are ignored.
    """
    last = (
        updates.where(F.col("email_content").isNotNull())
        .groupBy("id")
        .agg(F.max(F.struct("version", "email_content")).alias("u"))
        .select("id", F.col("u.email_content").alias("new_email"))
    )
    kept = [c for c in collections.columns if c not in ("ai_generated_email", "updated_at")]
    touched = F.col("new_email").isNotNull()
    return collections.join(last, "id", "left").select(
        *kept,
        F.coalesce("new_email", "ai_generated_email").alias("ai_generated_email"),
        F.when(touched, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def _versions(spark: SparkSession, path: str, finished: bool = True) -> list[int]:
    """Numbers of the finished versions of a table, or of all; a write that failed half way leaves no success mark."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/*" + ("/_SUCCESS" if finished else ""))
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    paths = [f.getPath().getParent() if finished else f.getPath() for f in found or []]
    return sorted(int(p.getName()) for p in paths)


def current_path(spark: SparkSession, path: str) -> str:
    """Where the rows of a table are: its newest version, or its own folder as long as it has none."""
    numbers = _versions(spark, path)
    return f"{path}/_versions/{numbers[-1]}" if numbers else path


def swap_table(df: DataFrame, path: str, tries: int = 20) -> DataFrame:
    """Write a changed table as its next version; readers that open it from then on see it.

    Versions lie below the table's folder under a name that readers of the folder skip, so
    the old files stay readable for queries that already run on them. Of two writers that
    aim at one number the later one goes on to the next; a number that a failed write has
    used is not used again.
    """
    spark = df.sparkSession
    for _ in range(tries):
        numbers = _versions(spark, path, finished=False)
        target = f"{path}/_versions/{numbers[-1] + 1 if numbers else 1}"
        try:
            df.write.mode("errorifexists").parquet(target)
        except AnalysisException as taken:
            if taken.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            continue
        return spark.read.parquet(target)
    raise RuntimeError(f"{path}: other writers took {tries} versions")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)
