"""Chat turns: position within the conversation, context before a turn, numbered questions.

A conversation may be arbitrarily long, so no window spans a whole one. Turns are
cut into chunks of ``span`` consecutive turn numbers; windows run inside a chunk and
a second, small window over one summary row per chunk carries counts and the last
role across the chunk borders. (conv_id, turn) is the key of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 65536


def with_position(turns: DataFrame, counted: Column | None = None, span: int = SPAN) -> DataFrame:
    """Add ``chunk``, ``n_before``, ``n_total`` (of the rows where ``counted`` holds) and ``last_role``."""
    counted = F.lit(True) if counted is None else counted
    flagged = turns.withColumns(
        {"chunk": F.floor(F.col("turn") / span).cast("bigint"), "one": F.when(counted, 1).otherwise(0)}
    )
    local = Window.partitionBy("conv_id", "chunk").orderBy("turn")
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    inside = flagged.withColumns(
        {
            "local_before": F.coalesce(F.sum("one").over(earlier), F.lit(0)),
            "local_role": F.lag("role").over(local),
        }
    )
    chunks = flagged.groupBy("conv_id", "chunk").agg(
        F.sum("one").alias("n"), F.max(F.struct("turn", "role")).alias("last")
    )
    along = Window.partitionBy("conv_id").orderBy("chunk")
    carried = chunks.select(
        "conv_id",
        "chunk",
        F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"),
        F.sum("n").over(Window.partitionBy("conv_id")).alias("n_total"),
        F.lag("last.role").over(along).alias("carry_role"),
    )
    return inside.join(carried, ["conv_id", "chunk"]).select(
        *turns.columns,
        "chunk",
        (F.col("carry") + F.col("local_before")).alias("n_before"),
        "n_total",
        F.coalesce("local_role", "carry_role").alias("last_role"),
    )


def conversation_context(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """For every user turn: how many turns came before it, and who spoke last."""
    placed = with_position(turns.select("conv_id", "turn", "role"), span=span)
    return placed.where("role = 'user'").select(
        "conv_id", "turn", F.col("n_before").alias("history_len"), "last_role"
    )


def question_numbers(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """User turns numbered in order of asking, and their place in a newest-first list."""
    asked = turns.where("role = 'user'").select("conv_id", "turn", "role")
    return with_position(asked, span=span).select(
        "conv_id",
        "turn",
        (F.col("n_before") + 1).alias("question_no"),
        (F.col("n_total") - F.col("n_before")).alias("newest_first"),
    )


def history(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """Every turn once, with its position in the conversation counted from 1."""
    placed = with_position(turns.select("conv_id", "turn", "role", "text"), span=span)
    return placed.select("conv_id", (F.col("n_before") + 1).alias("position"), "role", F.col("text").alias("content"))


def model_calls(turns: DataFrame, system_prompt: Column, span: int = SPAN) -> DataFrame:
    """What is sent to the model at every user turn, in linear form.

    The messages are the system prompt, the rows of ``history`` of the same conversation
    with a smaller position, and the user's message. The history is not repeated in every
    row: that would grow with the square of the length.
    """
    placed = with_position(turns.select("conv_id", "turn", "role", "text"), span=span)
    return placed.where("role = 'user'").select(
        "conv_id",
        "turn",
        (F.col("n_before") + 1).alias("position"),
        (F.col("n_before") + 2).alias("n_messages"),
        system_prompt.alias("system_prompt"),
        F.col("text").alias("user_message"),
    )
