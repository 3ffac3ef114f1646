"""Onboarding conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions import text as tx
from ledgerlane.operators import conversations as c
from ledgerlane.operators import prompts as p
from ledgerlane.plans.registry import query
from ledgerlane.sources.views import Lending


@query
def conversation_context(book: Lending) -> DataFrame:
    return c.conversation_context(book.conversations)


@query
def turn_numbering(book: Lending) -> DataFrame:
    return c.question_numbers(book.conversations)


@query
def onboarding_history(book: Lending) -> DataFrame:
    return c.history(book.conversations)


@query
def onboarding_messages(book: Lending) -> DataFrame:
    """One model call per user turn; its history is the earlier rows of ``onboarding_history``."""
    kind = F.when(F.col("conv_id") % 3 == 0, "business").otherwise("individual")
    return c.model_calls(book.conversations, p.onboarding_system_prompt(kind))


@query
def parsed_variations(book: Lending) -> DataFrame:
    """Assistant texts read as replies: as they are, or laid out as a list with a preamble."""
    listed = F.concat(
        F.lit("Here are the variations:\n \n1. "), F.replace("text", F.lit("\n"), F.lit("\n\t- ")), F.lit(" \n  and more")
    )
    reply = F.when(F.col("turn") % 4 == 1, listed).otherwise(F.concat("text", F.lit("\n2) "), "text"))
    return (
        book.conversations.where("role = 'assistant'")
        .select("conv_id", "turn", F.posexplode(tx.parse_variations(reply)).alias("at", "variation"))
        .select("conv_id", "turn", (F.col("at") + 1).alias("variation_no"), "variation")
    )
