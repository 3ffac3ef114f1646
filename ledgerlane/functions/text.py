"""Template filling and reply parsing inside one row; no explode, no shuffle, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlane.sources.schemas import SENTIMENT_REPLY

# Fixed values. A template is read as a run of these: an escaped brace, a
# placeholder, plain text, or a brace on its own.
TOKEN = r"\{\{|\}\}|\{\w+\}|[^{}]+|[{}]"
PLACEHOLDER = r"^\{\w+\}$"

# White space at the ends of a line, beyond the plain space.
EDGE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"
# A new item begins with a digit or a dash. Digits beyond the decimal ones are raised,
# lowered, circled and the like.
_ODD_DIGITS = "".join(
    f"\\x{{{code:x}}}" for code in range(0x80, 0x20000) if chr(code).isdigit() and not chr(code).isdecimal()
)
ITEM_START = rf"[\p{{Nd}}{_ODD_DIGITS}\-]"


def _tokens(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(TOKEN), F.lit(0))


def _name(token: Column) -> Column:
    return F.substring(token, F.lit(2), F.length(token) - 2)


def template_parts(template: Column) -> Column:
    """The template as (text, var) pieces, so that it is read once and filled many times."""

    def piece(token: Column) -> Column:
        slot = token.rlike(PLACEHOLDER)
        return F.struct(
            F.when(token == "{{", F.lit("{")).when(token == "}}", F.lit("}")).otherwise(token).alias("text"),
            F.when(slot, _name(token)).alias("var"),
        )

    return F.transform(_tokens(template), piece)


def fill_literal(template: str, values: dict[str, Column]) -> Column:
    """A template known in advance as one concatenation."""
    pieces = []
    for at, part in enumerate(template.replace("}", "{").split("{")):
        if part:
            pieces.append(values[part] if at % 2 else F.lit(part))
    return F.concat(*pieces)


def fill_template(template: Column, values: Column) -> Column:
    """Replace each ``{name}`` once; a value that itself holds braces is left alone."""

    def filled(token: Column) -> Column:
        return (
            F.when(token == "{{", F.lit("{"))
            .when(token == "}}", F.lit("}"))
            .when(token.rlike(PLACEHOLDER), F.coalesce(F.try_element_at(values, _name(token)), token))
            .otherwise(token)
        )

    return F.array_join(F.transform(_tokens(template), filled), "")


def missing_variables(template: Column, values: Column) -> Column:
    """Placeholders without a value, in order of first use."""
    names = F.transform(F.filter(_tokens(template), lambda t: t.rlike(PLACEHOLDER)), _name)
    return F.array_except(F.array_distinct(names), F.map_keys(values))


def strip_edges(text: Column) -> Column:
    return F.regexp_replace(text, f"^{EDGE}|{EDGE}$", "")


def parse_variations(reply: Column) -> Column:
    """Items of a numbered or dashed list, each joined to one line.

    Lines that start an item are marked by position in the joined text, so the reply
    is split in one pass; text before the first item is dropped.
    """
    lines = F.filter(F.transform(F.split(reply, "\n"), strip_edges), lambda line: line != "")
    items = F.split(F.array_join(lines, "\n"), f"\n(?={ITEM_START})")
    listed = F.filter(items, lambda item: item.rlike(f"^{ITEM_START}"))
    return F.transform(listed, lambda item: F.replace(item, F.lit("\n"), F.lit(" ")))


def parse_sentiment(reply: Column) -> Column:
    """A sentiment reply as (score, explanation); text that is not a JSON object scores 0."""
    parsed = F.from_json(
        reply, f"{SENTIMENT_REPLY}, bad string", {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"}
    )
    broken = reply.isNull() | parsed["bad"].isNotNull() | ~reply.rlike(r"(?s)^\s*\{.*\}\s*$")
    return F.struct(
        F.when(broken, F.lit(0.0)).otherwise(F.coalesce(parsed["score"], F.lit(0.0))).alias("score"),
        F.when(broken, F.lit("Error analyzing sentiment: reply is not a JSON object"))
        .otherwise(parsed["explanation"])
        .alias("explanation"),
    )
