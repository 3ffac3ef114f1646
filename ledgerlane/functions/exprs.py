"""Scalar lending rules as column expressions. No Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.sources.schemas import RISK_INDICATORS

# Risk weight per country; any other country counts as DEFAULT_COUNTRY_RISK.
COUNTRY_RISK = {
    "Germany": 0.1,
    "France": 0.15,
    "Italy": 0.2,
    "Spain": 0.25,
    "Poland": 0.3,
    "Netherlands": 0.05,
}
DEFAULT_COUNTRY_RISK = 0.2
DEFAULT_AGE = 35
DEFAULT_SCORE = 650


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: Column | str, table: dict, default=None) -> Column:
    """A fixed table of a few entries as one CASE: no join and nothing to broadcast."""
    key = _col(key)
    whens = reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), table.items(), F)
    return whens.otherwise(F.lit(default))


# names and text ---------------------------------------------------------------


def display_name(company="company_name", first="first_name", last="last_name") -> Column:
    return F.coalesce(_col(company), F.concat_ws(" ", _col(first), _col(last)))


def directory_label(name: Column, email: Column | str = "email") -> Column:
    return F.concat(name, F.lit(" ("), _col(email), F.lit(")"))


def title_case(c: Column | str) -> Column:
    return F.initcap(F.translate(_col(c), "_", " "))


def money_text(c: Column | str, digits: int = 2) -> Column:
    return F.concat(F.lit("€"), F.format_number(_col(c), digits))


def percent_text(c: Column | str, digits: int = 1) -> Column:
    return F.concat(F.format_number(_col(c) * 100, digits), F.lit("%"))


def padded_id(prefix: str, c: Column | str) -> Column:
    """``LOAN007``; ids over 999 keep all their digits."""
    return F.format_string(f"{prefix}%03d", _col(c))


def clamp(c: Column | str, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _col(c)))


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Round halves to even after scaling, the way NumPy rounds a float."""
    scale = F.lit(float(10**digits))
    return F.rint(_col(c) * scale) / scale


# overdue accounts -------------------------------------------------------------


def overdue_risk(days="days_overdue", amount="outstanding_amount") -> Column:
    return _col(days) / F.lit(30.0) * (_col(amount) / F.lit(1000.0))


def seed_stage(days="days_overdue") -> Column:
    d = _col(days)
    return F.when(d < 30, "early").when(d < 60, "mid").when(d >= 60, "late")


def workflow_stage(days="days_overdue") -> Column:
    d = _col(days)
    return (
        F.when(d < 15, "current")
        .when(d <= 30, "early")
        .when(d <= 60, "mid")
        .when(d <= 90, "late")
        .when(d > 90, "legal")
    )


def risk_band(days="days_overdue") -> Column:
    d = _col(days)
    return F.when(d > 90, "critical").when(d > 60, "high").when(d > 30, "elevated").when(d <= 30, "normal")


def payment_plan(amount="outstanding_amount", start="start_date", months: int = 12, rate: float = 0.05) -> Column:
    """Equal instalments; the rate is recorded and not applied."""
    return F.struct(
        (_col(amount) / F.lit(float(months))).alias("monthly_payment"),
        F.lit(months).alias("duration_months"),
        F.lit(rate).alias("interest_rate"),
        _col(start).cast("string").alias("start_date"),
    )


def json_text(schema: str, **values) -> Column:
    """The given columns as JSON text in the field order and types of a declared shape."""
    fields = T.StructType.fromDDL(schema)
    return F.to_json(F.struct(*[_col(values[f.name]).cast(f.dataType).alias(f.name) for f in fields]))


def next_action_date(last_contact="last_contact_date", days: int = 7) -> Column:
    return F.date_add(_col(last_contact), days)


# credit scores ----------------------------------------------------------------


def score_risk_level(score="score") -> Column:
    s = _col(score)
    return (
        F.when(s >= 740, "Low Risk")
        .when(s >= 670, "Medium-Low Risk")
        .when(s >= 580, "Medium Risk")
        .when(s.isNotNull(), "High Risk")
    )


def score_rating(score="score") -> Column:
    s = _col(score)
    return F.when(s >= 740, "Excellent").when(s >= 670, "Good").when(s >= 580, "Fair").when(s.isNotNull(), "Poor")


def score_delta(score="score", reference: int = DEFAULT_SCORE) -> Column:
    return _col(score) - F.lit(reference)


def histogram_bin(c: Column | str, low: float, high: float, bins: int) -> Column:
    """Equal-width bin number; the upper edge belongs to the last bin."""
    width = (high - low) / bins
    return F.least(F.floor((_col(c) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")


# sentiment --------------------------------------------------------------------


def sentiment_category(score="sentiment_score") -> Column:
    s = _col(score)
    return F.when(s >= 0.5, "Positive").when(s <= -0.5, "Negative").when(s.isNotNull(), "Neutral")


def sentiment_alert(score="sentiment_score") -> Column:
    s = _col(score)
    return F.when(s > 0.5, "positive").when(s < -0.5, "negative").otherwise("neutral")


def needs_escalation(score="sentiment_score", threshold: float = -0.5) -> Column:
    return F.coalesce(_col(score) < F.lit(threshold), F.lit(False))


# bank statements --------------------------------------------------------------


def expense_ratio(income="monthly_income", expenses="monthly_expenses", otherwise: float | None = 1.0) -> Column:
    i = _col(income)
    return F.when(i > 0, _col(expenses) / i).otherwise(F.lit(otherwise).cast("double"))


def savings_rate(income="monthly_income", expenses="monthly_expenses") -> Column:
    i = _col(income)
    return F.when(i > 0, (i - _col(expenses)) / i).otherwise(F.lit(0.0))


def parse_json(text: Column | str, schema: str) -> Column:
    """JSON text as a struct, parsed once per row however many fields are read.

    With an option set, the optimizer does not narrow the schema per field, which would
    parse the text again for each of them.
    """
    return F.from_json(_col(text), schema, {"mode": "PERMISSIVE"})


def parse_indicators(text="risk_indicators") -> Column:
    """Indicator JSON as a struct without NULLs: missing, malformed or absent reads as 0 / false."""
    raw = parse_json(text, RISK_INDICATORS)
    return F.struct(
        F.coalesce(raw["overdrafts"], F.lit(0)).alias("overdrafts"),
        F.coalesce(raw["returned_payments"], F.lit(0)).alias("returned_payments"),
        F.coalesce(raw["gambling_transactions"], F.lit(False)).alias("gambling_transactions"),
        F.coalesce(raw["irregular_income"], F.lit(False)).alias("irregular_income"),
    )


def statement_risk(indicators: Column | str) -> Column:
    i = _col(indicators)
    return (
        i["overdrafts"] * 2
        + i["returned_payments"] * 3
        + F.when(i["gambling_transactions"], 5).otherwise(0)
        + F.when(i["irregular_income"], 3).otherwise(0)
    )


def statement_risk_class(risk: Column | str) -> Column:
    r = _col(risk)
    return F.when(r <= 5, "low").when(r <= 10, "medium").when(r.isNotNull(), "high")


# customers --------------------------------------------------------------------


def age_at(as_of: str, born="date_of_birth", default: int = DEFAULT_AGE) -> Column:
    years = F.floor(F.months_between(F.lit(as_of).cast("date"), _col(born)) / 12).cast("int")
    return F.coalesce(years, F.lit(default))


def country_risk(country="country") -> Column:
    return lookup(country, COUNTRY_RISK, DEFAULT_COUNTRY_RISK)


# repeatable draws -------------------------------------------------------------


def digest(*parts: Column | str) -> Column:
    """A hash of the text of the parts as 32 hex digits, equal on every partitioning."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]))


def word32(hexes: Column | str, at: int = 0) -> Column:
    """One of the four 32-bit numbers in a digest."""
    return F.conv(F.substring(_col(hexes), 1 + 8 * at, 8), 16, 10).cast("bigint")


def hash32(*parts: Column | str) -> Column:
    return word32(digest(*parts))


def unit(word: Column) -> Column:
    """A 32-bit number as a draw from the open interval (0, 1)."""
    return (word + F.lit(0.5)) / F.lit(4294967296.0)


def uniform(*parts: Column | str) -> Column:
    return unit(hash32(*parts))
