"""Scalar column expressions shared by batch, stream and training.

Everything is a built-in Spark expression, so it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Literals the results depend on.
MISSING_LEVEL = "__NA__"
EMP_LENGTH_MISSING = ("NI", "n/a", "NA", "")
MONTH_FORMAT = "MMM-yyyy"
BAND_EDGES = (0.15, 0.30)
BAND_NAMES = ("Lower risk", "Moderate risk", "Higher risk")
TOWARD_DEFAULT, TOWARD_REPAYING = "toward default", "toward repaying"
PROPORTION_FLOOR = 1e-6

# Unicode blanks. Java's (?U)\s leaves out the four separator controls that Python strips.
_BLANK = r"[\s\x{1c}-\x{1f}]"
_HAS_INK = r"(?U)[^\s\x{1c}-\x{1f}]"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{_BLANK}+|{_BLANK}+$", "")


def finite_or_null(c: Column) -> Column:
    """Null for NaN and for both infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def numeric(df: DataFrame, name: str) -> Column:
    """Coerce to double; junk and NaN become null (the only missing value from here on)."""
    value = F.col(f"`{name}`")
    number = value.try_cast("double")
    if dict(df.dtypes)[name] == "string":
        # Java would also read type suffixes such as 1.5d as numbers.
        number = F.when(~value.rlike(r"[dDfF]\s*$") | value.rlike(r"(?i)inf\s*$"), number)
    return F.when(~F.isnan(number), number)


def strict_flag(name: str) -> Column:
    """Whole-number target as tinyint; junk and missing both fail the job."""
    value = F.col(f"`{name}`").cast("double").cast("tinyint")
    return F.coalesce(value, F.raise_error(F.lit(f"missing target in column {name}")).cast("tinyint"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return finite_or_null(F.try_divide(numerator, F.nullif(denominator, F.lit(0.0))))


def emp_length_years(c: Column) -> Column:
    text = stripped(c.cast("string"))
    return (
        F.when(text.isin(*EMP_LENGTH_MISSING), F.lit(None))
        .when(text.startswith("<"), F.lit(0.0))
        .when(text.startswith("10+"), F.lit(10.0))
        .otherwise(F.regexp_substr(text, F.lit("[0-9]+")).try_cast("double"))
    )


def has_text(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(_HAS_INK).cast("tinyint")


def text_length(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit("")))


def category(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING_LEVEL))


def month_start(c: Column) -> Column:
    """First day of a ``Dec-2015`` style month; null when it does not parse."""
    return F.try_to_date(c, MONTH_FORMAT)


def issue_date(df: DataFrame, *, typed: str, raw: str) -> Column:
    """The typed date column when there is one, else the date parsed from the raw month."""
    if typed in df.columns:
        return F.col(typed).try_cast("date")
    return month_start(F.col(raw))


def clip_low(c: Column, floor: float = PROPORTION_FLOOR) -> Column:
    return F.greatest(c, F.lit(floor))


def psi_term(ref_share: Column, cur_share: Column) -> Column:
    r, c = clip_low(ref_share), clip_low(cur_share)
    return (c - r) * F.ln(c / r)


def risk_band(probability: Column) -> Column:
    low, high = BAND_EDGES
    return (
        F.when(probability < low, F.lit(BAND_NAMES[0]))
        .when(probability < high, F.lit(BAND_NAMES[1]))
        .otherwise(F.lit(BAND_NAMES[2]))
    )


def push_direction(contribution: Column) -> Column:
    return F.when(contribution > 0, F.lit(TOWARD_DEFAULT)).otherwise(F.lit(TOWARD_REPAYING))


def hash_order(id_column: str, salt: object = "") -> Column:
    """Portable pseudo-random order of rows: MD5 of the salted id, as a hex string."""
    text = F.col(f"`{id_column}`").cast("string")
    return F.md5(text if salt == "" else F.concat(F.lit(f"{salt}|"), text))
