"""Safe parsing and arithmetic on columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright import rules

# Text that counts as a number.  A cast alone would also take '1d' and '1f'.
NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"

# Layouts tried in order for text that should be a date or time.
DATETIME_LAYOUTS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MMM-yyyy",
    "MMM d, yyyy", "yyyy-MM",
)


def safe_numeric(c: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    return F.when(c.rlike(NUMERIC_TEXT), F.trim(c).try_cast("double"))


def sql_literal(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double_literal(x: float | None) -> str:
    """A double as expression text, whatever it is."""
    if x is None:
        return "CAST(NULL AS DOUBLE)"
    if math.isfinite(x):
        return f"{x!r}D"
    return "double('NaN')" if math.isnan(x) else f"double('{'-' if x < 0 else ''}Infinity')"


def finite_sql(v: str) -> str:
    """A double where it is finite, else null, as expression text."""
    return f"CASE WHEN abs({v}) < double('Infinity') THEN {v} END"


def safe_numeric_sql(c: str) -> str:
    """``safe_numeric`` as expression text, for aggregates over many columns."""
    return f"CASE WHEN {c} RLIKE {sql_literal(NUMERIC_TEXT)} THEN try_cast(trim({c}) AS DOUBLE) END"


def safe_timestamp(c: Column) -> Column:
    """Text to a wall-clock timestamp; unreadable text becomes null."""
    tries = [F.try_to_timestamp(F.trim(c), F.lit(layout)) for layout in DATETIME_LAYOUTS]
    return F.when(c.rlike(r"\d"), F.coalesce(*tries)).cast("timestamp_ntz")


def safe_timestamp_sql(c: str) -> str:
    """``safe_timestamp`` as expression text."""
    tries = ", ".join(f"try_to_timestamp(trim({c}), {sql_literal(layout)})" for layout in DATETIME_LAYOUTS)
    return f"CAST(CASE WHEN {c} RLIKE '[0-9]' THEN coalesce({tries}) END AS TIMESTAMP_NTZ)"


def blank_to_null(c: Column) -> Column:
    """Empty or all-space text becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def no_nan(c: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(c), c)


def ratio(a: Column, b: Column, scale: float, digits: int) -> Column:
    """``a / b * scale`` rounded half-up; a zero or missing denominator gives null."""
    value = F.try_divide(a.cast("double"), b.cast("double"))
    return F.round(value if scale == 1 else value * F.lit(float(scale)), digits)


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share in percent, 0 when the whole is empty."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * 100.0, F.lit(0.0)), digits)


def grade(score: Column) -> Column:
    """Letter for a score of 0 to 100."""
    bands = [F.when(score >= floor, F.lit(letter)) for letter, floor in rules.GRADE_BANDS]
    return F.coalesce(*bands, F.lit("F"))


def grade_rank(letter: Column) -> Column:
    """Rank of a letter; unknown letters rank lowest."""
    return F.coalesce(*[F.when(letter == g, F.lit(r)) for g, r in rules.GRADE_RANK.items()], F.lit(0))


def age_days(then: Column, as_of: Column) -> Column:
    """Whole elapsed days between two timestamps."""
    return F.floor(F.timestamp_diff("SECOND", then, as_of) / 86400).cast("int")


def all_of(conditions: list[Column]) -> Column:
    """Conjunction; true when there are no conditions."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_fractional(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType))


def is_number(t: T.DataType) -> bool:
    return is_integral(t) or is_fractional(t)


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.CharType, T.VarcharType))


def is_moment(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def type_family(t: T.DataType) -> str:
    """The five logical types of a data dictionary."""
    if is_integral(t):
        return "INTEGER"
    if is_fractional(t):
        return "FLOAT"
    if is_moment(t):
        return "TIMESTAMP"
    if isinstance(t, T.BooleanType):
        return "BOOLEAN"
    return "VARCHAR"
