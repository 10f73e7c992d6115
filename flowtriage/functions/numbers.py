"""Ratios and roundings that agree with Python's float arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def py_round(value: Column, digits: int) -> Column:
    """Python's round(): half to even, decided on the exact binary value.

    bround() decides on the shortest decimal text instead, so it turns 2.675
    into 2.68 where Python gives 2.67; number formatting looks at the binary value.
    """
    text = F.call_function("format_number", value.cast("double"), F.lit("0." + "#" * digits))
    return text.cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as DOUBLE, 0.0 when there is no whole."""
    whole = F.coalesce(whole.cast("double"), F.lit(0.0))
    return F.when(whole == 0.0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def safe_pct(part: Column, whole: Column, digits: int = 4) -> Column:
    return py_round(ratio(part, whole) * F.lit(100.0), digits)


def ci_margin(n: Column, z: float = 1.96, p: float = 0.5) -> Column:
    """Margin of error in percent for a proportion p at sample size n; NULL without a sample."""
    return F.when(n > 0, py_round(F.lit(z) * F.sqrt(F.lit(p * (1 - p)) / n.cast("double")) * F.lit(100.0), 2))


def lenient_integer(column: str, sql_type: str) -> str:
    """SQL for text to integer as non-ANSI casts do it: a decimal fraction is cut off, junk is NULL.

    The pattern only runs for values the plain cast refuses.
    """
    return (
        f"coalesce(try_cast({column} AS {sql_type}),"
        f" try_cast(regexp_replace(cast({column} AS STRING), '[.][0-9]*[ ]*$', '') AS {sql_type}))"
    )
