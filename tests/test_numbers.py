from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from flowtriage.functions.numbers import ci_margin, py_round, ratio, safe_pct


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=200), st.integers(1, 8))
def test_py_round_is_pythons_round(spark, values, digits):
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", py_round(F.col("x"), digits)).collect()
    assert all(got == round(x, digits) for x, got in rows)


def test_rounding_decides_on_the_binary_value(spark):
    ties = [2.675, 1.005, 0.0078125, 0.5, 2.5, 1 / 128]
    df = spark.createDataFrame([(v,) for v in ties], "x double")
    for digits in (2, 6):
        rows = df.select("x", py_round(F.col("x"), digits)).collect()
        assert [r[1] for r in rows] == [round(v, digits) for v in ties]


def test_ratios_without_a_whole(spark):
    df = spark.createDataFrame([(1, 0), (1, None), (0, 4), (1, 3)], "a bigint, b bigint")
    rows = df.select(ratio(F.col("a"), F.col("b")), safe_pct(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0), (0.0, 0.0), (0.0, 0.0), (1 / 3, 33.3333)]


@pytest.mark.parametrize("n, margin", [(1000, 3.1), (3000, 1.79), (5000, 1.39), (0, None)])
def test_margins(spark, n, margin):
    assert spark.range(1).select(ci_margin(F.lit(n))).first()[0] == margin
