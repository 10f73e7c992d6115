"""How long stored tables live."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowtriage.session import released, scratch, scratch_path, shared_dir, stored


def folders(spark):
    return {p.name for p in Path(shared_dir(spark), "flowtriage").glob("*")}


def test_a_block_takes_its_tables_along(spark):
    before = folders(spark)
    with scratch(spark):
        table = stored(spark.range(10), "ten")
        with scratch(spark):
            stored(table.filter("id > 3"), "six")
            assert len(folders(spark) - before) == 2
        assert len(folders(spark) - before) == 1 and table.count() == 10
    assert folders(spark) == before


def test_a_block_that_fails_leaves_nothing(spark):
    before = folders(spark)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        stored(spark.range(10), "ten")
        1 / 0
    assert folders(spark) == before


def test_what_a_result_reads_stays_until_the_block_outside_ends(spark):
    @released
    def halves(df, n):
        first = stored(df.filter(f"id < {n}"), "first")
        second = stored(first.withColumn("half", F.col("id") / 2), "second")
        other = stored(df.filter(f"id >= {n}"), "other")
        return second.join(other.select((F.col("id") - n).alias("id")), "id")

    before = folders(spark)
    with scratch(spark):
        result = halves(spark.range(20), 10)
        assert len(folders(spark) - before) == 2  # the two tables that the join reads
        assert result.count() == 10
    assert folders(spark) == before
    outside = halves(spark.range(20), 10)  # without a block the session keeps them
    assert len(folders(spark) - before) == 2 and outside.count() == 10


def test_a_path_alone_makes_no_folder(spark):
    before = folders(spark)
    with scratch(spark):
        pass
    assert scratch_path(spark, "x").startswith(shared_dir(spark)) and folders(spark) == before
