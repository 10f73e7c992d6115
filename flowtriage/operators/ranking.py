"""Rank 1..N over a whole table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from flowtriage.session import materialise

RANK_ORDER = ["timestamp", "record_id"]
#: Rows that a range holds, about.
RANGE_ROWS = 250_000
#: Bits of a row number below those of its partition.
ROW_BITS = 33


def global_rank(df: DataFrame, rows: int | None = None, order: list[str] = RANK_ORDER) -> DataFrame:
    """Adds sample_rank by the order columns, the other columns breaking ties.

    Range partitions are sorted side by side, each starting after the rows
    before it. Their number comes from the row count: what the caller knows it
    to be, or one more pass. The random last key splits equal rows over several
    ranges. Range bounds and random keys change when recomputed, so the sorted
    partitions are kept, with a number per row, and not shuffled again.
    """
    keys = [*order, *[c for c in df.columns if c not in order]]
    parts = max(1, math.ceil((df.count() if rows is None else rows) / RANGE_ROWS))
    ranged = materialise(
        df.withColumn("_salt", F.rand())
        .repartitionByRange(parts, *keys, "_salt").sortWithinPartitions(*keys, "_salt").drop("_salt")
        .withColumn("_number", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("_number", ROW_BITS)
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    row = F.col("_number").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    return (
        ranged.withColumn("_part", part).join(F.broadcast(starts), "_part")
        .withColumn("sample_rank", (row + F.col("_start")).cast("bigint"))
        .drop("_number", "_part", "_start")
    )
