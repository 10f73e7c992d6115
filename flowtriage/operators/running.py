"""Running totals that do not put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def running_totals(df: DataFrame, group: list[str], block: str, order: list[str], values: list[str]) -> DataFrame:
    """Replaces each value by its running total within group, in the given order.

    block must grow with the order. Windows only ever hold one block, or one
    total per block: the totals before a block are added to those inside it.
    """
    keys = [*group, block]
    inside = f"PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)} ROWS UNBOUNDED PRECEDING"
    before = f"PARTITION BY {', '.join(group)} ORDER BY {block} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    offsets = (
        df.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
        .selectExpr(*keys, *[f"coalesce(sum({v}) OVER ({before}), 0) AS _before_{v}" for v in values])
    )
    rest = [c for c in df.columns if c not in values and c not in keys]
    return (
        df.selectExpr(*keys, *rest, *[f"sum({v}) OVER ({inside}) AS {v}" for v in values])
        .join(offsets, keys)
        .selectExpr(*keys, *rest, *[f"{v} + _before_{v} AS {v}" for v in values])
    )
