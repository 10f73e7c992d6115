"""Stable hashes of a flow."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowtriage.schema import FLOW_COLUMNS, RECORD_ID_COLUMNS


def _joined(columns: list[str]) -> str:
    return ", ".join(f"coalesce(cast({c} AS STRING), 'NULL')" for c in columns)


def record_id() -> Column:
    """Hex SHA-256 over the identifying columns, NULL spelled out."""
    return F.expr(f"sha2(concat_ws('|', {_joined(RECORD_ID_COLUMNS)}), 256)")


def row_hash(seed: int, columns: list[str] = FLOW_COLUMNS) -> Column:
    """Seeded pseudo-random order key.

    It depends on the row alone, so the order is the same under any
    partitioning, which rand(seed) cannot promise.
    """
    return F.expr(f"md5(concat_ws('|', '{seed}', {_joined(columns)}))")
