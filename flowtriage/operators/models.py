"""The classifiers and their prices."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Model(NamedTuple):
    model_name: str
    model_ord: int
    provider: str
    model_id: str


# Models in listing order, dollars per 1000 input and output tokens.
MODELS = [
    Model("chatgpt", 0, "openai", "gpt-4.1-mini"),
    Model("gemini", 1, "google", "gemini-2.5-flash"),
    Model("deepseek", 2, "deepseek", "deepseek-chat"),
    Model("claude", 3, "anthropic", "claude-haiku-4-5-20251001"),
]
PRICES = {
    "claude": (0.0008, 0.0040),
    "chatgpt": (0.00015, 0.00060),
    "gemini": (0.000075, 0.00030),
    "deepseek": (0.00014, 0.00028),
}


def model_table(spark: SparkSession, models: list[Model] = MODELS) -> DataFrame:
    """A literal relation, so Catalyst knows how small it is."""
    rows = ", ".join(f"('{m.model_name}', {m.model_ord}, '{m.provider}', '{m.model_id}')" for m in models)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(model_name, model_ord, provider, model_id)")


def price_table(spark: SparkSession, prices: dict[str, tuple[float, float]] = PRICES) -> DataFrame:
    rows = ", ".join(f"('{name}', double({p_in!r}), double({p_out!r}))" for name, (p_in, p_out) in prices.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(model_name, in_per_1k, out_per_1k)")
