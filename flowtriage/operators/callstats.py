"""Calls, tokens, latency, confidence and cost per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtriage.functions.numbers import py_round, ratio
from flowtriage.operators.evaluation import with_models
from flowtriage.operators.models import MODELS, PRICES, Model, price_table
from flowtriage.operators.running import running_totals

LOW_CONFIDENCE = 0.5
UNKNOWN_LATENCY = 999.0
COUNTS = [
    "calls", "errors", "skipped_resume", "input_tokens", "output_tokens", "total_latency", "pred_attack",
    "pred_normal", "pred_error", "confidence_sum", "confidence_count", "low_confidence",
]


#: Sums of these have so many decimals.
EXACT = {"total_latency": 3, "confidence_sum": 12}


def _exact_sum(value: Column, name: str, kind: str | None) -> Column:
    """Sum as DECIMAL, so that the result does not depend on the order of the rows; handed on as the kind asked for."""
    total = F.coalesce(F.sum(value.cast(f"decimal(18,{EXACT[name]})")), F.lit(0))
    return (total if kind is None else total.cast(kind)).alias(name)


def counter_parts(now: Column | None = None, fractions: str | None = None) -> list[Column]:
    """The counters of all rows for which now holds; sums of fractions stay decimals unless another type is asked for."""
    now = F.lit(True) if now is None else now
    ok = now & (F.col("status") == "ok")
    failed = now & (F.col("status") == "error")
    confidence = F.when(ok, F.col("confidence"))
    latency = F.when(ok, F.col("latency_s"))
    return [
        F.count_if(ok).alias("calls"),
        F.count_if(failed).alias("errors"),
        F.coalesce(F.sum(F.when(ok, F.col("input_tokens"))), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("output_tokens"))), F.lit(0)).alias("output_tokens"),
        _exact_sum(latency, "total_latency", fractions),
        F.min(latency).alias("min_latency"),
        F.max(latency).alias("max_latency"),
        F.count_if(ok & (F.col("prediction") == "attack")).alias("pred_attack"),
        F.count_if(ok & (F.col("prediction") == "normal")).alias("pred_normal"),
        F.count_if(failed).alias("pred_error"),
        _exact_sum(confidence, "confidence_sum", fractions),
        F.count(confidence).alias("confidence_count"),
        F.count_if(confidence < LOW_CONFIDENCE).alias("low_confidence"),
    ]


def added_counters(parts: DataFrame) -> DataFrame:
    """Counters per model from those of parts of its rows."""
    sums = [c for c in COUNTS if c in parts.columns]
    return parts.groupBy("model_name").agg(
        *[F.sum(c).cast("double" if c in EXACT else "bigint").alias(c) for c in sums],
        F.min("min_latency").alias("min_latency"), F.max("max_latency").alias("max_latency"))


def _aggregates(now: Column) -> list[Column]:
    """The counters of all rows for which now holds."""
    return counter_parts(now, "double")


def call_counters(log: DataFrame) -> DataFrame:
    """All counters but skipped_resume, for the models met; also on a stream."""
    return log.groupBy("model_name").agg(*_aggregates(F.lit(True)))


def call_stats(log: DataFrame, models: list[Model] = MODELS, run_id: str | None = None, others: bool = False) -> DataFrame:
    """Counters per listed model (with others, of all models): of the whole log, or of one run.

    For a run, skipped_resume counts the ids that earlier runs logged, failed ones included, and that it did not call
    again. Runs follow each other by run_seq; to a run that has logged nothing, all others are earlier.
    """
    if run_id is None:
        stats = call_counters(log).withColumn("skipped_resume", F.lit(0).cast("bigint"))
    else:
        now = F.col("run_id") == run_id
        seq = log.filter(now).agg(F.max("run_seq")).scalar()
        earlier = ~now & F.coalesce(F.col("run_seq") < seq, F.lit(True))
        skipped = (
            log.filter("record_id is not null").groupBy("model_name", "record_id")
            .agg(F.bool_or(earlier).alias("earlier"), F.bool_or(now).alias("called"))
            .groupBy("model_name").agg(F.count_if(F.col("earlier") & ~F.col("called")).alias("skipped_resume"))
        )
        stats = log.groupBy("model_name").agg(*_aggregates(now)).join(skipped, "model_name", "left")
    return with_models(stats, models, COUNTS, others)


def estimate_cost(stats: DataFrame, prices: dict[str, tuple[float, float]] = PRICES) -> DataFrame:
    """Dollars per model from its token sums; a model without a price costs nothing."""
    return (
        stats.join(price_table(stats.sparkSession, prices), "model_name", "left")
        .withColumn("estimated_cost", py_round(
            F.col("input_tokens") / F.lit(1000.0) * F.coalesce("in_per_1k", F.lit(0.0))
            + F.col("output_tokens") / F.lit(1000.0) * F.coalesce("out_per_1k", F.lit(0.0)), 6))
        .drop("in_per_1k", "out_per_1k")
    )


def derived_call_stats(stats: DataFrame) -> DataFrame:
    """Averages, and extremes that are 0.0 without a call."""
    return stats.withColumns({
        "avg_latency": ratio(F.col("total_latency"), F.col("calls")),
        "avg_confidence": ratio(F.col("confidence_sum"), F.col("confidence_count")),
        "min_latency": F.coalesce("min_latency", F.lit(0.0)),
        "max_latency": F.coalesce("max_latency", F.lit(0.0)),
    })


def checkpoint_series(
    log: DataFrame, total_records: int | None = None, every: int = 100, models: list[Model] = MODELS,
    prices: dict[str, tuple[float, float]] = PRICES, run_id: str | None = None,
) -> DataFrame:
    """What the counters stood at after every n records and after the last one, per model.

    Records count from 1, up to the largest index of the log if total_records is not given. No row is left out: a missing
    index or one below 1 counts in the first step, one above total_records in the last, so the last step equals
    call_stats. There is one step at least.
    Time is the latency summed over all models. Totals run over blocks of
    checkpoints, so a long log is not pulled into one task per model.
    """
    sums = ["calls", "errors", "pred_attack", "pred_normal", "input_tokens", "output_tokens", "total_latency",
            "confidence_sum", "confidence_count"]
    now = F.lit(True) if run_id is None else F.col("run_id") == run_id
    total = F.lit(total_records) if total_records is not None else log.agg(F.max("record_index")).scalar()
    total = F.coalesce(total, F.lit(0)).cast("bigint")
    steps = F.greatest(F.lit(1), F.ceil(total / every))
    per_step = (
        log.withColumn("step", F.greatest(F.lit(1), F.least(F.ceil(F.col("record_index") / every), steps)))
        .groupBy("model_name", "step").agg(*_aggregates(now))
        .select("model_name", "step", *sums)
        .withColumns({c: F.col(c).cast("decimal(28,12)") for c in ("total_latency", "confidence_sum")})
    )
    each = F.array(*[
        F.struct(F.lit(m.model_name).alias("model_name"), F.lit(m.model_ord).alias("model_ord")) for m in models
    ])
    grid = log.sparkSession.range(1).select(total.alias("total"), F.explode(F.sequence(F.lit(1).cast("bigint"), steps)).alias("step"))
    grid = grid.select("total", "step", F.inline(each))
    series = running_totals(
        grid.join(per_step, ["model_name", "step"], "left").fillna(0, sums)
        .withColumn("block", F.floor(F.col("step") / 1000)),
        ["model_name", "model_ord"], "block", ["step"], sums,
    )
    if run_id is None:
        skipped = F.lit(0).cast("bigint")
    else:
        before = call_stats(log, models, run_id).select("model_name", "skipped_resume")
        series, skipped = series.join(before, "model_name"), F.col("skipped_resume")
    done = F.least(F.col("step") * every, F.col("total"))
    elapsed = F.sum("total_latency").over(Window.partitionBy("step")).cast("double")
    latency, confidence = F.col("total_latency").cast("double"), F.col("confidence_sum").cast("double")
    return estimate_cost(series, prices).select(
        "model_name", "model_ord", done.cast("bigint").alias("completed"),
        py_round(ratio(done, F.col("total")) * F.lit(100.0), 1).alias("pct_done"),
        "calls", "errors", skipped.alias("skipped"), "pred_attack", "pred_normal",
        py_round(ratio(confidence, F.col("confidence_count")), 3).alias("avg_confidence"),
        "input_tokens", "output_tokens", "estimated_cost",
        py_round(ratio(latency, F.col("calls")), 3).alias("avg_latency"),
        py_round(elapsed, 3).alias("elapsed_s"),
        py_round(ratio(elapsed, done) * (F.col("total") - done).cast("double"), 3).alias("eta_s"),
    )


def compare_models(measured: DataFrame, costed: DataFrame) -> DataFrame:
    """The winner per criterion; among equals the model listed first.

    measured is the result of metrics(), costed that of estimate_cost(); both have a row per model.
    """
    latency = F.when(F.col("calls") > 0, F.col("total_latency") / F.col("calls")).otherwise(F.lit(UNKNOWN_LATENCY))
    high, low = -1.0, 1.0
    criteria = [
        ("best_f1", F.col("f1"), high),
        ("best_precision", F.col("precision"), high),
        ("best_recall", F.col("recall_sensitivity"), high),
        ("best_accuracy", F.col("accuracy"), high),
        ("best_specificity", F.col("specificity"), high),
        ("lowest_fpr", F.col("false_positive_rate"), low),
        ("lowest_fnr", F.col("false_negative_rate"), low),
        ("fastest", latency, low),
        ("lowest_cost", F.col("estimated_cost"), low),
        ("fewest_errors", F.col("errors"), low),
        ("most_conservative", F.col("pred_normal"), high),
        ("most_aggressive", F.col("pred_attack"), high),
    ]
    rows = measured.join(costed.drop("model_ord"), "model_name")
    winners = rows.agg(*[
        F.min_by("model_name", F.struct((value.cast("double") * sign).alias("v"), F.col("model_ord"))).alias(name)
        for name, value, sign in criteria
    ])
    listed = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("criterion"), F.col(name).alias("model_name"))
        for i, (name, _, _) in enumerate(criteria, 1)
    ])
    return winners.select(F.inline(listed))
