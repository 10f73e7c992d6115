"""From sampled records to metrics: score what is missing, then judge the whole log."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from flowtriage.functions.numbers import py_round
from flowtriage.operators import callstats, evaluation
from flowtriage.operators.calls import Clock, RetryPolicy, Scorer
from flowtriage.operators.models import MODELS, PRICES, Model
from flowtriage.operators.running import running_totals
from flowtriage.operators.sampling import limit_records
from flowtriage.operators.scoring import (
    missing_id_errors, pending, predictions_of, record_requests, score, with_bodies, with_prompt,
)
from flowtriage.session import materialise, scratch, scratch_path
from flowtriage.sources import storage
from flowtriage.sources.predictions import (
    append_predictions, errors, latest_predictions, read_log, reset_outputs, store_rejected,
)
from flowtriage.sources.reports import report_rows, unpivot_rows, write_report

SECTIONS = {
    "truth": "Ground truth",
    "records": "Records",
    "method": "Method",
    "models": "Models",
    "calls": "Calls per model",
    "metrics": "Metrics per model",
    "comparison": "Comparison",
    "checkpoints": "Counters after every so many records",
}
CALL_FIGURES = [
    "calls", "errors", "skipped_resume", "pred_attack", "pred_normal", "pred_error", "avg_confidence",
    "low_confidence", "input_tokens", "output_tokens", "avg_latency", "min_latency", "max_latency", "estimated_cost",
]


class EvaluationResult(NamedTuple):
    alignment: DataFrame
    truth: DataFrame
    metrics: DataFrame
    stats: DataFrame
    comparison: DataFrame
    errors: DataFrame
    rejected: DataFrame
    checkpoints: DataFrame
    report: DataFrame | None


def judge(
    log: DataFrame, truth: DataFrame, models: list[Model] = MODELS, run_id: str | None = None,
    prices: dict[str, tuple[float, float]] = PRICES, others: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics, call statistics, comparison) of a log, for the listed models; with others, for all that it holds."""
    if not others:
        log = log.filter(F.col("model_name").isin([m.model_name for m in models]))
    judged = evaluation.outcomes(latest_predictions(log), truth)
    measured = materialise(evaluation.metrics(evaluation.confusion_matrix(judged, models, others)))
    stats = callstats.call_stats(log, models, run_id, others)
    costed = materialise(callstats.estimate_cost(callstats.derived_call_stats(stats), prices))
    return measured, costed, callstats.compare_models(measured, costed)


#: What is said of a checkpoint of a model.
CHECKPOINT_FIGURES = ["calls", "errors", "skipped", "pred_attack", "pred_normal", "estimated_cost", "elapsed_s"]


def evaluation_report(
    truth: DataFrame, measured: DataFrame, stats: DataFrame, comparison: DataFrame, series: DataFrame | None = None,
    records: dict[str, int | None] | None = None, models: list[Model] = MODELS, method: dict[str, str] | None = None,
) -> DataFrame:
    """Every figure of the run as report rows; records and method: what else is known of the run, by name."""
    spark = truth.sparkSession
    counts = evaluation.truth_counts(truth).withColumn("all", F.col("attack") + F.col("normal"))
    names = [*evaluation.OUTCOMES, "total_valid", *evaluation.METRICS]
    told = {f"{m.model_name}.{part}": getattr(m, part) for m in models for part in ("model_id", "provider")}
    cost = stats.agg(py_round(F.sum(F.col("estimated_cost").cast("decimal(18,6)")), 6).alias("cost"))
    parts = [
        report_rows(counts, "records", "matched_truth", F.col("all")),
        report_rows(counts, "truth", "attack", F.col("attack")),
        report_rows(counts, "truth", "normal", F.col("normal")),
        unpivot_rows(stats, "calls", "model_name", CALL_FIGURES),
        report_rows(cost, "calls", "all.estimated_cost", value=F.col("cost")),
        unpivot_rows(measured, "metrics", "model_name", names),
        report_rows(comparison, "comparison", F.col("criterion"), text=F.col("model_name")),
    ]
    for section, texts in (("models", told), ("method", method)):
        if texts:
            rows = spark.createDataFrame(list(texts.items()), "key string, text string")
            parts.append(report_rows(rows, section, F.col("key"), text=F.col("text")))
    if records:
        rows = spark.createDataFrame(list(records.items()), "key string, n bigint")
        parts.append(report_rows(rows, "records", F.col("key"), F.col("n")))
    if series is not None:
        marked = series.withColumn("_at", F.concat_ws(".", "model_name", "completed"))
        parts.append(unpivot_rows(marked, "checkpoints", "_at", CHECKPOINT_FIGURES))
    return reduce(DataFrame.unionByName, parts)


def in_waves(todo: DataFrame, wave: int) -> DataFrame:
    """Adds _wave: rows by record_index, about `wave` indices that occur to each; those without an index come first.

    Indices are counted by blocks of `wave`, so however far apart they lie, a wave is not left nearly empty.
    """
    block = F.coalesce(F.floor((F.col("record_index") - 1) / wave), F.lit(-1))
    marked = todo.withColumn("_block", block)
    counts = (
        marked.select("_block", "record_index").distinct().groupBy("_block").agg(F.count("*").alias("_n"))
        .withColumns({"_all": F.lit(0), "_thousand": F.floor(F.col("_block") / 1000), "_upto": F.col("_n")})
    )
    before = running_totals(counts, ["_all"], "_thousand", ["_block"], ["_upto"])
    waves = before.select("_block", F.floor((F.col("_upto") - F.col("_n")) / wave).alias("_wave"))
    return marked.join(waves, "_block").drop("_block")


def run_evaluation(
    api_records: DataFrame,
    eval_records: DataFrame,
    log_path: str,
    scorer: Scorer,
    run_id: str,
    models: list[Model] = MODELS,
    policy: str = "conservative",
    limit: int | None = None,
    resume: bool = True,
    retry_errors: bool = False,
    concurrency: int = 8,
    retries: RetryPolicy = RetryPolicy(),
    pause: float = 0.0,
    sleep: Callable[[float], None] = time.sleep,
    report_folder: str | None = None,
    wave: int = 10_000,
    prepare: Callable[[DataFrame], DataFrame] = with_bodies,
    calls_per_second: float | None = None,
    clock: Clock | None = None,
    others: bool = False,
    every: int = 100,
) -> EvaluationResult:
    """Scores pending records, appends them to the log and evaluates the log.

    Records are scored in waves of about so many indices; each is in the log before the next begins, so a run that is stopped
    loses one wave at most and resuming it calls the rest. prepare adds to the requests what else the scorer needs. Runs count in the order in which they first write to the log.
    """
    spark = api_records.sparkSession
    if not resume:
        reset_outputs(spark, log_path, [m.model_name for m in models])
    records = limit_records(api_records, limit)
    requests = record_requests(records)
    writer = uuid.uuid4().hex
    rejected = store_rejected(missing_id_errors(requests), log_path, run_id, writer)
    # Kept as it is now, a folder per wave: the log grows while the waves are scored, each of which reads its own rows.
    with scratch(spark):
        folder = scratch_path(spark, "waves")
        todo = in_waves(pending(requests, models, read_log(spark, log_path), retry_errors), wave)
        todo.repartition("_wave").write.partitionBy("_wave").parquet(folder)
        parts = [int(f.rpartition("=")[2]) for f in storage.glob(spark, f"{folder}/_wave=*")]
        for batch, part in enumerate(sorted(parts)):
            asked = with_prompt(spark.read.schema(todo.drop("_wave").schema).parquet(f"{folder}/_wave={part}"), policy)
            scored = score(prepare(asked), scorer, concurrency, retries, pause, sleep, calls_per_second, clock)
            append_predictions(predictions_of(scored), log_path, run_id, batch, writer)

    log = read_log(spark, log_path)
    truth = evaluation.truth_of(eval_records)
    aligned = evaluation.aligned_truth(truth, records)
    measured, stats, comparison = judge(log, aligned, models, run_id, others=others)
    processed = records.count()
    listed = log.filter(F.col("model_name").isin([m.model_name for m in models]))
    series = callstats.checkpoint_series(listed, processed, every, models, run_id=run_id)
    report = None
    if report_folder is not None:
        sizes = {"input": processed if limit is None else api_records.count(), "processed": processed, "limit": limit}
        method = {"policy": policy, "resume": str(resume).lower()}
        report = write_report(
            evaluation_report(aligned, measured, stats, comparison, series, sizes, models, method), SECTIONS, report_folder,
            "evaluation_report")
    return EvaluationResult(
        evaluation.alignment_check(records, truth), aligned, measured, stats, comparison, errors(log),
        rejected, series, report,
    )
