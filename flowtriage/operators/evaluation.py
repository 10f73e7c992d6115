"""Predictions against ground truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtriage.functions.labels import VERDICTS, binary_label
from flowtriage.functions.numbers import py_round, ratio
from flowtriage.functions.text import strip
from flowtriage.operators.models import MODELS, Model, model_table

OUTCOMES = ["TP", "FP", "TN", "FN", "missing_truth", "invalid_prediction"]
METRICS = [
    "precision", "recall_sensitivity", "specificity", "f1", "false_positive_rate", "false_negative_rate", "accuracy",
]


def _has_id() -> Column:
    return F.coalesce(F.col("record_id"), F.lit("")) != ""


def split_valid_ids(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with and rows without a record id."""
    return records.filter(_has_id()), records.filter(~_has_id())


def last_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key. The rank filter already runs before the shuffle, one row per key and task."""
    latest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_nth", F.row_number().over(latest)).filter(F.col("_nth") == 1).drop("_nth")


def truth_of(eval_rows: DataFrame, order: list[str] = ["sample_rank"]) -> DataFrame:
    """(record_id, truth); of several rows with one id the last counts."""
    rows = eval_rows.filter(_has_id()).select("record_id", "label", *order)
    return last_rows(rows, ["record_id"], order).select("record_id", binary_label(F.col("label")).alias("truth"))


def aligned_truth(truth: DataFrame, records: DataFrame) -> DataFrame:
    """Truth of the processed records only; repeated ids are dropped before the shuffle."""
    return truth.join(records.select("record_id").distinct(), "record_id", "left_semi")


def truth_counts(truth: DataFrame) -> DataFrame:
    return truth.agg(
        F.count_if(F.col("truth") == "attack").alias("attack"),
        F.count_if(F.col("truth") == "normal").alias("normal"),
    )


def alignment_check(records: DataFrame, truth: DataFrame) -> DataFrame:
    """Input rows against matched truth ids; aligned is false when they differ."""
    matched = aligned_truth(truth, records).agg(F.count("*")).scalar()
    return (
        records.agg(F.count("*").alias("api_records"))
        .withColumn("matched_truth", matched)
        .withColumn("aligned", F.col("api_records") == F.col("matched_truth"))
    )


def outcomes(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions with truth and outcome. Both sides must hold one row per id (and model).

    No side is forced to be broadcast: the join strategy follows the sizes met at run time.
    """
    guess, truth_is = F.lower(strip(F.coalesce("prediction", F.lit("")))), F.col("truth")
    outcome = (
        F.when(truth_is.isNull(), "missing_truth")
        .when(~guess.isin(VERDICTS), "invalid_prediction")
        .when(truth_is == "attack", F.when(guess == "attack", "TP").otherwise("FN"))
        .otherwise(F.when(guess == "attack", "FP").otherwise("TN"))
    )
    return predictions.join(truth, "record_id", "left").withColumn("outcome", outcome)


def with_models(stats: DataFrame, models: list[Model], counts: list[str], others: bool = False) -> DataFrame:
    """One row per listed model, also for models without any rows; with others, then those that only stats hold."""
    listed = model_table(stats.sparkSession, models).select("model_name", "model_ord")
    last = max((m.model_ord for m in models), default=0) + 1
    full = listed.join(stats, "model_name", "full" if others else "left")
    return full.fillna(0, counts).fillna(last, ["model_ord"])


def confusion_matrix(judged: DataFrame, models: list[Model] = MODELS, others: bool = False) -> DataFrame:
    """Outcomes per listed model; with others, of all models judged."""
    counts = judged.groupBy("model_name").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    )
    full = with_models(counts, models, OUTCOMES, others)
    valid = reduce(lambda a, b: a + b, [F.col(o) for o in OUTCOMES[:4]])
    return full.withColumn("total_valid", valid)


def metrics(confusion: DataFrame) -> DataFrame:
    """Seven metrics to six digits; a metric without cases is 0.0."""
    tp, fp, tn, fn = (F.col(c) for c in OUTCOMES[:4])
    exact = confusion.withColumns({
        "_p": ratio(tp, tp + fp),
        "_r": ratio(tp, tp + fn),
    })
    p, r = F.col("_p"), F.col("_r")
    values = [p, r, ratio(tn, tn + fp), ratio(F.lit(2.0) * p * r, p + r), ratio(fp, fp + tn), ratio(fn, fn + tp),
              ratio(tp + tn, F.col("total_valid"))]
    return exact.withColumns({name: py_round(v, 6) for name, v in zip(METRICS, values)}).drop("_p", "_r")
