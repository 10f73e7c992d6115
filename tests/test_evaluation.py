from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowtriage import fixtures
from flowtriage.operators import callstats, evaluation
from flowtriage.operators.models import MODELS, Model
from flowtriage.plans.evaluation_job import SECTIONS, evaluation_report, judge
from flowtriage.sources.predictions import LOG_SCHEMA, latest_predictions
from flowtriage.sources.reports import report_lines

THREE = [m for m in MODELS if m.model_name != "gemini"]

# Published runs: model, calls, latency, tokens in and out, cost, TP, FP, TN, FN, precision, recall, F1, accuracy
GOLDEN = {
    "first": [
        ("chatgpt", 150, 240.593, 59407, 4413, 0.011559, 10, 125, 12, 3, 0.074074, 0.769231, 0.135135, 0.146667),
        ("deepseek", 150, 154.191, 63526, 3903, 0.009986, 7, 117, 20, 6, 0.056452, 0.538462, 0.10219, 0.18),
        ("claude", 150, 178.421, 65706, 6272, 0.077653, 6, 100, 37, 7, 0.056604, 0.461538, 0.10084, 0.286667),
    ],
    "second": [
        ("chatgpt", 150, 236.966, 76657, 4416, 0.014148, 2, 53, 84, 11, 0.036364, 0.153846, 0.058824, 0.573333),
        ("deepseek", 150, 159.921, 80776, 3635, 0.012326, 3, 33, 104, 10, 0.083333, 0.230769, 0.122449, 0.713333),
        ("claude", 150, 182.331, 84456, 6386, 0.093109, 3, 104, 33, 10, 0.028037, 0.230769, 0.05, 0.24),
    ],
    "aggressive": [
        ("chatgpt", 1000, 1596.7, 409884, 29392, 0.079118, 73, 927, 0, 0, 0.073, 1.0, 0.136067, 0.073),
        ("deepseek", 1000, 1096.042, 437398, 25912, 0.068491, 73, 927, 0, 0, 0.073, 1.0, 0.136067, 0.073),
        ("claude", 1000, 1147.998, 452854, 43387, 0.535831, 71, 913, 14, 2, 0.072154, 0.972603, 0.134342, 0.085),
    ],
    "conservative": [
        ("chatgpt", 1000, 1587.679, 510884, 29549, 0.094362, 9, 375, 552, 64, 0.023438, 0.123288, 0.039387, 0.561),
        ("deepseek", 1000, 913.189, 538398, 24086, 0.082120, 10, 208, 719, 63, 0.045872, 0.136986, 0.068729, 0.729),
        ("claude", 1000, 1189.349, 562854, 42996, 0.622267, 13, 696, 231, 60, 0.018336, 0.178082, 0.033248, 0.244),
    ],
}
WINNERS = {
    "aggressive": {
        "best_f1": "chatgpt", "best_precision": "chatgpt", "best_recall": "chatgpt", "best_accuracy": "claude",
        "best_specificity": "claude", "lowest_fpr": "claude", "lowest_fnr": "chatgpt", "fastest": "deepseek",
        "lowest_cost": "deepseek", "fewest_errors": "chatgpt", "most_conservative": "claude",
        "most_aggressive": "chatgpt",
    },
}


def golden_sides(spark, run):
    """Confusion matrix and call statistics as published."""
    ords = {m.model_name: m.model_ord for m in MODELS}
    confusion = spark.createDataFrame(
        [(r[0], ords[r[0]], *r[6:10], 0, 0, sum(r[6:10])) for r in GOLDEN[run]],
        "model_name string, model_ord int, TP bigint, FP bigint, TN bigint, FN bigint, missing_truth bigint, "
        "invalid_prediction bigint, total_valid bigint")
    stats = spark.createDataFrame(
        [(r[0], ords[r[0]], r[1], 0, r[2], r[3], r[4], r[6] + r[7], r[8] + r[9]) for r in GOLDEN[run]],
        "model_name string, model_ord int, calls bigint, errors bigint, total_latency double, input_tokens bigint, "
        "output_tokens bigint, pred_attack bigint, pred_normal bigint")
    return evaluation.metrics(confusion), callstats.estimate_cost(stats)


@pytest.mark.parametrize("run", list(GOLDEN))
def test_golden_metrics_and_costs(spark, run):
    measured, costed = golden_sides(spark, run)
    found = {r.model_name: (r.precision, r.recall_sensitivity, r.f1, r.accuracy) for r in measured.collect()}
    assert found == {r[0]: r[10:] for r in GOLDEN[run]}
    assert {r.model_name: r.estimated_cost for r in costed.collect()} == {r[0]: r[5] for r in GOLDEN[run]}
    if run in WINNERS:
        comparison = callstats.compare_models(measured, costed).collect()
        assert {r.criterion: r.model_name for r in comparison} == WINNERS[run]


def log_rows(spark, rows):
    base = dict.fromkeys(LOG_SCHEMA.names) | {"timestamp": "2026-01-01T00:00:00", "status": "ok", "run_id": "r1",
                                              "batch_id": 0, "latency_s": 1.0, "input_tokens": 1, "output_tokens": 1}
    rows = [base | r for r in rows]
    rows = [r | {"run_seq": int(r["run_id"][1:])} for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in LOG_SCHEMA.names) for r in rows], LOG_SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    log = log_rows(spark, [
        {"model_name": "chatgpt", "record_id": "a", "record_index": 1, "prediction": "Attack ", "confidence": 0.4},
        {"model_name": "chatgpt", "record_id": "b", "record_index": 2, "prediction": "normal"},
        {"model_name": "chatgpt", "record_id": "b", "record_index": 2, "prediction": "attack", "run_id": "r2",
         "confidence": 0.5},
        {"model_name": "chatgpt", "record_id": "c", "record_index": 3, "prediction": "error", "status": "error"},
        {"model_name": "chatgpt", "record_id": "d", "record_index": 4, "prediction": "normal"},
        {"model_name": "chatgpt", "record_id": "", "record_index": 5, "prediction": "normal"},
        {"model_name": "claude", "record_id": "c", "record_index": 3, "prediction": "normal"},
        {"model_name": "unlisted", "record_id": "c", "record_index": 3, "prediction": "normal"},
    ])
    truth = evaluation.truth_of(spark.createDataFrame(
        [("a", 1, "blacklist"), ("b", 2, "126"), ("b", 3, "background"), ("c", 4, None), ("", 5, "x"), (None, 6, "x")],
        "record_id string, sample_rank bigint, label string"))
    return log, truth


def test_truth_takes_the_last_row(small):
    assert {r.record_id: r.truth for r in small[1].collect()} == {"a": "attack", "b": "normal", "c": "attack"}


def test_every_row_has_one_outcome(small):
    log, truth = small
    latest = latest_predictions(log)
    judged = evaluation.outcomes(latest, truth)
    found = {(r.model_name, r.record_id): r.outcome for r in judged.collect()}
    assert found == {
        ("chatgpt", "a"): "TP", ("chatgpt", "b"): "FP", ("chatgpt", "c"): "invalid_prediction",
        ("chatgpt", "d"): "missing_truth", ("claude", "c"): "FN", ("unlisted", "c"): "FN"}
    rows = {r.model_name: r for r in evaluation.confusion_matrix(judged).collect()}
    assert set(rows) == {m.model_name for m in MODELS}
    assert rows["gemini"].total_valid == 0 and rows["chatgpt"].total_valid == 2
    for name, n in (("chatgpt", 4), ("claude", 1), ("gemini", 0)):
        assert sum(rows[name][o] for o in evaluation.OUTCOMES) == n


def test_models_without_rows_measure_zero(small):
    log, truth = small
    measured, stats, comparison = judge(log, truth)
    empty = measured.filter("model_name = 'gemini'").first()
    assert [empty[m] for m in evaluation.METRICS] == [0.0] * 7
    costed = stats.filter("model_name = 'gemini'").first()
    assert (costed.calls, costed.avg_latency, costed.min_latency, costed.estimated_cost) == (0, 0.0, 0.0, 0.0)
    assert {r.criterion: r.model_name for r in comparison.collect()}["fastest"] != "gemini"


def test_call_statistics_of_a_run(small):
    log, _ = small
    row = callstats.call_stats(log, run_id="r2").filter("model_name = 'chatgpt'").first()
    assert (row.calls, row.errors, row.skipped_resume, row.low_confidence) == (1, 0, 4, 0)  # b was called again
    whole = callstats.call_stats(log).filter("model_name = 'chatgpt'").first()
    assert (whole.calls, whole.errors, whole.skipped_resume, whole.low_confidence) == (5, 1, 0, 1)


def test_runs_follow_by_number(spark):
    log = log_rows(spark, [
        {"model_name": "chatgpt", "record_id": "a", "prediction": p, "run_id": run}
        for run, p in (("r10", "normal"), ("r9", "attack"))])
    assert latest_predictions(log).first().prediction == "normal"
    assert callstats.call_stats(log, run_id="r9").filter("model_name = 'chatgpt'").first().skipped_resume == 0
    assert callstats.call_stats(log, run_id="r11").filter("model_name = 'chatgpt'").first().skipped_resume == 1


def test_unknown_price_costs_nothing(small):
    models = [Model("unlisted", 9, "x", "x")]
    row = callstats.estimate_cost(callstats.call_stats(small[0], models)).first()
    assert (row.calls, row.estimated_cost) == (1, 0.0)


def test_checkpoints_cover_every_step(spark):
    log = log_rows(spark, [
        {"model_name": "chatgpt", "record_id": str(i), "record_index": i, "prediction": "attack", "confidence": 0.5,
         "latency_s": 0.25} for i in (1, 100, 101, 350)])
    rows = callstats.checkpoint_series(log, 350, models=THREE).filter("model_name = 'chatgpt'").orderBy("completed")
    assert [(r.completed, r.calls, r.pct_done, r.elapsed_s, r.eta_s) for r in rows.collect()] == [
        (100, 2, 28.6, 0.5, 1.25), (200, 3, 57.1, 0.75, 0.562), (300, 3, 85.7, 0.75, 0.125), (350, 4, 100.0, 1.0, 0.0)]
    assert callstats.checkpoint_series(log, 350, models=THREE).count() == 12


def test_checkpoints_without_records_or_rows(spark):
    log = log_rows(spark, [{"model_name": "chatgpt", "record_id": "a", "record_index": 7, "prediction": "attack", "latency_s": 0.25}])
    rows = {r.model_name: r for r in callstats.checkpoint_series(log, 0, models=THREE).collect()}
    assert len(rows) == 3 and (rows["chatgpt"].completed, rows["chatgpt"].calls, rows["chatgpt"].eta_s) == (0, 1, 0.0)
    assert [r.completed for r in callstats.checkpoint_series(log, models=THREE).collect()] == [7] * 3  # by the log's largest index
    assert callstats.checkpoint_series(log.limit(0), models=THREE).count() == 3


def test_models_that_are_not_listed_are_judged_on_request(spark, small):
    log, truth = small
    rest = [m for m in THREE if m.model_name != "chatgpt"]
    for others in (False, True):
        found = [{r.model_name for r in table.collect()} for table in judge(log, truth, rest, others=others)[:2]]
        assert all(("chatgpt" in names) == others for names in found)


def test_checkpoints_know_the_run(small):
    rows = callstats.checkpoint_series(small[0], 5, models=THREE, run_id="r2").collect()
    assert {(r.model_name, r.calls, r.skipped) for r in rows} == {
        ("chatgpt", 1, 4), ("deepseek", 0, 0), ("claude", 0, 1)}


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    log = fixtures.prediction_log(spark, sf_dir)
    seen = {tuple(sorted(map(tuple, callstats.call_stats(log.repartition(n)).collect()))) for n in (1, 3, 16)}
    assert len(seen) == 1


def test_alignment(spark, small):
    records = spark.createDataFrame([("a",), ("b",), ("z",), ("",)], "record_id string")
    check = evaluation.alignment_check(records, small[1]).first()
    assert (check.api_records, check.matched_truth, check.aligned) == (4, 2, False)
    counts = evaluation.truth_counts(evaluation.aligned_truth(small[1], records)).first()
    assert (counts.attack, counts.normal) == (1, 1)


def test_report_text(spark, small):
    log, truth = small
    report = evaluation_report(truth, *judge(log, truth))
    lines = report_lines(report, SECTIONS).orderBy("section_no", "line_no").select("value").collect()
    text = [r.value for r in lines]
    assert [t for t in text if not t.startswith(" ")] == list(SECTIONS.values())
    assert any(t.split() == ["best_f1", "chatgpt"] for t in text)
    assert len(text) == report.count() + len(SECTIONS)


def test_split_ids(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "record_id string")
    valid, invalid = evaluation.split_valid_ids(df)
    assert (valid.count(), invalid.count()) == (1, 2)


def test_hot_key_is_reduced_before_the_shuffle(spark):
    """All rows share one id: each task sends on a single row of it."""
    log = spark.range(10_000).select(
        F.expr("if(id < 0, 'x', 'a')").alias("record_id"), F.expr("if(id < 0, 'x', 'm')").alias("model_name"),
        F.col("id").alias("n")).repartition(8)
    last = evaluation.last_rows(log, ["model_name", "record_id"], ["n"])
    assert [r.n for r in last.collect()] == [9999]
    assert "WindowGroupLimit" in last._jdf.queryExecution().executedPlan().toString()


def test_models_that_are_not_listed_are_shown(spark):
    judged = spark.createDataFrame([("chatgpt", "TP"), ("other", "FN")], "model_name string, outcome string")
    found = {r.model_name: r for r in evaluation.confusion_matrix(judged, others=True).collect()}
    assert (found["chatgpt"].TP, found["other"].FN) == (1, 1)
    assert found["other"].model_ord > max(r.model_ord for n, r in found.items() if n != "other")
