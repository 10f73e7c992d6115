from __future__ import annotations

import datetime as dt
import json
import os
import sys

import pytest
import scorers
from pyspark import cloudpickle
from pyspark.sql import functions as F

from flowtriage.functions import prompts
from flowtriage.functions.requests import request_body
from flowtriage.operators import scoring
from flowtriage.operators.calls import CountedClock, RetryPolicy, call_with_retries
from flowtriage.operators.models import MODELS
from flowtriage.plans import evaluation_job
from flowtriage.schema import API_SCHEMA, SAMPLE_SCHEMA
from flowtriage.sources.predictions import latest_predictions, read_log, reset_outputs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests

FAST = RetryPolicy(max_tries=3, base_delay=0.0, jitter=0.0)


def answer(label="attack"):
    return 200, json.dumps(scorers.envelope("openai", json.dumps({"label": label, "confidence": 0.8}), 5, 6))


class Scripted:
    """Plays back outcomes, one per call."""

    def __init__(self, *script):
        self.script = list(script)

    def __call__(self, request):
        step = self.script.pop(0)
        if isinstance(step, Exception):
            raise step
        return step


@pytest.mark.parametrize("script, waits", [
    ([answer()], 0),
    ([(503, "busy"), answer()], 1),
    ([(404, "gone"), TimeoutError(), answer()], 2),
    ([ConnectionError("lost"), (429, "slow"), answer()], 2),
])
def test_retries_until_an_answer(script, waits):
    slept = []
    assert call_with_retries(Scripted(*script), {}, FAST, slept.append) == answer()[1]
    assert len(slept) == waits


@pytest.mark.parametrize("step, waits", [((500, "x"), 3), ((400, "x"), 2), (TimeoutError("t"), 2)])
def test_retries_end(step, waits):
    slept = []
    with pytest.raises(RuntimeError):
        call_with_retries(Scripted(*[step] * 3), {}, FAST, slept.append)
    assert len(slept) == waits


def test_other_exceptions_are_not_retried():
    with pytest.raises(KeyError):
        call_with_retries(Scripted(KeyError("k"), answer()), {}, FAST, lambda s: None)


def test_delays_double():
    assert [RetryPolicy().delay(k, lambda a, b: b) for k in (1, 2, 3, 4, 5)] == [2.5, 4.5, 8.5, 16.5, 32.5]


@pytest.fixture(scope="module")
def sample(spark):
    rows = []
    for i in range(1, 41):
        row = dict.fromkeys(SAMPLE_SCHEMA.names, f'v"{i}\\é') | {
            "record_id": f"id{i}", "sample_rank": i, "total_pkts": str(900 + 10 * i), "total_bytes": None,
            "dst_port": "22" if i % 2 else "80", "protocol": "TCP", "label": "blacklist" if i % 4 == 0 else "background"}
        rows.append(tuple(row[c] for c in SAMPLE_SCHEMA.names))
    return spark.createDataFrame(rows, SAMPLE_SCHEMA)


def test_prompt_is_the_python_rendering(sample):
    for policy in prompts.POLICIES:
        rows = scoring.with_prompt(scoring.record_requests(sample), policy).collect()
        for source, row in zip(sample.collect(), rows):
            record = {k: v for k, v in source.asDict().items()
                      if v is not None and k not in ("label", "suspect_reason")}
            text = json.dumps(record, ensure_ascii=False, sort_keys=True)
            assert row.record == text
            assert row.prompt == (prompts.PROMPT_HEAD + text + prompts.PROMPT_FIELDS + prompts.POLICIES[policy]
                                  + prompts.PROMPT_TAIL)


class Flaky:
    """Fails some records for good, answers others in bad shape."""

    def __call__(self, request):
        number = int(json.loads(request["prompt"].split("\n")[5])["record_id"][2:])
        if number == 7:
            raise ValueError("no route")
        if number == 8:
            return 500, "broken"
        reply = "who knows" if number == 9 else '{"label":"attack","confidence":0.25}'
        return 200, json.dumps(scorers.envelope(request["provider"], reply, number, 1))


def run(sample, path, scorer, run_id, **options):
    return evaluation_job.run_evaluation(
        sample.select(*API_SCHEMA.names), sample, path, scorer, run_id, retries=FAST, sleep=lambda s: None,
        policy="balanced", concurrency=4, **options)


def test_failures_are_rows(sample, tmp_path, spark):
    path = str(tmp_path / "log")
    result = run(sample, path, Flaky(), "run1", report_folder=str(tmp_path / "report"))
    log = read_log(spark, path)
    assert log.count() == 160
    failed = {r.record_id: r for r in log.filter("status = 'error' AND model_name = 'claude'").collect()}
    assert set(failed) == {"id7", "id8", "id9"}
    assert failed["id7"].error == "no route" and "HTTP 500" in failed["id8"].error
    assert failed["id9"].error.endswith("who knows")
    for row in failed.values():
        assert (row.prediction, row.reason, row.input_tokens, row.output_tokens, row.latency_s, row.confidence) == (
            "error", "api_or_parse_error", 0, 0, 0.0, None)
    assert result.errors.count() == 12
    assert {(r.TP, r.FP, r.TN, r.FN, r.invalid_prediction) for r in result.metrics.collect()} == {(9, 28, 0, 0, 3)}
    stats = {r.model_name: r for r in result.stats.collect()}
    assert all((r.calls, r.errors, r.low_confidence) == (37, 3, 37) for r in stats.values())
    assert stats["gemini"].input_tokens == sum(range(1, 41)) - 7 - 8 - 9
    assert (tmp_path / "report" / "evaluation_report.txt").read_text().startswith("Ground truth\n")
    assert result.alignment.first().aligned


def test_resume_adds_nothing(sample, tmp_path, spark):
    path = str(tmp_path / "log")
    run(sample, path, scorers.RuleScorer(), "run1", limit=10)
    assert read_log(spark, path).count() == 40
    again = run(sample, path, scorers.RuleScorer(), "run1")
    assert read_log(spark, path).count() == 160
    before = sorted(map(tuple, read_log(spark, path).collect()))
    third = run(sample, path, Flaky(), "run2")
    assert sorted(map(tuple, read_log(spark, path).collect())) == before
    assert sorted(map(tuple, third.metrics.collect())) == sorted(map(tuple, again.metrics.collect()))
    assert {(r.calls, r.skipped_resume) for r in third.stats.collect()} == {(0, 40)}


def test_failed_calls_count_as_done_unless_retried(sample, tmp_path, spark):
    path = str(tmp_path / "log")
    run(sample, path, Flaky(), "run1")
    run(sample, path, scorers.RuleScorer(), "run2")
    assert read_log(spark, path).count() == 160
    run(sample, path, scorers.RuleScorer(), "run2", retry_errors=True)
    log = read_log(spark, path)
    assert log.count() == 172
    assert latest_predictions(log).filter("status = 'error'").count() == 0


class Ending:
    """Ends the job at a record, as a machine that is lost does."""

    def __call__(self, request):
        if json.loads(request["prompt"].split("\n")[5])["record_id"] == "id25":
            os._exit(1)
        return scorers.RuleScorer()(request)


def test_a_stopped_run_keeps_finished_waves(sample, tmp_path, spark):
    path = str(tmp_path / "log")
    with pytest.raises(Exception):
        run(sample, path, Ending(), "run1", wave=10)
    before = sorted(map(tuple, read_log(spark, path).collect()))
    assert len(before) == 80
    run(sample, path, scorers.RuleScorer(), "run1", wave=10)
    log = read_log(spark, path)
    assert log.count() == 160 == log.select("record_id", "model_name").distinct().count()
    assert set(before) <= set(map(tuple, log.collect()))


def test_no_resume_discards_the_selected_models(sample, tmp_path, spark):
    path = str(tmp_path / "log")
    run(sample, path, scorers.RuleScorer(), "run1")
    run(sample, path, scorers.RuleScorer(), "run2", models=MODELS[:1], resume=False)
    rows = read_log(spark, path).groupBy("model_name", "run_id").count().collect()
    assert {(r.model_name, r.run_id, r["count"]) for r in rows} == {
        ("chatgpt", "run2", 40), ("gemini", "run1", 40), ("deepseek", "run1", 40), ("claude", "run1", 40)}
    reset_outputs(spark, path, [m.model_name for m in MODELS])
    assert read_log(spark, path).count() == 0


def test_records_without_id_are_not_sent(spark, sample, tmp_path):
    nameless = sample.limit(1).selectExpr(*[f"'' AS {c}" if c == "record_id" else c for c in sample.columns])
    result = run(sample.union(nameless), str(tmp_path / "log"), scorers.RuleScorer(), "run1")
    assert read_log(spark, str(tmp_path / "log")).count() == 160
    assert [(r.record_id, r.error) for r in result.rejected.collect()] == [(None, "missing record_id")]
    stored = spark.read.parquet(*(str(p) for p in (tmp_path / "log" / "_rejected").glob("*/*"))).collect()
    assert stored == result.rejected.collect()


def test_calls_spread_over_partitions(sample):
    todo = scoring.with_prompt(scoring.pending(scoring.record_requests(sample)), "balanced")
    scored = scoring.score(todo, scorers.RuleScorer(), 4)
    sizes = scored.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 4 and min(sizes) > 20


def test_pause_after_every_call(spark, sample):
    waits = spark.sparkContext.accumulator(0)
    todo = scoring.with_prompt(scoring.pending(scoring.record_requests(sample), MODELS[:1]), "balanced")
    scoring.score(todo, scorers.RuleScorer(), 2, pause=0.5, sleep=lambda s: waits.add(1)).collect()
    assert waits.value == 40


def test_rule_scorer_reads_the_record(sample):
    todo = scoring.with_prompt(scoring.pending(scoring.record_requests(sample), MODELS[:1]), "aggressive")
    rows = scoring.predictions_of(scoring.score(todo, scorers.RuleScorer({"chatgpt": 2}), 2)).collect()
    found = {r.record_id: r.prediction for r in rows}
    for i in range(1, 41):
        hits = (900 + 10 * i > 1000) + (i % 2)
        assert found[f"id{i}"] == ("attack" if hits >= 2 else "normal")


class ClientError(OSError):
    """As HTTP clients derive their failures."""


def test_retries_failures_of_clients():
    tries = []

    def scorer(request):
        tries.append(1)
        if len(tries) < 3:
            raise ClientError("reset")
        return 200, "{}"

    assert call_with_retries(scorer, {}, FAST, sleep=lambda s: None) == "{}"
    assert len(tries) == 3


def test_repeated_ids_are_called_once_per_model(spark):
    requests = spark.createDataFrame(
        [(3, "x", "late"), (1, "x", "early"), (2, "y", "{}"), (2, "y", "{}")], "record_index long, record_id string, record string")
    rows = scoring.pending(requests, MODELS[:2]).collect()
    assert sorted((r["record_id"], r["record"], r["model_name"]) for r in rows) == sorted(
        (i, record, m.model_name) for i, record in (("x", "early"), ("y", "{}")) for m in MODELS[:2])


def test_a_rate_holds_for_all_partitions_together(sample):
    """Four partitions share two calls a second: each starts one every two seconds, whatever the calls take."""
    todo = scoring.with_prompt(scoring.pending(scoring.record_requests(sample), MODELS[:1]), "balanced")
    clock = CountedClock()

    def slow(request):
        clock.sleep(5.0 if request["record_index"] % 4 == 0 else 0.25)
        return answer()

    rows = scoring.score(todo, slow, 4, clock=clock, calls_per_second=2.0).withColumn("part", F.spark_partition_id()).collect()
    assert len(rows) == 40 and {r.latency_s for r in rows} == {5.0, 0.25}
    for part in {r.part for r in rows}:
        ends = [(dt.datetime.fromisoformat(r.timestamp).timestamp(), r.latency_s) for r in rows if r.part == part]
        starts = [end - latency for end, latency in ends]
        assert all(b - a >= 2.0 - 1.0 for a, b in zip(starts, starts[1:]))  # time stamps are whole seconds
        assert ends[-1][0] >= 2 * (len(ends) - 1)


def test_bodies_reach_the_scorer(sample):
    todo = scoring.with_bodies(scoring.with_prompt(scoring.pending(scoring.record_requests(sample), MODELS), "balanced"))

    def checked(request):
        body = json.loads(request["request_body"])
        if request["provider"] == "google":
            sent, known = body["contents"][0]["parts"][0]["text"], body["generationConfig"]["thinkingConfig"] == {"thinkingBudget": 0}
        else:
            sent, known = body["messages"][0]["content"], body["model"] == request["model_id"] and body["temperature"] == 0
        assert sent == request["prompt"] and known and "record" not in request
        return 200, json.dumps(scorers.envelope(request["provider"], '{"label":"attack"}', 1, 1))

    rows = scoring.predictions_of(scoring.score(todo, checked, 4)).collect()
    assert {r.status for r in rows} == {"ok"} and len(rows) == 160
    other = todo.withColumn("request_body", request_body(F.lit("elsewhere"), F.col("model_id"), F.col("prompt")))
    assert other.filter("request_body is not null").isEmpty()


def test_one_id_that_a_third_of_the_rows_share_is_called_once(spark, sample):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("record_id"),
                                    (F.col("id") + 1).alias("record_index"), F.col("id").cast("string").alias("record"))
    todo = scoring.pending(many, MODELS[:1])
    found = {r.record_id: r.record_index for r in todo.collect()}
    assert len(found) == 2001 and found["hot"] == 1
    plan = todo._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min" in plan
