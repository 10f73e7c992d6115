from __future__ import annotations

import json
from urllib.parse import urlparse

import pyarrow.parquet as pq
import scorers

from flowtriage import catalog, fixtures
from flowtriage.operators import callstats, rules
from flowtriage.operators.models import MODELS
from flowtriage.schema import FLOW_SCHEMA, PREDICTION_SCHEMA, SAMPLE_SCHEMA
from flowtriage.sources import done, storage
from flowtriage.sources.predictions import append_predictions, read_log, reset_outputs
from flowtriage.streaming import live


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_suspects_arrive_once_over_restarts(spark, sf_dir, tmp_path):
    flows = fixtures.flows(spark, sf_dir)
    halves = flows.randomSplit([0.5, 0.5], seed=1)
    source, target, state = (str(tmp_path / n) for n in ("flows", "suspects", "state"))
    for half in halves:
        half.write.mode("append").parquet(source)
        stream = spark.readStream.schema(FLOW_SCHEMA).parquet(source)
        live.stream_suspects(stream, target, state).awaitTermination()
    batch = rules.suspects(spark.read.parquet(source))
    assert rows_of(spark.read.parquet(target).select(*batch.columns)) == rows_of(batch)


def test_tasks_of_the_stream_follow_the_table(spark, sf_dir, tmp_path):
    parts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(24)
    parts.write.parquet(str(tmp_path / "lineitem.parquet"))
    small = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        found = catalog.QUERIES["stream_suspects"](spark, str(tmp_path))
        sizes = [r["count"] for r in found.groupBy("_metadata.file_path").count().collect()]
    finally:
        for key in small:
            spark.conf.unset(key)
    assert sum(sizes) == rules.suspects(fixtures.flows(spark, sf_dir)).count()
    assert max(sizes) < sum(sizes) / 8


def test_tables_in_many_row_groups_are_not_shuffled(spark, sf_dir, tmp_path, monkeypatch):
    def shuffled(folder):
        return "Exchange" in fixtures.derive_flows(spark, folder)._jdf.queryExecution().executedPlan().toString()

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(8).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert not shuffled(str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert shuffled(sf_dir)  # one row group
    monkeypatch.setattr(fixtures, "DEALT_ROWS", 100)
    derived = fixtures.derive_flows(spark, sf_dir)
    assert derived.rdd.getNumPartitions() == -(-derived.count() // 100)


def test_counters_follow_the_log(spark, sf_dir, tmp_path):
    log = fixtures.prediction_log(spark, sf_dir)
    path, target, state = (str(tmp_path / n) for n in ("log", "stats", "state"))
    for batch, run in enumerate(("r0", "r1")):
        append_predictions(log.filter(f"run_id = '{run}'"), path, run, batch)
        live.stream_call_stats(live.read_log_stream(spark, path), target, state).awaitTermination()
        expected = callstats.call_counters(read_log(spark, path))
        assert rows_of(spark.read.parquet(target).select(*expected.columns)) == rows_of(expected)


def records(spark, first, last):
    rows = [tuple({"record_id": f"id{i}", "sample_rank": i, "total_pkts": "2000"}.get(c) for c in SAMPLE_SCHEMA.names)
            for i in range(first, last)]
    return spark.createDataFrame(rows, SAMPLE_SCHEMA)


def test_scores_resume_without_doubles(spark, tmp_path):
    source, log, state = (str(tmp_path / n) for n in ("records", "log", "state"))
    for first, last in ((0, 10), (5, 20)):
        records(spark, first, last).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SAMPLE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        live.stream_scores(stream, scorers.RuleScorer(), log, "run1", state, MODELS[:2], "balanced", 2).awaitTermination()
    stored = read_log(spark, log)
    assert stored.count() == 40 == stored.select("record_id", "model_name").distinct().count()


def test_two_sources_of_one_run_keep_all_rows(spark, tmp_path):
    """Both streams begin with batch 0 under one run id; the second must not replace rows of the first."""
    log = str(tmp_path / "log")
    for n in (0, 10):
        source = str(tmp_path / f"records{n}")
        records(spark, n, n + 10).write.parquet(source)
        stream = spark.readStream.schema(SAMPLE_SCHEMA).parquet(source)
        live.stream_scores(stream, scorers.RuleScorer(), log, "run1", str(tmp_path / f"state{n}"), MODELS[:2], "balanced",
                           2).awaitTermination()
    stored = read_log(spark, log)
    assert stored.count() == 40 == stored.select("record_id", "model_name").distinct().count()


def test_a_replayed_stream_adds_nothing(spark, tmp_path):
    """Two streams with fresh state but one run id: the second finds all in the log."""
    source, log = str(tmp_path / "records"), str(tmp_path / "log")
    records(spark, 0, 10).write.parquet(source)
    for attempt in ("first", "second"):
        stream = spark.readStream.schema(SAMPLE_SCHEMA).parquet(source)
        live.stream_scores(stream, scorers.RuleScorer(), log, "run1", str(tmp_path / attempt), MODELS[:2], "balanced",
                           2).awaitTermination()
    stored = read_log(spark, log)
    assert stored.count() == 20
    assert {json.loads(r.raw_response)["label"] for r in stored.collect()} == {"attack"}


def prediction(i, model="claude", status="ok", index=None):
    row = {"timestamp": "2024-01-01T00:00:00", "record_index": index or i, "record_id": f"id{i}", "model_name": model, "model_id": "m",
           "prediction": "attack", "confidence": 0.5, "input_tokens": 3, "output_tokens": 1, "latency_s": 0.25, "status": status}
    return tuple(row.get(c) for c in PREDICTION_SCHEMA.names)


def test_live_state_is_a_row_per_batch_and_follows_repeats(spark, tmp_path):
    path, target, state = (str(tmp_path / n) for n in ("log", "stats", "state"))
    sizes = []
    for rows, batch in ((200, 0), (50, 1), (400, 1), (10, 2)):  # the second write of batch 1 replaces the first
        made = spark.createDataFrame([prediction(1000 * batch + i) for i in range(rows)], PREDICTION_SCHEMA)
        append_predictions(made, path, "run", batch)
        query = live.stream_call_stats(live.read_log_stream(spark, path), target, state)
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        expected = callstats.call_counters(read_log(spark, path))
        assert rows_of(spark.read.parquet(target).select(*expected.columns)) == rows_of(expected)
    assert sizes == [1, 2, 3, 4]  # a row per write of a batch, not per call


def test_lookups_do_not_grow_with_the_log(spark, tmp_path, monkeypatch):
    """32 batches of 40 calls: what a lookup opens stays what a few buckets hold, and every call is found."""
    monkeypatch.setattr(done, "BUCKET_ROWS", 20)
    monkeypatch.setattr(done, "FANOUT", 4)
    path, opened = str(tmp_path / "log"), []
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for batch in range(32):
        rows = [prediction(40 * batch + i) for i in range(40)]
        append_predictions(spark.createDataFrame(rows, PREDICTION_SCHEMA).coalesce(1), path, "run", batch)
        asked = spark.createDataFrame([(f"id{40 * batch}",), ("id7",), ("new",)], "record_id string")
        found = done.lookup(asked, path)
        opened.append(sum(pq.ParquetFile(urlparse(f).path).metadata.num_rows for f in found.inputFiles()))
        assert {r.record_id for r in found.join(asked, "record_id").collect()} == {f"id{40 * batch}", "id7"}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert max(opened[20:]) <= 1.5 * max(opened[8:20]) and max(opened) < 0.4 * 32 * 40
    spans = done.spans(spark, path)
    assert len(spans) <= 3 * 3 and sum(s.last - s.first + 1 for s in spans) == 32
    # also without the table: it is made again from the log
    storage.delete(spark, f"{path}/{done.FOLDER}")
    done.catch_up(spark, path)
    every = done.lookup(spark.createDataFrame([(f"id{i}",) for i in range(1280)], "record_id string"), path)
    assert every.count() == 1280 and len(done.spans(spark, path)) == 1


def test_a_batch_whose_writer_stopped_is_entered_at_the_next_start(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch, status in ((0, "ok"), (1, "error"), (5, "ok")):
        append_predictions(spark.createDataFrame([prediction(batch, status=status)], PREDICTION_SCHEMA), path, "run", batch, "w")
    for span in done.spans(spark, path):
        if span.first != 0:
            storage.delete(spark, span.folder(path))
    done.catch_up(spark, path)
    ids = spark.createDataFrame([(f"id{i}",) for i in range(9)], "record_id string")
    assert sorted((r.record_id, r.status) for r in done.lookup(ids, path).collect()) == [("id0", "ok"), ("id1", "error"), ("id5", "ok")]
    assert [r.record_id for r in done.lookup(ids, path, ("run", "w", 5)).collect() if r.record_id == "id5"] == []
    reset_outputs(spark, path, ["claude"])
    assert done.lookup(ids, path).count() == 0
