"""Tagging, scoring and statistics on rows as they arrive."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from flowtriage.operators.calls import Clock, RetryPolicy, Scorer
from flowtriage.operators.callstats import added_counters, counter_parts
from flowtriage.operators.models import MODELS, Model
from flowtriage.operators.rules import RULES, Rule, suspects
from flowtriage.operators.scoring import pending, predictions_of, record_requests, score, with_bodies, with_prompt
from flowtriage.sources import done
from flowtriage.sources.predictions import LOG_SCHEMA, append_predictions


def stream_suspects(
    flows: DataFrame, target: str, checkpoint: str, rules: list[Rule] = RULES, until_caught_up: bool = True
) -> StreamingQuery:
    """Tags suspects row by row and appends them as Parquet; needs no state."""
    writer = suspects(flows, rules).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return _trigger(writer, until_caught_up).start(target)


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The prediction log as a stream of its files, each row with the write (`_write`) and the time (`_written`) of its file."""
    write = F.regexp_extract("_metadata.file_name", r"^part-\d+-([0-9a-f-]{36})", 1)
    return spark.readStream.schema(LOG_SCHEMA).parquet(path).select(
        "*", write.alias("_write"), F.col("_metadata.file_modification_time").alias("_written"))


def stream_call_stats(log: DataFrame, target: str, checkpoint: str, until_caught_up: bool = True) -> StreamingQuery:
    """Running counters per model, of the rows that the log holds; log as read_log_stream gives it.

    A batch that its writer repeats comes in new files, which replace the old: of each batch the counters of its last
    write stand. State is a row per batch and write, however many calls they have. Every trigger replaces the table at
    target, a row per model.
    """
    place = ["run_seq", "run_id", "writer_id", "batch_id"]

    def replace(parts: DataFrame, _: int) -> None:
        last = F.max(F.struct("_written", "_write")).over(Window.partitionBy(*place))["_write"]
        added_counters(parts.withColumn("_last", last).filter("_write = _last")).write.mode("overwrite").parquet(target)

    parts = log.groupBy("model_name", *place, "_write").agg(*counter_parts(), F.max("_written").alias("_written"))
    writer = parts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(replace)
    return _trigger(writer, until_caught_up).start()


def stream_scores(
    records: DataFrame,
    scorer: Scorer,
    log_path: str,
    run_id: str,
    checkpoint: str,
    models: list[Model] = MODELS,
    policy: str = "conservative",
    concurrency: int = 8,
    retry_errors: bool = False,
    retries: RetryPolicy = RetryPolicy(),
    pause: float = 0.0,
    sleep: Callable[[float], None] = time.sleep,
    index: str = "sample_rank",
    until_caught_up: bool = True,
    prepare: Callable[[DataFrame], DataFrame] = with_bodies,
    calls_per_second: float | None = None,
    clock: Clock | None = None,
) -> StreamingQuery:
    """Scores what arrives and is not in the log yet. A batch looks its own ids up in the table of calls made, and does
    not read the log, so its cost does not grow with what was scored before.

    A batch that is repeated after a crash ignores its own earlier rows and
    replaces them, so the log has every (record, model) once. The writer is
    the stream's id, which its checkpoint keeps: another stream, or the same
    one with a fresh checkpoint, never replaces these rows.
    """

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        writer = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        requests = record_requests(batch, index)
        called = done.lookup(requests, log_path, (run_id, writer, batch_id))
        todo = with_prompt(pending(requests, models, called, retry_errors), policy)
        append_predictions(
            predictions_of(score(prepare(todo), scorer, concurrency, retries, pause, sleep, calls_per_second, clock)), log_path, run_id, batch_id, writer
        )

    done.catch_up(records.sparkSession, log_path)
    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(score_batch)
    return _trigger(writer, until_caught_up).start()


def _trigger(writer, until_caught_up: bool):
    return writer.trigger(availableNow=True) if until_caught_up else writer
