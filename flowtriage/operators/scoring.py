"""Sending records to classifiers.

The only Python that runs per row is the call itself, inside mapInPandas. What
to call, and what the answers mean, is decided in Spark.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from flowtriage.functions.envelopes import parse_body, unwrap_envelope
from flowtriage.functions.prompts import record_json, render_prompt
from flowtriage.functions.replies import parse_reply
from flowtriage.functions.requests import request_body
from flowtriage.operators import calls
from flowtriage.operators.calls import Clock, Pace, RetryPolicy, Scorer, call_with_retries
from flowtriage.operators.evaluation import split_valid_ids
from flowtriage.operators.models import MODELS, Model
from flowtriage.schema import PREDICTION_SCHEMA, drop_sensitive

# Workers get these few functions with the task and need no copy of the package.
cloudpickle.register_pickle_by_value(calls)

CALL_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("record_index", T.LongType()),
    T.StructField("record_id", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("latency_s", T.DoubleType()),
])


def record_requests(records: DataFrame, index: str = "sample_rank") -> DataFrame:
    """(record_index, record_id, record): the JSON of each record without columns that tell the answer."""
    safe = drop_sensitive(records)
    columns = dict(safe.dtypes)
    return safe.select(
        F.col(index).cast("bigint").alias("record_index"), "record_id", record_json(columns).alias("record")
    )


def pending(
    requests: DataFrame, models: list[Model] = MODELS, log: DataFrame | None = None, retry_errors: bool = False
) -> DataFrame:
    """Requests times models, less what the log already holds; failed calls count as done unless retried.

    A repeated id is called once per model, for its record of the smallest index.
    """
    valid, _ = split_valid_ids(requests)
    # the least of equal ids is found before the shuffle, so a row per id and task is sent
    rest = [c for c in valid.columns if c not in ("record_id", "record_index", "record")]
    first = F.min(F.struct("record_index", "record", *rest)).alias("_first")
    valid = valid.groupBy("record_id").agg(first).select("record_id", "_first.*").select(*valid.columns)
    each = F.array(*[
        F.struct(F.lit(m.model_name).alias("model_name"), F.lit(m.provider).alias("provider"),
                 F.lit(m.model_id).alias("model_id"))
        for m in models
    ])
    todo = valid.select("*", F.inline(each))
    if log is None:
        return todo
    done = log.filter(F.col("status") == "ok") if retry_errors else log
    return todo.join(done.select("record_id", "model_name").distinct(), ["record_id", "model_name"], "left_anti")


def with_prompt(todo: DataFrame, policy: str) -> DataFrame:
    return todo.withColumn("prompt", render_prompt(F.col("record"), policy))


def with_prompts(todo: DataFrame, policies: list[str]) -> DataFrame:
    """One row per policy, with its name and prompt."""
    each = F.array(*[
        F.struct(F.lit(p).alias("policy"), render_prompt(F.col("record"), p).alias("prompt")) for p in policies
    ])
    return todo.select("*", F.inline(each))


def with_bodies(todo: DataFrame) -> DataFrame:
    """The body of each request, for scorers that only send it."""
    return todo.withColumn("request_body", request_body(F.col("provider"), F.col("model_id"), F.col("prompt")))


def score(
    todo: DataFrame,
    scorer: Scorer,
    concurrency: int,
    retries: RetryPolicy = RetryPolicy(),
    pause: float = 0.0,
    sleep: Callable[[float], None] = time.sleep,
    calls_per_second: float | None = None,
    clock: Clock | None = None,
) -> DataFrame:
    """Calls the scorer once per row; concurrency is the number of partitions calling at a time.

    Rows are dealt out evenly, so neither a model nor a repeated record piles up in one partition. The scorer gets all
    columns of todo but the record. Failures become rows with an error, never exceptions.

    calls_per_second holds for the whole job: each of the partitions that can run at a time gets its share, and spaces
    the starts of its calls accordingly (a retry belongs to its call). pause is waited after each call, by its partition.
    Times are those of the clock, which also waits in place of sleep.
    """
    names = CALL_SCHEMA.names
    running = min(concurrency, todo.sparkSession.sparkContext.defaultParallelism)
    interval = running / calls_per_second if calls_per_second else 0.0
    times = clock or Clock()
    sleep = times.sleep if clock else sleep

    def call(row: dict, pace: Pace) -> dict:
        if interval:
            pace.wait()
        started = times.now()
        body, error = None, None
        try:
            body = call_with_retries(scorer, row, retries, sleep)
        except Exception as exc:  # whatever a scorer raises is that row's result
            error = str(exc) or type(exc).__name__
        ended = times.now()
        if pause > 0:
            sleep(pause)
        stamp = dt.datetime.fromtimestamp(ended).isoformat(timespec="seconds")
        return {**row, "timestamp": stamp, "body": body, "error": error, "latency_s": round(ended - started, 3)}

    def call_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(interval, times)
        for batch in batches:
            rows = [call(row, pace) for row in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=names)

    return todo.drop("record").repartition(concurrency).mapInPandas(call_batches, CALL_SCHEMA)


def predictions_of(scored: DataFrame) -> DataFrame:
    """Log rows from scored calls: verdicts where the reply holds one, error rows otherwise."""
    read = (
        scored.withColumn("_body", parse_body(F.col("body")))
        .withColumn("_envelope", unwrap_envelope(F.col("provider"), F.col("_body")))
        .withColumn("_verdict", parse_reply(F.col("_envelope.reply")))
    )
    ok = F.col("error").isNull() & F.col("_verdict").isNotNull()
    failure = F.coalesce(
        F.col("error"), F.col("_envelope.error"),
        F.concat(F.lit("no verdict in the reply: "), F.substring(F.col("_envelope.reply"), 1, 300)),
    )
    zero = F.lit(0).cast("bigint")
    return read.select(
        "timestamp", "record_index", "record_id", "model_name", "model_id",
        F.when(ok, F.col("_verdict.prediction")).otherwise("error").alias("prediction"),
        F.when(ok, F.col("_verdict.confidence")).alias("confidence"),
        F.when(ok, F.col("_verdict.reason")).otherwise("api_or_parse_error").alias("reason"),
        F.coalesce("_envelope.reply", failure).alias("raw_response"),
        F.when(ok, F.col("_envelope.input_tokens")).otherwise(zero).alias("input_tokens"),
        F.when(ok, F.col("_envelope.output_tokens")).otherwise(zero).alias("output_tokens"),
        F.when(ok, F.col("latency_s")).otherwise(F.lit(0.0)).alias("latency_s"),
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.when(~ok, failure).alias("error"),
    ).select(*PREDICTION_SCHEMA.names)


def missing_id_errors(requests: DataFrame) -> DataFrame:
    """Error rows for records without an id; they are never sent."""
    _, invalid = split_valid_ids(requests)
    return invalid.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        "record_index",
        F.lit(None).cast("string").alias("record_id"),
        F.lit("missing record_id").alias("error"),
    )
