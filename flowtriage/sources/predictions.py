"""The prediction log: appended in batches, read back with the last row per record and model.

Layout: model_name= / run_seq= / run_id= / writer_id= / batch_id= folders of Parquet. Runs are numbered in the order in
which they first write; a run's number is claimed by creating a file that must not exist. A batch replaces only what its own writer left under its number, so writing it again after a
failure adds nothing twice, and no writer touches another's rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowtriage.operators.evaluation import last_rows, split_valid_ids
from flowtriage.schema import PREDICTION_SCHEMA
from flowtriage.sources import done, storage
from flowtriage.sources.jsonl import read_jsonl_tolerant

FOLDERS = ["model_name", "run_seq", "run_id", "writer_id", "batch_id"]
LOG_SCHEMA = T.StructType([
    *PREDICTION_SCHEMA.fields,
    T.StructField("run_seq", T.LongType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("writer_id", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])
LOG_ORDER = ["run_seq", "timestamp", "batch_id", "record_index", "writer_id"]
LOG_KEYS = ["model_name", "record_id"]


def run_sequence(spark: SparkSession, path: str, run_id: str) -> int:
    """The number of a run: the one it has, or the next, which it then has for good.

    A number belongs to the run whose file was created first, so runs that begin at the same time get different ones.
    """
    run, claims = _plain(run_id), f"{path}/_runs"

    def known() -> int | None:
        found = storage.glob(spark, f"{claims}/run_id={run}/run_seq=*")
        found = found or storage.glob(spark, f"{path}/model_name=*/run_seq=*/run_id={run}")  # of logs without claims
        numbers = [int(m) for f in found for m in re.findall(r"run_seq=(\d+)", f)]
        return min(numbers, default=None)

    number = known()
    if number is None:
        taken = storage.glob(spark, f"{claims}/taken/*") + storage.glob(spark, f"{path}/model_name=*/run_seq=*")
        number = max((int(f.rpartition("/")[2].removeprefix("run_seq=")) for f in taken), default=-1) + 1
        while not storage.create_new(spark, f"{claims}/taken/{number}", run):
            number += 1
        storage.create_new(spark, f"{claims}/run_id={run}/run_seq={number}", "")
        number = known()  # of two writers of one run that begin together both take the lower number
    return number


def _plain(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
        raise ValueError(f"run and writer ids become folder names: {name!r}")
    return name


def append_predictions(rows: DataFrame, path: str, run_id: str, batch_id: int = 0, writer_id: str = "main") -> None:
    """OK and error rows of one batch, written once per batch rather than once per row.

    Whoever writes at the same time, or starts to count batches anew, needs a writer_id of its own.
    """
    seq = run_sequence(rows.sparkSession, path, run_id)
    (
        rows.select(*PREDICTION_SCHEMA.names)
        .withColumns({
            "run_seq": F.lit(seq).cast("bigint"), "run_id": F.lit(run_id), "writer_id": F.lit(_plain(writer_id)),
            "batch_id": F.lit(batch_id).cast("bigint")})
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(path)
    )
    done.add(rows.sparkSession, path, run_id, writer_id, batch_id)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the log; a log that does not exist yet is empty."""
    if not storage.glob(spark, f"{path}/model_name=*"):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(path).select(*LOG_SCHEMA.names)


def store_rejected(rows: DataFrame, path: str, run_id: str, writer_id: str) -> DataFrame:
    """Error rows of records that could not be sent, kept beside the log (a folder that readers of the log pass over)."""
    folder = f"{path}/_rejected/{_plain(run_id)}/{_plain(writer_id)}"
    rows.write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def errors(log: DataFrame) -> DataFrame:
    return log.filter(F.col("status") == "error").select(
        "timestamp", "record_index", "record_id", "model_name", "model_id", "error", "status"
    )


def latest_predictions(log: DataFrame, order: list[str] = LOG_ORDER) -> DataFrame:
    """Last row per record and model; rows without an id are skipped."""
    valid, _ = split_valid_ids(log)
    return last_rows(valid, LOG_KEYS, order)


def read_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    """Last predictions out of JSON lines; lines that do not parse and missing files are skipped.

    What the lines say of run, time and batch tells which is last, so copying files changes nothing; the place of a line
    counts only between lines that agree in these.
    """
    rows = read_jsonl_tolerant(spark, path, LOG_SCHEMA)
    return latest_predictions(rows, [*LOG_ORDER, "log_position"]).select(*PREDICTION_SCHEMA.names)


def reset_outputs(spark: SparkSession, path: str, models: list[str]) -> None:
    """Discards what the log holds of these models."""
    for model in models:
        folder = f"{path}/model_name={model}"
        if storage.exists(spark, folder):
            storage.delete(spark, folder)
    if storage.exists(spark, f"{path}/{done.FOLDER}"):
        storage.delete(spark, f"{path}/{done.FOLDER}")
        done.catch_up(spark, path)
