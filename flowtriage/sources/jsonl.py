"""JSON lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowtriage.functions.replies import STRICT, json_object
from flowtriage.functions.text import strip
from flowtriage.sources import storage

#: Lines of a packed file at most.
PACKED_LINES = 1_000_000


def _object_line(line: Column) -> Column:
    return json_object(F.when(line.startswith("{"), line))


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per line; blank lines are skipped, any other line is an error."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line"), F.input_file_name().alias("file"))
    broken = F.raise_error(F.concat(F.lit("invalid JSON in "), F.col("file"), F.lit(": "), F.col("line")))
    return (
        lines.filter(F.col("line") != "")
        .select(F.coalesce(_object_line(F.col("line")), broken.cast("string")).alias("line"))
        .select(F.from_json("line", schema, STRICT | {"mode": "FAILFAST"}).alias("row"))
        .select("row.*")
    )


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects that parse, with log_position: where in the log a line stands.

    Files count in the order of their names, which copying keeps, lines in file order
    (row ids only grow within a split, so the split's offset goes before them).
    """
    if not storage.glob(spark, path):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("log_position", T.StringType())]))
    lines = spark.read.text(path).select(
        strip(F.col("value")).alias("line"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("log_position"),
    )
    return (
        lines.select(F.from_json(_object_line(F.col("line")), schema, STRICT).alias("row"), "log_position")
        .filter(F.col("row").isNotNull())
        .select("row.*", "log_position")
    )


def json_line(columns: list[str]) -> Column:
    """The columns as one JSON text; a NULL column is left out."""
    return F.to_json(F.struct(*columns))


def to_jsonl(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(json_line(columns).alias("value"))


def write_packed_jsonl(df: DataFrame, columns: list[str], path: str) -> None:
    """JSON lines for later steps of a job, as LZ4, which takes a quarter of the room.

    A packed file is read by one task, so files have a bounded number of lines.
    """
    to_jsonl(df, columns).write.option("maxRecordsPerFile", PACKED_LINES).text(path, compression="lz4")


def write_single_text(lines: DataFrame, order: list[str], path: str) -> None:
    """Column value as one text file at path, in the given order; replaces what is there.

    The lines are made in parallel, then sorted and written by a single task.
    """
    spark = lines.sparkSession
    folder = f"{path}.parts-{uuid.uuid4().hex}"  # beside the target, so that the move is a rename
    lines.repartition(1).sortWithinPartitions(*order).select("value").write.text(folder)
    parts = storage.glob(spark, f"{folder}/part-*")
    if len(parts) != 1:
        raise RuntimeError(f"expected one part file for {path}, found {len(parts)}")
    storage.replace(spark, parts[0], path)
    storage.delete(spark, folder)


def write_single_jsonl(df: DataFrame, columns: list[str], path: str, order: str = "sample_rank") -> None:
    """One file, which one task writes row by row; large exports are better sharded."""
    write_single_text(df.select(json_line(columns).alias("value"), order), [order], path)
