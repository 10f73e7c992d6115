"""Flow tables: Parquet parts and headerless CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from flowtriage.schema import FLOW_COLUMNS, FLOW_SCHEMA, bind_flow_schema, is_typed, typed_flows


def scan_flows(spark: SparkSession, path: str) -> DataFrame:
    """A directory of Parquet parts with 13 positional columns."""
    return bind_flow_schema(spark.read.parquet(path))


def stream_flows(spark: SparkSession, path: str, files_per_trigger: int) -> DataFrame:
    """The same directory as a stream of its files."""
    positional = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(FLOW_COLUMNS))])
    return bind_flow_schema(
        spark.readStream.schema(positional).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def scan_typed_flows(spark: SparkSession, path: str) -> DataFrame:
    """What a typed ingest has written."""
    flows = spark.read.parquet(path)
    if not is_typed(flows):
        raise ValueError(f"no typed flows in {path}: {flows.columns}")
    return flows


def ingest_csv(spark: SparkSession, source: str, target: str, typed: bool = False) -> None:
    """Headerless CSV to Snappy Parquet, all text; typed writes the declared types, and the text beside them."""
    rows = spark.read.schema(FLOW_SCHEMA).csv(source, header=False)
    rows = typed_flows(rows) if typed else rows
    rows.write.mode("overwrite").parquet(target, compression="snappy")
