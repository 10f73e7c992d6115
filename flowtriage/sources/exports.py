"""The nested samples as JSON lines, without and with labels."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from os.path import commonprefix

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtriage.operators.sampling import PREFIXES, nested_prefix
from flowtriage.schema import API_COLUMNS, EVAL_COLUMNS
from flowtriage.sources import storage
from flowtriage.sources.jsonl import json_line, write_single_jsonl

VIEWS = {"api": API_COLUMNS, "eval": EVAL_COLUMNS}


def export_samples(sample: DataFrame, folder: str, prefixes: dict[str, int] = PREFIXES) -> dict[str, int]:
    """One file per prefix and view; returns the lines each must have.

    The ranks 1..N are unique, so a prefix holds at most its own length. Each
    file is written by one task; export_sharded is the way for large samples.
    """
    rows = sample.count()
    files = {f"{folder}/{name}_{view}.jsonl": (k, columns)
             for name, k in prefixes.items() for view, columns in VIEWS.items()}
    with ThreadPoolExecutor(len(files)) as jobs:  # one small job each, side by side
        list(jobs.map(lambda f: write_single_jsonl(nested_prefix(sample, f[1][0]), f[1][1], f[0]), files.items()))
    return {path: min(k, rows) for path, (k, _) in files.items()}


def export_sharded(sample: DataFrame, folder: str, prefixes: dict[str, int] = PREFIXES) -> dict[str, int]:
    """The same lines in one job, as sample= / view= folders of many files; returns the lines each must have."""
    copies = F.array_compact(F.array(*[
        F.when(F.col("sample_rank") <= k, F.struct(
            F.lit(name).alias("sample"), F.lit(view).alias("view"), json_line(columns).alias("value")))
        for name, k in prefixes.items() for view, columns in VIEWS.items()
    ]))
    sample.select(F.inline(copies)).write.mode("overwrite").partitionBy("sample", "view").text(folder)
    rows = sample.count()
    return {f"{folder}/sample={name}/view={view}": min(k, rows) for name, k in prefixes.items() for view in VIEWS}


def verify_export(spark: SparkSession, expected: dict[str, int]) -> DataFrame:
    """Lines found per file or folder against lines expected: (file, expected_lines, line_count, size_bytes, line_count_ok).

    file is the path below the folder that all have in common. A missing file
    has NULL counts; an empty one has 0.
    """
    above = commonprefix([path.rsplit("/", 1)[0] + "/" for path in expected])
    above = above[: above.rfind("/") + 1]
    present = [path for path in expected if storage.exists(spark, path)]
    listed = spark.createDataFrame(
        [(path, path[len(above):], n, path in present) for path, n in expected.items()],
        "path string, file string, expected_lines bigint, found boolean",
    )
    if not present:
        return listed.selectExpr("file", "expected_lines", "cast(NULL AS BIGINT) AS line_count",
                                 "cast(NULL AS BIGINT) AS size_bytes", "false AS line_count_ok")
    lines = reduce(DataFrame.unionByName, [spark.read.text(path).select(
        F.lit(path).alias("path"), F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_size").alias("size"),
    ) for path in present])
    counts = (
        lines.groupBy("path", "part").agg(F.count("*").alias("lines"), F.max("size").alias("size"))
        .groupBy("path").agg(F.sum("lines").alias("lines"), F.sum("size").alias("size"))
    )
    zero = F.when(F.col("found"), F.lit(0).cast("bigint"))
    return listed.join(counts, "path", "left").select(
        "file", "expected_lines", F.coalesce("lines", zero).alias("line_count"),
        F.coalesce("size", zero).alias("size_bytes"),
        (F.coalesce("lines", zero).eqNullSafe(F.col("expected_lines"))).alias("line_count_ok"),
    )


def require_complete(verified: DataFrame) -> DataFrame:
    """Stops the job when a file is missing or short."""
    wrong = [f"{r.file}: expected {r.expected_lines}, got {r.line_count}"
             for r in verified.filter(~F.col("line_count_ok")).collect()]  # at most one row per exported file
    if wrong:
        raise ValueError("line counts differ: " + "; ".join(wrong))
    return verified
