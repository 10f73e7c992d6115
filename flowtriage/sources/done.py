"""Which calls a prediction log holds, kept so that looking up a batch of ids does not read the log.

Beside the log (in a folder that readers of the log pass over) lie spans: folders with one row per record, model and
status of the batches first to last of one writer. A span is cut into buckets by the hash of the record id, as many as
keep a bucket at BUCKET_ROWS rows, so a lookup opens the buckets of its own ids only. A writer adds a span per batch
and merges FANOUT spans of like length into one, so there are few, and a row is rewritten once per level. Spans are
written once, under a name that tells what they hold, and count when they are complete; a merged span stands before the
spans that it holds, which go when the next merge is done, so whoever reads meanwhile finds all files it has listed.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtriage.sources import storage

FOLDER = "_done"
BUCKET_ROWS, FANOUT = 100_000, 8
#: More buckets than this are not listed for a lookup, which then reads the whole span.
MOST_LISTED = 4096
SCHEMA = "record_id string, model_name string, status string"
BATCHES = re.compile(r"run_id=([^/]+)/writer_id=([^/]+)/batch_id=(\d+)")
SPAN = re.compile(r"run_id=([^/]+)/writer_id=([^/]+)/span=(\d+)-(\d+)-of-(\d+)")


class Span(NamedTuple):
    run_id: str
    writer_id: str
    first: int
    last: int
    buckets: int

    def folder(self, path: str) -> str:
        return f"{path}/{FOLDER}/run_id={self.run_id}/writer_id={self.writer_id}/span={self.first}-{self.last}-of-{self.buckets}"

    def inside(self, other: "Span") -> bool:
        return self[:2] == other[:2] and other.first <= self.first and self.last <= other.last


def _all_spans(spark: SparkSession, path: str, of: str = "run_id=*/writer_id=*") -> list[Span]:
    found = storage.glob(spark, f"{path}/{FOLDER}/{of}/span=*/_SUCCESS")
    return [Span(m[1], m[2], *map(int, m.groups()[2:])) for m in map(SPAN.search, found)]


def spans(spark: SparkSession, path: str) -> list[Span]:
    """The complete spans that no other span holds."""
    found = _all_spans(spark, path)
    return [s for s in found if not any(s[:4] != o[:4] and s.inside(o) for o in found)]


def _bucket(buckets: int):
    return F.xxhash64("record_id").bitwiseAND(F.lit(buckets - 1))


def _write(rows: DataFrame, path: str, run_id: str, writer_id: str, first: int, last: int, n: int) -> None:
    """A span of n rows, a file per bucket. A failed call that was made again counts by its later success."""
    buckets = 1 << max(0, math.ceil(math.log2(max(n, 1) / BUCKET_ROWS)))
    one = rows.groupBy("record_id", "model_name").agg(F.max("status").alias("status"))  # ok comes after error
    one.withColumn("bucket", _bucket(buckets)).repartition(min(buckets, 200), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
        Span(run_id, writer_id, first, last, buckets).folder(path))


def _keys(spark: SparkSession, path: str, run_id: str, writer_id: str, batch_ids: list[int]) -> DataFrame:
    """The keys of batches, from the log."""
    folders = [f for b in batch_ids for f in storage.glob(spark, f"{path}/model_name=*/run_seq=*/run_id={run_id}/writer_id={writer_id}/batch_id={b}")]
    schema = f"{SCHEMA}, run_seq long, run_id string, writer_id string, batch_id long"
    return spark.read.option("basePath", path).schema(schema).parquet(*folders).select("record_id", "model_name", "status").filter("record_id <> ''")


def add(spark: SparkSession, path: str, run_id: str, writer_id: str, batch_id: int) -> None:
    """Enters a batch that is in the log, and merges the writer's spans where FANOUT are of like length."""
    if not storage.glob(spark, f"{path}/model_name=*/run_seq=*/run_id={run_id}/writer_id={writer_id}/batch_id={batch_id}"):
        return  # a batch without rows
    keys = _keys(spark, path, run_id, writer_id, [batch_id])
    _write(keys, path, run_id, writer_id, batch_id, batch_id, keys.count())
    _merge(spark, path, run_id, writer_id)


def _merge(spark: SparkSession, path: str, run_id: str, writer_id: str) -> None:
    while True:
        held = _all_spans(spark, path, f"run_id={run_id}/writer_id={writer_id}")
        own = sorted((s for s in held if not any(s[:4] != o[:4] and s.inside(o) for o in held)), key=lambda s: s.first)
        levels: dict[int, list[Span]] = {}
        for span in own:
            levels.setdefault(int(math.log(span.last - span.first + 1, FANOUT) + 1e-9), []).append(span)
        full = next((part for _, part in sorted(levels.items()) if len(part) >= FANOUT), None)
        if full is None:
            return
        for span in set(held) - set(own):  # held by spans that were complete before this merge
            storage.delete(spark, span.folder(path))
        rows = _read(spark, path, [s.folder(path) for s in full])
        _write(rows, path, run_id, writer_id, full[0].first, full[-1].last, rows.count())


def catch_up(spark: SparkSession, path: str) -> None:
    """Enters what the log holds and no span does, such as a batch whose writer stopped between log and span.

    It lists a folder per batch, so a stream does this when it starts, not for every batch.
    """
    known = _all_spans(spark, path)
    missing: dict[tuple[str, str], set[int]] = {}
    for folder in storage.glob(spark, f"{path}/model_name=*/run_seq=*/run_id=*/writer_id=*/batch_id=*"):
        run_id, writer_id, batch = BATCHES.search(folder).groups()
        one = Span(run_id, writer_id, int(batch), int(batch), 1)
        if not any(one.inside(s) for s in known):
            missing.setdefault((run_id, writer_id), set()).add(int(batch))
    for (run_id, writer_id), batches in missing.items():
        ordered = sorted(batches)
        starts = [b for b in ordered if b - 1 not in batches]
        for first, after in zip(starts, [*starts[1:], ordered[-1] + 1]):
            part = [b for b in ordered if first <= b < after]
            keys = _keys(spark, path, run_id, writer_id, part)
            _write(keys, path, run_id, writer_id, part[0], part[-1], keys.count())


def _read(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.option("basePath", f"{path}/{FOLDER}").schema(SCHEMA).parquet(*folders).select("record_id", "model_name", "status")


def lookup(ids: DataFrame, path: str, leave: tuple[str, str, int] | None = None) -> DataFrame:
    """record_id, model_name and status of the calls in the log, for all rows of ids at least (their column record_id).

    Files of other ids' buckets are not opened. `leave` names a batch (run, writer, number) that is about to be repeated:
    its own span does not count. Where a merge has taken that span in, the batch was complete in the log, and its calls count.
    The numbers of the buckets, MOST_LISTED at most, pass through the driver.
    """
    spark = ids.sparkSession
    found = [s for s in spans(spark, path) if leave is None or s[:4] != (leave[0], leave[1], leave[2], leave[2])]
    most = max((s.buckets for s in found), default=1)
    wanted = range(most)
    if 1 < most:
        listed = [r[0] for r in ids.select(_bucket(most)).distinct().limit(MOST_LISTED + 1).collect()]
        wanted = listed if len(listed) <= MOST_LISTED else wanted
    folders = []
    for span in found:
        whole, root = len(wanted) >= span.buckets, span.folder(path)
        own = [root] if whole else [f"{root}/bucket={b}" for b in sorted({w & (span.buckets - 1) for w in wanted})]
        folders += own if whole else [f for f in own if storage.exists(spark, f)]
    return _read(spark, path, folders)
