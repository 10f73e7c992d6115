"""Shared folders of the running session, and how long the tables in them live."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from flowtriage.sources import storage

#: Shuffle files of an execution that has ended are of no use to the next, which reads the stored table.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local session may fall back to a folder of its own machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="flowtriage-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """The folders made while a `scratch` block was the innermost one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        """Hands the tables that a result still reads on to the block outside this one, or to the session."""
        read = "\n".join(df.inputFiles())
        kept = [f for f in self.folders if f.rpartition("/")[2] in read]
        self.folders = [f for f in self.folders if f not in kept]
        if _blocks.get():
            _blocks.get()[-1].folders += kept
        return df

    def release(self) -> None:
        for folder in self.folders:
            storage.delete(self.spark, folder)
        self.folders = []


_blocks: ContextVar[tuple[Scratch, ...]] = ContextVar("scratch blocks", default=())


@contextmanager
def scratch(spark: SparkSession, result: Callable[[], DataFrame] | None = None) -> Iterator[Scratch]:
    """Folders that the block makes below the shared folder are deleted when it ends, also when it fails.

    Those that the table `result()` still reads, asked when the block has ended well, go on to the block outside.
    """
    block = Scratch(spark)
    token = _blocks.set((*_blocks.get(), block))
    try:
        yield block
    except BaseException:
        _blocks.reset(token)
        block.release()
        raise
    _blocks.reset(token)
    if result is not None:
        block.keep(result())
    block.release()


def released(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Deletes the intermediate tables of a function of tables once its result, a table, no longer reads them."""

    @functools.wraps(function)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        found: list[DataFrame] = []
        with scratch(df.sparkSession, lambda: found[0]):
            found.append(function(df, *args, **options))
        return found[0]

    return run


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for intermediate tables; it goes with the innermost `scratch` block."""
    folder = f"{shared_dir(spark)}/flowtriage/{uuid.uuid4().hex}"
    if _blocks.get():
        _blocks.get()[-1].folders.append(folder)
    return f"{folder}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Computes a table once and reads it back from the shared folder.

    The rows survive the loss of executors, the planner knows the size of the table, and the shuffle files that it took
    are gone when it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_SHUFFLES) if before is None else spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Computes the rows once and keeps them where a lost executor cannot take them along."""
    return stored(df, "rows")
