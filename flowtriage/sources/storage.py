"""Paths on whatever file system the session writes to."""

from __future__ import annotations

import contextlib
import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).exists(_path(spark, path))


def delete(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).delete(_path(spark, path), True)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    found = _file_system(spark, pattern).globStatus(_path(spark, pattern))
    return [status.getPath().toString() for status in found] if found else []


def move(spark: SparkSession, source: str, target: str) -> None:
    if not _file_system(spark, source).rename(_path(spark, source), _path(spark, target)):
        raise OSError(f"could not move {source} to {target}")


def _local(system, spark: SparkSession, path: str) -> str | None:
    """The path for Python, where a local file system's Hadoop client takes two steps for what must be one."""
    return system.makeQualified(_path(spark, path)).toUri().getPath() if system.getScheme() == "file" else None


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Moves a file to where another may be, in one step: whoever reads the target finds the old file or the new one."""
    system = _file_system(spark, target)
    there = _local(system, spark, target)
    if there is not None:
        folder, name = os.path.split(there)
        with contextlib.suppress(FileNotFoundError):
            os.unlink(f"{folder}/.{name}.crc")  # the old file's, which readers need not have
        os.replace(_local(system, spark, source), there)
        return
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), system.getConf())
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context.rename(system.makeQualified(_path(spark, source)), system.makeQualified(_path(spark, target)), options)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file that must not exist yet: of all who try, one succeeds."""
    system = _file_system(spark, path)
    local = _local(system, spark, path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "x", encoding="utf-8") as file:
                file.write(text)
        except FileExistsError:
            return False
        return True
    try:
        stream = system.create(_path(spark, path), False)
    except Py4JJavaError as refused:
        if "AlreadyExists" not in refused.java_exception.getClass().getName():
            raise
        return False
    stream.write(bytearray(text.encode()))
    stream.close()
    return True
