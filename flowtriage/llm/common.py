"""What the operators of this folder share: words, column names, stored tables."""

from __future__ import annotations

import pickle
import sys
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowtriage.session import stored

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
STRIPPED = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of rows that a Python worker gets at a time; a longer row goes alone.
BATCH_BYTES = 2 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """Bounds by bytes what Python workers of the session get at once: 10,000 rows, the default, can be any amount of text."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    """The public tokenizer file that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


store = stored


class Shipped:
    """An object of bounded size that tasks get once, by broadcast.

    It goes as bytes with its classes inside, as executors may not have this package: a broadcast of the object itself
    names its classes only.
    """

    def __init__(self, spark: SparkSession, value: Any):
        self.data, self.known = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self) -> dict[str, Any]:
        return {"data": self.data, "known": None}

    @property
    def value(self) -> Any:
        if self.known is None:
            self.known = pickle.loads(self.data.value)
        return self.known


class Plain:
    """A table under names of its own (c0, c1, ...), so that no column can clash with an operator's.

    The first column of a wanted name counts, whatever the case; `restore` gives the names back and
    replaces columns whose name a result takes.
    """

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> str:
        return f"c{[n.lower() for n in self.names].index(name.lower())}"

    def restore(self, df: DataFrame, **results: Column) -> DataFrame:
        taken = {name.lower() for name in results}
        kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(self.names) if n.lower() not in taken]
        return df.select(*kept, *[column.alias(name) for name, column in results.items()])


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; texts of ASCII alone take the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(id_column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def most_frequent(counts: DataFrame, n_col: str, limit: int) -> DataFrame:
    """The rows of the largest counts, `limit` at most; rows of one count stay or go together.

    The cut comes from the number of rows per count, exact up to 1,024 and in steps of a hundredth above, so the driver
    sees a few thousand numbers, and no task sorts all rows. Rows of the step that crosses the limit go.
    """
    n = F.col(n_col).cast("double")
    power = F.pow(F.lit(1.01), F.floor(F.log(n) / F.log(F.lit(1.01))))
    step = F.when(n <= 1024, n).otherwise(F.greatest(F.lit(1024.0), power))  # never falls as counts rise
    total, least = 0, float("inf")
    for row in sorted(counts.groupBy(step.alias("_step")).count().collect(), key=lambda r: -r["_step"]):
        total += row["count"]
        if total > limit:
            break
        least = row["_step"]
    return counts.filter(step >= F.lit(least))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
