"""Exact duplicates by sorting contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtriage.llm.common import Plain, partitions, store

#: Runs of white space that are not already one space.
UNEVEN_SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
LEAST_CHUNK = 64
SPLIT_CHARS = 32


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_SPACES, " ")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[Plain, DataFrame]:
    """The rows under plain names with _keep, _size, _kept and _sha."""
    plain = Plain(docs)
    key, text = plain[id_col], plain[text_col]
    rows = plain.df.withColumn("_norm", normalised(F.col(text))).withColumn("_sha", F.sha2("_norm", 256))
    chunk = max(LEAST_CHUNK, docs.count() // (8 * partitions(docs.sparkSession)))
    counts = rows.groupBy("_sha").agg(F.count("*").alias("_n"), F.min(key).alias("_least"))
    hot = store(counts.filter(F.col("_n") > chunk), "hot_texts")
    pieces = F.ceil(F.col("_n") / chunk)
    salted = (
        # The text is carried once: a second time only where normalising changed it.
        rows.withColumn("_same", F.col(text).eqNullSafe(F.col("_norm")))
        .withColumn(text, F.when(~F.col("_same"), F.col(text)))
        .join(F.broadcast(hot), "_sha", "left")
        .withColumn("_piece", F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(key), pieces)).cast("int"))
    )
    # Sampled keys pass through the driver: of a text they hold its start, and its digest for texts that start alike.
    names = ["_start", "_sha", "_piece"]
    ranged = salted.withColumn("_start", F.substring("_norm", 1, SPLIT_CHARS)).repartitionByRange(*names).sortWithinPartitions(*names, "_norm", F.col(key).asc_nulls_last())
    equal = Window.partitionBy(*names, "_norm")
    first = equal.orderBy(F.col(key).asc_nulls_last())
    cold = F.col("_n").isNull()
    # A hot text with null ids only has no least id: its first row stays (the hash of a null is its seed, 42).
    least = F.when(F.col("_least").isNull(), F.col("_piece") == F.pmod(F.lit(42), pieces)).otherwise(
        F.coalesce(F.col(key) == F.col("_least"), F.lit(False)))
    found = (
        ranged.withColumn("_rank", F.row_number().over(first))
        .withColumn("_first", F.first(key).over(first))
        .withColumn("_count", F.count(F.lit(1)).over(equal))
        .withColumn("_keep", F.when(cold, F.col("_first")).otherwise(F.col("_least")))
        .withColumn("_size", F.coalesce("_n", "_count"))
        .withColumn("_kept", (F.col("_rank") == 1) & (cold | least))
        .withColumn(text, F.when(F.col("_same"), F.col("_norm")).otherwise(F.col(text)))
    )
    return plain, found


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows, with `keep_id`, `group_size`, `kept` and `text_sha256` of their group of equal texts.

    Sampled splitters deal the normalised texts out by range of their start and digest, each task sorts its range, and
    rows next to each other are compared in full; the smallest id of equal texts stays. A text with more copies than an eighth of a
    mean partition is cut into pieces by the hash of the id, and its least id and size come from counts by digest,
    which are summed before they are shuffled. There are at most eight such texts per partition, so they are broadcast.

    Null texts equal empty ones. Null ids come after all others; a group of null ids only has a null `keep_id`.
    Of repeated rows (same id, equal text) exactly one is kept. An empty table gives an empty result. Columns of the
    input whose name a result takes are replaced.
    """
    plain, found = _grouped(docs, id_col, text_col)
    return plain.restore(
        found, keep_id=F.col("_keep"), group_size=F.col("_size"), kept=F.col("_kept"), text_sha256=F.col("_sha"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that `exact_groups` keeps, with the columns they came with."""
    plain, found = _grouped(docs, id_col, text_col)
    return plain.restore(found.filter("_kept"))
