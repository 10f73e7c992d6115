"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowtriage.llm.common import SPACES, STRIPPED, Plain, partitions, store

WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2.0, "mix-1"


def n_words(text: Column) -> Column:
    """Words of a text; a null or blank text has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(STRIPPED))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACES))).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place in code point order, null last: ranges, then the rows before each range."""
    ranged = store(
        sources.repartitionByRange(partitions(sources.sparkSession), F.col("source").asc_nulls_last())
        .withColumn("_range", F.spark_partition_id()),
        "source_ranges",
    )
    before = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))  # a row per range
    before = before.withColumn("_before", F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last()))
    return ranged.join(before, "_range").select("source", "source_size", (F.col("_before") + within - 1).alias("rank"))


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """`source`, `source_size` and `target` (words) of each source; docs has `source` and `size`.

    The weights repeat over the sources in code point order, null last. All targets together are `share` times all
    words; a target stops at `most` times its source's words and the rest is shared out again by weight. Each round
    raises one level (words per weight) from two sums over the sources, until no more of them stop; only these sums
    reach the driver.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = store(
        _ranked(sizes).select("source", "source_size", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight")),
        "sources",
    )
    stop = F.col("source_size") * F.lit(most)
    level, stopped = 0.0, -1
    while True:
        full = stop < F.col("weight") * F.lit(level)
        row = weighed.agg(
            F.sum("source_size").alias("words"), F.sum(F.when(full, F.col("source_size"))).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count(F.when(full, 1)).alias("stopped"),
        ).first()
        if row["stopped"] == stopped or not row["weight"]:
            break
        stopped = row["stopped"]
        level = (share * (row["words"] or 0) - most * (row["full"] or 0)) / row["weight"]
    return weighed.select("source", "source_size", F.least(stop, F.col("weight") * F.lit(level)).alias("target"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, **shares) -> tuple[Plain, DataFrame]:
    plain = Plain(docs)
    text = F.col(plain[text_col])
    rows = plain.df.withColumn("_size", n_words(text))
    targets = source_targets(rows.select(F.col(plain[source_col]).alias("source"), F.col("_size").alias("size")), **shares)
    targets = targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_all"), F.col("target").alias("_target"))
    joined = rows.join(targets, F.col(plain[source_col]).eqNullSafe(F.col("_source")), "left")
    rate = F.when(F.col("_all") > 0, F.col("_target") / F.col("_all")).otherwise(0.0)
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(plain[id_col]).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))
    # 52 bits of the digest, as a fraction of one.
    drawn = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    copies = F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)
    return plain, joined.withColumn("_copies", copies.cast("int"))


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **shares
) -> DataFrame:
    """All rows, with `size`, `source_size`, `target` and `copies`, how often the mix takes the row.

    A row is taken floor(rate) times, and once more if the hash of seed, id and text falls under the rest of the rate
    (target by words of the source), so a rerun takes the same copies. Repeated rows draw alike. Null texts have no words,
    null sources are a source, null ids hash as an empty text. A source without words has target and rate zero.
    The table of sources is joined as its stored size allows. Columns of the input whose name a result takes are replaced.
    """
    plain, planned = _planned(docs, id_col, text_col, source_col, seed, **shares)
    return plain.restore(
        planned, size=F.col("_size"), source_size=F.col("_all"), target=F.col("_target"), copies=F.col("_copies"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **shares
) -> DataFrame:
    """The mixed rows, each as often as `mix_plan` says, with the columns they came with."""
    plain, planned = _planned(docs, id_col, text_col, source_col, seed, **shares)
    repeated = planned.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies"))))
    return plain.restore(repeated)
