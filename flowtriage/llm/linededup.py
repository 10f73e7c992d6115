"""Line dedup with levelled sorted runs of line hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowtriage.llm.common import LOWER, STRIPPED, UPPER, Plain, store

HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key_hash(line: Column, least: int) -> Column:
    """128 bits of the key of a line; null for keys that are too short to count."""
    key = F.btrim(line, F.lit(STRIPPED))
    lowered = F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))
    # The seed of a hash with two arguments is the hash of the first, so the halves do not depend on each other.
    return F.when(
        F.char_length(key) >= least, F.struct(F.xxhash64(lowered).alias("h1"), F.xxhash64(F.lit(7), lowered).alias("h2")))


class LineRuns:
    """Line hashes seen so far, as sorted runs in the shared folder.

    A run has a row per key: h1, h2, the documents `n` of its batches that hold the key, and `holder`, the id that keeps
    the line, set in the run of the batch that saw the key first. Each level holds fewer than `fanout` runs; when it is
    full, its runs are merged into one run of the next level, so a key is rewritten once per level and a batch meets
    few runs. A run is written once and never changed; a reader meets whole runs only.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.levels = spark, fanout, []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """One row per key. `holder` is set in one run only, so any aggregate that skips nulls finds it."""
        return reduce(DataFrame.unionByName, runs).groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("holder").alias("holder"))

    def add(self, keys: DataFrame) -> None:
        """Adds a batch: keys has h1, h2 and id, one row per document and key. Keys of no run get a holder, the largest id."""
        batch = store(
            keys.groupBy(*HASH).agg(F.count("*").alias("n"), F.max("id").alias("holder")).sortWithinPartitions(*HASH), "batch"
        )
        fresh = reduce(lambda left, run: left.join(run, HASH, "left_anti"), self.runs(), batch)
        if self.runs():
            known = reduce(DataFrame.unionByName, [run.select(*HASH) for run in self.runs()]).distinct()
            seen = batch.join(known, HASH, "left_semi").withColumn("holder", F.lit(None).cast(batch.schema["holder"].dataType))
            run = store(fresh.unionByName(seen).repartition(*HASH).sortWithinPartitions(*HASH), "run")
        else:
            run = batch
        self._put(0, run)

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, store(self.merged(runs).sortWithinPartitions(*HASH), "run"))

    def table(self) -> DataFrame:
        """One row per key over all runs."""
        return self.merged(self.runs())


def _batches(rows: DataFrame, key: str, n: int) -> list[DataFrame]:
    """The rows in n batches of about the same size, larger ids first, null ids in the last."""
    if n < 2:
        return [rows]
    cuts = rows.select(F.percentile_approx(key, [i / n for i in range(1, n)])).first()[0]
    cuts = sorted(set(cuts or []), reverse=True)
    column, parts, above = F.col(key), [], None
    for cut in cuts:
        parts.append(rows.filter(column > cut if above is None else (column > cut) & (column <= above)))
        above = cut
    last = F.lit(True) if above is None else column.isNull() | (column <= above)
    return [*parts, rows.filter(last)]


def drop_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3,
    batches: int = 4, fanout: int = 2,
) -> DataFrame:
    """All rows with the lines that many documents share taken out, `n_lines` (before) and `n_dropped`.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of `least_chars` code
    points or more that `least_docs` rows hold lose all their lines except in the largest id that holds them. Batches
    of documents go by falling id, so the first batch with a key has its keeper: it is set where the batch's keys
    anti-join the runs, and later batches only add to the count. Keys are compared by 128 bits of hash.

    A null or empty text has one empty line. A row is a document: repeated rows count each, and all rows with the
    largest id keep the line. Null ids are smaller than all others. An empty table gives an empty result. Columns of
    the input whose name a result takes are replaced.
    """
    plain = Plain(docs)
    key, text = plain[id_col], plain[text_col]
    hashes = F.transform(lines_of(F.col(text)), lambda line: _key_hash(line, least_chars))
    runs = LineRuns(docs.sparkSession, fanout)
    for batch in _batches(plain.df, key, batches):
        runs.add(batch.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.array_compact(hashes))).alias("_h")).select("id", "_h.*"))
    common = store(runs.table().filter(F.col("n") >= least_docs), "common_lines")
    # Rows are told apart by id and text; rows alike in both lose the same lines.
    row = {"_id": F.col(key), "_text": F.xxhash64(F.coalesce(F.col(text), F.lit("")))}
    hits = (
        plain.df.withColumns(row).select(*row, F.posexplode(hashes).alias("_pos", "_h"))
        .filter("_h is not null").select(*row, "_pos", "_h.*")
        .join(common, HASH).filter(~F.col("_id").eqNullSafe(F.col("holder")))
        .groupBy(*row).agg(F.array_sort(F.collect_set("_pos")).alias("_hits"))
        .select(F.col("_id").alias("_hit_id"), F.col("_text").alias("_hit_text"), "_hits")
    )
    lines = F.col("_lines")
    # The lines between hits, in slices: work in proportion to the lines, however many are dropped.
    edges = F.concat(F.array(F.lit(-1)), F.col("_hits"), F.array(F.size(lines)))
    between = F.flatten(F.transform(
        F.sequence(F.lit(1), F.size("_hits") + 1),
        lambda i: F.slice(lines, F.element_at(F.col("_edges"), i) + 2, F.element_at(F.col("_edges"), i + 1) - F.element_at(F.col("_edges"), i) - 1),
    ))
    joined = (
        plain.df.withColumns(row)
        .join(hits, F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.col("_text") == F.col("_hit_text")), "left")
        .withColumn("_lines", lines_of(F.col(text))).withColumn("_edges", edges)
    )
    kept = F.when(F.col("_hits").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(between, "\n"))
    return plain.restore(joined, **{
        text_col: kept, "n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size("_hits"), F.lit(0)).cast("long")})
