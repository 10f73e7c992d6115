"""Samples that depend on the rows alone.

A sample of n rows is the n rows with the smallest seeded hash. Sorting all
candidates, or keeping n per map task, would send far too much to one reducer.
Instead, a bound on the hash cuts the candidates down first. It comes from the
size of the pool; where that leaves too few rows, from counts per stratum and
hash prefix (a few thousand counts however large the table). About 1.1 n rows
pass and are moved once, to bring equal rows together. Counts per block of
hashes tell in which block the n-th row lies: only there rows are put in order.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from flowtriage.functions.identity import record_id, row_hash
from flowtriage.schema import FLOW_COLUMNS
from flowtriage.session import materialise

# Strata with their sizes (None takes all), seed and nested prefixes.
TARGETS = {"background": 4700, "blacklist": 290, "anomaly-sshscan": None}
SEED = 42
PREFIXES = {"sample_1000": 1000, "sample_3000": 3000, "sample_5000": 5000}

# Digits that a bound on the hash has, a bound above all hashes, and the digits after a bound's zeros that make a block.
CUT_DIGITS, NO_CUT, BLOCK_DIGITS = 12, "g", 3


def stratum_filter(df: DataFrame, strata: list[str], column: str = "label") -> DataFrame:
    """All strata in one pass over the table."""
    return df.filter(F.col(column).isin(list(strata)))


def _exact_cuts(hashed: DataFrame, targets: dict[str, int]) -> dict[str, str]:
    """The least hash prefix of each stratum up to which the target is there; one row per stratum reaches the driver.

    A prefix is the zeros a hash begins with and two more digits, so the last one adds a sixteenth at most.
    """
    upto = "sum(_n) OVER (PARTITION BY _stratum ORDER BY _prefix)"
    found = (
        hashed.filter(F.col("_stratum").isin(list(targets)))
        .selectExpr("_stratum", "substring(_hash, 1, length(_hash) - length(ltrim('0', _hash)) + 2) AS _prefix")
        .groupBy("_stratum", "_prefix").agg(F.count("*").alias("_n"))
        .selectExpr("_stratum", f"if({upto} >= {_per_stratum(targets)}, _prefix, NULL) AS _prefix")
        .groupBy("_stratum").agg(F.min("_prefix").alias("cut"))
    )
    # no hash continues with a digit above f
    return {r._stratum: r.cut + "g" for r in found.collect() if r.cut is not None}


def likely_cuts(pool: dict[str, int], targets: dict[str, int | None]) -> dict[str, str]:
    """Bounds per stratum from known pool sizes, with a wide margin above the wanted share.

    Not certain to leave enough rows, so whoever uses them has to count the sample.
    """
    cuts = {}
    for stratum, target in targets.items():
        wanted = math.inf if target is None else target + 10 * math.sqrt(target) + 50
        if wanted < pool.get(stratum, 0):
            cuts[stratum] = f"{wanted_share(wanted, pool[stratum]):0{CUT_DIGITS}x}"
    return cuts


def wanted_share(wanted: float, pool: int) -> int:
    """wanted / pool of all hashes, in units of the last digit of a bound."""
    return math.ceil(wanted / pool * 16**CUT_DIGITS)


def _per_stratum(values: dict[str, int | str], default: str = "NULL") -> str:
    """SQL for the value of the row's stratum."""
    cases = " ".join(
        f"WHEN {_quoted(stratum)} THEN {_quoted(value) if isinstance(value, str) else value}" for stratum, value in values.items())
    return f"CASE _stratum {cases} ELSE {default} END" if values else default


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _survivors(hashed: DataFrame, columns: list[str], limited: dict[str, int], cuts: dict[str, str]) -> tuple[DataFrame, dict]:
    """The rows below their bound with _copies and _block, stored, and the rows per limited stratum and block.

    Copies of a row share its hash and may be very many: they are counted instead of moved. At most 4096 counts per
    stratum reach the driver.
    """
    zeros = {stratum: len(cut) - len(cut.lstrip("0")) for stratum, cut in cuts.items()}
    block = f"CAST(conv(substring(_hash, 1 + {_per_stratum(zeros, '0')}, {BLOCK_DIGITS}), 16, 10) AS INT) AS _block"
    kept = materialise(
        hashed.filter(f"_hash < {_per_stratum(cuts, _quoted(NO_CUT))}")
        .groupBy(*columns, "_hash").agg(F.count("*").alias("_copies")).selectExpr("*", block))
    counts: dict[str, dict[int, int]] = {s: {} for s in limited}
    if limited:
        found = kept.filter(F.col("_stratum").isin(list(limited))).groupBy("_stratum", "_block").agg(F.sum("_copies").alias("n"))
        for row in found.collect():
            counts[row["_stratum"]][row["_block"]] = row["n"]
    return kept, counts


def _lowest_hashes(
    pool: DataFrame, targets: dict[str, int | None], seed: int, cuts: dict[str, str] | None = None
) -> DataFrame:
    """Exactly targets[s] rows per value s of _stratum (all, where there are fewer or the target is None)."""
    columns = pool.columns
    hash_columns = [c for c in columns if c in FLOW_COLUMNS] or columns
    hashed = pool.withColumn("_hash", row_hash(seed, hash_columns))
    limited = {s: n for s, n in targets.items() if n is not None}
    if cuts is None:
        sizes = {r["_stratum"]: r["count"] for r in pool.groupBy("_stratum").count().collect()}  # a row per stratum
        cuts = likely_cuts(sizes, limited)
    kept, counts = _survivors(hashed, columns, limited, cuts)
    if any(s in cuts and sum(counts[s].values()) < n for s, n in limited.items()):
        kept, counts = _survivors(hashed, columns, limited, _exact_cuts(hashed, limited))

    # the block that holds the n-th row of a stratum, and how many of its rows the sample takes
    edge, rest = {}, {}
    for stratum, n in limited.items():
        for block, size in sorted(counts[stratum].items()):
            if size > n:
                edge[stratum], rest[stratum] = block, n
                break
            n -= size
    whole = kept.filter(f"_block < {_per_stratum(edge, str(16**BLOCK_DIGITS))}").withColumn("_take", F.col("_copies"))
    parts = whole
    if edge:
        upto = "sum(_copies) OVER (PARTITION BY _stratum ORDER BY _hash ROWS UNBOUNDED PRECEDING)"
        cut = kept.filter(f"_block = {_per_stratum(edge)}").withColumn(
            "_take", F.expr(f"least(_copies, {_per_stratum(rest)} - ({upto} - _copies))"))
        parts = whole.unionByName(cut.filter("_take > 0"))
    return parts.withColumn("_copy", F.expr("explode(sequence(1L, _take))")).select(*[c for c in columns if c != "_stratum"])


def take_all(df: DataFrame, strata: list[str], column: str = "label") -> DataFrame:
    return stratum_filter(df, strata, column)


def union_strata(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def stratified_sample(
    df: DataFrame,
    targets: dict[str, int | None] = TARGETS,
    seed: int = SEED,
    column: str = "label",
    cuts: dict[str, str] | None = None,
) -> DataFrame:
    """The rows with the smallest hashes of each stratum; a target of None takes the whole stratum.

    Bounds that are not given come from the sizes of the strata, counted first. The rows that pass are stored at once;
    should they be too few, which only piles of equal rows can bring about, counts per hash give exact bounds.
    """
    pool = stratum_filter(df, list(targets), column).withColumn("_stratum", F.col(column))
    return _lowest_hashes(pool, targets, seed, cuts)


def random_sample(df: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """n rows regardless of their label."""
    return _lowest_hashes(df.withColumn("_stratum", F.lit("all")), {"all": n}, seed)


def seeded_order(df: DataFrame, seed: int = SEED) -> DataFrame:
    """A reproducible shuffle of all rows, as a range-partitioned sort."""
    return df.withColumn("_hash", row_hash(seed)).orderBy("_hash").drop("_hash")


def draw_sample(
    suspects: DataFrame,
    pool: dict[str, int],
    targets: dict[str, int | None] = TARGETS,
    seed: int = SEED,
    column: str = "label",
) -> DataFrame:
    """stratified_sample in a single scan, for known pool sizes."""
    return stratified_sample(suspects, targets, seed, column, likely_cuts(pool, targets))


def with_record_id(df: DataFrame) -> DataFrame:
    return df.withColumn("record_id", record_id())


def distinct_ids(df: DataFrame) -> DataFrame:
    return df.select("record_id").distinct()


def nested_prefix(sample: DataFrame, k: int) -> DataFrame:
    return sample.filter(F.col("sample_rank") <= k)


def limit_records(sample: DataFrame, n: int | None) -> DataFrame:
    """The first n records in rank order."""
    return sample if n is None else sample.orderBy("sample_rank").limit(n)
