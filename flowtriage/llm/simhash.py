"""SimHash near-duplicates by a generalised pigeonhole search."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from flowtriage.llm.common import Plain, bound_batches, store
from flowtriage.llm.components import components
from flowtriage.session import released

BITS, MOST_BITS, SHINGLE, SEED = 64, 2, 3, 42
#: Buckets up to this size, for two bits, are compared pair by pair; fingerprints of larger ones are linked over their neighbours.
PAIRED_BUCKET = 64
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits that over half the shingle hashes set, as a signed 64-bit integer; zero without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and the six ASCII white space characters
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        part = words[at : at + HASHES_AT_ONCE + shingle - 1]
        parts = zip(*[part[i:] for i in range(shingle)]) if len(words) >= shingle else [words]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in parts], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(shingle: int):
    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return fingerprints


# ---------------------------------------------------------------- the plan of the search


def _bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bit i and bit j, over all of them (2,080 sums reach the driver)."""
    upper = np.triu_indices(BITS)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            raw = np.ascontiguousarray(batch["fp"].to_numpy("<i8")).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            rows += len(batch)
        if rows:
            yield pd.DataFrame({"i": upper[0], "j": upper[1], "n": both[upper], "rows": rows})

    found = prints.mapInPandas(counted, "i int, j int, n double, rows long").groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum("rows").alias("rows")).collect()
    both = np.zeros((BITS, BITS))
    for row in found:
        both[row["i"], row["j"]] = both[row["j"], row["i"]] = row["n"]
    return (found[0]["rows"] if found else 0), both


def correlated_groups(rows: int, both: np.ndarray, n: int) -> list[list[int]]:
    """Bits in n groups of like size, each grown from its first free bit by the strongest mean correlation."""
    p = np.diag(both) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(both / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, groups = list(range(BITS)), []
    for left in range(n, 0, -1):
        group = [free.pop(0)]
        while len(group) < -(-(len(free) + len(group)) // left):
            best = max(free, key=lambda b: (related[b, group].mean(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _mask(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def paired_bucket(most: int) -> int:
    """Up to which size buckets are compared pair by pair (64 for two bits, 4,096 for four): a fingerprint has 65 or 2,081
    neighbours to be linked over otherwise, each a row, which costs far more than a comparison."""
    return PAIRED_BUCKET * (most // 2) ** 6


def _bucket_sizes(prints: DataFrame, groups: list[list[int]]) -> dict[int, list[tuple[float, float]]]:
    """For each group of bits the fingerprints by the size of the bucket of those equal in it: mean size and number, per
    power of two; a few dozen numbers for each group reach the driver."""
    keyed = prints.select(F.explode(F.array(*[
        F.struct(F.lit(g).alias("g"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("key")) for g, bits in enumerate(groups)])).alias("s"))
    sizes = keyed.groupBy("s.g", "s.key").agg(F.count("*").cast("double").alias("n"))
    found = sizes.groupBy("g", F.floor(F.log2("n")).alias("power")).agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    result: dict[int, list[tuple[float, float]]] = {}
    for row in found.collect():
        result.setdefault(row["g"], []).append((row["squares"] / row["rows"], row["rows"]))
    return result


#: What it costs to compare two fingerprints of a bucket, in rows that are made, shuffled, sorted and joined.
COMPARED = 0.05


def _cost(rows: int, sizes: list[tuple[float, float]], chance: np.ndarray, t: int, most: int = MOST_BITS) -> float:
    """Estimated cost, in rows, of one group at threshold t: signatures, candidates, neighbours of crowded buckets; -1 leaves it out.

    chance: how likely two fingerprints differ in each bit. Pairs that differ in s bits of a group are estimated from
    those that are equal in it, by the odds of a difference in each bit; buckets grow likewise.
    """
    if t < 0:
        return 0.0
    odds, sums = chance / np.maximum(1 - chance, 1e-9), np.zeros(t + 1)
    sums[0] = 1.0
    for o in odds:
        sums[1:] += sums[:-1].copy() * o
    growth, paired = sums.sum(), paired_bucket(most)
    pairs = sum(r * (n - 1) / 2 for n, r in sizes if n * growth <= paired)
    pairs = max(pairs, rows * min(rows * np.prod(1 - chance), paired) / 2) * growth
    crowded = sum(r for n, r in sizes if n * growth > paired)
    around = sum(comb(BITS, i) for i in range(most // 2 + 1))
    return rows * sum(comb(len(chance), s) for s in range(t + 1)) + COMPARED * pairs + around * crowded


def thresholds(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The cheapest threshold per group that sum to total, by dynamic programming over the groups."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for spent, (price, chosen) in best.items():
            for t, c in cost.items():
                if spent + t not in nxt or price + c < nxt[spent + t][0]:
                    nxt[spent + t] = (price + c, [*chosen, t])
        best = nxt
    return best[total]


def search_plan(prints: DataFrame, most: int = MOST_BITS) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds, for the number of groups with the least estimated cost.

    By the general pigeonhole principle, fingerprints that differ in `most` bits or fewer are within the threshold of
    some group if the thresholds of m groups sum to most - m + 1.
    """
    rows, both = _bit_counts(prints)
    p = np.diag(both) / max(rows, 1)
    chance = 2 * p * (1 - p)
    choices = [correlated_groups(rows, both, m) for m in range(1, most + 2)]
    sizes = _bucket_sizes(prints, [g for groups in choices for g in groups])
    plans, at = [], 0
    for groups in choices:
        costs = [
            {t: _cost(rows, sizes.get(at + i, []), chance[bits], t, most) for t in range(-1, most + 1)} for i, bits in enumerate(groups)]
        at += len(groups)
        price, chosen = thresholds(costs, most - len(groups) + 1)
        plans.append((price, len(groups), list(zip(groups, chosen))))
    return min(plans, key=lambda plan: (plan[0], -plan[1]))[2]  # of equals, as without rows, the most groups


# ---------------------------------------------------------------- the search


def _links(prints: DataFrame, most: int) -> DataFrame:
    """Links u, v of distinct fingerprints: enough to join all that differ in `most` bits or fewer, an even number."""
    if most < 2 or most % 2:
        raise ValueError(f"an even number of bits, not {most}")
    signatures, plan = [], search_plan(prints, most)
    for g, (bits, t) in enumerate(plan):
        value = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        for s in range(t + 1):
            for flips in combinations(bits, s):
                signatures.append(F.struct(
                    F.lit(g).alias("g"), value.bitwiseXOR(F.lit(_mask(flips))).alias("key"), F.lit(s > 0).alias("probe")))
    keyed = prints.select("fp", F.explode(F.array(*signatures)).alias("s")).select("fp", "s.*")
    sizes = keyed.groupBy("g", "key").agg(F.count("*").alias("n"), F.min("probe").alias("_probes")).filter("n > 1 and not _probes")
    shared = store(keyed.join(sizes.drop("_probes"), ["g", "key"]), "shared_signatures")

    small = shared.filter(F.col("n") <= paired_bucket(most))
    left = small.select("g", "key", F.col("fp").alias("u"), F.col("probe").alias("_probe"))
    right = small.select("g", "key", F.col("fp").alias("v"), "probe")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most
    # a pair counts in the first group that it is near enough in
    apart = F.col("u").bitwiseXOR(F.col("v"))
    first = F.lit(True)
    for g, (bits, t) in enumerate(plan):
        first = first & ((F.col("g") <= g) | (F.bit_count(apart.bitwiseAND(F.lit(_mask(bits)))) > t))
    pairs = left.join(right, ["g", "key"]).filter((F.col("u") < F.col("v")) & ~(F.col("_probe") & F.col("probe")) & near & first).select("u", "v")

    # Two fingerprints differ in `most` bits or fewer just if some value is within half as many bits of both. No more
    # distinct fingerprints are that near to a value than values to a fingerprint (65 for one bit, 2,081 for two), so
    # the group of a value is small, however large the bucket that its fingerprints came from.
    crowded = shared.filter(F.col("n") > paired_bucket(most)).select("fp").distinct()
    flips = [_mask(f) for n in range(most // 2 + 1) for f in combinations(range(BITS), n)]
    around = F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: F.col("fp").bitwiseXOR(f))
    meeting = crowded.select("fp", F.explode(around).alias("value")).groupBy("value").agg(F.collect_set("fp").alias("near"))
    stars = meeting.filter(F.size("near") > 1).select(F.array_min("near").alias("u"), F.explode("near").alias("v")).filter("u <> v")
    return pairs.unionByName(stars)


def _rooted(prints: DataFrame, most: int) -> DataFrame:
    """Each distinct fingerprint with the least one that it reaches."""
    linked = components(_links(prints.select("fp"), most)).withColumnRenamed("node", "fp")
    return prints.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


@released
def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most: int = MOST_BITS
) -> DataFrame:
    """A row per document: its id, `fingerprint` (16 hex digits) and `component_id`, the least id that links reach.

    Words are lower-cased (A-Z) and taken in shingles; fingerprints that differ in `most` bits or fewer (an even number)
    are linked. A null or blank text has fingerprint zero, which links like any other. Null ids come after all others: a
    component of null ids only has a null `component_id`. Repeated rows are rows of the same component. An empty table
    gives an empty result. Links are between distinct fingerprints, so copies add no pairs.
    """
    plain = Plain(bound_batches(docs))
    key = plain[id_col]
    rows = plain.df.withColumn("_fp", _fingerprints(shingle)(F.col(plain[text_col])))
    marked = store(rows.select(F.col(key).alias("id"), F.col("_fp").alias("fp")), "fingerprints")
    prints = store(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct_fingerprints")
    rooted = store(_rooted(prints, most), "rooted_fingerprints")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component"))
    found = rooted.join(ids, "root").select(F.col("fp").alias("_print"), "component")
    joined = marked.join(found, marked["fp"] == found["_print"])
    return joined.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


@released
def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most: int = MOST_BITS
) -> DataFrame:
    """One row of each component of `near_groups`, that of the least id, with the columns it came with.

    Null ids come after all others. Of rows with that id the one whose text has the least hash stays, and one of repeated
    rows; a null text is a blank one. An empty table gives an empty result.
    """
    plain = Plain(bound_batches(docs))
    key, text = F.col(plain[id_col]), F.coalesce(F.col(plain[text_col]), F.lit(""))
    marked = plain.df.select(key.alias("id"), F.xxhash64(text).alias("text"), _fingerprints(shingle)(F.col(plain[text_col])).alias("fp"))
    marked = store(marked, "fingerprints")
    # of a fingerprint only its first row can stay, however many have it
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text"))
    prints = store(marked.groupBy("fp").agg(first.alias("one")), "first_rows")
    kept = store(_rooted(prints, most).groupBy("root").agg(F.min("one").alias("one")).select("one.id", "one.text"), "kept_rows")
    several = marked.groupBy("id", "text").agg(F.count("*").alias("n")).filter("n > 1")
    same = lambda table: F.col("id").eqNullSafe(table["_id"]) & (F.col("text") == table["_text"])
    renamed = several.select(F.col("id").alias("_id"), F.col("text").alias("_text"))
    repeated = store(kept.join(renamed, same(renamed), "left_semi"), "repeated_rows")
    rows = plain.df.withColumns({"_id": key, "_text": F.xxhash64(text)})
    if repeated.isEmpty():
        return plain.restore(rows.join(kept, same(rows), "left_semi"))
    once = kept.join(repeated.select(F.col("id").alias("_id"), F.col("text").alias("_text")), F.col("id").eqNullSafe(F.col("_id")) & (F.col("text") == F.col("_text")), "left_anti")
    one = rows.join(repeated, same(rows), "left_semi").dropDuplicates(["_id", "_text"])
    return plain.restore(rows.join(once, same(rows), "left_semi").unionByName(one))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
