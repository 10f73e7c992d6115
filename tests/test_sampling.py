from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from flowtriage import fixtures
from flowtriage.operators import ranking, rules, running, sampling
from flowtriage.schema import FLOW_COLUMNS


@pytest.fixture(scope="module")
def suspects(spark):
    return rules.suspects(fixtures.flows(spark, "/root/testdata/sf0.01")).cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def seeded(row, seed=42):
    return hashlib.md5("|".join([str(seed), *["NULL" if row[c] is None else row[c] for c in FLOW_COLUMNS]]).encode()).hexdigest()


def brute_force(rows, targets):
    picked = []
    for label, n in targets.items():
        stratum = sorted((r for r in rows if r.label == label), key=seeded)
        picked += stratum if n is None else stratum[:n]
    return sorted((tuple(r) for r in picked), key=repr)


def test_sample_is_the_lowest_hashes_under_any_partitioning(suspects):
    expected = brute_force(suspects.collect(), sampling.TARGETS)
    assert len(expected) == 4994
    for parts in (1, 4, 16):
        assert rows_of(sampling.stratified_sample(suspects.repartition(parts))) == expected


def test_other_targets_and_seeds(suspects):
    targets = {"background": 7, "blacklist": 10**6, "anomaly-spam": 1, "no such label": 5}
    assert rows_of(sampling.stratified_sample(suspects, targets)) == brute_force(suspects.collect(), targets)
    other = sampling.stratified_sample(suspects, targets, seed=43)
    assert rows_of(other) != rows_of(sampling.stratified_sample(suspects, targets))


def test_known_pool_gives_the_same_sample(suspects):
    pool = {r.label: r["count"] for r in suspects.groupBy("label").count().collect()}
    expected = rows_of(sampling.stratified_sample(suspects))
    assert rows_of(sampling.draw_sample(suspects, pool)) == expected


def test_a_cut_that_is_too_tight_is_noticed(suspects):
    pool = {r.label: r["count"] for r in suspects.groupBy("label").count().collect()}
    piled = suspects.filter("label = 'background'").limit(1).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(200_000))))
    many = suspects.unionByName(piled.drop("i"))
    pool["background"] += 200_000
    targets = {"background": 4700, "blacklist": 290}
    assert sampling.likely_cuts(pool, targets)["background"].startswith("0")
    expected = rows_of(sampling.stratified_sample(many, targets))
    assert len(expected) == 4990
    assert rows_of(sampling.draw_sample(many, pool, targets)) == expected


def test_copies_of_a_row_count_as_rows(spark, suspects):
    """One row holding most of the table: it may fill the sample, up to its number of copies."""
    first = sorted(suspects.collect(), key=seeded)[0]
    copies = spark.createDataFrame([first], suspects.schema).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(49))))
    many = suspects.unionByName(copies.drop("i"))
    expected = sorted(many.collect(), key=seeded)[:60]
    assert rows_of(sampling.random_sample(many, 60)) == sorted((tuple(r) for r in expected), key=repr)
    assert sum(r == first for r in sampling.random_sample(many, 40).collect()) == 40


def test_whole_strata_come_along_in_the_same_pass(suspects):
    targets = {"background": 100, "blacklist": None, "anomaly-sshscan": None}
    assert rows_of(sampling.stratified_sample(suspects, targets)) == brute_force(suspects.collect(), targets)
    assert rows_of(sampling.stratified_sample(suspects, {"blacklist": None})) == brute_force(suspects.collect(), {"blacklist": None})


def test_the_bound_leaves_few_rows_and_is_a_plain_filter(suspects):
    hashes = sorted(seeded(r) for r in suspects.collect())
    hashed = suspects.selectExpr("'all' AS _stratum", "*").withColumn("_hash", sampling.row_hash(42))
    for n in (10, 1000, 3000):
        cut = sampling._exact_cuts(hashed, {"all": n})["all"]
        assert n <= sum(h < cut for h in hashes) <= 1.2 * n + 10
    assert sampling._exact_cuts(hashed, {"all": len(hashes) + 1}) == {}
    plan = sampling.stratified_sample(suspects, {"background": 100}, cuts={"background": "08"})._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "BroadcastHint" not in plan


def test_rank_is_the_same_for_any_ranges(suspects, monkeypatch):
    found = sampling.with_record_id(suspects)
    monkeypatch.setattr(ranking, "RANGE_ROWS", 500)
    near, far = ranking.global_rank(found, rows=1), ranking.global_rank(found)
    assert far.rdd.getNumPartitions() > near.rdd.getNumPartitions() == 1
    assert rows_of(near.select("record_id", "sample_rank")) == rows_of(far.select("record_id", "sample_rank"))
    ranks = far.orderBy("sample_rank").collect()
    assert [r.sample_rank for r in ranks] == list(range(1, len(ranks) + 1))
    assert [(r.timestamp, r.record_id) for r in ranks] == sorted((r.timestamp, r.record_id) for r in ranks)


def test_rank_splits_equal_rows(spark, monkeypatch):
    """A third of the rows are equal: they spread over partitions and still get ranks of their own."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("timestamp"),
        F.when(F.col("id") % 3 == 0, "same").otherwise("r").alias("record_id"),
    )
    monkeypatch.setattr(ranking, "RANGE_ROWS", 200)
    ranked = ranking.global_rank(df)
    assert [r[0] for r in ranked.select("sample_rank").orderBy("sample_rank").collect()] == list(range(1, 3001))


def test_prefixes_are_nested(suspects):
    ranked = ranking.global_rank(sampling.with_record_id(sampling.stratified_sample(suspects)), rows=5000)
    ids = {k: {r.record_id for r in sampling.nested_prefix(ranked, k).collect()} for k in (1000, 3000, 5000)}
    assert ids[1000] < ids[3000] < ids[5000] and [len(ids[k]) for k in ids] == [1000, 3000, 4994]


def test_record_id(spark, suspects):
    row = sampling.with_record_id(suspects).first()
    parts = [row[c] for c in ("timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "duration",
                              "total_pkts", "total_bytes")]
    text = "|".join("NULL" if p is None else p for p in parts)
    assert row.record_id == hashlib.sha256(text.encode()).hexdigest()


def test_seeded_order_is_by_hash(suspects):
    few = suspects.filter("label = 'blacklist'")
    assert [seeded(r) for r in sampling.seeded_order(few).collect()] == sorted(seeded(r) for r in few.collect())


def test_running_totals(spark):
    df = spark.range(1000).selectExpr("id % 2 AS g", "id", "floor(id / 50) AS b", "id * 3 AS v")
    total = {0: 0, 1: 0}
    for r in sorted(running.running_totals(df, ["g"], "b", ["id"], ["v"]).collect(), key=lambda r: r.id):
        total[r.g] += r.id * 3
        assert r.v == total[r.g]
