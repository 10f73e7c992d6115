"""Sources of a language against each other, beside the SQL of the query."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from flowtriage.llm import divergence, queries

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def against_sql(spark, docs, tmp_path):
    folder = str(tmp_path / "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    expected = sorted(connection.sql(queries.DIVERGENCE_SQL).select(*COLUMNS).fetchall())
    got = sorted(tuple(r[c] for c in COLUMNS) for r in queries.op13_source_divergence(spark, folder).collect())
    assert got == expected
    return got


def rows():
    common = "the The quick brown fox état ÀB naïve"
    made = [(i, f"{common} w{i % 7}x " * (1 + i % 5) + "lone" * (i == 3), "en", f"s{i % 5}", i, "k") for i in range(60)]
    made += [(100 + i, "der die das " * (i % 3), "de", "s1" if i % 2 else None, i, "k") for i in range(24)]
    made += [(None, None, "fr", "s0", None, None), (None, None, "fr", "s0", None, None), (201, "", "fr", "s9", 1, "k"), (202, "un deux", None, None, 1, "k")]
    return made


@pytest.mark.parametrize("block", [128, 2])
def test_odd_rows_and_blocks_of_sources(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", block)
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, value long, rank string")
    got = against_sql(spark, docs, tmp_path)
    assert {r[4] for r in got if r[0] == "fr"} == {0}  # keeps no term
    assert ("de", "", "pair", "s1") in {r[:4] for r in got}


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_terms_are_split_by_bytes():
    terms, sizes = divergence.terms_of(pa.array(["A-bÉc d1e", None, "", "\x00x\x7f", "日本 ü"]))
    assert terms.to_pylist() == ["a", "bÉc", "d", "e", "x", "日本", "ü"] and sizes.tolist() == [4, 0, 0, 1, 2]


def test_joint_sums_equal_a_loop_over_terms():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (5, 64)) * (rng.random((5, 64)) < 0.6)
    mask = int(sum(1 << t for t in range(64) if t % 9))
    counts[:, [t for t in range(64) if t % 9 == 0]] = 0
    share = lambda s, c: 1 + 10**9 * (c + 2) // (s + 200)
    levels = [(s, share(s, c), sum(1 << t for t in np.flatnonzero(counts[s] == c))) for s in range(5) for c in range(1, 4) if (counts[s] == c).any()]
    source, p, bits = (np.array(x) for x in zip(*levels))
    side = (source, p, bits.astype(np.uint64))
    zeros = np.array([share(s, 0) for s in range(5)])
    got = divergence.joint_sums(side, side, (5, 5), (zeros, zeros), mask)
    for a in range(5):
        for b in range(5):
            f = [(share(a, int(counts[a, t])), share(b, int(counts[b, t]))) for t in range(64) if t % 9]
            assert got[a, b] == sum((x - y) ** 2 // (x + y) for x, y in f)
