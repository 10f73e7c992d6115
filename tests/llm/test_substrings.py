"""Repeated passages, beside SQL and brute force."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from flowtriage.llm import queries, substrings
from flowtriage.llm.fmindex import FMIndex, WaveletTree

WORDS = [f"w{i}" for i in range(400)]


def brute_statistics(texts, query, most):
    return [max((l for l in range(most, 0, -1) if any(tuple(query[i : i + l]) == tuple(t[j : j + l]) and i + l <= len(query)
                                                      for t in texts for j in range(len(t) - l + 1))), default=0) for i in range(len(query))]


def test_wavelet_tree_counts():
    values = np.random.default_rng(1).integers(0, 11, 300)
    tree = WaveletTree(values, 11)
    value, start = np.arange(11).repeat(30), np.tile(np.arange(0, 300, 10), 11)
    low, high = tree.rank(value, start, start + 7)
    assert low.tolist() == [(values[:s] == v).sum() for v, s in zip(value, start)]
    assert high.tolist() == [(values[: s + 7] == v).sum() for v, s in zip(value, start)]


@pytest.mark.parametrize("most", [1, 3, 5])
def test_matching_statistics_equal_brute_force(most):
    rng = np.random.default_rng(most)
    texts = [rng.integers(0, 4, rng.integers(1, 30)) for _ in range(8)] + [np.zeros(20, np.int64)]
    queries_ = [rng.integers(0, 5, rng.integers(1, 40)) for _ in range(12)] + [np.zeros(25, np.int64)]
    index = FMIndex(np.concatenate(texts), np.array([len(t) for t in texts]), most)
    found, where = index.matching_statistics(np.concatenate(queries_), np.array([len(q) for q in queries_]))
    assert found.tolist() == [n for q in queries_ for n in brute_statistics(texts, q, most)]
    flat = np.concatenate([np.append(t, -1) for t in texts])
    asked = np.concatenate([np.append(q, [-2] * most) for q in queries_])
    place = np.concatenate([np.arange(len(q)) + sum(len(p) + most for p in queries_[:i]) for i, q in enumerate(queries_)])
    for n, s, at in zip(found, where, place):
        assert n == 0 or flat[index.suffix[s] : index.suffix[s] + n].tolist() == asked[at : at + n].tolist()


def against_sql(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    expected = sorted(connection.sql(queries.SUBSTRING_SQL).select(*columns).fetchall(), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in queries.op12_substring_dedup(spark, folder).collect()), key=repr)
    assert got == expected
    return got


def made_texts():
    rng = np.random.default_rng(8)
    own = lambda n: " ".join(rng.choice(WORDS, n))
    passage, long = own(60), own(14)
    texts = [(i, f"{own(rng.integers(0, 30))}\n {passage}  {own(rng.integers(0, 30))}") for i in range(40)]
    texts += [(100 + i, f"{own(9)} {long}") for i in range(6)] + [(200, passage[: len(passage) // 2]), (201, passage.upper())]
    texts += [(300, "a " * 500), (301, "a " * 40 + "b " * 12), (302, "b " * 12), (303, "b " * 13), (304, "b " * 13)]
    texts += [(400, None), (401, ""), (402, " \t\n"), (None, f"{own(5)} {passage}"), (None, passage), (403, texts[0][1]), (403, texts[0][1]),
              (403, own(50)), (500, own(3) + "é" * 30 + " x " * 3), (600, " ".join([own(40)] * 3))]
    return texts


@pytest.mark.parametrize("hot", [1024, 2])
def test_odd_rows(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_PIECES", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 500)
    rows = [(i, t, 1, "x") for i, t in made_texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, starts string")
    got = against_sql(spark, docs, str(tmp_path / "sf"))
    assert sum(r[2] >= 60 for r in got) >= 39
    assert substrings.drop_repeats(docs).columns == ["doc_id", "starts", "text", "n_words", "n_removed"]


def test_empty_table(spark):
    assert substrings.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
