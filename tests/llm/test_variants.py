"""Words one edit apart, beside brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowtriage.llm import queries, variants
from flowtriage.llm.kdtree import KdTree

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]
LOWERED = {i: i + 32 for i in range(65, 91)}


def counted(docs, slip=31):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(counts):
    """By the words that each word becomes by one edit: those with one letter less meet in a table."""
    gaps, near = {}, {w: set() for w in counts}
    for w in counts:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            gaps.setdefault((i, shorter), set()).add(w)
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(rows, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_tables_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(queries.op11_spelling_variants(spark, sf_dir)) == brute(counted(docs))


@pytest.mark.parametrize("cell", [1 << 12, 16])
def test_random_words_in_many_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(variants, "LEAST_CELL_WORDS", cell)
    monkeypatch.setattr(variants, "CELL_WORDS", 4 * cell)
    monkeypatch.setattr(variants, "LEAF_WORDS", 8)
    rng, words = np.random.default_rng(5), {}
    alphabet = list("abéÿo")
    while len(words) < 1500:
        words["".join(rng.choice(alphabet, rng.integers(7, 10)))] = int(rng.integers(2, 2000))
    words |= {"x" * 300 + "y" * i: 5 * 20**i for i in range(3)}
    made = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(variants.variants(made)) == brute(words)


def test_odd_rows(spark):
    docs = [
        (1, None, "n"), (2, "", "n"), (None, "straße straße straße", "n"), (3, "Übermut übermut ÜBERMUT Übermut", "n"),
        (4, "wondering " * 60 + "wonderng wonderng", "n"), (4, "wondering " * 60, "n"), (5, "wondeng wondeng a-b-c-defghij", None),
        (6, "q" * 40_000 + " " + "q" * 40_000, "n")]
    made = spark.createDataFrame(docs, "doc_id long, text string, n string")
    counts = variants.word_counts(made, slip=31)
    assert {r["word"]: r["n"] for r in counts.collect()} == counted([d[:2] for d in docs])
    assert rows_of(variants.variants(counts)) == brute(counted([d[:2] for d in docs]))
    assert {r["word"]: r["n"] for r in variants.word_counts(made).collect()} == counted([d[:2] for d in docs], 1 << 40)
    empty = spark.createDataFrame([], "doc_id long, text string, n string")
    assert variants.variants(variants.word_counts(empty)).count() == 0


def test_tree_finds_all_points_in_reach():
    rng = np.random.default_rng(2)
    points, asked = rng.integers(0, 4, (400, 6)), rng.integers(0, 5, (50, 6))
    for tight in (True, False):
        tree, seen = KdTree(points, 10, tight), set()
        for who, (begin, end, _) in tree.near(asked, np.full(50, 2)):
            seen |= {(int(q), int(p)) for q in who for p in tree.order[begin:end]}
        close = np.argwhere(np.abs(asked[:, None] - points[None]).sum(axis=2) <= 2)
        assert {tuple(map(int, x)) for x in close} <= seen and len(seen) < 50 * 400
