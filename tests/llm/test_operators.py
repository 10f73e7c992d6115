"""Edge rows and brute-force results of the training data operators."""

from __future__ import annotations

import itertools
import math
import os
import re
import string
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from flowtriage.llm import bpe, decisionlist, exactdedup, hmm, langid, linecrf, linededup, mixing, queries, simhash, urlfilter
from flowtriage.llm.common import most_frequent, tokenizer_path
from flowtriage.llm.components import components
from flowtriage.session import scratch, shared_dir

LOWERED = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# doc_id, text, lang, source, n_chars and columns that clash with names the operators use.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _size long, kept string, c0 string"
COMMON = "a line that many of the documents share"
ROWS = [
    (1, None, None, None, None, None, None, None, None),
    (None, "no id, but\ta text of its own", "en", "a", 1, "x", 1, "k", "c"),
    (2, "", "en", "a", 0, "x", 1, "k", "c"),
    (3, "  same  text\n\nhere ", "en", "b", 1, "x", 1, "k", "c"),
    (4, " same text here ", "de", "b", 1, "x", 1, "k", "c"),
    (4, " same text here ", "de", "b", 1, "x", 1, "k", "c"),
    (5, "word " * 30_000, "en", "a", 1, None, 1, "k", "c"),
    (6, f"first own line of six\n{COMMON}\n  {COMMON.upper()}  ", "fr", None, 1, "x", None, "k", None),
    (7, f"{COMMON}\nÉtat ÀÉ own line of seven", "fr", "c", 1, "x", 1, None, "c"),
    (8, f"\n{COMMON} \n\nshort\nshort", None, "c", 1, "x", 1, "k", "c"),
    (9, "12 345 !! 67", "en", "ü", 1, "x", 1, "k", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (3, 1), (6, 1), (None, 1), (9, None), (77, 0)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    return connection


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


def held(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def ascii_words(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(text or "")]


def key(row):
    return repr(row)


# ---------------------------------------------------------------- queries with SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    result = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(result.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in result.collect()), key=key)
    expected = duck.sql(queries.ORACLES[name])
    order = [expected.columns.index(c) for c in columns]
    assert rows == sorted((tuple(row[i] for i in order) for row in expected.fetchall()), key=key)


def test_sql_agrees_on_odd_rows(spark, odd, tmp_path):
    folder = str(tmp_path / "sf")
    odd.select("doc_id", "text", "lang", "source").write.parquet(f"{folder}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    for name, sql in queries.ORACLES.items():
        result = queries.QUERIES[name](spark, folder)
        rows = sorted((tuple(r) for r in result.collect()), key=key)
        assert rows == sorted((tuple(r) for r in connection.sql(sql).select(*result.columns).fetchall()), key=key), name


# ---------------------------------------------------------------- native operators


def test_exact_groups(odd, empty):
    rows = exactdedup.exact_groups(odd).collect()
    same = [r for r in rows if r["doc_id"] in (3, 4)]
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in same) == [(3, 3, 3, True), (4, 3, 3, False), (4, 3, 3, False)]
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in rows if not r["text"]} == {(1, 1, True), (2, 1, False)}
    assert {r["_size"] for r in rows} == {1, None}
    assert exactdedup.exact_groups(empty).count() == 0
    left = exactdedup.drop_exact_copies(odd)
    assert left.columns == odd.columns and left.count() == len(ROWS) - 3


def test_exact_groups_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "LEAST_CHUNK", 2)
    docs = spark.createDataFrame(
        [(i, "hot  text") for i in range(300, 0, -1)] + [(None, "null ids")] * 40 + [(500, "lone")] * 2, "doc_id long, text string")
    rows = exactdedup.exact_groups(docs).collect()
    assert {(r["keep_id"], r["group_size"]) for r in rows if r["text"] == "hot  text"} == {(1, 300)}
    assert sorted((r["doc_id"], r["text"]) for r in rows if r["kept"] and r["doc_id"]) == [(1, "hot  text"), (500, "lone")]
    assert sum(r["kept"] for r in rows if r["text"] == "null ids") == 1


def test_line_runs_compact_and_agree(spark, odd, empty):
    expected = None
    for batches, fanout in ((1, 2), (3, 2), (5, 3)):
        found = sorted((tuple(r) for r in linededup.drop_common_lines(odd, batches=batches, fanout=fanout).select(
            "doc_id", "text", "n_lines", "n_dropped", "kept").collect()), key=key)
        assert expected in (None, found)
        expected = found
    by_id = {r[0]: r for r in found}
    assert by_id[6][1:4] == ("first own line of six", 3, 2)
    assert by_id[8][1:4] == (f"\n{COMMON} \n\nshort\nshort", 5, 0)  # the largest id keeps the line
    assert linededup.drop_common_lines(empty).count() == 0
    runs = linededup.LineRuns(spark, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(7, 7, 100 - i), (i, i, 100 - i)], "h1 long, h2 long, id long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(r["h1"], r["n"], r["holder"]) for r in runs.table().collect()} == {(7, 5, 100), (0, 1, 100), (1, 1, 99), (2, 1, 98), (3, 1, 97), (4, 1, 96)}


def test_mix_reaches_targets(spark, odd, empty):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 4}") for i in range(6000)], "doc_id long, text string, source string")
    rows = mixing.mix_plan(docs).toPandas()
    sums = rows.assign(taken=rows["size"] * rows["copies"]).groupby("source").agg({"taken": "sum", "target": "first", "source_size": "first"})
    assert (abs(sums["taken"] - sums["target"]) <= 0.05 * sums["target"]).all()
    assert abs(sums["target"].sum() - 1.5 * sums["source_size"].sum()) < 1e-6 * sums["target"].sum()
    assert (sums["target"] <= 2 * sums["source_size"] + 1e-9).all() and rows["copies"].max() <= 2
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == rows["copies"].sum()
    plan = mixing.mix_plan(odd)
    assert plan.count() == len(ROWS) and plan.filter("source is null").first()["source_size"] > 0
    assert mixing.mix(empty).count() == 0 and mixing.mix_plan(empty).count() == 0


def test_most_frequent_is_bounded(spark):
    counts = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate([9, 9, 5, 5, 5, 1, 100_000])], "word string, n long")
    assert sorted(r["n"] for r in most_frequent(counts, "n", 3).collect()) == [9, 9, 100_000]
    assert most_frequent(counts, "n", 5).count() == 3 and most_frequent(counts, "n", 6).count() == 6


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (3, 2)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert roots == {i: 0 for i in range(41)} | {i: 1000 for i in range(1000, 1100)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- fingerprints


def brute_print(text, k=3):
    words = ascii_words(text)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most=2):
    parent = {i: i for i in prints}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= most:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("bucket", [64, 1])
def test_near_groups_equal_brute_force(spark, sf_dir, texts, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", bucket)
    prints = {i: brute_print(t) for i, t in texts.items()}
    roots = brute_components(prints)
    found = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op2_simhash(spark, sf_dir).collect()}
    assert found == {(i, f"{prints[i]:016x}", roots[i]) for i in texts}


@pytest.mark.parametrize("most, bucket", [(2, 64), (2, 1), (4, 64), (4, 1)])
def test_links_within_some_bits(spark, monkeypatch, most, bucket):
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", bucket)
    rnd = np.random.default_rng(5)
    centers = rnd.integers(0, 1 << 63, 12)
    prints = {int(c) for c in centers}
    for c in centers:
        for _ in range(25):
            bits = rnd.choice(63, rnd.integers(1, 3 + most), replace=False)
            prints.add(int(c) ^ sum(1 << int(b) for b in bits))
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = brute_components({p: p for p in prints}, most)
    plan = [(list(range(0, 20)), most - 1), (list(range(20, 64)), 0)]
    for chosen in (None, plan):
        if chosen:
            monkeypatch.setattr(simhash, "search_plan", lambda *_: chosen)
        found = {r["node"]: r["root"] for r in components(simhash._links(table, most)).collect()}
        assert {p: found.get(p, p) for p in prints} == roots
    with pytest.raises(ValueError):
        simhash._links(table, 3)


def test_thresholds_sum_and_are_cheapest():
    costs = [{-1: 0.0, 0: 5.0, 1: 9.0, 2: 50.0}, {-1: 0.0, 0: 1.0, 1: 90.0, 2: 99.0}]
    assert simhash.thresholds(costs, 1) == (10.0, [1, 0])


def test_near_copies_of_odd_rows(spark, odd, empty):
    rnd = np.random.default_rng(3)
    base = [f"w{rnd.integers(4000)}" for _ in range(2000)]
    docs = [(2, " ".join(["new", *base[1:]])), (1, " ".join(base)), (None, " ".join(base)), (2, " ".join(["new", *base[1:]]))]
    docs += [(10 + i, " ".join(f"v{rnd.integers(4000)}" for _ in range(300))) for i in range(20)]
    docs += [(50, None), (50, " "), (50, ""), (51, " "), (None, ""), (60, "of two"), (60, "of two"), (60, "Of TWO")]
    for bits in (2, 4):
        left = simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string"), most=bits)
        assert sorted(r["doc_id"] for r in left.collect()) == [1, *range(10, 30), 50, 60]
    assert simhash.drop_near_copies(odd).columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in simhash.drop_near_copies(odd).collect()) == [0, 1, 3, 5, 6, 7, 8, 9]
    assert simhash.drop_near_copies(empty).count() == 0 and simhash.near_groups(empty).count() == 0
    assert simhash.near_groups(odd).count() == len(ROWS)


@pytest.mark.parametrize("bucket", [64, 1])
def test_near_copies_of_the_tables_equal_brute_force(spark, texts, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", bucket)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    prints = {i: brute_print(t) for i, t in texts.items()}
    for bits in (2, corpus_pipeline.NEAR_BITS):
        kept = {i for i, root in brute_components(prints, bits).items() if i == root}
        assert {r["doc_id"] for r in simhash.drop_near_copies(docs, most=bits).collect()} == kept


# ---------------------------------------------------------------- learned models


def test_bpe_equals_the_library(spark, sf_dir, odd, empty, texts):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    theirs = Tokenizer.from_file(path)
    theirs.no_truncation()
    theirs.no_padding()
    ours, strings = bpe.WordBpe(open(path, encoding="utf-8").read()), None
    strings = bpe.vocabulary(open(path, encoding="utf-8").read())
    rnd = np.random.default_rng(1)
    pool = [*"abXY'sSt \n\t\x1c\x1f\x85\xa0éÉßΣσςİŉ日한٣²Ⅷ😀!?.,*_<|>09", "<|endoftext|>", "'ve", "I'll", "ΟΔΟΣ ", "A\u030a", "\x00"]
    samples = ["".join(rnd.choice(pool, rnd.integers(0, 40))) for _ in range(1500)] + [t for t in texts.values() if t] + ["", "a" * 20_000]
    for text, expected in zip(samples, theirs.encode_batch(samples, add_special_tokens=False)):
        ids = ours.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == expected.ids
        assert bpe.decoded_text(ids, strings) == theirs.decode(expected.ids, skip_special_tokens=False)
    assert bpe.encode(odd, path).filter("text is null").first()["ids"] == b""
    assert bpe.encode(empty, path).count() == 0
    assert queries.op4_bpe(spark, sf_dir).count() == len(texts)


def test_language_models_are_distributions_and_right(spark, sf_dir, duck, odd, empty):
    grams = langid.Grams()
    packed, _ = grams.of(["the cat and the hat", "das ist ein hund"])
    values, counts = np.unique(packed, return_counts=True)
    models = langid.CharModels({"x": (values, counts)})
    context = int(values[0]) >> 8
    every = (np.uint32(context << 8) + np.arange(256)).astype(np.uint32)
    assert abs((2.0 ** models.log_probabilities(every)).sum() - 1) < 1e-4
    rows = queries.op3_language_id(spark, sf_dir).collect()
    truth = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    tested = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in tested} == {i for i in truth if held(i, 3) == 1}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in tested) >= 0.95 * len(tested)
    assert all(0 <= r["score"] <= 1 for r in rows)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, langid.learn(odd)).collect()}
    assert found[1] == found[2] == found[9] == "und" and found[5] in ("en", "de", "fr")
    assert langid.identify(odd, langid.learn(empty)).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.identify(empty, langid.learn(empty)).count() == 0


def test_line_field_marginals_equal_brute_force():
    rnd = np.random.default_rng(2)
    sizes = np.array([3, 1, 4])
    unary, moves = rnd.random((8, 2)) + 0.1, rnd.random((2, 2)) + 0.1
    good, _ = linecrf.marginals(unary, sizes, moves)
    at = 0
    for n in sizes:
        total, ones = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=int(n)):
            weight = np.prod([unary[at + i, s] for i, s in enumerate(path)]) * np.prod([moves[a, b] for a, b in zip(path, path[1:])])
            total += weight
            ones += weight * np.array(path)
        assert np.allclose(good[at : at + n], ones / total)
        at += n


def test_line_field_on_held_out_documents(spark, odd, empty, labels):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op5_line_crf(spark, folder).collect()}
    truth = duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{folder}/labels.parquet')").fetchall()
    tested = [(rows[i]["predicted"], q) for i, q in truth if i in rows and rows[i]["held_out"]]
    assert sum(p == q for p, q in tested) >= 0.95 * len(tested)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (held(i, 5) == 0) for i, r in rows.items())
    field = linecrf.learned_field(odd, labels)
    scored = linecrf.quality(odd, field)
    assert scored.count() == len(ROWS) and scored.filter("score is null").count() == 0
    untaught = linecrf.learned_field(empty, labels)
    assert {r["score"] for r in linecrf.quality(odd, untaught).collect()} == {0.5}
    assert linecrf.quality(empty, field).count() == 0 and linecrf.keep_good(odd, untaught).columns == odd.columns


def test_line_field_learns_from_documents_of_any_length(spark, monkeypatch):
    good, bad = "a plain sentence of words that go on", "### $$$ !!! 000"
    docs = [(i, "\n".join([good if i % 2 else bad] * (300 + i))) for i in range(20)] + [(30, None), (31, "")]
    made = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(30, 1)], "doc_id long, quality int")
    field = linecrf.learned_field(made, marks)
    scores = {r["doc_id"]: r["score"] for r in linecrf.quality(made, field).collect()}
    assert all((scores[i] > 0.5) == bool(i % 2) for i in range(20))
    seen = []
    monkeypatch.setattr(linecrf, "fit", lambda chains, good: seen.append([len(c) for c in chains]))
    linecrf.learned_field(made, marks, most_lines=1000)
    linecrf.learned_field(made, marks, most_docs=5)
    assert 1000 <= sum(seen[0]) and sum(seen[0][:-1]) < 1000 and len(seen[1]) == 5


def test_hidden_markov_model(spark, sf_dir, texts, odd, empty):
    tokens = {i: [*[w.encode() for w in ascii_words(t)], b"\n"] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if held(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = queries.op6_hidden_markov(spark, sf_dir).collect()
    for r in rows:
        words = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in counts for w in words), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
    tested = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in tested) > sum(r["base_score"] for r in tested)
    scored = {r["doc_id"]: r for r in hmm.score(odd, hmm.learn(odd)).collect()}
    assert scored[1]["n_tokens"] == scored[2]["n_tokens"] == 1 and scored[5]["n_tokens"] == 30_001
    blank = hmm.learn(empty)
    assert {r["train_tokens"] for r in hmm.score(odd, blank).collect()} == {0}
    assert {r["n_known"] for r in hmm.score(odd, blank).collect()} == {0}
    assert hmm.score(empty, blank).count() == 0


def test_words_of_whole_columns():
    texts = [None, "", " \t\n", "A b\x0b\x0cC\r\nd ", "Ä\xa0É \x1c x", "one", "one two ONE"]
    words, sizes = hmm.words_of(pa.array(texts))
    expected = [[w.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)) for w in WORD.findall(t or "")] for t in texts]
    assert sizes.tolist() == [len(w) for w in expected] and words.to_pylist() == sum(expected, [])
    classes = hmm.Classes({"one": 2, "x": 1}, 7, np.ones(hmm.BUCKETS), 20, 9)
    ids, lengths, rare, which = classes.of(pa.array(texts))
    assert lengths.tolist() == [len(w) + 1 for w in expected] and (ids == 0).sum() == len(texts) and (ids == 1).sum() == 3
    assert [rare[i].as_py() for i in which] == [w for w in sum(expected, []) if w not in ("one", "x")]
    assert hmm.words_of(pa.array([], pa.string()))[1].tolist() == []


def test_forward_recursion_equals_all_paths():
    rnd = np.random.default_rng(4)
    start, moves, emissions = rnd.random(3), rnd.random((3, 3)), rnd.random((5, 3))
    model = hmm.Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emissions / emissions.sum(0))
    sizes, seq = np.array([2, 5, 1, 5]), rnd.integers(0, 5, 13)
    found, counts = model.log10_likelihood(seq, sizes), hmm.Counts(5, 3)
    model.expected(seq, sizes, counts)
    expected, at = np.zeros((5, 3)), 0
    for size, value in zip(sizes, found):
        part = seq[at : at + size]
        paths = {p: model.start[p[0]] * np.prod([model.moves[a, b] for a, b in zip(p, p[1:])]) * np.prod(model.emissions[part, p]) for p in itertools.product(range(3), repeat=int(size))}
        total = sum(paths.values())
        assert math.isclose(value, math.log10(total), rel_tol=1e-9)
        for path, weight in paths.items():
            for c, k in zip(part, path):
                expected[c, k] += weight / total
        at += size
    assert np.allclose(counts.emissions, expected) and math.isclose(counts.moves.sum(), (sizes - 1).sum()) and math.isclose(counts.start.sum(), 4)


def test_quality_counts_equal_brute_force(spark, sf_dir, texts, odd, empty, labels):
    for r in queries.op8_quality_rules(spark, sf_dir).collect():
        text = texts[r["doc_id"]] or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        expected = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        assert r["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and (not r["base_failed"] or not r["kept"])
    assert decisionlist.learned_rules(odd, labels) == [] == decisionlist.learned_rules(empty, labels)
    rows = {r["doc_id"]: r for r in decisionlist.judge(odd, [[("repeated_words", ">=", 0.5), ("words", ">=", 100.0)]]).collect()}
    assert rows[5]["n_repeat_words"] == 30_000 and not rows[5]["kept"] and rows[1]["n_words"] == 0 and rows[2]["base_failed"]
    assert decisionlist.judge(empty, []).count() == 0


def test_decision_list_finds_planted_rules():
    rnd = np.random.default_rng(6)
    x = {"a": rnd.random(3000), "b": rnd.random(3000), "c": rnd.random(3000)}
    bad = (x["a"] >= 0.8) & (x["b"] < 0.5) | (x["c"] >= 0.95)
    rules = decisionlist.learn(x, bad)
    found = np.any([decisionlist._holds(rule, x) for rule in rules], axis=0)
    assert (found == bad).mean() > 0.98


def test_url_filter(spark, sf_dir):
    urls = [
        (1, None), (2, "no scheme"), (3, "http://Sub.Example.NET/en/1?x=/de/#y"), (4, "https://net/"), (5, "https://notnet/"),
        (6, "http://a.net"), (7, "ftp://shop.example.com/de/x#/en/"), (8, "http://example.com/en/7"), (8, "http://example.com/en/7"),
        (9, "x://y.org/fr/z://w"), (10, "http://?q"),
    ]
    pages = spark.createDataFrame([(i, u, "<p>cheap pills and cheap bets</p>", "v") for i, u in urls], "page_id long, url string, html string, verdict string")
    rows = {r["page_id"]: r for r in urlfilter.judge(pages, queries.URL_RULES).collect()}
    assert {i: rows[i]["rule"] for i in rows} == {
        1: None, 2: None, 3: "example.net/en/", 4: "net/", 5: None, 6: None, 7: "example.com/de/", 8: None, 9: "org/fr/", 10: None}
    assert (rows[3]["host"], rows[3]["path"], rows[3]["verdict"]) == ("sub.example.net", "/en/1", "allow")
    assert (rows[6]["path"], rows[9]["host"], rows[9]["path"]) == ("", "y.org", "/fr/z://w") and rows[1]["host"] == rows[1]["path"] == ""
    assert all(r["verdict"] in ("allow", "block") for r in rows.values())
    segmenter = urlfilter.Segmenter({"cheap": 20, "pills": 10, "bets": 5, "che": 1})
    assert segmenter.tokens("cheappills.cheap-bets2", "/en/77.html") == ["cheap", "pills", "cheap", "bets", "#", "/en", "/#", "/html"]
    nothing = spark.createDataFrame([], pages.schema)
    assert urlfilter.judge(nothing, queries.URL_RULES).count() == 0
    assert urlfilter.judge(pages, []).filter("verdict = 'allow'").count() == len(urls)
    assert queries.op9_url_filter(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def brute_verdicts(pages, rules):
    """page_id, tokens and verdict, all by loops over dictionaries."""
    counts = Counter(w for _, _, html in pages for w in re.split(r"[\W\d_]+", re.sub("<[^>]*>", " ", html or "").lower()) if 0 < len(w) <= 24)
    segmenter, rows, n, seen = urlfilter.Segmenter(counts), [], Counter(), {"block": Counter(), "allow": Counter()}
    for page_id, url, _ in pages:
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].translate(LOWERED), found[2]) if found else ("", "")
        verdict = None
        for kind, rule in sorted(rules, key=lambda r: len(r[1])):
            domain, _, start = rule.partition("/")
            if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
                verdict = kind
        tokens = segmenter.tokens(host, path)
        rows.append((page_id, tokens, verdict))
        if verdict:
            n[verdict] += 1
            seen[verdict].update(tokens)
    size = len(set(seen["block"]) | set(seen["allow"])) + 1
    blocks, allows = (sum(seen[v].values()) + size for v in ("block", "allow"))

    def judged(tokens):
        odds = math.log((n["block"] + 1) / (n["allow"] + 1))
        odds += sum(math.log((seen["block"][t] + 1) / blocks) - math.log((seen["allow"][t] + 1) / allows) for t in tokens)
        return "block" if odds > 1e-7 else "allow"

    return sorted((i, t, v or judged(t)) for i, t, v in rows)


def test_url_verdicts_equal_brute_force(spark, sf_dir):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    pages += [(-1, "http://" + "cheappills" * 300 + ".net.com/x", None), (-2, "http://Straße12.example.com/de/ä_b", "<p>straße und äpfel</p>"),
              (-3, "x://a.b/c", None), (-3, "x://a.b/c", None), (-4, "http://unseen.org/fr", "one two"), (-5, None, None)]
    made = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = urlfilter.judge(made, queries.URL_RULES)
    expected = brute_verdicts(pages, queries.URL_RULES)
    assert sorted((r["page_id"], r["tokens"], r["verdict"]) for r in rows.collect()) == expected
    assert {v for *_, v in expected} == {"allow", "block"}


WORKER_SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {folder!r}).config("spark.sql.session.timeZone", "UTC").getOrCreate())
assert spark.range(1).select(F.udf(lambda x: __import__("importlib.util").util.find_spec("flowtriage") is None, "boolean")("id")).first()[0]
from flowtriage.llm import queries
for name in ("op3_language_id", "op6_hidden_markov", "op9_url_filter"):
    assert queries.QUERIES[name](spark, {sf!r}).count() > 0
print("done")
"""


def test_workers_need_no_package(sf_dir, tmp_path):
    """In a process of its own, whose Python workers cannot import what the driver can."""
    script = tmp_path / "run.py"
    script.write_text(WORKER_SCRIPT.format(repo=str(Path(__file__).resolve().parents[2]), folder=str(tmp_path / "shared"), sf=sf_dir))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.strip().endswith("done"), done.stderr[-3000:]


def test_rules_are_learned_from_few_labels(spark):
    """At both sizes there is a rule, and on labels it was not learned from the verdicts agree better than the base alone."""
    for size in ("sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
        labels = spark.read.parquet(f"/root/testdata/{size}/labels.parquet")
        half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
        rules = decisionlist.learned_rules(docs, labels.filter(half))
        judged = decisionlist.judge(docs, rules).join(labels.filter(~half), "doc_id").select("base_failed", "kept", "quality").collect()
        base = sum(r["base_failed"] == (r["quality"] == 0) for r in judged)
        assert rules and sum(r["kept"] == (r["quality"] == 1) for r in judged) > base


def test_every_language_is_learned_whatever_its_texts_hash_to(spark):
    made = spark.range(60).select(F.concat(F.lit("żółw pływa powoli w jeziorze "), "id").alias("text"))
    only = made.filter(F.pmod(F.xxhash64("text"), F.lit(10)) == 0).first()["text"]
    docs = [(f"the quick brown fox number {i} runs over the hill", "en") for i in range(30)] + [(only, "pl")] * 15
    docs = spark.createDataFrame(docs, "text string, lang string")
    identifier = langid.learn(docs)
    assert identifier.models.langs == ["en", "pl"]
    found = {(r["lang"], r["lang_pred"]) for r in langid.identify(docs, identifier).collect()}
    assert found == {("en", "en"), ("pl", "pl")}


def test_all_words_around_the_cut_are_counted(spark, monkeypatch):
    counts = spark.range(1017, 1031).select(F.col("id").alias("n"))
    for limit in range(1, 15):
        kept = sorted(r["n"] for r in most_frequent(counts, "n", limit).collect())
        assert kept == list(range(1031 - len(kept), 1031)) and len(kept) <= limit
    monkeypatch.setattr(hmm, "MOST_WORDS", 8)
    docs = spark.createDataFrame([(n, f"w{n} " * n) for n in range(1017, 1031)], "doc_id long, text string")
    language = hmm.learn(docs, rounds=0)
    assert len(language.classes.words) + language.words.count() == 14
    total = sum(range(1017, 1031)) + 14
    for r in hmm.score(docs, language).collect():
        n = r["doc_id"]
        assert r["n_known"] == n + 1 and r["train_tokens"] == total
        assert math.isclose(r["base_score"], n * math.log10((n + 1) / (total + 16)) + math.log10(15 / (total + 16)))


# ---------------------------------------------------------------- the pipeline


def test_pipeline_keeps_what_its_stages_keep(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "mix_sources", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, sf_dir).collect(), docs.schema)
        assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} <= before
        if name == "exact_dedup":  # brute force: the least id of each text
            least = {}
            for i in sorted(before):
                least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
            assert {r["doc_id"] for r in kept.collect()} == set(least.values())
        if name == "simhash_near_dedup":  # brute force: the least id of each component
            roots = brute_components({i: brute_print(texts[i]) for i in before}, corpus_pipeline.NEAR_BITS)
            assert {r["doc_id"] for r in kept.collect()} == {i for i, root in roots.items() if i == root}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in kept.collect())
    tokenizer = bpe.WordBpe(open(tokenizer_path(), encoding="utf-8").read())
    assert all(tokenizer.encode(texts[r["doc_id"]]) == r["ids"] and len(r["ids"]) == 4 * r["n_tokens"] for r in rows)


def test_pipeline_leaves_nothing_but_its_result(spark, sf_dir):
    def folders():
        return {p.name for p in Path(shared_dir(spark), "flowtriage").glob("*")}

    before = folders()
    with scratch(spark):
        rows = corpus_pipeline.run(spark, sf_dir)
        assert len(folders() - before) == len(corpus_pipeline.STAGES) - 1  # the stages, and none of what they stored
        assert rows.count() > 0
    assert folders() == before
