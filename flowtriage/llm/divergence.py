"""How far the sources of a language differ in the words they use, by count-level bitmaps."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtriage.llm.common import Plain, bound_batches, partitions, store
from flowtriage.llm.hmm import words_of
from flowtriage.session import released

LEAST_DOCS, TOP_TERMS, SCALE, PRIOR = 10, 10, 1_000_000_000, 2
#: Term ids of one bitmap.
WORD_BITS = 64
#: Bitmap words that go to one task together, and sources of a block; pairs of blocks are compared.
RANGE_WORDS, BLOCK_SOURCES = 16, 128
#: Occurrences that a task adds up before it hands them on.
HELD_TOKENS = 2_500_000
#: Term bytes stay (words_of lowers A-Z); all others part terms. Bytes above 0x7F belong to characters that are terms.
TERM_BYTES = np.array([b if b > 127 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms (ASCII letters, lower-cased, and all other letters and signs above U+007F) of texts, and how many each has."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return words_of(pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(TERM_BYTES[data])], offset=texts.offset))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per language, source and term of about HELD_TOKENS terms at a time."""
    held, tokens = [], 0

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return pa.RecordBatch.from_arrays(
            [table[c].combine_chunks().cast(t) for c, t in (("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n_sum", pa.int64()), ("docs_sum", pa.int64()))],
            names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        terms, sizes = terms_of(batch.column(2))
        coded = terms.dictionary_encode()
        width = max(len(coded.dictionary), 1)
        group = np.arange(len(sizes)).repeat(sizes) * width + coded.indices.to_numpy()
        cells, n = np.unique(group, return_counts=True)  # one cell for a document and a term
        doc = pa.array(cells // width)
        held.append(pa.RecordBatch.from_arrays(
            [batch.column(0).take(doc), batch.column(1).take(doc), coded.dictionary.take(pa.array(cells % width)).cast(pa.string()),
             pa.array(n, pa.int64()), pa.array(np.ones(len(n), np.int64))], names=["lang", "source", "term", "n", "docs"]))
        tokens += len(cells)
        if tokens >= HELD_TOKENS:
            yield flush()
            held, tokens = [], 0
    if tokens:
        yield flush()


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of positive whole numbers up to 10^9 + 1, exact in 64 bits."""
    return (p - q) ** 2 // (p + q)


def joint_sums(left: tuple, right: tuple, sizes: tuple[int, int], zeros: tuple[np.ndarray, np.ndarray], mask: int) -> np.ndarray:
    """For the sources of two blocks the sum of the divergence over the terms of one bitmap word.

    left and right: source, share p and bitmap of each (source, count) with a term in the word. zeros: the share of a count
    of zero per source. mask: the terms of the word. The terms that a source lacks are the complement of its bitmaps.
    AND and popcount give how many terms any two levels share; the divergence of their shares counts as often.
    """
    sides = []
    for (source, p, bits), size, zero in zip((left, right), sizes, zeros):
        seen = np.zeros(size, np.uint64)
        np.bitwise_or.at(seen, source, bits)
        lacks = ~seen & np.uint64(mask)
        absent = np.flatnonzero(lacks)
        sides.append((np.concatenate([source, absent]), np.concatenate([p, zero[absent]]), np.concatenate([bits, lacks[absent]])))
    (a, p, x), (b, q, y) = sides
    sums = np.zeros(sizes, np.int64)
    step = max(1, (1 << 21) // max(len(y), 1))
    for at in range(0, len(x), step):
        shared = np.bitwise_count(x[at : at + step, None] & y[None, :])
        i, j = np.nonzero(shared)
        np.add.at(sums, (a[at + i], b[j]), divergence(p[at + i], q[j]) * shared[i, j].astype(np.int64))
    return sums


def _runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The stretches of rows that are equal in the named columns, each with these values."""
    new = np.arange(len(batch)) == 0
    for name in names:
        codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(new)
    for start, end in zip(starts, [*starts[1:], len(batch)]):
        yield tuple(batch.column(n)[int(start)].as_py() for n in names), batch.slice(start, end - start)


def _range_sums(lang: str, block: int, other: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Sums per pair of sources over a range of words; rows without a word tell of counts of zero, without a source of masks."""
    zero = table.filter(pc.is_null(table["word"]))
    names, shares, of = zero["source"].combine_chunks(), zero["p"].to_numpy(), zero["side"].to_numpy()
    side = [np.flatnonzero(of == s) for s in (0, 1)] if block != other else [np.arange(len(of))] * 2
    place = np.zeros(len(of), np.int64)
    for s in side:
        place[s] = np.arange(len(s))
    total = np.zeros((len(side[0]), len(side[1])), np.int64)
    filled = table.filter(pc.is_valid(table["word"]))
    row = pc.fill_null(pc.index_in(filled["source"], value_set=names), -1).to_numpy()
    p, word, bits = (filled[c].to_numpy() for c in ("p", "word", "bits"))
    bits, order = bits.view(np.uint64), np.argsort(word, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(word[order])) + 1) if len(order) else []:
        mask = int(np.bitwise_or.reduce(bits[part[row[part] < 0]]))
        part = part[row[part] >= 0]
        own = [part if block == other else part[of[row[part]] == s] for s in (0, 1)]
        left, right = ((place[row[o]], p[o], bits[o]) for o in own)
        total += joint_sums(left, right, total.shape, (shares[side[0]], shares[side[1]]), mask)
    i, j = np.nonzero(np.ones(total.shape, bool) if block != other else ~np.eye(len(total), dtype=bool))
    left, right = names.take(pa.array(side[0][i])), names.take(pa.array(side[1][j]))
    for one, two in ((left, right), (right, left))[: 1 if block == other else 2]:
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(i), pa.string()), one.cast(pa.string()), two.cast(pa.string()), pa.array(total[i, j])],
            names=["lang", "source", "item", "value"])


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per pair of sources for each language, pair of blocks and range of words, whose rows follow one another."""
    current, rows = None, []
    for batch in batches:
        for key, part in _runs(batch, ["lang", "block", "other", "range"]):
            if key != current and rows:
                yield from _range_sums(*current[:3], pa.Table.from_batches(rows))
                rows = []
            current = key
            rows.append(part)
    if rows:
        yield from _range_sums(*current[:3], pa.Table.from_batches(rows))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 V)), exact: whole numbers of up to 38 digits."""
    scaled = (n + F.lit(PRIOR)).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    # a whole-number division; without terms nothing is shared out
    whole = F.call_function("div", scaled, (total + F.lit(PRIOR) * terms).cast("decimal(38,0)"))
    return F.when(terms > 0, whole + 1).otherwise(F.lit(1)).cast("long")


@released
def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_docs: int = LEAST_DOCS, top: int = TOP_TERMS,
) -> DataFrame:
    """`lang`, `source`, `part`, `item`, `value` and `rank`: how far each source of a language is from the others, and why.

    A language keeps the terms that stand in `least_docs` of its documents. A source's share of a term is in billionths,
    with two more occurrences of every term; the divergence of two shares is floor((p - q)^2 / (p + q)). Part `pair` has
    the sum over all terms for each other source, all ranks; part `term` the terms that the source has more of than the
    language, up to rank `top`. Values fall with rank, equal ones go by item.

    Terms get ids by falling count, 64 to a bitmap word, and the bitmaps of a (source, count) have the ids it holds that
    often. Words go to tasks in ranges, sources in blocks of BLOCK_SOURCES if a language has more, so no task sees a whole
    language. A null text, language or source is an empty one. Repeated rows are documents of their own. A language that
    keeps no term has values of zero and no terms. An empty table gives an empty result; other columns play no part.
    """
    plain = Plain(bound_batches(docs))
    lang, source, text = (F.coalesce(F.col(plain[c]), F.lit("")) for c in (lang_col, source_col, text_col))
    rows = plain.df.select(lang.alias("lang"), source.alias("source"), text.alias("text"))
    found = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    cells = store(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "cells")
    n_parts = partitions(docs.sparkSession)
    terms = cells.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    # ids need not be dense: ranges of terms by falling count, numbered within
    kept = store(
        terms.select("lang", "term", "n_lang").repartitionByRange(n_parts, "lang", F.desc("n_lang"), "term")
        .sortWithinPartitions("lang", F.desc("n_lang"), "term").withColumn("id", F.monotonically_increasing_id()), "kept_terms")
    used = store(cells.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept_cells")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("lang_total"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct()
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_SOURCES).cast("int").alias("blocks"))
    groups = groups.join(blocks, "lang").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", "blocks", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")])
    groups = store(groups.withColumn("zero", _share(F.lit(0), F.col("total"), F.col("terms"))), "groups")

    shared = used.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))
    q = _share(F.col("n_lang"), F.col("lang_total"), F.col("terms"))
    ahead = shared.withColumn("q", q).filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))

    pairs = _pairs(shared, kept, groups, n_parts).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = ahead.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)


def _pairs(shared: DataFrame, kept: DataFrame, groups: DataFrame, n_parts: int) -> DataFrame:
    """lang, source, item and value for each two sources of a language."""
    # a row meets all blocks, its own as the first or the second of the pair
    own = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("_own")
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_met")
    pair = [F.least("_own", "_met").alias("block"), F.greatest("_own", "_met").alias("other")]
    side = (F.col("_own") > F.col("_met")).cast("int").alias("side")
    word, place = F.shiftright("id", 6), ["lang", "block", "other", "range"]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(F.lit(WORD_BITS - 1)).cast("int"))
    of = (F.col("word") / RANGE_WORDS).cast("long").alias("range")
    nothing = F.lit(None).cast("long")

    levels = shared.groupBy("lang", "source", "blocks", "n", "p", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    levels = levels.select("*", own, of).select("*", meets).select("lang", *pair, "range", side, "source", "p", "word", "bits")
    masks = kept.groupBy("lang", word.alias("word")).agg(F.bit_or(bit).alias("bits")).select("*", of)
    zeros = groups.join(masks.select("lang", "range").distinct(), "lang", "left").select("*", own).select("*", meets).select(
        "lang", *pair, "range", side, "source", F.col("zero").alias("p"), nothing.alias("word"), nothing.alias("bits"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    blocks = groups.select("lang", "blocks").distinct().select("*", each.alias("_own")).select("*", each.alias("_met")).filter("_own <= _met")
    masks = masks.join(blocks, "lang").select(
        "lang", *pair, "range", F.lit(0).alias("side"), F.lit(None).cast("string").alias("source"), nothing.alias("p"), "word", "bits")
    dealt = zeros.unionByName(levels).unionByName(masks).repartition(n_parts, *place).sortWithinPartitions(*place)
    sums = dealt.mapInArrow(_pair_sums, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
