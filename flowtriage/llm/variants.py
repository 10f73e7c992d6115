"""Spelling variants: words one edit apart, found in k-d trees over letter counts."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from flowtriage.llm.common import Plain, ascii_lower, partitions, store
from flowtriage.llm.kdtree import KdTree
from flowtriage.session import released

LEAST_LETTERS, LEAST_N, RATIO = 7, 2, 10
#: Letters are a-z and U+00C0 to U+00FF; each is a dimension.
LETTERS = 26 + 64
DIMENSION = np.full(256, -1, np.int64)
DIMENSION[97:123], DIMENSION[192:256] = np.arange(26), np.arange(26, LETTERS)
#: Weight of the length among the dimensions of the cells: words of other lengths are never near.
LENGTH_WEIGHT = 1000
#: Words that a cell holds at most, about, and at least where there are enough tasks.
CELL_WORDS, LEAST_CELL_WORDS = 1 << 16, 1 << 12
#: Words that the cells are laid out on.
SAMPLE_WORDS = 1 << 17
LEAF_WORDS, QUERIES_AT_ONCE, CODES_AT_ONCE = 128, 1 << 13, 1 << 23


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_n: int = LEAST_N,
    slip: int | None = None,
) -> DataFrame:
    """`word` and `n` of the words of `least_letters` letters or more that occur `least_n` times in all texts.

    Words are maximal runs of letters with A-Z lower-cased. With `slip`, a run loses a letter if that divides the crc32 of
    `<id>:<run>`, the one at the crc32 modulo its length: misspellings for trials. A null text has no words, a null id
    counts as an empty text, repeated rows count each.
    """
    plain = Plain(docs)
    runs = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(plain[text_col]), F.lit(""))), F.lit(f"[a-zÀ-ÿ]{{{least_letters},}}"), F.lit(0))
    key = F.coalesce(F.col(plain[id_col]).cast("string"), F.lit(""))
    words = plain.df.select(key.alias("id"), F.explode(runs).alias("word"))
    if slip is not None:
        h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("word")).cast("binary"))
        at = (h % F.char_length("word")).cast("int")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
        words = words.select(F.when(h % slip == 0, cut).otherwise(F.col("word")).alias("word")).filter(F.char_length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all words one after another, the length of each, and its letter counts."""
    lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
    codes = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8)
    counts, ends = np.zeros((len(words), LETTERS), np.int32), np.cumsum(lengths)
    for at in range(0, len(words), 1 << 14):
        own = lengths[at : at + (1 << 14)]
        letters = DIMENSION[codes[ends[at] - own[0] : ends[at + len(own) - 1]]]
        places = np.arange(len(own)).repeat(own) * LETTERS + letters
        counts[at : at + len(own)] = np.bincount(places, minlength=len(own) * LETTERS).reshape(-1, LETTERS)
    return codes, lengths, counts


def signatures(counts: np.ndarray) -> np.ndarray:
    """64 bits per row of counts, of which rows differ in as many as their L1 distance at most.

    A letter has two bits, for one and for two or more; of the letters above U+00C0 every sixth shares its bits.
    """
    slots = np.concatenate([counts[:, :26], np.stack([counts[:, 26 + i :: 6].sum(axis=1) for i in range(6)], axis=1)], axis=1)
    bits = np.concatenate([slots > 0, slots > 1], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows of code points differ by one replaced letter, or by one inserted in the longer rows."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (short != long).sum(axis=1) == 1
    before = np.logical_and.accumulate(short == long[:, :n], axis=1).sum(axis=1)
    after = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + after >= n


class LengthTree:
    """The words of one length in a k-d tree, with their ids."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, counts: np.ndarray):
        self.tree = KdTree(counts, LEAF_WORDS, tight=True)
        order = self.tree.order
        self.ids, self.codes, self.counts, self.signs = ids[order], codes[order], counts[order], signatures(counts[order])

    def near(self, codes: np.ndarray, counts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Query and indexed row of all pairs one edit apart: boxes within the L1 radius, then counts, then letter order."""
        signs, found = signatures(counts), [(np.zeros(0, np.int64),) * 2]
        for who, (begin, end, _) in self.tree.near(counts.astype(np.int64), np.full(len(counts), radius)):
            a, b = np.nonzero(np.bitwise_count(signs[who, None] ^ self.signs[None, begin:end]) <= radius)
            a, b = who[a], b + begin
            for at in range(0, len(a), 1 << 18):
                i, j = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
                close = np.abs(counts[i] - self.counts[j]).sum(axis=1) <= radius
                found.append((i[close], j[close]))
        a, b = (np.concatenate(x) for x in zip(*found))
        step = max(1, CODES_AT_ONCE // max(1, codes.shape[1]))
        right = [one_edit(codes[a[at : at + step]], self.codes[b[at : at + step]]) for at in range(0, len(a), step)]
        right = np.concatenate([np.zeros(0, bool), *right])
        return a[right], b[right]


def _by_length(ids: np.ndarray, words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Length, ids, rows of code points and letter counts of the words of each length."""
    codes, lengths, counts = letters_of(words)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        yield int(n), ids[own], codes[starts[own, None] + np.arange(n)], counts[own]


def _totals(first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
    """For each id of the pairs how many it has, and the least id it is paired with."""
    ids, other = np.concatenate([first, second]), np.concatenate([second, first])
    known, place = np.unique(ids, return_inverse=True)
    best = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(best, place, other)
    return pa.RecordBatch.from_arrays([pa.array(known), pa.array(np.bincount(place, minlength=len(known))), pa.array(best)], names=["id", "n_near", "best"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by cell, in each those that it indexes first, then those that look for near words of `length` in it."""
    cell, waiting, trees = None, [], {}
    for batch in batches:
        cells, roles = batch["cell"].to_numpy(), batch["role"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(cells) != 0) | (np.diff(roles) != 0)]))
        for begin, end in zip(starts, [*starts[1:], len(batch)]):
            if cells[begin] != cell:
                cell, waiting, trees = cells[begin], [], {}
            part = batch.slice(begin, end - begin)
            if roles[begin] == 0:
                waiting.append(part)
                continue
            if waiting:
                table = pa.Table.from_batches(waiting)
                trees = {n: LengthTree(*rest) for n, *rest in _by_length(table["id"].to_numpy(), table["word"].combine_chunks())}
                waiting = []
            wanted = part["length"].to_numpy()
            for length in np.intersect1d(wanted, list(trees)):
                tree, own = trees[int(length)], part.filter(pa.array(wanted == length))
                for at in range(0, len(own), QUERIES_AT_ONCE):
                    some = own.slice(at, QUERIES_AT_ONCE)
                    for n, ids, codes, counts in _by_length(some["id"].to_numpy(), some["word"]):
                        a, b = tree.near(codes, counts, 2 if n == length else 1)
                        first, second = ids[a], tree.ids[b]
                        once = (first < second) | (n != length)  # of two words of one length, each looks for the other
                        if once.any():
                            yield _totals(first[once], second[once])


def _cells(words: DataFrame, n_words: int) -> KdTree:
    """A tree over length and letter counts, laid out on a sample by hash; its leaves are the cells."""
    tasks = partitions(words.sparkSession)
    cells = max(1, min(tasks, n_words // LEAST_CELL_WORDS), n_words // CELL_WORDS)
    every = max(1, n_words // SAMPLE_WORDS)
    sample = words.filter(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word").toArrow()["word"].combine_chunks()
    _, lengths, counts = letters_of(sample.cast(pa.string()))
    points = np.concatenate([counts, LENGTH_WEIGHT * lengths[:, None]], axis=1)
    return KdTree(points, max(1, -(-len(points) // cells)), tight=False)


def _dealt(words: DataFrame, tree: KdTree) -> DataFrame:
    """Each word where it is indexed (role 0), and in all cells that may hold near words of its length or one more."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch["word"].cast(pa.string())
            _, lengths, counts = letters_of(word)
            for role, more, radius in ((0, 0, 0), (1, 0, 2), (1, 1, 1)):
                points = np.concatenate([counts, LENGTH_WEIGHT * (lengths + more)[:, None]], axis=1)
                for who, (_, _, cell) in tree.near(points, np.full(len(points), radius)):
                    n = len(who)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, cell), pa.int32()), pa.array(np.full(n, role), pa.int32()),
                         pa.array((lengths + more)[who], pa.int32()), batch["id"].take(pa.array(who)), word.take(pa.array(who))],
                        names=["cell", "role", "length", "id", "word"])

    dealt = words.select("id", "word").mapInArrow(deal, "cell int, role int, length int, id long, word string")
    return dealt.repartition("cell").sortWithinPartitions("cell", "role")


def _roots(linked: DataFrame) -> DataFrame:
    """id and root for each id of links id, to: links are followed twice as far a round, until none goes on."""
    reached, going = store(linked.select("id", F.col("to").alias("root"), F.lit(True).alias("goes")), "roots"), True
    while going:
        after = reached.select(F.col("id").alias("_at"), F.col("root").alias("_next"))
        joined = reached.join(after, F.col("root") == F.col("_at"), "left")
        reached = store(joined.select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("goes")), "roots")
        going = not reached.filter("goes").isEmpty()
    return reached.select("id", "root")


@released
def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """`word`, `form`, `root`, `n`, `n_near` and `form_n` of each word; words has `word` and `n`, a row per word.

    Two words are near if one inserted, deleted or replaced letter (a-z, U+00C0 to U+00FF) tells them apart. A word's form is
    its near word of largest n, the least in code-point order of those, if it has `ratio` times the word's n or more;
    `root` is where forms lead, the word itself without one.

    One edit changes the letter counts by two at most (L1), and by one for another length. The cells of a k-d tree over
    length and letter counts, laid out on a sample, share the words out; each word looks into all cells whose box is near
    enough. In a cell there is a k-d tree per length; its boxes, then counts, then the order of letters decide. Ids run by
    falling n, so a form is the least id that is near. No pair is lost or counted twice. An empty table gives an empty result.
    """
    words = store(
        words.select("word", "n").repartitionByRange(F.desc("n"), "word").sortWithinPartitions(F.desc("n"), "word")
        .withColumn("id", F.monotonically_increasing_id()), "words")
    found = _dealt(words, _cells(words, words.count())).mapInArrow(_search, "id long, n_near long, best long")
    near = store(found.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")), "near_words")
    known = words.join(near, "id", "left")
    better = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    linked = known.select("id", "n", "best").join(better, "best").filter(F.col("form_n") >= F.lit(ratio) * F.col("n"))
    linked = store(linked.select("id", F.col("best").alias("to"), "form", "form_n"), "forms")
    ends = words.select(F.col("id").alias("root"), F.col("word").alias("_root"))
    rooted = linked.drop("to").join(_roots(linked).join(ends, "root").drop("root"), "id")
    return known.join(rooted, "id", "left").select(
        "word", "form", F.coalesce("_root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
