"""Substring dedup: repeated passages by matching statistics over an FM-index per shard."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from flowtriage.llm.common import SPACES, STRIPPED, Plain, bound_batches, partitions, store
from flowtriage.llm.fmindex import FMIndex
from flowtriage.session import released

WINDOW, GRAM, SEED = 13, 5, 42
#: Words of a shard, about.
SHARD_WORDS = 1 << 19
#: An anchor with more different pieces than this deals them out by window.
HOT_PIECES = 1024
#: The key of a null id: after all others.
LAST = (1 << 63) - 1
BASE, ODD = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
PIECE = "key long, print long, at int, n int, anchor long, digest long"


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, odd in zip((30, 27), ODD):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after another, and how many words each has; none for a null."""
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    lists = pc.ascii_split_whitespace(trimmed)
    words, blank = lists.flatten(), pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
    if blank.any():  # splits into one empty word
        words = words.filter(pc.not_equal(words, ""))
    coded = words.dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    sizes = np.where(blank, 0, pc.list_value_length(lists).to_numpy()).astype(np.int64)
    return known[coded.indices.to_numpy()], sizes


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words that follow one another."""
    x = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for i in range(n):
        x = x * np.uint64(BASE) + hashes[i : i + len(x)]
    return _mixed(x)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its length, one after another."""
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def pieces_of(hashes: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Cuts the windows of all texts into pieces: text, first window, number of windows, anchor and digest of each.

    The anchor of a window is the least hash of `gram` words in it, of equal ones the first; windows that follow one
    another and have the same place as their anchor are a piece. Equal windows have equal anchors, wherever they stand. The
    digest is a hash of the words of all windows of the piece.
    """
    if len(hashes) < window:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    least, place, span = _grams(hashes, gram), np.arange(len(hashes) - gram + 1), 1
    wide = window - gram + 1
    while span < wide:
        shift = min(span, wide - span)
        later = least[shift:] < least[:-shift]
        least, place = np.where(later, least[shift:], least[:-shift]), np.where(later, place[shift:], place[:-shift])
        span += shift
    ends = np.cumsum(sizes)
    text_of = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    windows = np.flatnonzero(np.arange(len(least)) + window <= ends[text_of])
    new = np.ones(len(windows), bool)
    new[1:] = (np.diff(windows) > 1) | (np.diff(place[windows]) != 0)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(windows)))
    start = windows[first]
    stop = start + n + window - 1
    powers = np.full(len(hashes), BASE, np.uint64)
    powers[:1] = 1
    inverse = np.full(len(hashes), pow(BASE, -1, 1 << 64), np.uint64)
    inverse[:1] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64)])
    digest = _mixed((sums[stop] - sums[start]) * np.cumprod(inverse, dtype=np.uint64)[start] + n.astype(np.uint64))
    text = text_of[start]
    return text, start - (ends - sizes)[text], n, least[start].view(np.int64), digest.view(np.int64)


def _cut(window: int, gram: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, at, n, anchor, digest = pieces_of(*hashed_words(batch.column(2)), window, gram)
            of = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(anchor), pa.array(digest)],
                names=["key", "print", "at", "n", "anchor", "digest"])

    return cut


@released
def _shared_pieces(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """The pieces whose anchor stands in documents of two ids or more."""
    pieces = store(rows.mapInArrow(_cut(window, gram), PIECE), "pieces")
    anchors = pieces.groupBy("anchor").agg(F.min("key").alias("_least"), F.max("key").alias("_most")).filter("_least < _most")
    # as a table of its own, so that the pieces of a frequent anchor can be split over tasks where they meet it
    anchors = store(anchors.select("anchor"), "shared_anchors")
    return store(pieces.join(anchors, "anchor").select(*pieces.columns), "shared_pieces")


def _spelled(window: int, shards: int):
    """The words of wanted pieces, in the shard of their anchor, or window by window in the shard of the window's hash."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = hashed_words(batch["text"])
            lists = batch["wanted"]
            wanted, doc = lists.flatten(), np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy())
            at, n, anchor, digest, hot, least, most = (wanted.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "anchor", "digest", "hot", "least", "most"))
            start = (np.cumsum(sizes) - sizes)[doc] + at
            windows = _grams(hashes, window)
            parts = np.where(hot, n, 1)
            row = np.repeat(np.arange(len(n)), parts)
            off = _ranges(np.zeros(len(n), np.int64), parts)
            start, count = start[row] + off, np.where(hot, 1, n)[row]
            key = np.where(hot[row], windows[start].view(np.int64), anchor[row])
            length = count + window - 1
            words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(hashes[_ranges(start, length)].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_mixed(key.view(np.uint64)) % np.uint64(shards)).cast(pa.int32()), pa.array(anchor[row]), pa.array(digest[row]), pa.array(off, pa.int32()),
                 pa.array(least[row]), pa.array(most[row]), words], names=["shard", "anchor", "digest", "off", "least", "most", "words"])

    return spell


def least_holders(symbols: np.ndarray, lengths: np.ndarray, holders: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the texts the least holder of a text that has it; texts are streamed against the index of all.

    Returns the holders of the windows of all texts, one after another, and how many windows each text has.
    """
    index = FMIndex(symbols, lengths, window)
    found, where = index.matching_statistics(symbols, lengths)
    starts = index.starts[window]
    least = np.minimum.reduceat(holders[np.minimum(index.text_of, len(holders) - 1)], starts[:-1])
    full = found >= window
    return least[index.group(where[full], window)], np.add.reduceat(full, np.cumsum(lengths) - lengths)


def _matched(window: int):
    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per shard, whose rows follow one another, the least holder of each window of each piece that has a lesser one."""
        shard, held = None, []

        def answer() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            words = table["words"].combine_chunks()
            lengths = pc.list_value_length(words).to_numpy().astype(np.int64)
            least, sizes = least_holders(words.flatten().to_numpy(), lengths, table["least"].to_numpy(), window)
            places = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            useful = np.minimum.reduceat(least, np.cumsum(sizes) - sizes) < table["most"].to_numpy()
            return pa.RecordBatch.from_arrays(
                [*(table[c].combine_chunks() for c in ("anchor", "digest", "off")), pa.ListArray.from_arrays(places, pa.array(least))],
                names=["anchor", "digest", "off", "least"]).filter(pa.array(useful))

        for batch in batches:
            shards = batch["shard"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], np.diff(shards) != 0]))
            for begin, end in zip(starts, [*starts[1:], len(batch)]):
                if shards[begin] != shard and held:
                    yield answer()
                    held = []
                shard = shards[begin]
                held.append(batch.slice(begin, end - begin))
        if held:
            yield answer()

    return matched


@released
def repeated_windows(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, print and `starts`: the places of windows that a row with a lesser key has too; rows has key, print and text."""
    shared = _shared_pieces(rows, window, gram)
    # equal pieces are one, with its least and its largest holder
    apart = shared.groupBy("anchor", "digest").agg(F.min(F.struct("key", "print", "at", "n")).alias("one"), F.max("key").alias("most"))
    apart = store(apart.select("anchor", "digest", "one.*", "most"), "different_pieces")
    size = apart.agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    shards = max(partitions(rows.sparkSession), -(-size // SHARD_WORDS))
    hot = apart.groupBy("anchor").agg(F.count("*").alias("_pieces")).filter(F.col("_pieces") > HOT_PIECES).select("anchor", F.lit(True).alias("hot"))
    marked = apart.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).withColumn("least", F.col("key"))
    wanted = marked.groupBy("key", "print").agg(F.collect_list(F.struct("at", "n", "anchor", "digest", "hot", "least", "most")).alias("wanted"))
    spelled = rows.join(wanted, ["key", "print"]).select("text", "wanted").mapInArrow(
        _spelled(window, shards), "shard int, anchor long, digest long, off int, least long, most long, words array<long>")
    dealt = spelled.repartition("shard").sortWithinPartitions("shard")
    answers = store(dealt.mapInArrow(_matched(window), "anchor long, digest long, off int, least array<long>"), "least_holders")
    found = F.filter(F.transform("least", lambda m, j: F.when(m < F.col("key"), F.col("at") + F.col("off") + j)), lambda x: x.isNotNull())
    starts = shared.join(answers, ["anchor", "digest"]).select("key", "print", found.alias("_s")).filter(F.size("_s") > 0)
    return store(starts.groupBy("key", "print").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_s")))).alias("starts")), "repeated_windows")


@released
def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """All rows, with `n_words` (before) and `n_removed`, and of the text the words outside repeated windows, joined by a space.

    A window is `window` words of one text, as they are; it is repeated if it also stands in a row with a smaller id
    (an integer). Only windows of the input count, not of what is left. The row with the smallest id keeps all its words.

    Texts are cut into pieces by the anchors of their windows, so that equal windows meet in a shard; pieces whose anchor no
    other id has are left out, equal pieces are one. Each shard has an FM-index, against which its pieces are streamed;
    anchors of many pieces are dealt out window by window. Words are compared by 64 bits of hash, pieces by 128.

    A null or blank text has no words. Null ids come after all others, and rows of one id repeat nothing of each other.
    Repeated rows lose the same words. An empty table gives an empty result. Columns of the input whose name a result
    takes are replaced.
    """
    plain = Plain(bound_batches(docs))
    text = F.coalesce(F.col(plain[text_col]), F.lit(""))
    row = {"_key": F.coalesce(F.col(plain[id_col]).cast("long"), F.lit(LAST)), "_print": F.xxhash64(text)}
    keyed = plain.df.withColumns(row)
    hits = repeated_windows(keyed.select(F.col("_key").alias("key"), F.col("_print").alias("print"), text.alias("text")), window, gram)
    joined = keyed.join(hits.select(F.col("key").alias("_key"), F.col("print").alias("_print"), "starts"), ["_key", "_print"], "left")
    inner = F.btrim(text, F.lit(STRIPPED))
    joined = joined.withColumn("_words", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES)))
    words, starts = F.col("_words"), F.col("starts")
    # what lies between one window and the next, in slices: work in proportion to the words
    before = F.concat(F.array(F.lit(0)), F.transform(starts, lambda s: s + window))
    gaps = F.zip_with(before, F.concat(starts, F.array(F.size(words))), lambda a, b: F.slice(words, a + 1, F.greatest(b - a, F.lit(0))))
    joined = joined.withColumn("_left", F.when(starts.isNull(), words).otherwise(F.flatten(gaps)))
    return plain.restore(joined, **{
        text_col: F.array_join("_left", " "), "n_words": F.size("_words").cast("long"),
        "n_removed": (F.size("_words") - F.size("_left")).cast("long")})


cloudpickle.register_pickle_by_value(sys.modules[__name__])
