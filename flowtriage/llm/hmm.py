"""Hidden Markov language model over words, trained by Baum-Welch counts summed over partitions."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from flowtriage.llm.common import Shipped, Plain, bound_batches, most_frequent, store

STATES, ROUNDS = 6, 3
#: Words with an emission of their own, at most; all others share one of BUCKETS emissions by hash (a power of two).
MOST_WORDS, BUCKETS = 1 << 16, 1 << 10
#: Frequent words whose company in documents sets the first emissions.
SEED_WORDS = 256
SMOOTHING, SEED = 2000.0, 42
END = "\n"  # no word: words hold no white space
#: Tokens that a task counts, holds and runs through the model at a time, at least.
COUNTED_TOKENS, HELD_TOKENS, GROUP_TOKENS = 2_500_000, 4_000_000, 500_000


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, one text after another, and how many each has; none for a null."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(trimmed)
    words, blank = lists.flatten(), pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
    if blank.any():  # splits into one empty word
        words = words.filter(pc.not_equal(words, ""))
    return words, np.where(blank, 0, pc.list_value_length(lists).to_numpy()).astype(np.int64)


def word_counts(rows: DataFrame) -> DataFrame:
    """word and n over all texts, with one end per text; summed in each task before they are shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, ends = [], 0, 0

        def flush() -> pa.RecordBatch:
            counts = pa.chunked_array(held, held[0].type).value_counts()
            n = pa.concat_arrays([counts.field("counts"), pa.array([ends], pa.int64())])
            return pa.RecordBatch.from_arrays([pa.concat_arrays([counts.field("values").cast(pa.string()), pa.array([END])]), n], names=["word", "n"])

        for batch in batches:
            words, sizes = words_of(batch.column(0))
            held.append(words)
            tokens, ends = tokens + len(words), ends + len(sizes)
            if tokens >= COUNTED_TOKENS:
                yield flush()
                held, tokens, ends = [], 0, 0
        if ends:
            yield flush()

    return rows.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Classes:
    """Emission classes: the end (0), frequent words (1, 2, ...), then buckets of all other words."""

    def __init__(self, counts: dict[str, int], ends: int, bucket_mass: np.ndarray, total: int, size: int):
        """bucket_mass: the sum of count + 1 over the words of each bucket, and 1 for those it has not seen."""
        words = sorted(counts, key=lambda w: (-counts[w], w))
        self.words = pa.array(words, pa.string())
        self.first_bucket = len(words) + 1
        self.n = self.first_bucket + BUCKETS
        seen = np.array([ends, *[counts[w] for w in words]], np.float64)
        self.total, self.size, self.known_end = total, size, ends > 0
        self.base_logs = np.log10((seen + 1) / (total + size + 1))
        self.shares = np.concatenate([seen + 1, bucket_mass])
        self.shares /= self.shares.sum()

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """The classes of all words and the end of each text, one text after another; how many each text has; the distinct
        words without an emission of their own, and for each place of such a word which of them it is."""
        words, sizes = words_of(texts)
        sizes += 1
        ids = pc.fill_null(pc.index_in(words, value_set=self.words.cast(words.type)), -1).to_numpy() + 1
        missing = np.flatnonzero(ids == 0)
        others = words.take(pa.array(missing)).dictionary_encode()
        distinct, which = others.dictionary, others.indices.to_numpy()
        buckets = [xxhash.xxh64_intdigest(w, SEED) & (BUCKETS - 1) for w in distinct.cast(pa.binary()).to_pylist()]
        ids[missing] = self.first_bucket + np.array(buckets, np.int32)[which]
        classes, ends = np.zeros(len(ids) + len(sizes), np.int32), np.ones(len(ids) + len(sizes), bool)
        ends[np.cumsum(sizes) - 1] = False
        classes[ends] = ids
        return classes, sizes, distinct, which


class Model:
    """Start, moves and emissions (class by state)."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emissions: np.ndarray):
        self.start, self.moves, self.emissions = start, moves, emissions

    @staticmethod
    def by_step(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each token of chains that lie one after another goes when the chains, longest first, are laid out step by
        step, and where each step begins. A step is then one piece of memory, and the chains it serves come first in it."""
        rank = np.empty(len(sizes), np.int64)
        rank[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes))
        chains = np.cumsum(np.bincount(sizes)[::-1])[::-1][1:]  # chains longer than t
        steps = np.concatenate([[0], np.cumsum(chains)])
        t = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return steps[t] + np.repeat(rank, sizes), steps

    def forward(self, seq: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward values, scales and emissions of tokens laid out step by step."""
        e = self.emissions[seq]
        a, scale, moves, before = np.empty_like(e), np.empty(len(seq)), self.moves, None
        ones = np.ones(e.shape[1])
        for t, (start, end) in enumerate(zip(steps[:-1].tolist(), steps[1:].tolist())):
            now = a[start:end]
            if t:
                np.matmul(before[: end - start], moves, out=now)
                now *= e[start:end]
            else:
                np.multiply(self.start, e[start:end], out=now)
            c = np.matmul(now, ones, out=scale[start:end])
            now /= c[:, None]
            before = now
        return a, scale, e

    def log10_likelihood(self, seq: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        place, steps = self.by_step(sizes)
        laid = np.empty_like(seq)
        laid[place] = seq
        _, scale, _ = self.forward(laid, steps)
        return np.add.reduceat(np.log10(scale)[place], np.cumsum(sizes) - sizes)

    def expected(self, seq: np.ndarray, sizes: np.ndarray, counts: "Counts") -> None:
        """Adds the expected starts, moves and emissions of the chains."""
        place, steps = self.by_step(sizes)
        laid = np.empty_like(seq)
        laid[place] = seq
        a, scale, e = self.forward(laid, steps)
        ahead = np.ones_like(e)  # scaled backward values
        back, moved, steps = np.ascontiguousarray(self.moves.T), np.zeros_like(self.moves), steps.tolist()
        e /= scale[:, None]
        for t in range(len(steps) - 2, 0, -1):
            start, end = steps[t], steps[t + 1]
            after = e[start:end]
            after *= ahead[start:end]
            first = steps[t - 1]
            moved += a[first : first + end - start].T @ after
            np.matmul(after, back, out=ahead[first : first + end - start])
        counts.moves += self.moves * moved
        a *= ahead
        counts.start += a[: steps[1]].sum(axis=0)
        for k in range(a.shape[1]):
            counts.emissions[:, k] += np.bincount(laid, a[:, k], len(counts.emissions))


class Counts:
    def __init__(self, n: int, states: int):
        self.start, self.moves, self.emissions = np.zeros(states), np.zeros((states, states)), np.zeros((n, states))

    def model(self, shares: np.ndarray) -> Model:
        """The model of these counts; emissions are smoothed with the shares of the classes in the corpus."""
        start, moves = self.start + 1, self.moves + 1
        emissions = self.emissions + SMOOTHING * shares[:, None]
        return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))


def _chains(batches: Iterator[pa.Array], classes: Classes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Class sequences in groups, those of like length together, so that few steps serve few chains."""
    held, tokens = [], 0

    def groups():
        held.sort(key=len)
        group, size = [], 0
        for seq in held:
            group.append(seq)
            size += len(seq)
            if size >= GROUP_TOKENS:
                yield np.concatenate(group), np.array([len(s) for s in group])
                group, size = [], 0
        if group:
            yield np.concatenate(group), np.array([len(s) for s in group])
        held.clear()

    for texts in batches:
        if not len(texts):
            continue
        seq, sizes, _, _ = classes.of(texts)
        held.extend(np.split(seq, np.cumsum(sizes)[:-1]))
        tokens += len(seq)
        if tokens >= HELD_TOKENS:
            yield from groups()
            tokens = 0
    if held:
        yield from groups()


def _company(rows: DataFrame, classes: Classes) -> np.ndarray:
    """In how many documents two of the most frequent words stand together, over all documents."""
    frequent = classes.words.slice(0, SEED_WORDS)
    n = len(frequent)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((n, n))
        for batch in batches:
            words, sizes = words_of(batch.column(0))
            found = pc.fill_null(pc.index_in(words, value_set=frequent.cast(words.type)), -1).to_numpy()
            place = np.flatnonzero(found >= 0)
            held = np.zeros((len(sizes), n), np.float32)
            held[np.repeat(np.arange(len(sizes)), sizes)[place], found[place]] = 1
            both += held.T @ held
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(both[i, j])], names=["i", "j", "n"])

    both = np.zeros((n, n))
    for row in rows.select("text").mapInArrow(met, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[row["i"], row["j"]] = row["n"]
    return both


def first_model(both: np.ndarray, classes: Classes, states: int) -> Model:
    """Emissions that favour, in each state, the frequent words that keep company with one of words far apart."""
    tilt = np.ones((classes.n, states))
    n = len(both)
    if n:
        met = np.sqrt(np.maximum(np.diag(both), 1e-9))
        near = both / np.outer(met, met)
        common = np.flatnonzero(np.diag(both) >= 0.02 * np.diag(both).max())
        seeds = [int(np.argmax(np.diag(both)))]
        while len(seeds) < min(states, len(common)):
            seeds.append(int(min(common, key=lambda w: (near[w, seeds].max(), w))))
        tilt[1 : n + 1] = 0.2
        tilt[1 + np.arange(n), near[:, seeds].argmax(axis=1)] = 5.0
    # States without a word of their own differ a little, or they would stay alike.
    tilt *= 1 + 0.05 * np.random.default_rng(SEED).random(tilt.shape)
    emissions = classes.shares[:, None] * tilt
    moves = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), moves, emissions / emissions.sum(axis=0))


def _round(rows: DataFrame, classes, model: Model, n: int, states: int) -> Counts:
    """One round of Baum-Welch over all documents: counts of each task, summed by Spark; a row per class reaches the driver."""
    shared = Shipped(rows.sparkSession, model)
    columns = [f"s{k}" for k in range(states)]

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(n, states)
        for seq, sizes in _chains((b.column(0) for b in batches), classes.value):
            shared.value.expected(seq, sizes, counts)
        used = np.flatnonzero(counts.emissions.any(axis=1))
        for kind, places, table in ((0, used, counts.emissions[used]), (1, range(states), counts.moves), (2, [0], counts.start[None])):
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(table[:, k]) for k in range(states)], pa.array([kind] * len(table), pa.int32()), pa.array(list(places), pa.int32())],
                names=[*columns, "kind", "place"])

    found = rows.select("text").mapInArrow(expected, ", ".join(f"{c} double" for c in columns) + ", kind int, place int")
    total = found.groupBy("kind", "place").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    counts = Counts(n, states)
    for kind, table in ((0, counts.emissions), (1, counts.moves), (2, counts.start[None])):
        part = total[total["kind"] == kind]
        table[part["place"].to_numpy()] = part[columns].to_numpy()
    return counts


class Language:
    """A trained model, with the table of all words that it counts from."""

    def __init__(self, classes: Classes, model: Model, words: DataFrame, buckets: DataFrame):
        self.classes, self.model, self.words, self.buckets = classes, model, words, buckets


def learn(docs: DataFrame, text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> Language:
    """Word counts and a model from all whole texts of docs (a null text counts as empty: just an end).

    The emission of a rarer word is that of its bucket times the word's share of the bucket, known from the counts, so
    states share the words of a bucket in the same way. What reaches the driver and is broadcast is bounded by MOST_WORDS
    and BUCKETS, the counts of all words stay a distributed table. No rows give a model of unseen words.
    """
    plain = Plain(bound_batches(docs))
    rows = plain.df.select(F.col(plain[text_col]).alias("text"))
    words = store(word_counts(rows), "words")
    sums = words.agg(F.sum("n").alias("total"), F.count("*").alias("size"), F.sum(F.when(F.col("word") == END, F.col("n"))).alias("ends")).first()
    open_words = words.filter(F.col("word") != END)
    frequent = {r["word"]: r["n"] for r in most_frequent(open_words, "n", MOST_WORDS).collect()}
    least = min(frequent.values(), default=0)
    rare = open_words.filter(F.col("n") < least) if frequent else open_words
    bucket = F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    mass = np.ones(BUCKETS)
    for row in rare.groupBy(bucket.alias("b")).agg(F.sum(F.col("n") + 1).alias("mass")).collect():
        mass[row["b"]] += row["mass"]
    classes = Classes(frequent, sums["ends"] or 0, mass, sums["total"] or 0, sums["size"])
    spark = docs.sparkSession
    model = first_model(_company(rows, classes), classes, states)
    shared = Shipped(spark, classes)
    for _ in range(rounds if sums["total"] else 0):
        model = _round(rows, shared, model, classes.n, states).model(classes.shares)
    buckets = spark.createDataFrame([(b, float(m)) for b, m in enumerate(mass)], "bucket int, mass double")
    return Language(classes, model, rare.select("word", "n"), buckets)


def score(docs: DataFrame, language: Language, text_col: str = "text") -> DataFrame:
    """All rows with `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score`.

    `score` is the log10 probability of the whole text and its end under the model, by the scaled forward recursion;
    `base_score` that of its words one by one. Words with an emission of their own are looked up in the task; the others
    meet their counts in a join by word, as a row for each word of a text. A null text is an end alone. Repeated rows
    are scored each. Columns of the input whose name a result takes are replaced.
    """
    plain = Plain(bound_batches(docs))
    spark = docs.sparkSession
    shared = Shipped(spark, (language.classes, language.model))
    text = plain[text_col]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, model = shared.value
        for batch in batches:
            if not len(batch):
                continue
            seq, sizes, distinct, which = classes.of(batch.column(0))
            starts, own = np.cumsum(sizes) - sizes, seq < classes.first_bucket
            known = np.add.reduceat(own.astype(np.int64), starts) - (not classes.known_end)
            base = np.add.reduceat(np.where(own, classes.base_logs[np.where(own, seq, 0)], 0.0), starts)
            logs = model.log10_likelihood(seq, sizes)
            # each rarer word once per text, with how often it is there
            text_of = np.repeat(np.arange(len(sizes)), sizes)[~own]
            pairs, times = np.unique(text_of * max(len(distinct), 1) + which, return_counts=True)
            in_text, word = np.divmod(pairs, max(len(distinct), 1))
            places = pa.array(np.searchsorted(in_text, np.arange(len(sizes) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                *batch.columns[1:], pa.array(sizes), pa.array(known), pa.array(base), pa.array(logs),
                pa.ListArray.from_arrays(places, distinct.take(pa.array(word)).cast(pa.string())),
                pa.ListArray.from_arrays(places, pa.array(times, pa.int64())),
            ], names=[*batch.schema.names[1:], "_tokens", "_own", "_base", "_logs", "_rare", "_counts"])

    carried = plain.df.withColumn("_row", F.monotonically_increasing_id()).select(F.col(text).alias("_text"), "*")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[1:])
    own = "_tokens long, _own long, _base double, _logs double, _rare array<string>, _counts array<long>"
    rows = store(carried.mapInArrow(scored, f"{fields}, {own}"), "forward")

    met = (
        rows.select("_row", F.explode(F.arrays_zip("_rare", "_counts")).alias("r"))
        .select("_row", F.col("r._rare").alias("word"), F.col("r._counts").alias("times"))
        .join(language.words, "word", "left")
        .withColumn("bucket", F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        .join(F.broadcast(language.buckets), "bucket")  # BUCKETS rows
    )
    seen = F.coalesce(F.col("n"), F.lit(0)) + 1
    classes = language.classes
    whole = float(classes.total + classes.size + 1)
    sums = met.groupBy("_row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("_met"),
        F.sum(F.col("times") * F.log10(seen / F.lit(whole))).alias("_met_base"),
        F.sum(F.col("times") * F.log10(seen / F.col("mass"))).alias("_met_logs"),
    )
    joined = rows.join(sums, "_row", "left")
    zero = F.lit(0)
    return plain.restore(
        joined, n_tokens=F.col("_tokens"), n_known=F.col("_own") + F.coalesce("_met", zero),
        train_tokens=F.lit(classes.total).cast("long"), base_score=F.col("_base") + F.coalesce("_met_base", zero.cast("double")),
        score=F.col("_logs") + F.coalesce("_met_logs", zero.cast("double")))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
