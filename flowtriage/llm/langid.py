"""Language identification with interpolated Kneser-Ney models over characters."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from flowtriage.llm.common import Shipped, Plain, bound_batches, most_frequent, store

ORDER, DISCOUNT = 4, 0.75
#: N-grams of all languages together, and labelled rows for calibration, at most.
MOST_GRAMS, MOST_CALIBRATED = 1 << 20, 5_000
LEAST_PRECISION = 0.99
SYMBOLS, GROUP_CHARS = 256, 250_000
UNKNOWN = "und"


def symbol_table() -> np.ndarray:
    """Symbol of each code point of the basic plane: 0 for what is no letter, its own for a-z, else one of 229 by hash."""
    points = np.arange(1 << 16)
    letter = np.array([chr(p).isalpha() for p in range(1 << 16)])
    symbols = np.where(letter, 27 + (points * 2654435761 >> 7) % (SYMBOLS - 27), 0)
    symbols[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return symbols.astype(np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Grams:
    """N-grams of lower-cased texts: the last ORDER symbols of each place, packed into 32 bits."""

    def __init__(self):
        self.table = symbol_table()

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
        if len(points) and points.max() >= 1 << 16:
            wide = points >= 1 << 16
            found = self.table[np.where(wide, 0, points)]
            letters = np.array([chr(p).isalpha() for p in points[wide].tolist()])
            found[wide] = np.where(letters, 27 + points[wide] % (SYMBOLS - 27), 0)
        else:
            found = self.table[points]
        kept = np.ones(len(found), bool)
        kept[1:] = (found[1:] != 0) | (found[:-1] != 0)  # what is between words counts once
        return found[kept]

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams, text after text, and the number in each text."""
        pad = np.zeros(ORDER - 1, np.uint32)
        parts = [self.symbols(t) for t in texts]
        line = np.concatenate([x for part in parts for x in (pad, part)])
        packed = np.zeros(len(line), np.uint32)
        for back in range(ORDER):
            packed[back:] |= line[: len(line) - back] << np.uint32(8 * back)
        real = np.concatenate([x for part in parts for x in (np.zeros(ORDER - 1, bool), np.ones(len(part), bool))])
        return packed[real], np.array([len(p) for p in parts])


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram and n over all rows (text, lang), summed in each task before they are shuffled."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, held = Grams(), {}

        def flush(lang: str) -> pd.DataFrame:
            pieces = held.pop(lang)
            values, places = np.unique(np.concatenate([v for v, _ in pieces]), return_inverse=True)
            return pd.DataFrame({"lang": lang, "gram": values.astype(np.int64), "n": np.bincount(
                places, weights=np.concatenate([n for _, n in pieces])).astype(np.int64)})

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                group, chars = [], 0
                for i, text in enumerate(texts):
                    group.append(text)
                    chars += len(text)
                    if chars >= GROUP_CHARS or i == len(texts) - 1:
                        held.setdefault(lang, []).append(np.unique(grams.of(group)[0], return_counts=True))
                        group, chars = [], 0
                if sum(len(v) for v, _ in held[lang]) > 1_000_000:
                    yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    found = rows.select("text", "lang").mapInPandas(counted, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class CharModels:
    """Kneser-Ney models of all languages in common sorted arrays of n-grams.

    Of each order, `grams[k]` holds the n-grams that any language has seen, sorted, and `logs[k]` their interpolated
    log2 probability in each language; `contexts[k]` and `shares[k]` hold the log2 weight that a context leaves to the
    next lower order.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        tables = [self._orders(*counts[lang]) for lang in self.langs]
        self.grams, self.logs, self.contexts, self.shares = {}, {}, {}, {}
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([t[k][0] for t in tables])) if tables else np.zeros(0, np.uint32)
            contexts = keys >> 8
            known, place = np.unique(contexts, return_inverse=True)
            logs, shares = np.zeros((len(keys), len(tables))), np.zeros((len(known), len(tables)))
            lower = self._lower(keys, k)
            for j, table in enumerate(tables):
                grams, n = table[k]
                own = np.zeros(len(keys))
                own[np.searchsorted(keys, grams)] = n
                total = np.bincount(place, own, len(known))
                types = np.bincount(place, own > 0, len(known))
                left = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
                part = np.where(own > 0, (own - DISCOUNT) / np.maximum(total[place], 1), 0.0)
                logs[:, j] = np.log2(part + left[place] * 2.0 ** lower[:, j])
                shares[:, j] = np.log2(left)
            self.grams[k], self.logs[k] = keys, logs.astype(np.float32)
            self.contexts[k], self.shares[k] = known, shares.astype(np.float32)

    @staticmethod
    def _orders(grams: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Counts of the highest order, and of each lower one how many different symbols stand before an n-gram."""
        order = np.argsort(grams)
        tables = {ORDER: (grams[order].astype(np.uint32), n[order].astype(np.float64))}
        for k in range(ORDER - 1, 0, -1):
            suffixes = tables[k + 1][0] & np.uint32((1 << 8 * k) - 1)
            values, counts = np.unique(suffixes, return_counts=True)
            tables[k] = (values, counts.astype(np.float64))
        return tables

    def _lower(self, keys: np.ndarray, k: int) -> np.ndarray:
        """log2 probabilities of the n-grams of order k without their first symbol."""
        if k == 1:
            return np.full((len(keys), len(self.langs)), -np.log2(SYMBOLS))
        return self.log_probabilities(keys & np.uint32((1 << 8 * (k - 1)) - 1), k - 1)

    def log_probabilities(self, grams: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Of each n-gram in each language; unseen ones take what their context leaves to the next lower order."""
        keys, found = self.grams[k], np.empty((len(grams), len(self.langs)), np.float32)
        place = np.minimum(np.searchsorted(keys, grams), max(len(keys) - 1, 0))
        hit = keys[place] == grams if len(keys) else np.zeros(len(grams), bool)
        found[hit] = self.logs[k][place[hit]]
        if not hit.all():
            missed = grams[~hit]
            rest = self._lower(missed, k).astype(np.float32)
            contexts, known = missed >> 8, self.contexts[k]
            at = np.minimum(np.searchsorted(known, contexts), max(len(known) - 1, 0))
            if len(known):
                rest += np.where((known[at] == contexts)[:, None], self.shares[k][at], 0)
            found[~hit] = rest
        return found

    def entropies(self, grams: Grams, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol of each text in each language, and the number of symbols."""
        packed, sizes = grams.of(texts)
        sums = np.add.reduceat(self.log_probabilities(packed).astype(np.float64), np.cumsum(sizes) - sizes, axis=0)
        return -sums / sizes[:, None], sizes


def _margins(models: CharModels, grams: Grams, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language of least entropy (the first of equals), its lead over the second in bits per symbol, sizes."""
    bits, sizes = models.entropies(grams, texts)
    best = bits.argmin(axis=1)
    if bits.shape[1] == 1:
        return best, np.ones(len(bits)), sizes
    two = np.partition(bits, 1, axis=1)
    return best, two[:, 1] - two[:, 0], sizes


class Calibration:
    """P(right) from the lead and the length of a text, and the score below which a prediction is rejected."""

    def __init__(self, weights: np.ndarray, reject_below: float):
        self.weights, self.reject_below = weights, reject_below

    def score(self, lead: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._inputs(lead, sizes) @ self.weights, -30, 30)))

    @staticmethod
    def _inputs(lead: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(lead)), lead, np.log(lead + 1e-4), lead * np.sqrt(sizes), np.log(sizes)])

    @classmethod
    def fitted(cls, lead: np.ndarray, sizes: np.ndarray, right: np.ndarray) -> "Calibration":
        """Penalised logistic regression by Newton steps. Without rows, one right answer is taken for granted."""
        if not len(lead):
            lead, sizes, right = np.ones(1), np.ones(1), np.ones(1)
        x, weights = cls._inputs(lead, sizes), np.zeros(5)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            gradient = x.T @ (right - p) - 0.1 * weights
            weights = weights + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(5), gradient)
        made = cls(weights, 0.0)
        scores = made.score(lead, sizes)
        order = np.argsort(-scores)
        precise = np.cumsum(right[order]) >= LEAST_PRECISION * np.arange(1, len(order) + 1)
        made.reject_below = float(scores[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
        return made


def _predicted(texts: list[str | None], models: CharModels, grams: Grams, judged) -> list:
    """judged(best, lead, sizes) of texts with letters, group by group; None for the others."""
    result, group, places, chars = [None] * len(texts), [], [], 0

    def flush():
        for place, value in zip(places, judged(*_margins(models, grams, group))):
            result[place] = value
        group.clear()
        places.clear()

    for i, text in enumerate(texts):
        if has_letter(text):
            group.append(text)
            places.append(i)
            chars += len(text)
            if chars >= GROUP_CHARS:
                flush()
                chars = 0
    if group:
        flush()
    return result


class Identifier:
    def __init__(self, models: CharModels, calibration: Calibration):
        self.models, self.calibration = models, calibration

    def predict(self, texts: list[str | None], grams: Grams) -> pd.DataFrame:
        def judged(best, lead, sizes):
            scores = self.calibration.score(lead, sizes)
            return [(self.models.langs[b], float(s), bool(s < self.calibration.reject_below)) for b, s in zip(best, scores)]

        found = _predicted(texts, self.models, grams, judged) if self.models.langs else [None] * len(texts)
        return pd.DataFrame([f or (UNKNOWN, 0.0, True) for f in found], columns=["lang_pred", "score", "rejected"])


def _models(counts: DataFrame, most_grams: int) -> CharModels:
    langs = [r["lang"] for r in counts.select("lang").distinct().collect()]
    found = {}
    for lang in langs:
        kept = most_frequent(counts.filter(F.col("lang") == lang).select("gram", "n"), "n", most_grams // len(langs)).toPandas()
        if len(kept):
            found[lang] = (kept["gram"].to_numpy(), kept["n"].to_numpy())
    return CharModels(found)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_grams: int = MOST_GRAMS) -> Identifier:
    """Models of every language named in docs, from all texts with a letter and a language.

    The score is calibrated on at most MOST_CALIBRATED distinct texts of a tenth of all, by hash of the text, with models
    of the other nine; the models that predict count all rows. Each language keeps its most frequent n-grams, all
    together at most `most_grams`, so what reaches the driver and is broadcast is bounded. Equal texts count as often as
    they occur. Without rows every prediction is unknown.
    """
    plain = Plain(bound_batches(docs))
    rows = plain.df.select(F.col(plain[text_col]).alias("text"), F.col(plain[lang_col]).alias("lang")).dropna()
    held = F.pmod(F.xxhash64("text"), F.lit(10)) == 0
    parts = gram_counts(rows.select("text", F.concat(F.when(held, "1").otherwise("0"), "lang").alias("lang")))
    parts = store(parts.select(F.expr("substring(lang, 2)").alias("lang"), "gram", "n", F.col("lang").startswith("1").alias("held")), "gram_counts")
    models = _models(store(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "all_gram_counts"), most_grams)
    rest = _models(parts.filter("not held"), most_grams)
    if not rest.langs:
        return Identifier(models, Calibration.fitted(np.zeros(0), np.zeros(0), np.zeros(0)))
    shared = Shipped(docs.sparkSession, rest)

    @F.pandas_udf("best int, lead double, size long")
    def led(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for texts in batches:
            judged = lambda best, lead, sizes: list(zip(best.tolist(), lead.tolist(), sizes.tolist()))
            values = _predicted(list(texts), shared.value, grams, judged)
            yield pd.DataFrame([v or (-1, 0.0, 1) for v in values], columns=["best", "lead", "size"])

    # One distinct text in some by a second hash, so that about MOST_CALIBRATED pass, then the first of these by the hash.
    # A language that only the held tenth has cannot be judged by the other models.
    second = F.xxhash64(F.lit(3), "text")
    tested = rows.filter(held & F.col("lang").isin(rest.langs))
    n_held = tested.select(F.xxhash64("text"), "lang").distinct().count()
    one_in = max(1, n_held // MOST_CALIBRATED)
    some = tested.filter(F.pmod(second, F.lit(one_in)) == 0).groupBy(second.alias("o"), "lang").agg(F.min("text").alias("text"))
    led_rows = some.select("lang", "o", led("text").alias("s")).select("o", "lang", "s.*")
    sample = led_rows.filter("best >= 0").orderBy("o", "lang").limit(MOST_CALIBRATED).toPandas()
    right = np.array([rest.langs[b] == lang for b, lang in zip(sample["best"], sample["lang"])], np.float64)
    return Identifier(models, Calibration.fitted(sample["lead"].to_numpy(float), sample["size"].to_numpy(float), right))


def identify(docs: DataFrame, identifier: Identifier, text_col: str = "text") -> DataFrame:
    """All rows with `lang_pred`, `score` (0 to 1) and `rejected`.

    The language of least cross-entropy per symbol over the whole text wins, the first in code point order of equals.
    Null texts and texts without a letter are `und` with score 0, and rejected. Columns of the input whose name a result
    takes are replaced.
    """
    plain = Plain(bound_batches(docs))
    shared = Shipped(docs.sparkSession, identifier)  # bounded by MOST_GRAMS

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predictions(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for texts in batches:
            yield shared.value.predict(list(texts), grams)

    rows = plain.df.withColumn("_p", predictions(F.col(plain[text_col])))
    return plain.restore(rows, **{n: F.col(f"_p.{n}") for n in ("lang_pred", "score", "rejected")})


cloudpickle.register_pickle_by_value(sys.modules[__name__])
