"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from flowtriage.llm.common import LOWER, UPPER, Plain, bound_batches

#: The field is fitted on the first labelled documents by hash of their id, of any length: so many, or as many as have so
#: many lines together, whichever is less.
MOST_DOCS, MOST_LINES = 6_000, 768_000
STEPS, RATE, PENALTY = 160, 0.1, 1e-3
THRESHOLD = 0.3
#: Texts are handled in groups of about so many characters.
GROUP_CHARS = 1_000_000
NOT_UPPER, NOT_LOWER, NOT_DIGIT, NOT_SYMBOL = UPPER.encode(), LOWER.encode(), b"0123456789", b"#*$%&<>~^=_{}[]\\@"
OWN = 12


def _own_features(lines: list[bytes]) -> np.ndarray:
    """Features of each line of one document."""
    rows, seen = [], set()
    for line in lines:
        size, words = len(line), line.split()
        n = len(words) or 1
        upper, lower = size - len(line.translate(None, NOT_UPPER)), size - len(line.translate(None, NOT_LOWER))
        rows.append((
            np.log1p(size) / 8, upper / (upper + lower + 1), (size - len(line.translate(None, NOT_DIGIT))) / (size + 1),
            min(line.count(b"!") / n, 2), min((size - len(line.translate(None, NOT_SYMBOL))) / n, 4), min(line.count(b"|") / n, 2),
            min(size / n, 40) / 10, not words, sum(map(eq, words, words[1:])) / n, len(set(words)) / n,
            line in seen and bool(words), line.rstrip()[-1:] in (b".", b"!", b"?", b'"', b":"),
        ))
        seen.add(line)
    return np.array(rows, np.float32).reshape(-1, OWN)


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with those of the lines before and after, and the lengths of the lines."""
    lines = (text or "").encode().split(b"\n")
    own = _own_features(lines)
    none = np.zeros((1, OWN), np.float32)
    ends = np.zeros((len(lines), 2), np.float32)
    ends[0, 0] = ends[-1, 1] = 1
    near = np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), ends, np.ones((len(lines), 1), np.float32)])
    return near, np.array([max(len(line), 1) for line in lines], np.float64)


WIDTH = 3 * OWN + 3


def marginals(unary: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the expected moves between labels, for chains that lie one after another in unary.

    unary: weights of (bad, good) per line; moves: weights of moves from label to label. Chains go step by step side by
    side, longest first, so a step works on all chains that are that long.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    forward, backward = np.empty_like(unary), np.ones_like(unary)
    pairs = np.zeros((2, 2))
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains longer than t
    for t in range(longest):
        at = starts[: active[t]] + t
        now = unary[at] if t == 0 else (forward[at - 1] @ moves) * unary[at]
        forward[at] = now / now.sum(axis=1, keepdims=True)
    for t in range(longest - 1, 0, -1):
        at = starts[: active[t]] + t
        after = unary[at] * backward[at]
        pair = forward[at - 1][:, :, None] * moves[None] * after[:, None, :]
        pairs += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        before = after @ moves.T
        backward[at - 1] = before / before.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1), pairs


class LineField:
    """Weights of the field: of the features for label good, and of the moves between labels (bad, good)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, center: np.ndarray, spread: np.ndarray):
        self.weights, self.moves, self.center, self.spread = weights, moves, center, spread

    def unary(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.spread, -6, 6) @ self.weights
        good = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return np.column_stack([1 - good, good])

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Mean P(good) of the lines of each text, weighted by their lengths."""
        parts = [line_features(t) for t in texts]
        sizes = np.array([len(lengths) for _, lengths in parts])
        good, _ = marginals(self.unary(np.vstack([x for x, _ in parts])), sizes, np.exp(self.moves))
        lengths, starts = np.concatenate([n for _, n in parts]), np.cumsum(sizes) - sizes
        return np.clip(np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts), 0.0, 1.0)


def fit(chains: list[np.ndarray], good: np.ndarray) -> LineField:
    """The field of largest penalised likelihood when each line has its document's label, by gradient steps.

    Without documents of both labels all weights are zero and every score is a half.
    """
    weights, moves = np.zeros(WIDTH), np.zeros((2, 2))
    if len(set(good.tolist())) < 2:
        return LineField(weights, moves, np.zeros(WIDTH), np.ones(WIDTH))
    x, sizes = np.vstack(chains).astype(np.float64), np.array([len(c) for c in chains])
    center, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    center[-1], spread[-1] = 0, 1  # the constant
    field = LineField(weights, moves, center, spread)
    scaled = np.clip((x - center) / spread, -6, 6)
    truth = np.repeat(good.astype(np.float64), sizes)
    seen = np.diag([(sizes[good == 0] - 1).sum(), (sizes[good == 1] - 1).sum()]).astype(np.float64)
    first, second = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, STEPS + 1):
        found, pairs = marginals(field.unary(x), sizes, np.exp(field.moves))
        gradient = np.concatenate([scaled.T @ (truth - found), (seen - pairs).ravel()]) / len(x)
        gradient -= PENALTY * np.concatenate([field.weights, field.moves.ravel()])
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        change = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        field.weights = field.weights + change[:WIDTH]
        field.moves = field.moves + change[WIDTH:].reshape(2, 2)
    return field


@F.pandas_udf(T.BinaryType())
def _packed_features(texts: pd.Series) -> pd.Series:
    return pd.Series([line_features(t)[0].astype("<f4").tobytes() for t in texts], dtype=object)


def learned_field(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_docs: int = MOST_DOCS,
    most_lines: int = MOST_LINES,
) -> LineField:
    """The field fitted on the first labelled documents by hash of their id, `most_docs` at most, of any length.

    Labels without id or quality teach nothing. The document that makes up `most_lines` lines is the last, so what reaches
    the driver is bounded by these two and the longest document.
    """
    plain = Plain(bound_batches(docs))
    chosen = (
        labels.select(F.col("doc_id").alias("_label_id"), F.col("quality").alias("_quality")).dropna()
        .orderBy(F.xxhash64("_label_id"), "_label_id", "_quality").limit(most_docs)
    )
    text = F.coalesce(F.col(plain[text_col]), F.lit(""))
    rows = plain.df.join(F.broadcast(chosen), F.col(plain[id_col]) == F.col("_label_id")).select(
        F.xxhash64("_label_id").alias("_hash"), "_label_id", "_quality", text.alias("_text"))
    order = ["_hash", "_label_id", "_quality"]
    lines = F.char_length("_text") - F.char_length(F.replace("_text", F.lit("\n"))) + 1
    listed = rows.select(*order, lines.alias("_lines")).orderBy(*order, "_lines").limit(most_docs).collect()
    if not listed:
        return fit([], np.zeros(0, np.int64))
    total = np.cumsum([r["_lines"] for r in listed])
    last = listed[min(int(np.searchsorted(total, most_lines)), len(listed) - 1)]
    until = F.struct(*order) <= F.struct(*[F.lit(last[c]).cast(rows.schema[c].dataType) for c in order])
    packed = rows.filter(until).select(*order, _packed_features("_text").alias("_x"))
    found = packed.orderBy(*order, "_x").limit(most_docs).collect()
    chains = [np.frombuffer(r["_x"], "<f4").reshape(-1, WIDTH) for r in found]
    return fit(chains, np.array([int(r["_quality"] == 1) for r in found], np.int64))


def _scored(field: LineField):
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            result, group, chars = [], [], 0
            for text in texts:
                group.append(text)
                chars += len(text or "")
                if chars >= GROUP_CHARS:
                    result.append(field.score(group))
                    group, chars = [], 0
            if group:
                result.append(field.score(group))
            yield pd.Series(np.concatenate(result) if result else [], dtype="float64")

    return scores


def quality(docs: DataFrame, field: LineField, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows with `score` (0 to 1) and `predicted` (1 if the score reaches the threshold).

    Every line of the whole text counts by its length in bytes, an empty line as one. Null and empty texts are one
    empty line. Equal texts have equal scores up to rounding. Columns of the input whose name a result takes are replaced.
    """
    plain = Plain(bound_batches(docs))
    rows = plain.df.withColumn("_score", _scored(field)(F.col(plain[text_col])))
    return plain.restore(rows, score=F.col("_score"), predicted=F.when(F.col("_score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, field: LineField, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with the columns they came with."""
    plain = Plain(bound_batches(docs))
    return plain.restore(plain.df.filter(_scored(field)(F.col(plain[text_col])) >= threshold))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
