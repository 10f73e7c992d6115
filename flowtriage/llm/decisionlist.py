"""Quality rules: decision lists learned by sequential covering."""

from __future__ import annotations

import math
import sys
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowtriage.llm.common import UPPER, Plain, bound_batches

STATS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_shouts", "n_digits",
]
SYMBOLS = "#*$%&|<>"
#: At most so many labelled rows are fitted, the first by hash of their id.
MOST_ROWS, CUTS, MOST_RULES, MOST_CONDITIONS = 20_000, 48, 16, 4
#: Of the rows a rule marks that it was not grown on, this share must be bad, and as many by chance at most so likely.
LEAST_PRECISION, LEVEL = 0.95, 0.01
#: Rules that fail this before learning ends.
MOST_FAILURES = 32
#: The base fails texts of fewer words, or with more than this share of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
NOT_UPPER, NOT_DIGIT = UPPER.encode(), b"0123456789"


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts named in STATS; a null text counts as empty."""
    text = text or ""
    data = text.encode()
    words = data.split()  # of bytes: the six ASCII white space characters
    n = len(words)
    spaces = sum(text.count(c) for c in " \t\n\v\f\r")
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            counts, covered = Counter(windows), bytearray(n)
            for i, window in enumerate(windows):
                if counts[window] > 1:
                    covered[i : i + 3] = b"\1\1\1"
            repeated = sum(covered)
    return (
        n, len(text) - spaces, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines),
        len(set(words)), len(data) - len(data.translate(None, NOT_UPPER)), text.count("!"), len(data) - len(data.translate(None, NOT_DIGIT)),
    )


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in STATS]))
def stats_of(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t) for t in texts], columns=STATS, dtype="int64")


def features(prefix: str = "") -> dict[str, Column]:
    """What the rules compare, from columns named as in STATS."""
    stat = {name: F.col(prefix + name).cast("double") for name in STATS}

    def share(part: str, whole: str) -> Column:
        return F.when(stat[whole] > 0, stat[part] / stat[whole]).otherwise(0.0)

    return {
        "words": stat["n_words"], "word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"),
        "repeated_lines": share("n_dup_lines", "n_lines"), "repeated_words": share("n_repeat_words", "n_words"),
        "distinct_words": share("n_distinct", "n_words"), "capitals": share("n_upper", "word_chars"),
        "shouts": share("n_shouts", "n_words"), "digits": share("n_digits", "word_chars"),
    }


Rule = list[tuple[str, str, float]]  # feature, ">=" or "<", threshold


def _holds(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    kept = [x[f] >= cut if sign == ">=" else x[f] < cut for f, sign, cut in rule]
    return reduce(np.logical_and, kept, np.ones(len(next(iter(x.values()))), bool))


def _grown(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Adds the condition with the largest gain in information until only bad rows are left or nothing gains."""
    rule, inside = [], np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS and (inside & ~bad).any():
        p, n = (inside & bad).sum(), inside.sum()
        best = (0.0, None)
        for name, values in x.items():
            for cut in np.unique(np.quantile(values[inside], np.linspace(0, 1, CUTS + 1)[1:-1])):
                for sign in (">=", "<"):
                    chosen = inside & (values >= cut if sign == ">=" else values < cut)
                    hit, size = (chosen & bad).sum(), chosen.sum()
                    gain = hit * (np.log2(hit / size) - np.log2(p / n)) if hit else 0.0
                    if gain > best[0] + 1e-9:
                        best = (gain, (name, sign, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _holds(rule[-1:], x)
    return rule


def _pruned(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning or the end of a rule that separates rows it was not grown on best, the shortest of equals."""
    def worth(part: Rule) -> float:
        inside = _holds(part, x)
        return ((inside & bad).sum() - (inside & ~bad).sum()) / max(inside.sum(), 1)

    parts = [rule[:k] for k in range(1, len(rule) + 1)] + [rule[k:] for k in range(1, len(rule))]
    return max(parts, key=lambda part: (worth(part), -len(part)))


def chance(hits: int, n: int, share: float) -> float:
    """How likely n rows, each bad with that likelihood, have so many bad ones or more."""
    logs = [
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share)
        for k in range(hits, n + 1)] if 0 < share < 1 else [0.0]
    return min(1.0, sum(map(math.exp, logs)))


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Rules for bad rows in order. Each is grown on two rows in three that no rule covers yet and pruned on the rest.

    It counts if what it marks of the rest is precise, and more than chance would give among so many rows; so the test
    fits few labels as well as many. The bad rows that a failed rule was grown on are not grown on again, and learning
    goes on with the others. No bad rows give no rules.
    """
    rules, left, given_up, failures = [], np.ones(len(bad), bool), np.zeros(len(bad), bool), 0
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < MOST_RULES and failures < MOST_FAILURES:
        grow, check = left & ~third & ~given_up, left & third
        if not (grow & bad).any() or not check.any():
            break
        rule = _grown({k: v[grow] for k, v in x.items()}, bad[grow])
        if not rule:
            break
        rule = _pruned(rule, {k: v[check] for k, v in x.items()}, bad[check])
        covered = _holds(rule, x)
        inside = covered & check
        hits, n = int((inside & bad).sum()), int(inside.sum())
        if hits and hits >= LEAST_PRECISION * n and chance(hits, n, bad[check].mean()) <= LEVEL:
            rules.append(rule)
            left &= ~covered
        else:
            given_up |= covered & grow & bad
            failures += 1
    return rules


def base_fails(prefix: str = "") -> Column:
    """What needs no learning, over columns named as in STATS."""
    words, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)


def learned_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> list[Rule]:
    """Rules from documents with a label that the base keeps; at most `most_rows` rows of nine numbers reach the driver.

    Rows with a null id or a null label teach nothing; of no labels come no rules.
    """
    plain = Plain(bound_batches(docs))
    chosen = (
        labels.select(F.col("doc_id").alias("_label_id"), F.col("quality").alias("_quality")).dropna()
        .orderBy(F.xxhash64("_label_id"), "_label_id", "_quality").limit(most_rows)
    )
    rows = plain.df.join(F.broadcast(chosen), F.col(plain[id_col]) == F.col("_label_id"))
    rows = rows.select("_quality", F.xxhash64("_label_id").alias("_order"), stats_of(F.col(plain[text_col])).alias("_s"))
    table = rows.select("_quality", "_order", "_s.*").filter(~base_fails()).select("_quality", "_order", *[c.alias(n) for n, c in features().items()])
    found = table.orderBy("_order", "_quality", *features()).limit(most_rows).toPandas()
    return learn({name: found[name].to_numpy(float) for name in features()}, (found["_quality"] == 0).to_numpy())


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The rules as one ordered conditional expression over columns named as in STATS: false for a bad text."""
    values, result = features(prefix), None
    for rule in rules:
        fits = reduce(Column.__and__, [values[f] >= cut if sign == ">=" else values[f] < cut for f, sign, cut in rule])
        result = F.when(fits, F.lit(False)) if result is None else result.when(fits, F.lit(False))
    return F.lit(True) if result is None else result.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with the counts of STATS, `base_failed` and `kept`.

    The base fails texts under 50 words or with over half their words in repeated windows of three; `kept` is false
    for those and for texts that a rule marks. Null and empty texts have no words, so the base fails them. Columns of
    the input whose name a result takes are replaced.
    """
    plain = Plain(bound_batches(docs))
    rows = plain.df.withColumn("_s", stats_of(F.col(plain[text_col]))).select("*", *[F.col(f"_s.{n}").alias(f"_{n}") for n in STATS])
    return plain.restore(
        rows, **{n: F.col(f"_{n}") for n in STATS}, base_failed=base_fails("_"), kept=~base_fails("_") & verdict(rules, "_"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
