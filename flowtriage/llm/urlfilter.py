"""URL filters: rules, host word segmentation and naive Bayes."""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowtriage.llm.common import Plain, ascii_lower, bound_batches, store
from flowtriage.session import released

Rules = list[tuple[str, str]]  # verdict, rule (host and path)
#: Letters of a word of the unigram model, at most; longer stretches are split.
LONGEST_WORD = 24


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased (A-Z), and path of a url; both empty for a null and without `://`."""
    found = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, found, 1)), F.regexp_extract(url, found, 2)


def fitting_rule(host: Column, path: Column, rules: Rules, of: int = 1) -> Column:
    """The longest rule that fits (of: 1) or its verdict (of: 0); null without one.

    A rule fits its host and all subdomains if the path starts with the rule's path. The rules are a list that the
    caller holds, and become one ordered conditional expression. Of rules of one length the first in the list wins.
    """
    result = None
    for entry in sorted(rules, key=lambda r: -len(r[1])):
        domain, slash, start = entry[1].partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + start))
        result = F.when(fits, entry[of]) if result is None else result.when(fits, entry[of])
    return F.lit(None).cast("string") if result is None else result


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """word and n of all texts: letters, lower-cased, without what stands in tags; words of LONGEST_WORD letters at most."""
    plain = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "<[^>]*>", " ")
    words = texts.select(F.explode(F.split(F.lower(plain), r"[^\p{L}]+")).alias("word"))
    return words.filter(F.char_length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count("*").alias("n"))


class Segmenter:
    """Splits names into the most likely sequence of words under a unigram model.

    counts: of words, or of those that a name holds; total and size: occurrences and number of all words.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None, size: int | None = None):
        mass = (sum(counts.values()) if total is None else total) + (len(counts) if size is None else size) + 1
        self.logs = {word: math.log((n + 1) / mass) for word, n in counts.items()}
        self.unknown = -math.log(mass)

    def split(self, name: str) -> list[str]:
        """Viterbi over all places to cut; a stretch that is no word costs an unseen word and more for each letter."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            choices = []
            for start in range(max(0, end - LONGEST_WORD), end):
                word = name[start:end]
                cost = self.logs.get(word, self.unknown - 2.5 * len(word))
                choices.append((best[start][0] + cost, start))
            best.append(max(choices, key=lambda c: (c[0], -c[1])))
        words, end = [], len(name)
        while end:
            start = best[end][1]
            words.append(name[start:end])
            end = start
        return words[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of the host, and those of the path marked as such."""
        words = [w for part in parts_of(host) for w in (["#"] if part == "#" else self.split(part))]
        return words + ["/" + part for part in parts_of(path.lower())]


def parts_of(text: str) -> list[str]:
    """Runs of letters; numbers are all alike."""
    return ["#" if part[0].isdigit() else part for part in re.findall(r"[^\W\d_]+|\d+", text)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parts(texts: pd.Series) -> pd.Series:
    return pd.Series([parts_of(t) for t in texts], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _path_tokens(paths: pd.Series) -> pd.Series:
    return pd.Series([["/" + part for part in parts_of(p.lower())] for p in paths], dtype=object)


def _name_key() -> list[Column]:
    """Two hashes in place of a name, which may be long and goes with each stretch of it."""
    return [F.xxhash64("name").alias("k1"), F.crc32(F.col("name").cast("binary")).alias("k2")]


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All different stretches of each name that may be words."""
    for batch in batches:
        for k1, k2, name in batch.itertuples(index=False):
            found = {name[i : i + n] for i in range(len(name)) for n in range(1, min(LONGEST_WORD, len(name) - i) + 1)}
            yield pd.DataFrame({"k1": k1, "k2": k2, "word": sorted(found)})


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """_host and its words; hosts has a row per _host, counts has word and n.

    The stretches of each name meet the counts in a join, so a task holds the words that a name can have, and no
    vocabulary is too large.
    """
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("size")).first()
    total, size = sums["total"], sums["size"]

    @F.pandas_udf("array<string>")
    def split(names: pd.Series, known: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([
            Segmenter(dict(zip(w, c)) if w is not None else {}, total, size).split(name) for name, w, c in zip(names, known, n)], dtype=object)

    parts = store(hosts.select("_host", F.posexplode(_parts("_host")).alias("pos", "name")), "host_parts")
    names = parts.filter("name <> '#'").select("name").distinct().select("name", *_name_key())
    stretches = names.select("k1", "k2", "name").mapInPandas(_stretches, "k1 long, k2 long, word string")
    known = stretches.join(counts, "word").groupBy("k1", "k2").agg(F.collect_list(F.struct("word", "n")).alias("w"))
    named = names.join(known, ["k1", "k2"], "left").select("name", split("name", F.col("w.word"), F.col("w.n")).alias("words"))
    words = parts.join(store(named, "split_names"), "name", "left").select(
        "_host", F.struct("pos", F.coalesce("words", F.array("name")).alias("words")).alias("part"))
    return words.groupBy("_host").agg(F.flatten(F.array_sort(F.collect_list("part"))["words"]).alias("_words"))


#: Log odds are added as whole numbers, so that no order of the rows changes a sum.
ODDS_UNIT = 1 << 32


def naive_bayes(sites: DataFrame) -> DataFrame:
    """Adds `_judged` (block or allow) to sites without a verdict; sites has _verdict, _tokens and the pages `_n` it stands for.

    Multinomial model over the tokens of sites with a verdict, with one more occurrence of every token and of one that is
    unseen. The counts of all tokens stay a table, which the tokens to be judged meet in a join.
    """
    marked = store(sites.withColumn("_site", F.monotonically_increasing_id()), "sites")
    taught = marked.filter("_verdict is not null")
    n = {r["_verdict"]: r["n"] for r in taught.groupBy("_verdict").agg(F.sum("_n").alias("n")).collect()}
    prior = math.log((n.get("block", 0) + 1) / (n.get("allow", 0) + 1))
    seen = lambda verdict: F.coalesce(F.sum(F.when(F.col("_verdict") == verdict, F.col("_n"))), F.lit(0)).alias(verdict)
    counts = store(taught.select("_verdict", "_n", F.explode("_tokens").alias("token")).groupBy("token").agg(seen("block"), seen("allow")), "token_counts")
    sums = counts.agg(F.count("*").alias("v"), F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
    size = sums["v"] + 1
    unseen = math.log(((sums["allow"] or 0) + size) / ((sums["block"] or 0) + size))
    odds = F.coalesce(F.log((F.col("block") + 1) / (F.col("allow") + 1)), F.lit(0.0)) + F.lit(unseen)
    asked = marked.filter("_verdict is null").select("_site", F.explode("_tokens").alias("token"))
    asked = asked.groupBy("_site", "token").agg(F.count("*").alias("times")).join(counts, "token", "left")
    total = asked.groupBy("_site").agg(F.sum(F.col("times") * F.round(odds * ODDS_UNIT).cast("long")).alias("_odds"))
    blocked = F.coalesce("_odds", F.lit(0)) + F.lit(round(prior * ODDS_UNIT)) > 0
    return marked.join(total, "_site", "left").withColumn("_judged", F.when(blocked, "block").otherwise("allow")).drop("_site", "_odds")


@released
def judge(pages: DataFrame, rules: Rules, id_col: str = "page_id", url_col: str = "url", words_col: str = "html") -> DataFrame:
    """All rows with `host`, `path`, `rule`, `verdict` (allow or block) and `tokens`.

    Pages that a rule fits get its verdict and teach a classifier over the words of host and path; it judges all others.
    The words come from all texts in `words_col`, null ones have none; hosts may be of any length. A null url, or one without `://`, has empty host and path, fits no
    rule, and is judged by the prior. Ties are allowed, and so is everything where no rule fits any page. Hosts may
    repeat without limit: each row is judged by itself. Columns of the input whose name a result takes are replaced.
    """
    plain = Plain(bound_batches(pages))
    host, path = host_and_path(F.col(plain[url_col]))
    split = plain.df.withColumn("_host", host).withColumn("_path", path)
    rule = {f"_{n}": fitting_rule(F.col("_host"), F.col("_path"), rules, of) for n, of in (("rule", 1), ("verdict", 0))}
    # what is said of a page follows from its host and path, so it is said once for all pages that share them
    sites = store(split.groupBy("_host", "_path").agg(F.count("*").alias("_n")).withColumns(rule), "hosts_and_paths")
    counts = store(word_counts(plain.df, plain[words_col]), "word_counts")
    words = store(host_words(sites.select("_host").distinct(), counts), "host_words")
    tokens = F.concat(F.coalesce("_words", F.array().cast("array<string>")), _path_tokens("_path"))
    told = naive_bayes(sites.join(words, "_host", "left").withColumn("_tokens", tokens).drop("_words"))
    told = store(told.select("_host", "_path", "_rule", F.coalesce("_verdict", "_judged").alias("_verdict"), "_tokens"), "verdicts")
    rows = split.join(told, ["_host", "_path"])
    return plain.restore(
        rows, host=F.col("_host"), path=F.col("_path"), rule=F.col("_rule"), verdict=F.col("_verdict"), tokens=F.col("_tokens"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
