"""Counts over the flow table.

All rule and label counts fold out of one aggregate by label and rule flags
(profile_cube). Its map side leaves at most labels x 2^rules rows per task, so a
class holding nearly all rows costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowtriage.functions.numbers import ci_margin, safe_pct
from flowtriage.operators.rules import RULES, Rule, bound_rules, reasons_of_flags, rule_flags


def total_count(flows: DataFrame) -> DataFrame:
    return flows.agg(F.count("*").alias("n"))


def label_distribution(df: DataFrame) -> DataFrame:
    """Rows per label, most frequent first; a missing label is shown as None."""
    return by_frequency(
        df.groupBy("label").agg(F.count("*").alias("n"))
        .select(F.coalesce("label", F.lit("None")).alias("label"), "n"),
        "label",
    )


def by_frequency(counts: DataFrame, tie_break: str, n: str = "n") -> DataFrame:
    return counts.orderBy(F.desc(n), F.asc(tie_break))


def profile_cube(flows: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Rows per label and combination of rule flags: (label, one flag per rule, n)."""
    flows, rules = bound_rules(flows, rules)
    return (
        flows.select("label", *rule_flags(rules))
        .groupBy("label", *[r.name for r in rules])
        .agg(F.count("*").alias("n"))
    )


def _is_suspect(rules: list[Rule]) -> Column:
    return F.expr(" OR ".join(f"{r.name} = 1" for r in rules))


def _total(cube: DataFrame) -> Column:
    return cube.agg(F.sum("n")).scalar()


def _suspect_total(cube: DataFrame, rules: list[Rule]) -> Column:
    return cube.filter(_is_suspect(rules)).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()


def labels_of_cube(cube: DataFrame, rules: list[Rule] = RULES, suspects_only: bool = False) -> DataFrame:
    rows = cube.filter(_is_suspect(rules)) if suspects_only else cube
    counts = rows.groupBy("label").agg(F.sum("n").alias("n"))
    return by_frequency(counts.select(F.coalesce("label", F.lit("None")).alias("label"), "n"), "label")


def rule_contributions(cube: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Hits per rule and their share of all rows."""
    hits = cube.selectExpr("coalesce(sum(n), 0L) AS total", *[f"coalesce(sum(n * {r.name}), 0L) AS {r.name}" for r in rules])
    facts = ", ".join(
        f"named_struct('rule', '{r.name}', 'condition', '{r.text}', 'matched_records', {r.name})" for r in rules
    )
    return hits.selectExpr("total", f"inline(array({facts}))").select(
        "rule", "condition", "matched_records", safe_pct(F.col("matched_records"), F.col("total")).alias("pct_of_full")
    )


def suspect_ratio(cube: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    return cube.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum(F.when(_is_suspect(rules), F.col("n"))), F.lit(0)).alias("suspect_records"),
    ).withColumn("suspect_ratio_percent", safe_pct(F.col("suspect_records"), F.col("total_records")))


def rule_overlap(cube: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Suspects per exact combination of rules."""
    counts = (
        cube.filter(_is_suspect(rules))
        .groupBy(reasons_of_flags(rules).alias("suspect_reason"))
        .agg(F.sum("n").alias("n"))
    )
    shares = counts.withColumn("pct_of_suspect", safe_pct(F.col("n"), _suspect_total(cube, rules)))
    return by_frequency(shares, "suspect_reason")


def profile_report(cube: DataFrame, rules: list[Rule] = RULES, suspect_labels: bool = True) -> DataFrame:
    """Every count as (section, key, n, pct), from one pass over the cube."""

    def fact(section: str, key: str, n: str) -> str:
        return f"named_struct('section', '{section}', 'key', {key}, 'n', {n})"

    label, tagged = "coalesce(label, 'None')", "if(suspect_reason <> '', n, 0L)"
    facts = [
        fact("total", "'records'", "n"),
        fact("suspects", "'records'", tagged),
        fact("label", label, "n"),
        fact("rule_overlap", "suspect_reason", tagged),
        *[fact("rule", f"'{r.name}'", f"n * {r.name}") for r in rules],
    ]
    if suspect_labels:
        facts.append(fact("suspect_label", label, tagged))
    counts = (
        cube.withColumn("suspect_reason", reasons_of_flags(rules))
        .selectExpr(f"inline(array({', '.join(facts)}))")
        .groupBy("section", "key").agg(F.sum("n").alias("n"))
        # single rules are listed without a hit too, as are the totals
        .filter("n > 0 OR section IN ('total', 'suspects', 'rule')")
    )
    # no filter below the sums: it would reach the scan, and the cube could not be shared
    suspect_total = cube.agg(F.sum(F.when(_is_suspect(rules), F.col("n")).otherwise(0))).scalar()
    whole = F.when(F.expr("section IN ('rule_overlap', 'suspect_label')"), suspect_total).otherwise(_total(cube))
    return counts.select("section", "key", "n", safe_pct(F.col("n"), whole).alias("pct"))


def timestamp_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))


def id_uniqueness(df: DataFrame) -> DataFrame:
    """Rows, distinct record ids and surplus rows."""
    return df.agg(
        F.count("*").alias("total_rows"), F.countDistinct("record_id").alias("unique_ids")
    ).withColumn("duplicate_ids", F.col("total_rows") - F.col("unique_ids"))


def nested_profile(sample: DataFrame, prefixes: dict[str, int]) -> DataFrame:
    """Rows per prefix and label, all prefixes in one pass over the ranked sample."""
    within = ", ".join(f"if(sample_rank <= {k}, '{name}', NULL)" for name, k in prefixes.items())
    return (
        sample.selectExpr(f"explode(array_compact(array({within}))) AS sample", "coalesce(label, 'None') AS label")
        .groupBy("sample", "label").agg(F.count("*").alias("n"))
    )


def nested_counts(sample: DataFrame, prefixes: dict[str, int]) -> DataFrame:
    """Rows per prefix with the 95 % margin of error of that size."""
    hits = sample.selectExpr(*[f"count_if(sample_rank <= {k}) AS {name}" for name, k in prefixes.items()])
    facts = ", ".join(f"named_struct('sample', '{name}', 'target', {k}L, 'n', {name})" for name, k in prefixes.items())
    return hits.selectExpr(f"inline(array({facts}))").withColumn("ci_margin_percent", ci_margin(F.col("n")))
