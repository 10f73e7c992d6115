"""From flows to exported samples and a report.

The flow table is read twice: five columns for the profile, all columns for the
sample. Everything later works on the sample.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from flowtriage.functions.numbers import ci_margin, safe_pct
from flowtriage.operators import profile
from flowtriage.operators.ranking import global_rank
from flowtriage.operators.rules import RULES, Rule, hit_rows, tag_reasons
from flowtriage.operators.sampling import PREFIXES, SEED, TARGETS, draw_sample, with_record_id
from flowtriage.session import materialise, released
from flowtriage.sources.exports import export_samples, export_sharded, require_complete, verify_export
from flowtriage.sources.reports import report_rows, write_report

SECTIONS = {
    "total": "Records",
    "label": "Label distribution, all records",
    "rule": "Rule contributions, share of all records",
    "suspects": "Suspects",
    "suspect_label": "Label distribution, suspects",
    "rule_overlap": "Rule overlap, share of suspects",
    "targets": "Rows asked for, per label",
    "sample": "Sample",
    "strata": "Label distribution, sample",
    "sample_label": "Label distribution, nested samples",
    "margin": "95 % margin of error in percent",
    "timestamps": "Time range of the sample",
    "ids": "Record ids of the sample",
    "files": "Exported files: lines, lines expected, bytes",
}


class SamplingResult(NamedTuple):
    cube: DataFrame
    sample: DataFrame
    files: DataFrame
    report: DataFrame


def suspect_pool(cube: DataFrame, strata: list[str]) -> dict[str, int]:
    """Suspects per stratum; one row per stratum reaches the driver."""
    rows = profile.labels_of_cube(cube, suspects_only=True).filter(F.col("label").isin(strata)).collect()
    return {r.label: r.n for r in rows}


def ranked_sample(
    flows: DataFrame, cube: DataFrame, targets: dict[str, int | None] = TARGETS, seed: int = SEED,
    rules: list[Rule] = RULES,
) -> DataFrame:
    """The stratified sample with suspect_reason, record_id and sample_rank.

    Reasons and ids are made for sampled rows only.
    """
    pool = suspect_pool(cube, list(targets))
    size = sum(pool.get(s, 0) if n is None else min(n, pool.get(s, 0)) for s, n in targets.items())
    sample = draw_sample(hit_rows(flows, rules), pool, targets, seed)
    return global_rank(with_record_id(tag_reasons(sample, rules)), rows=size)


def sample_report(
    cube: DataFrame, sample: DataFrame, files: DataFrame | None, prefixes: dict[str, int] = PREFIXES,
    targets: dict[str, int | None] = TARGETS,
) -> DataFrame:
    """Every figure of the run as report rows."""
    ids = profile.id_uniqueness(sample)
    counts = profile.nested_counts(sample, prefixes)
    times = profile.timestamp_range(sample)
    total = cube.agg(F.sum("n")).scalar()
    size = counts.select("sample", F.col("n").alias("size"))
    labels = profile.nested_profile(sample, prefixes).join(size, "sample")
    asked = cube.sparkSession.createDataFrame(list(targets.items()), "label string, n bigint")
    strata = profile.label_distribution(sample)
    parts = [
        report_rows(asked, "targets", F.col("label"), F.col("n"), text=F.when(F.col("n").isNull(), "all")),
        report_rows(strata.crossJoin(ids.select("total_rows")), "strata", F.col("label"), F.col("n"), safe_pct(F.col("n"), F.col("total_rows"), 2)),
        report_rows(profile.profile_report(cube), F.col("section"), F.col("key"), F.col("n"), F.col("pct")),
        report_rows(ids, "sample", "rows", F.col("total_rows"), safe_pct(F.col("total_rows"), total)),
        report_rows(labels, "sample_label", F.concat_ws(".", "sample", "label"), F.col("n"),
                    safe_pct(F.col("n"), F.col("size"), 2)),
        report_rows(counts, "margin", F.col("sample"), F.col("n"), ci_margin(F.col("target"))),
        report_rows(times, "timestamps", "first", text=F.col("first_timestamp")),
        report_rows(times, "timestamps", "last", text=F.col("last_timestamp")),
        report_rows(ids, "ids", "unique", F.col("unique_ids")),
        report_rows(ids, "ids", "duplicate", F.col("duplicate_ids")),
    ]
    if files is not None:
        verdict = F.when(F.col("line_count_ok"), "complete").otherwise("wrong")
        parts.append(report_rows(files, "files", F.col("file"), F.col("line_count"), text=verdict))
        parts.append(report_rows(files, "files", F.concat("file", F.lit(".expected")), F.col("expected_lines")))
        parts.append(report_rows(files, "files", F.concat("file", F.lit(".bytes")), F.col("size_bytes")))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


@released
def stored_sample(
    flows: DataFrame, cube: DataFrame, targets: dict[str, int | None] = TARGETS, seed: int = SEED, rules: list[Rule] = RULES,
) -> DataFrame:
    """ranked_sample as one table; what it took to make it is gone."""
    return materialise(ranked_sample(flows, cube, targets, seed, rules))


def run_sampling(
    flows: DataFrame,
    folder: str,
    targets: dict[str, int | None] = TARGETS,
    seed: int = SEED,
    prefixes: dict[str, int] = PREFIXES,
    rules: list[Rule] = RULES,
    sharded: bool = False,
) -> SamplingResult:
    """Profiles, samples, exports, verifies and reports; sharded writes folders of many files instead of single files.

    The tables of the result (cube, sample, report) stay as long as the scratch block around this call, or the session.
    """
    cube = materialise(profile.profile_cube(flows, rules))
    if not profile.suspect_ratio(cube, rules).first().suspect_records:
        raise ValueError("no suspects found")
    sample = stored_sample(flows, cube, targets, seed, rules)
    expected = (export_sharded if sharded else export_samples)(sample, folder, prefixes)
    files = require_complete(verify_export(flows.sparkSession, expected))
    report = write_report(sample_report(cube, sample, files, prefixes, targets), SECTIONS, folder, "processing_report")
    return SamplingResult(cube, sample, files, report)
