"""Statistics as a table, JSON lines and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowtriage.session import materialise
from flowtriage.sources.jsonl import write_single_text

REPORT_COLUMNS = ["section", "key", "n", "value", "text"]


def report_rows(
    df: DataFrame, section: str | Column, key: str | Column, n: Column | None = None,
    value: Column | None = None, text: Column | None = None,
) -> DataFrame:
    """df as report rows (section, key, n, value, text); what is not given is NULL."""
    null = F.lit(None)
    return df.select(
        (F.lit(section) if isinstance(section, str) else section).alias("section"),
        (F.lit(key) if isinstance(key, str) else key).cast("string").alias("key"),
        (null if n is None else n).cast("bigint").alias("n"),
        (null if value is None else value).cast("double").alias("value"),
        (null if text is None else text).cast("string").alias("text"),
    )


def unpivot_rows(df: DataFrame, section: str, key: str, names: list[str]) -> DataFrame:
    """One report row per model (or other key) and numeric column."""
    cells = F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names
    ])
    cells = df.select(F.col(key).alias("_key"), F.inline(cells))
    return report_rows(cells, section, F.concat_ws(".", "_key", "name"), value=F.col("value"))


def report_lines(report: DataFrame, sections: dict[str, str]) -> DataFrame:
    """(section_no, line_no, value): headings in the order of sections, rows by count.

    Lines are made where the rows are; the driver never holds the report.
    """
    numbers = {name: i for i, name in enumerate(sections, 1)}
    pairs = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    shown = F.concat_ws(
        "  ",
        F.rpad("key", F.greatest(F.lit(44), F.length("key")), F.lit(" ")),
        F.lpad(F.format_number("n", 0), 14, " "),
        F.when(F.col("value").isNotNull(), F.concat(F.lit("("), F.format_number("value", 4), F.lit(")"))),
        F.col("text"),
    )
    rows = report.select(
        F.try_element_at(pairs, F.col("section")).alias("section_no"),
        F.struct((-F.coalesce("n", F.lit(0))).alias("n"), "key").alias("line_no"),
        F.concat(F.lit("  "), shown).alias("value"),
    ).filter(F.col("section_no").isNotNull())
    spark = report.sparkSession
    titles = spark.createDataFrame([(i, sections[name]) for name, i in numbers.items()], "section_no int, title string")
    first = F.struct(F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("key"))
    headings = titles.select("section_no", first.alias("line_no"), F.col("title").alias("value"))
    return headings.unionByName(rows)


def write_report(report: DataFrame, sections: dict[str, str], folder: str, name: str) -> DataFrame:
    """name.json (a row per line) and name.txt; both hold one line per counted class, a few hundred at most.

    Returns the report, computed.
    """
    report = materialise(report)
    lines = report.select("section", "key", F.to_json(F.struct(*REPORT_COLUMNS)).alias("value"))
    write_single_text(lines, ["section", "key"], f"{folder}/{name}.json")
    write_single_text(report_lines(report, sections), ["section_no", "line_no"], f"{folder}/{name}.txt")
    return report
