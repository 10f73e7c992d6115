"""Threshold rules and the rows they hit."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from flowtriage.functions.numbers import lenient_integer
from flowtriage.schema import is_typed, text_flows


@dataclass(frozen=True)
class Rule:
    """A named SQL predicate over flow columns; a NULL predicate is no hit.

    `plain` is the same predicate over the columns of typed flows; a rule without one is evaluated on their text.
    """

    name: str
    condition: str
    text: str
    plain: str = ""


# Thresholds, ports and names of the four rules.
MAX_PACKETS = 1000
MAX_BYTES = 1_000_000
SENSITIVE_PORTS = [22, 23, 445, 3389]

RULES = [
    Rule("high_packet_count", f"{lenient_integer('total_pkts', 'BIGINT')} > {MAX_PACKETS}", "total_pkts > 1000",
         f"total_pkts > {MAX_PACKETS}"),
    Rule("high_bytes", f"{lenient_integer('total_bytes', 'BIGINT')} > {MAX_BYTES}", "total_bytes > 1000000",
         f"total_bytes > {MAX_BYTES}"),
    Rule("sensitive_port", f"{lenient_integer('dst_port', 'INT')} IN ({', '.join(map(str, SENSITIVE_PORTS))})",
         "dst_port in [22,23,445,3389]", f"dst_port IN ({', '.join(map(str, SENSITIVE_PORTS))})"),
    Rule("icmp_traffic", "upper(protocol) = 'ICMP'", "upper(protocol) == ICMP", "protocol_upper = 'ICMP'"),
]


def bound_rules(flows: DataFrame, rules: list[Rule]) -> tuple[DataFrame, list[Rule]]:
    """Flows and rules that go together: the plain predicates over typed flows if all rules have one, else text."""
    if not is_typed(flows):
        return flows, rules
    if not all(r.plain for r in rules):
        return text_flows(flows), rules
    return flows, [replace(r, condition=r.plain) for r in rules]


def rule_flags(rules: list[Rule] = RULES) -> list[Column]:
    """One 0/1 column per rule."""
    return [F.expr(f"CASE WHEN {r.condition} THEN 1 ELSE 0 END").alias(r.name) for r in rules]


def _named_hits(conditions: dict[str, str]) -> str:
    return ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in conditions.items())


def reasons(rules: list[Rule] = RULES) -> Column:
    """Comma-joined names of the rules hit, in rule order; '' without a hit."""
    return F.expr(f"concat_ws(',', {_named_hits({r.name: r.condition for r in rules})})")


def reasons_of_flags(rules: list[Rule] = RULES) -> Column:
    """The same text from the columns rule_flags made."""
    return F.expr(f"concat_ws(',', {_named_hits({r.name: f'{r.name} = 1' for r in rules})})")


def tag_reasons(flows: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    flows = text_flows(flows)
    return flows.withColumn("suspect_reason", reasons(rules))


def hit_rows(flows: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Rows hit by at least one rule, untagged; of typed flows the text."""
    flows, rules = bound_rules(flows, rules)
    return text_flows(flows.filter(" OR ".join(f"({r.condition})" for r in rules)))


def suspects(flows: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Tagged rows with a hit; the text is only built for those."""
    return tag_reasons(hit_rows(flows, rules), rules)


def rules_hit(flows: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The hits as an array column, for per-rule work on single rows."""
    flows = text_flows(flows)
    hits = _named_hits({r.name: r.condition for r in rules})
    return flows.withColumn("rules", F.expr(f"array_compact(array({hits}))"))


def require_nonempty(df: DataFrame, what: str = "suspects") -> DataFrame:
    """Stops the job when there is nothing to work on."""
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df
