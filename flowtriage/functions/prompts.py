"""Prompt text for one record."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The wording every record is sent with.
PROMPT_HEAD = """You are a network security analyst specialising in intrusion detection.

Classify the following network flow record as either attack or normal.

Network flow JSON:
"""
PROMPT_FIELDS = """

Field meanings:
- timestamp: capture time
- duration: flow duration in seconds
- src_ip / dst_ip: source and destination IP addresses
- src_port / dst_port: source and destination ports
- protocol: network protocol
- flags: TCP flags
- fwd_pkts / bwd_pkts: forward and backward packet counts
- total_pkts: total packets in the flow
- total_bytes: total bytes transferred

Rules:
- Use only the provided flow features.
- Do not invent missing information.
"""
PROMPT_TAIL = """- Return JSON only. Do not use Markdown. Do not add explanations outside JSON.
- The label must be exactly one of: attack, normal.
- confidence must be a number from 0.0 to 1.0.
- reason must be short, maximum 20 words.

Return ONLY this compact JSON, no explanation:
{"label":"attack","confidence":0.8,"reason":"max 20 words"}
"""
# What each policy says about doubtful records.
POLICIES = {
    "balanced": "- If uncertain, choose normal.\n",
    "aggressive": (
        "- If there are any suspicious indicators, classify as attack.\n"
        "- Do not default to normal when uncertain.\n"
    ),
    "conservative": (
        "- Be conservative when labeling a record as attack.\n"
        "- Label as \"attack\" only if there is strong evidence from the flow features, such as very high "
        "packet/byte counts, suspicious service ports, unusual protocol behavior, or clearly abnormal traffic "
        "patterns.\n"
        "- If the evidence is weak, normal-looking, or uncertain, choose \"normal\".\n"
        "- Avoid labeling normal background traffic as attack unless multiple suspicious indicators are present.\n"
        "- Do not label a record as attack based on one weak indicator only; require multiple suspicious "
        "indicators when possible.\n"
        "- Use high confidence only when evidence is strong; use lower confidence when evidence is limited.\n"
    ),
}


def record_json(columns: dict[str, str]) -> Column:
    """JSON of the named columns (name -> Spark type): keys sorted, blanks after , and :, NULLs left out."""

    def member(name: str, spark_type: str) -> Column:
        value = F.col(name)
        if spark_type == "string":
            # the array's JSON text without its brackets is the quoted, escaped string
            text = F.to_json(F.array(value))
            quoted = F.substring(text, F.lit(2), F.length(text) - 2)
        else:
            quoted = value.cast("string")
        return F.when(value.isNotNull(), F.concat(F.lit(f'"{name}": '), quoted))

    return F.concat(F.lit("{"), F.concat_ws(", ", *[member(c, columns[c]) for c in sorted(columns)]), F.lit("}"))


def render_prompt(record: Column, policy: str) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), record, F.lit(PROMPT_FIELDS + POLICIES[policy] + PROMPT_TAIL))
