"""A classifier for trials, and the bodies that providers send."""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, field

from pyspark import cloudpickle

from flowtriage.functions.prompts import PROMPT_HEAD
from flowtriage.operators.rules import MAX_BYTES, MAX_PACKETS, SENSITIVE_PORTS


@dataclass(frozen=True)
class RuleScorer:
    """A classifier for trials: an attack when enough threshold rules hit the record."""

    min_hits: dict[str, int] = field(default_factory=dict)

    def __call__(self, request: dict) -> tuple[int, str]:
        record = json.loads(request["prompt"].removeprefix(PROMPT_HEAD).split("\n", 1)[0])

        def number(name: str) -> float:
            try:
                return float(record.get(name, 0))
            except ValueError:
                return 0.0

        hits = sum([
            number("total_pkts") > MAX_PACKETS,
            number("total_bytes") > MAX_BYTES,
            number("dst_port") in SENSITIVE_PORTS,
            record.get("protocol", "").upper() == "ICMP",
        ])
        label = "attack" if hits >= self.min_hits.get(request["model_name"], 1) else "normal"
        reply = json.dumps({"label": label, "confidence": round(0.5 + hits / 10, 1), "reason": f"{hits} rules"})
        return 200, json.dumps(envelope(request["provider"], reply, 300 + hits, 10 + hits))


def envelope(provider: str, reply: str, tokens_in: int, tokens_out: int) -> dict:
    """A response body in the shape the provider sends."""
    if provider == "anthropic":
        return {"content": [{"text": reply}], "usage": {"input_tokens": tokens_in, "output_tokens": tokens_out}}
    if provider == "google":
        return {"candidates": [{"finishReason": "STOP", "content": {"parts": [{"text": reply}]}}],
                "usageMetadata": {"promptTokenCount": tokens_in, "candidatesTokenCount": tokens_out}}
    return {"choices": [{"message": {"content": reply}}],
            "usage": {"prompt_tokens": tokens_in, "completion_tokens": tokens_out}}


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests
