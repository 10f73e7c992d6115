"""Reply text and token counts out of the providers' response bodies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowtriage.functions.text import strip

# Token counts assumed when a body reports none.
DEFAULT_INPUT_TOKENS = 300
DEFAULT_OUTPUT_TOKENS = 10

# One schema for all providers; each body fills its own part.
BODY_SCHEMA = """
    content ARRAY<STRUCT<text: STRING>>,
    choices ARRAY<STRUCT<message: STRUCT<content: STRING>>>,
    candidates ARRAY<STRUCT<finishReason: STRING, content: STRUCT<parts: ARRAY<STRUCT<text: STRING>>>>>,
    usage STRUCT<input_tokens: BIGINT, output_tokens: BIGINT, prompt_tokens: BIGINT, completion_tokens: BIGINT>,
    usageMetadata STRUCT<promptTokenCount: BIGINT, candidatesTokenCount: BIGINT>
"""


def parse_body(body: Column) -> Column:
    return F.from_json(body, BODY_SCHEMA)


def unwrap_envelope(provider: Column, parsed: Column) -> Column:
    """STRUCT<reply, input_tokens, output_tokens, error> from a body parsed by parse_body."""
    first = F.lit(0)
    candidate = F.get(parsed["candidates"], first)
    parts = F.transform(candidate["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit("")))
    joined = F.nullif(strip(F.array_join(parts, "")), F.lit(""))
    chat = F.get(parsed["choices"], first)["message"]["content"]
    usage, meta = parsed["usage"], parsed["usageMetadata"]

    reply = (
        F.when(provider == "anthropic", F.get(parsed["content"], first)["text"])
        .when(provider.isin("openai", "deepseek"), chat)
        .when(provider == "google", joined)
    )
    tokens_in = (
        F.when(provider == "anthropic", usage["input_tokens"])
        .when(provider == "google", meta["promptTokenCount"])
        .otherwise(usage["prompt_tokens"])
    )
    tokens_out = (
        F.when(provider == "anthropic", usage["output_tokens"])
        .when(provider == "google", meta["candidatesTokenCount"])
        .otherwise(usage["completion_tokens"])
    )
    error = (
        F.when(reply.isNotNull(), F.lit(None))
        .when((provider == "google") & candidate.isNotNull(),
              F.concat(F.lit("empty reply, finishReason="), F.coalesce(candidate["finishReason"], F.lit(""))))
        .otherwise(F.lit("no reply in the response body"))
    )
    return F.struct(
        reply.alias("reply"),
        F.coalesce(tokens_in, F.lit(DEFAULT_INPUT_TOKENS).cast("bigint")).alias("input_tokens"),
        F.coalesce(tokens_out, F.lit(DEFAULT_OUTPUT_TOKENS).cast("bigint")).alias("output_tokens"),
        error.alias("error"),
    )
