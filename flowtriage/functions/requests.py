"""What is sent to a provider, as a column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Limits and settings of a request.
MAX_TOKENS, GOOGLE_MAX_TOKENS = 200, 512
JSON_REPLY = '"response_format":{"type":"json_object"}'
GOOGLE_SETTINGS = (
    f'"generationConfig":{{"maxOutputTokens":{GOOGLE_MAX_TOKENS},"temperature":0,'
    '"responseMimeType":"application/json","thinkingConfig":{"thinkingBudget":0}}')


def quoted(text: Column) -> Column:
    """A text as JSON, with its quotes."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def request_body(provider: Column, model_id: Column, prompt: Column) -> Column:
    """The JSON body of one request; the model of google's is named in its address. Other providers have none."""
    message = F.concat(F.lit('"messages":[{"role":"user","content":'), quoted(prompt), F.lit("}]"))
    chat = F.concat(
        F.lit('{"model":'), quoted(model_id), F.lit(f',"max_tokens":{MAX_TOKENS},"temperature":0,'), message)
    return (
        F.when(provider == "anthropic", F.concat(chat, F.lit("}")))
        .when(provider.isin("openai", "deepseek"), F.concat(chat, F.lit("," + JSON_REPLY + "}")))
        .when(provider == "google", F.concat(
            F.lit('{"contents":[{"role":"user","parts":[{"text":'), quoted(prompt), F.lit("}]}]," + GOOGLE_SETTINGS + "}")))
    )
