from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowtriage.functions.envelopes import parse_body, unwrap_envelope
from flowtriage.functions.replies import parse_reply

NONE = "valid_json_no_reason"
CASES = [
    ('{"label":"attack","confidence":0.9,"reason":"r"}', ("attack", 0.9, "r")),
    ('```json\n{"label":"normal","confidence":0.4}\n```', ("normal", 0.4, NONE)),
    ('```JSON {"label":"normal"} ```', ("normal", None, NONE)),
    ('﻿{"label":" Attack "}', ("attack", None, NONE)),
    ('Sure! {"label":"malicious","confidence":"1.7"} ok', ("attack", 1.0, NONE)),
    ('[{"label":"benign","confidence":-3}]', ("normal", 0.0, NONE)),
    ('[{"label":"benign"}, 1]', ("normal", None, NONE)),
    ('result: [{"label":"normal traffic"}] !', ("normal", None, NONE)),
    ('{"label":"background","reason":"  "}', ("normal", None, NONE)),
    ('{"label":"anomaly","reason":" a\\nb "}', ("attack", None, "a\nb")),
    ('{"label":"suspicious","confidence":"n/a"}', ("attack", None, NONE)),
    ('{"label":"attack","label":"normal"}', ("normal", None, NONE)),
    ('{"label":"attack","confidence":true}', ("attack", 1.0, NONE)),
    ('{"label":"attack","confidence":false}', ("attack", 0.0, NONE)),
    ('{"label":"attack","confidence":"true"}', ("attack", None, NONE)),
    ('{"label":"attack","confidence":NaN}', ("attack", 1.0, NONE)),
    ('{"label":"attack","confidence":"nan"}', ("attack", 1.0, NONE)),
    ('{"label":"attack","confidence":"-inf"}', ("attack", 0.0, NONE)),
    ('{"label":"attack","confidence":"1_0e-1"}', ("attack", 1.0, NONE)),
    ('{"label":"attack","confidence":"0.9f"}', ("attack", None, NONE)),
    ('{"label":"attack","confidence":" .5 "}', ("attack", 0.5, NONE)),
    ('{"label":"attack","confidence":null}', ("attack", None, NONE)),
    ('{"label":"attack","confidence":[0.5]}', ("attack", None, NONE)),
    ('{"label":"attack","reason":null}', ("attack", None, "None")),
    ('{"label":"attack","reason":7}', ("attack", None, "7")),
    ('{"label":"attack","reason":"' + "é" * 400 + '"}', ("attack", None, "é" * 300)),
    ('{"label":"attack"} or {"label":"normal"}', None),
    ('{"label":"attack"}] {"label":"normal"}', None),
    ('{"label":"attack"},{"label":"normal"}', None),
    ("{'label':'attack'}", None),
    ('"attack"', ("attack", None, "single-word fallback")),
    ('"{\\"label\\":\\"attack\\"}"', None),
    ('["{\\"label\\":\\"attack\\"}"]', None),
    ("[1]", None),
    ("[]", None),
    ('[[{"label":"attack"}]]', ("attack", None, NONE)),
    ('{"label":"attack","note":"line\nbreak"}', None),
    ('{"label":"unknown"}', None),
    ('{"note":{"label":"attack"}}', None),
    ("attack.", ("attack", None, "single-word fallback")),
    (" 'Normal'! ", ("normal", None, "single-word fallback")),
    ("```\nnormal\n```", ("normal", None, "single-word fallback")),
    ("attack now", None),
    ("", None),
    (None, None),
]


def test_replies(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, reply string")
    rows = df.select("i", parse_reply(F.col("reply")).alias("v")).orderBy("i").collect()
    found = [None if r.v is None else tuple(r.v) for r in rows]
    wrong = [(CASES[i][0], found[i], CASES[i][1]) for i in range(len(CASES)) if found[i] != CASES[i][1]]
    assert wrong == []


ENVELOPES = [
    ("anthropic", '{"content":[{"text":"hi"}],"usage":{"input_tokens":5,"output_tokens":2}}', ("hi", 5, 2, None)),
    ("anthropic", '{"content":[{"text":"hi"}]}', ("hi", 300, 10, None)),
    ("anthropic", '{"content":[]}', (None, 300, 10, "no reply in the response body")),
    ("openai", '{"choices":[{"message":{"content":"x"}}],"usage":{"prompt_tokens":7,"completion_tokens":3}}',
     ("x", 7, 3, None)),
    ("deepseek", '{"choices":[{"message":{"content":"y"}}],"usage":{"prompt_tokens":8}}', ("y", 8, 10, None)),
    ("openai", '{"choices":[{"message":{"content":null}}]}', (None, 300, 10, "no reply in the response body")),
    ("google", '{"candidates":[{"content":{"parts":[{"text":" a"},{"text":"b "}]}}],'
               '"usageMetadata":{"promptTokenCount":9,"candidatesTokenCount":4}}', ("ab", 9, 4, None)),
    ("google", '{"candidates":[{"finishReason":"SAFETY","content":{"parts":[]}}]}',
     (None, 300, 10, "empty reply, finishReason=SAFETY")),
    ("google", '{"candidates":[]}', (None, 300, 10, "no reply in the response body")),
    ("openai", "not json", (None, 300, 10, "no reply in the response body")),
    ("openai", None, (None, 300, 10, "no reply in the response body")),
]


@pytest.mark.parametrize("provider, body, expected", ENVELOPES)
def test_envelopes(spark, provider, body, expected):
    df = spark.createDataFrame([(provider, body)], "provider string, body string")
    read = df.withColumn("b", parse_body(F.col("body"))).select(unwrap_envelope(F.col("provider"), F.col("b")).alias("e"))
    assert tuple(read.first().e) == expected
