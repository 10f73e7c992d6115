"""Free-form classifier replies to verdicts, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from flowtriage.functions.labels import VERDICTS, normalise_verdict
from flowtriage.functions.text import strip

STRICT = {"allowSingleQuotes": "false"}
# A private-use character that closes the wrapper array below.
END = "\ue0f0"

# Fence spellings, byte order mark, punctuation around a single word, texts and limits.
FENCES = ["```json", "```JSON", "```"]
BYTE_ORDER_MARK = "\ufeff"
WORD_PUNCTUATION = ".:;!\\\"'"
NO_REASON = "valid_json_no_reason"
SINGLE_WORD = "single-word fallback"
REASON_CHARS = 300

_NUMBER = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
_INFINITE = r"(?i)^[+-]?inf(inity)?$"
_NAN = r"(?i)^[+-]?nan$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once and hands it to body under a name."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_reply(reply: Column) -> Column:
    text = strip(F.coalesce(reply, F.lit("")))
    for fence in FENCES:
        text = F.replace(text, F.lit(fence), F.lit(""))
    return strip(F.replace(strip(text), F.lit(BYTE_ORDER_MARK), F.lit("")))


def reply_candidates(text: Column) -> Column:
    """Texts worth parsing, in order: all of it, outermost braces, outermost brackets."""
    return F.array_distinct(F.array_compact(F.array(
        F.when(text.startswith("{") | text.startswith("["), text),
        F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")),
        F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")),
    )))


def json_object(text: Column) -> Column:
    """The text of the one object in text, or of the object heading the one list; else NULL.

    from_json stops after the first value and ignores what follows. Put in an
    array with an end mark, any trailing text breaks the array or its size.
    """
    wrapped = F.from_json(F.concat(F.lit("["), text, F.lit(f',"{END}"]')), "array<string>", STRICT)

    def pick(parts: Column) -> Column:
        whole = F.size(parts).eqNullSafe(2) & F.get(parts, F.lit(1)).eqNullSafe(END)
        first = F.get(parts, F.lit(0))
        head = F.get(F.from_json(first, "array<string>", STRICT), F.lit(0))
        return (
            F.when(whole & text.startswith("{"), first)
            .when(whole & text.startswith("[") & first.startswith("[{"), head)
        )

    return _let(wrapped, pick)


def clamp_confidence(value: Column) -> Column:
    """Number in [0, 1] from its text; NULL when it is no number."""

    def clamp(text: Column) -> Column:
        number = (
            F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
            .when(text.rlike(_INFINITE), text.try_cast("double"))
            .when(text.rlike(_NAN), F.lit(1.0))
        )
        return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))

    return _let(strip(value), clamp)


def _read_object(text: Column) -> Column:
    """prediction, confidence and reason of one object text."""

    def read(entries: Column) -> Column:
        def field(name: str) -> Column:
            # the last of repeated keys counts
            return F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(-1))

        confidence = field("confidence")["value"]
        flag = F.from_json(text, "confidence BOOLEAN", STRICT)["confidence"]
        reason = field("reason")
        words = strip(F.when(reason.isNull(), F.lit("")).otherwise(F.coalesce(reason["value"], F.lit("None"))))
        return F.struct(
            normalise_verdict(field("label")["value"]).alias("prediction"),
            F.when(confidence.isin("true", "false") & flag.isNotNull(), flag.cast("double"))
            .otherwise(clamp_confidence(confidence)).alias("confidence"),
            F.substring(F.when(words == "", F.lit(NO_REASON)).otherwise(words), 1, REASON_CHARS).alias("reason"),
        )

    return _let(F.map_entries(F.from_json(text, "map<string,string>", STRICT)), read)


def _single_word(text: Column) -> Column:
    word = strip(strip(F.lower(text)), WORD_PUNCTUATION)
    return F.when(
        word.isin(VERDICTS),
        F.struct(word.alias("prediction"), F.lit(None).cast("double").alias("confidence"),
                 F.lit(SINGLE_WORD).alias("reason")),
    )


def parse_reply(reply: Column) -> Column:
    """STRUCT<prediction, confidence, reason>, NULL when the reply holds no verdict."""

    def parse(text: Column) -> Column:
        verdicts = F.transform(reply_candidates(text), lambda c: _let(json_object(c), _read_object))
        return F.coalesce(
            F.get(F.filter(verdicts, lambda v: v["prediction"].isNotNull()), F.lit(0)), _single_word(text)
        )

    return _let(clean_reply(reply), parse)
