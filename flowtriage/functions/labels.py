"""Class labels and verdict words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowtriage.functions.text import strip

# Verdicts and the words that stand for them.
VERDICTS = ["attack", "normal"]
NORMAL_WORDS = ["normal", "benign", "normal traffic", "background"]
ATTACK_WORDS = ["attack", "malicious", "anomaly", "suspicious"]


def binary_label(label: Column) -> Column:
    """background is normal traffic; every other class, also a missing one, is an attack."""
    plain = F.lower(strip(F.coalesce(label.cast("string"), F.lit(""))))
    return F.when(plain == "background", F.lit("normal")).otherwise(F.lit("attack"))


def normalise_verdict(word: Column) -> Column:
    """attack, normal, or NULL for anything that means neither."""
    plain = F.lower(strip(word))
    return F.when(plain.isin(NORMAL_WORDS), F.lit("normal")).when(plain.isin(ATTACK_WORDS), F.lit("attack"))
