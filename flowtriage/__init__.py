"""Flow triage, sampling and classifier evaluation as Spark DataFrame operators."""
