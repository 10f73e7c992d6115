"""Flow tables, sample views and the prediction log: names and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from flowtriage.functions.numbers import lenient_integer

# The 13 positional flow columns.
FLOW_COLUMNS = [
    "timestamp", "duration", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
    "flags", "fwd_pkts", "bwd_pkts", "total_pkts", "total_bytes", "label",
]
FLOW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in FLOW_COLUMNS])

# The declared type of every flow column that is not text.
FLOW_TYPES = {
    "duration": "DOUBLE", "src_port": "INT", "dst_port": "INT", "fwd_pkts": "INT",
    "bwd_pkts": "INT", "total_pkts": "BIGINT", "total_bytes": "BIGINT",
}

#: What typed flows call the text of a column, and the protocol in capitals.
TEXT, UPPER_PROTOCOL = "_text", "protocol_upper"

# Columns that identify a record, in hashing order.
RECORD_ID_COLUMNS = [
    "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "duration",
    "total_pkts", "total_bytes",
]

# Columns that would give the answer away to a classifier.
SENSITIVE_COLUMNS = [
    "label", "ground_truth", "true_label", "binary_label", "suspect_reason", "is_attack",
    "attack_type",
]

API_COLUMNS = ["record_id", "sample_rank", *FLOW_COLUMNS[:-1]]
EVAL_COLUMNS = [*API_COLUMNS, "suspect_reason", "label"]

SAMPLE_SCHEMA = T.StructType(
    [T.StructField(name, T.LongType() if name == "sample_rank" else T.StringType()) for name in EVAL_COLUMNS]
)
API_SCHEMA = T.StructType([SAMPLE_SCHEMA[name] for name in API_COLUMNS])

PREDICTION_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("record_index", T.LongType()),
    T.StructField("record_id", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("reason", T.StringType()),
    T.StructField("raw_response", T.StringType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("latency_s", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])


def bind_flow_schema(df: DataFrame) -> DataFrame:
    """Names the 13 positional columns; any other column count is an error."""
    if len(df.columns) != len(FLOW_COLUMNS):
        raise ValueError(f"expected {len(FLOW_COLUMNS)} columns, found {len(df.columns)}: {df.columns}")
    return df.toDF(*FLOW_COLUMNS)


def typed_flows(flows: DataFrame) -> DataFrame:
    """Declared types, with the text of each typed column beside it; what does not parse becomes NULL.

    Whole numbers are read as the rules read them, so `1500.7` packets are 1500 here and there. Rules on a typed copy are
    plain comparisons, which reach the Parquet row groups; casts around text cannot. Ids, hashes and exports go by the
    text, which text_flows gives back.
    """
    typed = []
    for c in FLOW_COLUMNS:
        kind = FLOW_TYPES.get(c)
        value = F.col(c) if kind is None else F.col(c).try_cast(kind) if kind == "DOUBLE" else F.expr(lenient_integer(c, kind))
        typed.append(value.alias(c))
    texts = [F.col(c).alias(c + TEXT) for c in FLOW_TYPES]
    return flows.select(*typed, *texts, F.upper("protocol").alias(UPPER_PROTOCOL))


def is_typed(flows: DataFrame) -> bool:
    """Whether a table comes from typed_flows."""
    return {c + TEXT for c in FLOW_TYPES} | {UPPER_PROTOCOL} <= set(flows.columns)


def text_flows(flows: DataFrame) -> DataFrame:
    """The text columns of typed flows, whatever other columns they have; other flows as they are."""
    if not is_typed(flows):
        return flows
    made = {c + TEXT for c in FLOW_TYPES} | {UPPER_PROTOCOL}
    return flows.select(*[F.col(c + TEXT).alias(c) if c in FLOW_TYPES else F.col(c) for c in flows.columns if c not in made])


def api_view(sample: DataFrame) -> DataFrame:
    """What a classifier may see: no label, no rule names."""
    return sample.select(*API_COLUMNS)


def eval_view(sample: DataFrame) -> DataFrame:
    return sample.select(*EVAL_COLUMNS)


def drop_sensitive(df: DataFrame) -> DataFrame:
    return df.drop(*SENSITIVE_COLUMNS)
