"""Every operator as a query over the given tables, with the same result in SQL.

All queries work on whole tables: flows are derived from lineitem, classifier
calls from documents, truth from labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowtriage import fixtures
from flowtriage.functions import envelopes, identity, labels as label_functions, numbers, replies
from flowtriage.functions.prompts import POLICIES, PROMPT_FIELDS, PROMPT_HEAD, PROMPT_TAIL
from flowtriage.operators import calls, callstats, evaluation, profile, ranking, rules, sampling, scoring
from flowtriage.operators.models import MODELS, PRICES
from flowtriage.plans import evaluation_job, sampling_job
from flowtriage.schema import (
    API_COLUMNS, EVAL_COLUMNS, FLOW_COLUMNS, FLOW_SCHEMA, FLOW_TYPES, RECORD_ID_COLUMNS, SAMPLE_SCHEMA, api_view, drop_sensitive,
    eval_view, typed_flows,
)
from flowtriage.session import materialise, scratch, scratch_path, shared_dir
from flowtriage.sources import exports, flows as flow_source, jsonl, predictions, storage
from flowtriage.streaming import live

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


# ---------------------------------------------------------------- SQL side

RULE_NAMES = [r.name for r in rules.RULES]


def _spelled(columns: list[str]) -> str:
    return ", ".join(f"coalesce({c}, 'NULL')" for c in columns)


def _rounded(value: str, digits: int) -> str:
    return f"cast(format('{{:.{digits}f}}', {value}) AS DOUBLE)"


def _pct(part: str, whole: str, digits: int = 4) -> str:
    share = f"cast({part} AS DOUBLE) / cast({whole} AS DOUBLE) * 100"
    return f"CASE WHEN coalesce({whole}, 0) = 0 THEN 0.0 ELSE {_rounded(share, digits)} END"


def _ratio(part: str, whole: str) -> str:
    return f"CASE WHEN coalesce({whole}, 0) = 0 THEN 0.0 ELSE cast({part} AS DOUBLE) / cast({whole} AS DOUBLE) END"


def _names(columns: list[str]) -> str:
    return ", ".join(columns)


_REASONS = "concat_ws(',', " + ", ".join(f"CASE WHEN {r} = 1 THEN '{r}' END" for r in RULE_NAMES) + ")"
_SEEDED = f"md5(concat_ws('|', '{sampling.SEED}', {_spelled(FLOW_COLUMNS)}))"

_FLOW_TABLES = f"""
flows AS ({fixtures.flows_sql()}),
flagged AS (
    SELECT *,
           CASE WHEN try_cast(total_pkts AS BIGINT) > 1000 THEN 1 ELSE 0 END AS high_packet_count,
           CASE WHEN try_cast(total_bytes AS BIGINT) > 1000000 THEN 1 ELSE 0 END AS high_bytes,
           CASE WHEN try_cast(dst_port AS INT) IN (22, 23, 445, 3389) THEN 1 ELSE 0 END AS sensitive_port,
           CASE WHEN upper(protocol) = 'ICMP' THEN 1 ELSE 0 END AS icmp_traffic
    FROM flows),
tagged AS (SELECT *, {_REASONS} AS suspect_reason FROM flagged),
suspects AS (SELECT * FROM tagged WHERE suspect_reason <> ''),
hashed AS (
    SELECT *, {_SEEDED} AS h, sha256(concat_ws('|', {_spelled(RECORD_ID_COLUMNS)})) AS record_id FROM suspects),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS nth, row_number() OVER (ORDER BY h) AS position
    FROM hashed),
sample AS (
    SELECT *, row_number() OVER (ORDER BY timestamp, record_id) AS sample_rank FROM numbered
    WHERE label = 'background' AND nth <= 4700 OR label = 'blacklist' AND nth <= 290 OR label = 'anomaly-sshscan'),
prefixes AS (
    SELECT * FROM (VALUES ('sample_1000', 1000), ('sample_3000', 3000), ('sample_5000', 5000)) AS p(sample, k)),
nested AS (SELECT p.sample, p.k, s.* FROM prefixes AS p JOIN sample AS s ON s.sample_rank <= p.k)
"""

_COUNTERS = f"""
           count(*) FILTER (WHERE status = 'ok') AS calls,
           count(*) FILTER (WHERE status = 'error') AS errors,
           cast(sum(input_tokens) AS BIGINT) AS input_tokens,
           cast(sum(output_tokens) AS BIGINT) AS output_tokens,
           cast(sum(CASE WHEN status = 'ok' THEN cast(latency_s AS DECIMAL(18,3)) ELSE 0 END) AS DOUBLE)
               AS total_latency,
           min(CASE WHEN status = 'ok' THEN latency_s END) AS min_latency,
           max(CASE WHEN status = 'ok' THEN latency_s END) AS max_latency,
           count(*) FILTER (WHERE prediction = 'attack') AS pred_attack,
           count(*) FILTER (WHERE prediction = 'normal') AS pred_normal,
           count(*) FILTER (WHERE status = 'error') AS pred_error,
           coalesce(cast(sum(cast(confidence AS DECIMAL(18,12))) AS DOUBLE), 0.0) AS confidence_sum,
           count(confidence) AS confidence_count,
           count(*) FILTER (WHERE confidence < 0.5) AS low_confidence
"""
_MODEL_ROWS = ", ".join(
    f"('{m.model_name}', {m.model_ord}, '{m.provider}', '{m.model_id}', {PRICES[m.model_name][0]!r}, "
    f"{PRICES[m.model_name][1]!r})" for m in MODELS
)
_LOG_TABLES = f"""
models AS (SELECT model_name, model_ord, provider, model_id, cast(p_in AS DOUBLE) AS p_in, cast(p_out AS DOUBLE) AS p_out
           FROM (VALUES {_MODEL_ROWS}) AS m(model_name, model_ord, provider, model_id, p_in, p_out)),
calls AS ({fixtures.calls_sql()}),
log AS ({fixtures.prediction_log_sql()}),
latest AS (SELECT * EXCLUDE (nth) FROM (
    SELECT *, row_number() OVER (PARTITION BY model_name, record_id ORDER BY run DESC) AS nth FROM log) WHERE nth = 1),
eval_rows AS ({fixtures.eval_rows_sql()}),
truth AS (SELECT record_id, CASE WHEN label = 'background' THEN 'normal' ELSE 'attack' END AS truth FROM eval_rows),
judged AS (
    SELECT latest.*, truth,
           CASE WHEN truth IS NULL THEN 'missing_truth'
                WHEN prediction NOT IN ('attack', 'normal') THEN 'invalid_prediction'
                WHEN truth = 'attack' AND prediction = 'attack' THEN 'TP'
                WHEN truth = 'attack' THEN 'FN'
                WHEN prediction = 'attack' THEN 'FP' ELSE 'TN' END AS outcome
    FROM latest LEFT JOIN truth USING (record_id)),
confusion AS (
    SELECT model_name, model_ord,
           {", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in evaluation.OUTCOMES)},
           count(*) FILTER (WHERE outcome IN ('TP', 'FP', 'TN', 'FN')) AS total_valid
    FROM judged GROUP BY ALL),
rates AS (
    SELECT *, {_ratio('TP', '(TP + FP)')} AS p, {_ratio('TP', '(TP + FN)')} AS r FROM confusion),
metrics AS (
    SELECT * EXCLUDE (p, r), {_rounded('p', 6)} AS precision, {_rounded('r', 6)} AS recall_sensitivity,
           {_rounded(_ratio('TN', '(TN + FP)'), 6)} AS specificity,
           {_rounded('CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END', 6)} AS f1,
           {_rounded(_ratio('FP', '(FP + TN)'), 6)} AS false_positive_rate,
           {_rounded(_ratio('FN', '(FN + TP)'), 6)} AS false_negative_rate,
           {_rounded(_ratio('(TP + TN)', 'total_valid'), 6)} AS accuracy
    FROM rates),
stats AS (SELECT model_name, model_ord, {_COUNTERS}, cast(0 AS BIGINT) AS skipped_resume FROM log GROUP BY ALL),
costed AS (
    SELECT stats.*, {_rounded('input_tokens / 1000.0::DOUBLE * p_in + output_tokens / 1000.0::DOUBLE * p_out', 6)}
               AS estimated_cost
    FROM stats JOIN models USING (model_name, model_ord))
"""


def _flow_sql(sql: str) -> str:
    return f"WITH {_FLOW_TABLES} {sql}"


def _log_sql(sql: str) -> str:
    return f"WITH {_LOG_TABLES} {sql}"


def _json_sql(columns: list[str]) -> str:
    def member(c: str) -> str:
        value = f"cast({c} AS VARCHAR)" if c == "sample_rank" else f"'\"' || {c} || '\"'"
        return f"'\"{c}\":' || {value}"

    return "'{' || concat_ws(',', " + ", ".join(member(c) for c in columns) + ") || '}'"


def _record_sql() -> str:
    """JSON of the label-free record: sorted keys, blanks after comma and colon."""
    def member(c: str) -> str:
        value = f"cast({c} AS VARCHAR)" if c == "sample_rank" else f"'\"' || {c} || '\"'"
        return f"'\"{c}\": ' || {value}"

    return "'{' || concat_ws(', ', " + ", ".join(member(c) for c in sorted(API_COLUMNS)) + ") || '}'"


def _prompt_sql(policy: str) -> str:
    tail = fixtures.quoted(PROMPT_FIELDS + POLICIES[policy] + PROMPT_TAIL)
    return f"{fixtures.quoted(PROMPT_HEAD)} || {_record_sql()} || {tail}"


# ---------------------------------------------------------------- Spark side

flows, flows_once = fixtures.flows, fixtures.flows_once


def _suspects(spark: SparkSession, sf_dir: str, source: Query = flows) -> DataFrame:
    return rules.suspects(source(spark, sf_dir))


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_cube(flows(spark, sf_dir))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling_job.ranked_sample(flows(spark, sf_dir), materialise(_cube(spark, sf_dir)))


_STORED: dict[tuple[str, str], str] = {}


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked sample as input of later steps, drawn once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = scratch_path(spark, "sample")
        _ranked(spark, sf_dir).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.prediction_log(spark, sf_dir)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.truth_of(fixtures.eval_rows(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.outcomes(predictions.latest_predictions(_log(spark, sf_dir)), _truth(spark, sf_dir))


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion_matrix(_judged(spark, sf_dir))


# -- sources and sinks

@query(_flow_sql(f"SELECT {_names(FLOW_COLUMNS)} FROM flows"))
def scan_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional Parquet columns, bound to their names."""
    return flows(spark, sf_dir)


@query(_flow_sql(f"SELECT {_names(FLOW_COLUMNS)} FROM flows"))
def ingest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    csv, parquet = scratch_path(spark, "csv"), scratch_path(spark, "parquet")
    flows_once(spark, sf_dir).write.csv(csv, header=False)
    flow_source.ingest_csv(spark, csv, parquet)
    return flow_source.scan_flows(spark, parquet)


_TYPED = ", ".join(f"try_cast({c} AS {FLOW_TYPES[c]}) AS {c}" if c in FLOW_TYPES else c for c in FLOW_COLUMNS)


@query(_flow_sql(f"SELECT {_TYPED}, {', '.join(f'{c} AS {c}_text' for c in FLOW_TYPES)}, upper(protocol) AS protocol_upper FROM flows"))
def typed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_flows(flows_once(spark, sf_dir))


@query(_flow_sql(f"SELECT {_names(FLOW_COLUMNS)} FROM flows"))
def read_jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    jsonl.write_packed_jsonl(flows_once(spark, sf_dir), FLOW_COLUMNS, path)
    return jsonl.read_jsonl_strict(spark, path, FLOW_SCHEMA)


@query(_log_sql("""
    SELECT record_id, model_name, record_index, prediction, confidence, reason, input_tokens, output_tokens,
           latency_s, status FROM latest"""))
def read_prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON lines log with broken lines, rows without id and repeated ids: the last row per id counts."""
    path = scratch_path(spark, "log")
    log = _log(spark, sf_dir)
    line = jsonl.json_line(predictions.LOG_SCHEMA.names)
    for run in ("r0", "r1"):
        rows = log.filter(F.col("run_id") == run)
        anonymous = rows.withColumn("record_id", F.lit("")).select(line.alias("value"))
        broken = rows.select(F.concat(F.substring(line, 1, 40), F.lit(" {")).alias("value"))
        rows.select(line.alias("value")).union(anonymous).union(broken).write.mode("append").text(path)
    return predictions.read_prediction_log(spark, path).select(
        "record_id", "model_name", "record_index", "prediction", "confidence", "reason", "input_tokens",
        "output_tokens", "latency_s", "status",
    )


@query(_flow_sql(f"SELECT {_json_sql(EVAL_COLUMNS)} AS value FROM sample"))
def to_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.to_jsonl(_sample(spark, sf_dir), EVAL_COLUMNS)


_EXPORTED = " UNION ALL ".join(
    f"SELECT sample, '{view}' AS view, {_json_sql(columns)} AS value FROM nested" for view, columns in exports.VIEWS.items())


@query(_flow_sql("""
    SELECT sample || '_' || v.name || '.jsonl' AS file, count(*) AS expected_lines, count(*) AS line_count,
           true AS line_count_ok
    FROM nested, (VALUES ('api'), ('eval')) AS v(name) GROUP BY ALL"""))
def export_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six files, read back and counted."""
    expected = exports.export_samples(_sample(spark, sf_dir), scratch_path(spark, "export"))
    verified = exports.require_complete(exports.verify_export(spark, expected))
    return verified.select("file", "expected_lines", "line_count", "line_count_ok")


@query(_flow_sql(_EXPORTED))
def exported_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the six files."""
    path = scratch_path(spark, "export")
    exports.export_samples(_sample(spark, sf_dir), path)
    name = F.regexp_extract("_metadata.file_name", "^(.*)_(api|eval)[.]jsonl$", 1)
    view = F.regexp_extract("_metadata.file_name", "^(.*)_(api|eval)[.]jsonl$", 2)
    return spark.read.text(path).select(name.alias("sample"), view.alias("view"), "value")


@query(_flow_sql(_EXPORTED))
def export_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the folders."""
    path = scratch_path(spark, "sharded")
    exports.export_sharded(_sample(spark, sf_dir), path)
    return spark.read.schema("value STRING, sample STRING, view STRING").text(path).select("sample", "view", "value")


@query(_flow_sql(f"SELECT {_names(EVAL_COLUMNS)} FROM sample WHERE sample_rank <= 3000"))
def reread_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled export file, read back strictly: the same rows again."""
    path = scratch_path(spark, "sample_3000_eval.jsonl")
    jsonl.write_single_jsonl(sampling.nested_prefix(_sample(spark, sf_dir), 3000), EVAL_COLUMNS, path)
    return jsonl.read_jsonl_strict(spark, path, SAMPLE_SCHEMA)


@query(_log_sql("""
    SELECT record_id, record_index, model_name, run_id, status, prediction, input_tokens FROM log WHERE model_name <> 'gemini'"""))
def append_and_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appended runs, the second written twice, one model's rows discarded."""
    path = scratch_path(spark, "log")
    log = _log(spark, sf_dir)
    for run in ("r0", "r1", "r1"):
        predictions.append_predictions(log.filter(F.col("run_id") == run), path, run)
    predictions.reset_outputs(spark, path, ["gemini"])
    return predictions.read_log(spark, path).select(
        "record_id", "record_index", "model_name", "run_id", "status", "prediction", "input_tokens")


@query(_log_sql("SELECT record_id, model_name, status FROM log WHERE run = 0"))
def log_two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run, two writers that both begin with batch 0: neither replaces rows of the other."""
    path, rows = scratch_path(spark, "log"), _log(spark, sf_dir).filter("run_id = 'r0'")
    for writer, part in (("a", F.col("record_index") % 2 == 0), ("b", F.col("record_index") % 2 == 1)):
        predictions.append_predictions(rows.filter(part), path, "r0", 0, writer)
    return predictions.read_log(spark, path).select("record_id", "model_name", "status")


@query(_log_sql("""
    SELECT record_id, model_name, 'run' || cast(cast(substr(record_id, 2) AS BIGINT) % 12 AS VARCHAR) AS run_id
    FROM log WHERE run = 0"""))
def log_many_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve runs, each over fewer records: the last run of a record counts, run11 after run9."""
    path, rows = scratch_path(spark, "log"), _log(spark, sf_dir).filter("run_id = 'r0'")
    last = F.substring("record_id", 2, 20).cast("bigint") % 12
    for n in range(12):
        predictions.append_predictions(rows.filter(last >= n), path, f"run{n}")
    latest = predictions.latest_predictions(predictions.read_log(spark, path))
    return latest.select("record_id", "model_name", "run_id")


@query(_log_sql("SELECT record_id, model_name, prediction, confidence, status FROM latest"))
def log_copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON lines log whose older run was written to its folder last."""
    path, log = scratch_path(spark, "log"), _log(spark, sf_dir)
    for run in ("r1", "r0"):
        jsonl.to_jsonl(log.filter(F.col("run_id") == run), predictions.LOG_SCHEMA.names).write.mode("append").text(path)
    return predictions.read_prediction_log(spark, path).select(
        "record_id", "model_name", "prediction", "confidence", "status")


@query(_log_sql("SELECT record_id, model_name, record_index, run_id FROM log WHERE status = 'error'"))
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).filter(F.col("status") == "error").select(
        "record_id", "model_name", "record_index", "run_id"
    )


@query(_flow_sql(f"SELECT {_names(API_COLUMNS)} FROM sample WHERE sample_rank <= 150"))
def limit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 150 records in rank order."""
    return sampling.limit_records(api_view(_sample(spark, sf_dir)), 150)


# -- rules, ids and views

@query(_flow_sql(f"SELECT {_names(FLOW_COLUMNS)}, {_names(RULE_NAMES)} FROM flagged"))
def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_once(spark, sf_dir).select(*FLOW_COLUMNS, *rules.rule_flags())


@query(_flow_sql(f"SELECT {_names(FLOW_COLUMNS)}, suspect_reason FROM tagged"))
def tag_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.tag_reasons(flows_once(spark, sf_dir))


@query(_flow_sql(f"SELECT {_names(FLOW_COLUMNS)}, suspect_reason FROM suspects"))
def suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.require_nonempty(_suspects(spark, sf_dir, flows_once))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows by way of a CSV file and a typed ingest."""
    csv, parquet = scratch_path(spark, "csv"), scratch_path(spark, "typed")
    flows_once(spark, sf_dir).write.csv(csv, header=False)
    flow_source.ingest_csv(spark, csv, parquet, typed=True)
    return flow_source.scan_typed_flows(spark, parquet)


@query(_flow_sql(f"SELECT {_names(FLOW_COLUMNS)}, suspect_reason, record_id FROM hashed"))
def typed_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspects and their ids out of a typed copy, whose filters reach the row groups: the same as out of text."""
    return sampling.with_record_id(rules.suspects(_typed(spark, sf_dir)))


@query(_flow_sql("""
    SELECT rule, label, count(*) AS n FROM (SELECT unnest(string_split(suspect_reason, ',')) AS rule, label FROM suspects)
    GROUP BY ALL"""))
def rules_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = rules.rules_hit(flows_once(spark, sf_dir))
    return hit.select(F.explode("rules").alias("rule"), "label").groupBy("rule", "label").agg(F.count("*").alias("n"))


@query(_flow_sql(f"SELECT {_names(FLOW_COLUMNS)}, record_id FROM hashed"))
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.with_record_id(_suspects(spark, sf_dir, flows_once)).select(*FLOW_COLUMNS, "record_id")


@query(_flow_sql(f"SELECT {_names(API_COLUMNS)} FROM sample"))
def sample_api_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api_view(_sample(spark, sf_dir))


@query(_flow_sql(f"SELECT {_names(EVAL_COLUMNS)} FROM sample"))
def sample_eval_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_view(_sample(spark, sf_dir))


@query(_flow_sql(f"SELECT {_names(FLOW_COLUMNS[:-1])} FROM suspects"))
def without_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_sensitive(_suspects(spark, sf_dir, flows_once))


@query(_flow_sql("""
    SELECT label, CASE WHEN label = 'background' THEN 'normal' ELSE 'attack' END AS binary_label, count(*) AS n
    FROM flows GROUP BY ALL"""))
def binary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = flows_once(spark, sf_dir).withColumn(
        "binary_label", label_functions.binary_label(F.concat(F.lit(" "), F.upper("label"), F.lit("\t")))
    )
    return padded.groupBy("label", "binary_label").agg(F.count("*").alias("n"))


@query(_flow_sql(f"""
    SELECT {_names(FLOW_COLUMNS)} FROM suspects WHERE label IN ('background', 'blacklist', 'anomaly-sshscan')"""))
def stratum_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratum_filter(_suspects(spark, sf_dir, flows_once), list(sampling.TARGETS)).select(*FLOW_COLUMNS)


@query(_flow_sql(f"SELECT record_id, {_prompt_sql('conservative')} AS prompt FROM sample"))
def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = scoring.record_requests(api_view(_sample(spark, sf_dir)))
    return scoring.with_prompt(requests, "conservative").select("record_id", "prompt")


@query(_flow_sql("SELECT policy, record_id, md5(prompt) AS prompt_hash FROM (" + " UNION ALL ".join(
    f"SELECT '{p}' AS policy, record_id, {_prompt_sql(p)} AS prompt FROM sample" for p in POLICIES) + ")"))
def prompt_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = scoring.record_requests(eval_view(_sample(spark, sf_dir)))
    return scoring.with_prompts(requests, list(POLICIES)).select(
        "policy", "record_id", F.md5("prompt").alias("prompt_hash")
    )


@query(_flow_sql(f"""
    SELECT CASE WHEN dst_port IS NULL THEN 'invalid' ELSE 'valid' END AS kind, {_names(FLOW_COLUMNS)} FROM flows"""))
def split_valid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows without a port stand for records without an id."""
    rows = flows(spark, sf_dir).withColumn("record_id", F.coalesce("dst_port", F.lit("")))
    valid, invalid = evaluation.split_valid_ids(rows)
    both = valid.withColumn("kind", F.lit("valid")).unionByName(invalid.withColumn("kind", F.lit("invalid")))
    return both.drop("record_id")


# -- aggregations

@query(_flow_sql("SELECT count(*) AS n FROM flows"))
def total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.total_count(flows_once(spark, sf_dir))


@query(_flow_sql("SELECT label, count(*) AS n FROM flows GROUP BY ALL"))
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.label_distribution(flows_once(spark, sf_dir))


@query(_flow_sql(f"SELECT label, {_names(RULE_NAMES)}, count(*) AS n FROM flagged GROUP BY ALL"))
def profile_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cube(spark, sf_dir)


@query(_flow_sql(" UNION ALL ".join(f"""
    SELECT '{r.name}' AS rule, '{r.text}' AS condition, cast(sum({r.name}) AS BIGINT) AS matched_records,
           {_pct(f'sum({r.name})', 'count(*)')} AS pct_of_full FROM flagged""" for r in rules.RULES)))
def rule_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rule_contributions(_cube(spark, sf_dir))


@query(_flow_sql(f"""
    SELECT count(*) AS total_records, count(*) FILTER (WHERE suspect_reason <> '') AS suspect_records,
           {_pct("count(*) FILTER (WHERE suspect_reason <> '')", 'count(*)')} AS suspect_ratio_percent FROM tagged"""))
def suspect_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.suspect_ratio(_cube(spark, sf_dir))


@query(_flow_sql("SELECT label, count(*) AS n FROM suspects GROUP BY ALL"))
def suspect_label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.labels_of_cube(_cube(spark, sf_dir), suspects_only=True)


@query(_flow_sql(f"""
    SELECT suspect_reason, count(*) AS n, {_pct('count(*)', '(SELECT count(*) FROM suspects)')} AS pct_of_suspect
    FROM suspects GROUP BY suspect_reason"""))
def rule_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rule_overlap(_cube(spark, sf_dir))


_PROFILE = f"""
    SELECT section, key, n, {_pct('n', "CASE WHEN section IN ('rule_overlap', 'suspect_label') THEN s ELSE t END")} AS pct
    FROM (
        SELECT 'total' AS section, 'records' AS key, count(*) AS n FROM tagged
        UNION ALL SELECT 'suspects', 'records', count(*) FROM suspects
        UNION ALL SELECT 'label', label, count(*) FROM tagged GROUP BY label
        UNION ALL SELECT 'suspect_label', label, count(*) FROM suspects GROUP BY label
        UNION ALL SELECT 'rule_overlap', suspect_reason, count(*) FROM suspects GROUP BY suspect_reason
        {" ".join(f"UNION ALL SELECT 'rule', '{r}', cast(sum({r}) AS BIGINT) FROM flagged" for r in RULE_NAMES)}
    ), (SELECT count(*) AS t, count(*) FILTER (WHERE suspect_reason <> '') AS s FROM tagged)
"""


@query(_flow_sql(_PROFILE))
def profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of the profile out of one scan."""
    return profile.profile_report(_cube(spark, sf_dir))


@query(_flow_sql("SELECT min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp FROM suspects"))
def timestamp_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.timestamp_range(_suspects(spark, sf_dir))


@query(_flow_sql("""
    SELECT 2 * count(*) AS total_rows, count(DISTINCT record_id) AS unique_ids,
           2 * count(*) - count(DISTINCT record_id) AS duplicate_ids FROM hashed"""))
def id_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suspects twice, so that half the ids are surplus."""
    once = sampling.with_record_id(_suspects(spark, sf_dir))
    return profile.id_uniqueness(sampling.union_strata([once, once]))


@query(_flow_sql("SELECT sample, label, count(*) AS n FROM nested GROUP BY ALL"))
def nested_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.nested_profile(_sample(spark, sf_dir), sampling.PREFIXES)


@query(_flow_sql(f"""
    SELECT sample, cast(k AS BIGINT) AS target, count(*) AS n,
           {_rounded('1.96 * sqrt(0.25 / count(*)) * 100', 2)} AS ci_margin_percent FROM nested GROUP BY sample, k"""))
def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.nested_counts(_sample(spark, sf_dir), sampling.PREFIXES)


@query(_flow_sql(f"""
    SELECT label, count(*) AS n, {_rounded('1.96 * sqrt(0.25 / count(*)) * 100', 2)} AS margin FROM flows GROUP BY ALL"""))
def ci_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.label_distribution(flows(spark, sf_dir)).withColumn("margin", numbers.ci_margin(F.col("n")))


@query(_flow_sql(f"""
    SELECT count(*) AS sample_rows, {_pct('count(*)', '(SELECT count(*) FROM flows)')} AS sample_ratio_percent
    FROM sample"""))
def sample_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = profile.total_count(flows(spark, sf_dir)).scalar()
    return _sample(spark, sf_dir).agg(F.count("*").alias("sample_rows")).withColumn(
        "sample_ratio_percent", numbers.safe_pct(F.col("sample_rows"), total)
    )


# -- sampling and ranking

_SAMPLED = [*FLOW_COLUMNS, "suspect_reason"]


@query(_flow_sql(f"SELECT {_names(_SAMPLED)} FROM sample"))
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_sample(_suspects(spark, sf_dir))


@query(_flow_sql(f"SELECT {_names(_SAMPLED)} FROM sample"))
def stratified_sample_one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sample with the cut taken from the profile."""
    pool = sampling_job.suspect_pool(_cube(spark, sf_dir), list(sampling.TARGETS))
    return sampling.draw_sample(_suspects(spark, sf_dir), pool)


@query(_flow_sql(f"SELECT {_names(_SAMPLED)} FROM suspects WHERE label = 'anomaly-sshscan'"))
def take_all_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.take_all(_suspects(spark, sf_dir), ["anomaly-sshscan"])


@query(_flow_sql(f"""
    SELECT {_names(_SAMPLED)} FROM suspects WHERE label IN ('blacklist', 'anomaly-sshscan', 'anomaly-spam')"""))
def union_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _suspects(spark, sf_dir)
    strata = ["blacklist", "anomaly-sshscan", "anomaly-spam"]
    return sampling.union_strata([sampling.stratum_filter(found, [s]) for s in strata])


@query(_flow_sql(f"SELECT {_names(_SAMPLED)} FROM numbered WHERE position <= 5000"))
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_sample(_suspects(spark, sf_dir), 5000)


@query(_flow_sql("SELECT record_id, position FROM numbered"))
def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every suspect's place in the seeded shuffle."""
    hashed = sampling.with_record_id(_suspects(spark, sf_dir)).select(
        identity.row_hash(sampling.SEED).alias("h"), "record_id"
    )
    return ranking.global_rank(hashed, order=["h"]).select("record_id", F.col("sample_rank").alias("position"))


@query(_flow_sql("SELECT record_id, sample_rank FROM sample"))
def global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("record_id", "sample_rank")


@query(_flow_sql("""
    SELECT record_id, row_number() OVER (ORDER BY timestamp, record_id) AS sample_rank FROM hashed"""))
def global_rank_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suspects ranked, without a bound on their number."""
    found = sampling.with_record_id(_suspects(spark, sf_dir)).select("timestamp", "record_id")
    return ranking.global_rank(found).select("record_id", "sample_rank")


@query(_flow_sql("SELECT sample, record_id, sample_rank FROM nested"))
def nested_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = _sample(spark, sf_dir)
    return sampling.union_strata([
        sampling.nested_prefix(sample, k).select(F.lit(name).alias("sample"), "record_id", "sample_rank")
        for name, k in sampling.PREFIXES.items()
    ])


@query(_flow_sql("SELECT DISTINCT record_id FROM hashed"))
def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = sampling.with_record_id(_suspects(spark, sf_dir))
    return sampling.distinct_ids(sampling.union_strata([once, once]))


# -- joins and evaluation

@query(_log_sql("SELECT record_id, truth FROM truth"))
def truth_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each id twice with different labels; the later row counts."""
    rows = fixtures.eval_rows(spark, sf_dir)
    earlier = rows.withColumns({"label": F.lit("anomaly-spam"), "sample_rank": F.col("sample_rank") - 1})
    return evaluation.truth_of(earlier.unionByName(rows))


@query(_log_sql("""
    SELECT record_id, model_name, prediction, truth, outcome FROM judged"""))
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("record_id", "model_name", "prediction", "truth", "outcome")


@query(_log_sql("SELECT record_id, truth FROM truth WHERE record_id IN (SELECT record_id FROM log)"))
def aligned_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.aligned_truth(_truth(spark, sf_dir), _log(spark, sf_dir))


@query(_log_sql("""
    SELECT count(*) FILTER (WHERE truth = 'attack') AS attack, count(*) FILTER (WHERE truth = 'normal') AS normal
    FROM truth"""))
def truth_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.truth_counts(_truth(spark, sf_dir))


@query(_log_sql("""
    SELECT (SELECT count(*) FROM documents) AS api_records, count(*) AS matched_truth,
           count(*) = (SELECT count(*) FROM documents) AS aligned FROM truth"""))
def alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.alignment_check(fixtures.records(spark, sf_dir), _truth(spark, sf_dir))


@query(_log_sql("""
    SELECT d.record_id, m.model_name FROM (SELECT 'd' || cast(doc_id AS VARCHAR) AS record_id FROM documents) AS d, models AS m
    WHERE NOT EXISTS (SELECT 1 FROM log WHERE run = 1 AND log.record_id = d.record_id
                      AND log.model_name = m.model_name)"""))
def pending_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second run's log leaves to be done."""
    requests = scoring.record_requests(fixtures.records(spark, sf_dir))
    done = _log(spark, sf_dir).filter(F.col("run_id") == "r1")
    return scoring.pending(requests, MODELS, done).select("record_id", "model_name")


@query(_log_sql("""
    SELECT DISTINCT record_id, model_name FROM log AS a
    WHERE NOT EXISTS (SELECT 1 FROM log AS b WHERE b.status = 'ok' AND b.record_id = a.record_id
                      AND b.model_name = a.model_name)"""))
def pending_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With failed calls to be repeated, whatever never succeeded is pending."""
    requests = scoring.record_requests(fixtures.records(spark, sf_dir))
    return scoring.pending(requests, MODELS, _log(spark, sf_dir), retry_errors=True).select("record_id", "model_name")


@query(_log_sql("SELECT * FROM confusion"))
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(spark, sf_dir)


@query(_log_sql("SELECT * FROM metrics"))
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.metrics(_confusion(spark, sf_dir))


# -- calls, cost and comparison

@query(_log_sql("SELECT * FROM stats"))
def call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callstats.call_stats(_log(spark, sf_dir))


@query(_log_sql(f"""
    SELECT model_name, model_ord, {_COUNTERS},
           (SELECT count(DISTINCT record_id) FROM log AS e WHERE e.run = 0 AND e.model_name = log.model_name
            AND e.record_id NOT IN (SELECT c.record_id FROM log AS c WHERE c.run = 1 AND c.model_name = e.model_name))
               AS skipped_resume
    FROM log WHERE run = 1 GROUP BY model_name, model_ord"""))
def call_stats_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the second run; what only the first run logged was skipped."""
    return callstats.call_stats(_log(spark, sf_dir), run_id="r1")


@query(_log_sql(f"""
    SELECT * REPLACE (coalesce(min_latency, 0.0) AS min_latency, coalesce(max_latency, 0.0) AS max_latency),
           {_ratio('total_latency', 'calls')} AS avg_latency,
           {_ratio('confidence_sum', 'confidence_count')} AS avg_confidence
    FROM stats"""))
def derived_call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callstats.derived_call_stats(callstats.call_stats(_log(spark, sf_dir)))


@query(_log_sql("SELECT model_name, input_tokens, output_tokens, estimated_cost FROM costed"))
def estimate_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = callstats.call_stats(_log(spark, sf_dir))
    return callstats.estimate_cost(stats).select("model_name", "input_tokens", "output_tokens", "estimated_cost")


_SERIES = f"""
    , size AS (SELECT max(record_index) AS total FROM log),
    steps AS (SELECT m.*, unnest(generate_series(1, cast(ceil(total / 100.0) AS BIGINT))) AS step
              FROM models AS m, size),
    sums AS (
        SELECT model_name, CASE WHEN record_index > total THEN cast(ceil(total / 100.0) AS BIGINT)
                                WHEN record_index >= 1 THEN cast(ceil(record_index / 100.0) AS BIGINT) ELSE 1 END AS step,
               {_COUNTERS}
        FROM log, size GROUP BY 1, 2),
    running AS (
        SELECT model_name, model_ord, step, p_in, p_out, least(step * 100, total) AS completed, total,
               {", ".join(f"cast(sum(coalesce({c}, 0)) OVER w AS BIGINT) AS {c}" for c in
                          ["calls", "errors", "pred_attack", "pred_normal", "input_tokens", "output_tokens",
                           "confidence_count"])},
               cast(sum(coalesce(cast(total_latency AS DECIMAL(28,12)), 0)) OVER w AS DECIMAL(38,12)) AS latency,
               cast(sum(coalesce(cast(confidence_sum AS DECIMAL(28,12)), 0)) OVER w AS DOUBLE) AS confidence
        FROM steps LEFT JOIN sums USING (model_name, step), size
        WINDOW w AS (PARTITION BY model_name ORDER BY step)),
    timed AS (SELECT *, cast(sum(latency) OVER (PARTITION BY step) AS DOUBLE) AS elapsed FROM running)
    SELECT model_name, model_ord, completed, {_rounded('completed::DOUBLE / total::DOUBLE * 100', 1)} AS pct_done,
           calls, errors, cast(0 AS BIGINT) AS skipped, pred_attack, pred_normal,
           {_rounded(_ratio('confidence', 'confidence_count'), 3)} AS avg_confidence, input_tokens, output_tokens,
           {_rounded('input_tokens / 1000.0::DOUBLE * p_in + output_tokens / 1000.0::DOUBLE * p_out', 6)}
               AS estimated_cost,
           {_rounded(_ratio('latency', 'calls'), 3)} AS avg_latency, {_rounded('elapsed', 3)} AS elapsed_s,
           {_rounded('elapsed / completed::DOUBLE * (total - completed)::DOUBLE', 3)} AS eta_s
    FROM timed
"""


@query(_log_sql(_SERIES))
def checkpoint_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callstats.checkpoint_series(_log(spark, sf_dir))


def _winner(position: int, name: str, value: str, order: str) -> str:
    return (f"(SELECT {position} AS position, '{name}' AS criterion, model_name FROM both_sides "
            f"ORDER BY {value} {order}, model_ord LIMIT 1)")


_CRITERIA = [
    ("best_f1", "f1", "DESC"), ("best_precision", "precision", "DESC"), ("best_recall", "recall_sensitivity", "DESC"),
    ("best_accuracy", "accuracy", "DESC"), ("best_specificity", "specificity", "DESC"),
    ("lowest_fpr", "false_positive_rate", "ASC"), ("lowest_fnr", "false_negative_rate", "ASC"),
    ("fastest", "CASE WHEN calls > 0 THEN total_latency / calls ELSE 999.0 END", "ASC"),
    ("lowest_cost", "estimated_cost", "ASC"), ("fewest_errors", "errors", "ASC"),
    ("most_conservative", "pred_normal", "DESC"), ("most_aggressive", "pred_attack", "DESC"),
]
_COMPARISON = ", both_sides AS (SELECT * FROM metrics JOIN costed USING (model_name, model_ord)) " + " UNION ALL ".join(
    _winner(i, *c) for i, c in enumerate(_CRITERIA, 1))


@query(_log_sql(_COMPARISON))
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    costed = callstats.estimate_cost(callstats.call_stats(_log(spark, sf_dir)))
    return callstats.compare_models(evaluation.metrics(_confusion(spark, sf_dir)), costed)


# -- replies and scoring

@query(_log_sql("""
    SELECT record_id, model_name, run,
           trim(replace(replace(replace(raw_response, '```json', ''), '```JSON', ''), '```', ''), chr(10)) AS clean
    FROM calls"""))
def clean_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.calls(spark, sf_dir).select(
        "record_id", "model_name", "run", replies.clean_reply(F.col("raw_response")).alias("clean")
    )


@query(_log_sql("SELECT record_id, model_name, run, prediction, confidence, reason FROM calls"))
def parse_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all replies; the SQL side states what each kind of reply must give."""
    parsed = fixtures.calls(spark, sf_dir).withColumn("v", replies.parse_reply(F.col("raw_response")))
    return parsed.select("record_id", "model_name", "run", "v.*")


@query(_log_sql("""
    SELECT record_id, model_name, run, raw_response AS reply,
           input_tokens, CASE WHEN run = 1 THEN 10 ELSE output_tokens END AS output_tokens FROM calls"""))
def unwrap_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies in the shape of all four providers; the second run's bodies report no output tokens."""
    tokens_out = F.when(F.col("run") == 0, F.col("output_tokens"))
    text = F.col("raw_response")
    anthropic = F.to_json(F.struct(
        F.array(F.struct(text.alias("text"))).alias("content"),
        F.struct(F.col("input_tokens"), tokens_out.alias("output_tokens")).alias("usage")))
    google = F.to_json(F.struct(
        F.array(F.struct(F.struct(F.array(
            F.struct(F.substring(text, 1, 5).alias("text")),
            F.struct(F.substring(text, F.lit(6), F.length(text)).alias("text")),
        ).alias("parts")).alias("content"))).alias("candidates"),
        F.struct(F.col("input_tokens").alias("promptTokenCount"),
                 tokens_out.alias("candidatesTokenCount")).alias("usageMetadata")))
    chat = F.to_json(F.struct(
        F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"),
        F.struct(F.col("input_tokens").alias("prompt_tokens"),
                 tokens_out.alias("completion_tokens")).alias("usage")))
    provider = F.col("provider")
    body = F.when(provider == "anthropic", anthropic).when(provider == "google", google).otherwise(chat)
    return (
        fixtures.calls(spark, sf_dir).withColumn("body", envelopes.parse_body(body))
        .withColumn("e", envelopes.unwrap_envelope(provider, F.col("body")))
        .select("record_id", "model_name", "run", "e.reply", "e.input_tokens", "e.output_tokens")
    )


_FAILED = ", ".join(map(str, fixtures.FAILED))
_SCORED = f"""
    , votes AS (
        SELECT s.record_id, s.sample_rank, s.label, m.model_name, m.model_ord, m.provider, m.model_id,
               high_packet_count + high_bytes + sensitive_port + icmp_traffic AS hits,
               cast('0x' || substr(md5(s.record_id || '|' || m.model_name), 1, 4) AS INTEGER) % {fixtures.KINDS} AS kind,
               CASE m.model_name {" ".join(f"WHEN '{k}' THEN {v}" for k, v in fixtures.MIN_HITS.items())} END AS needed
        FROM sample AS s, (VALUES {", ".join(f"('{m.model_name}', {m.model_ord}, '{m.provider}', '{m.model_id}')" for m in MODELS)})
            AS m(model_name, model_ord, provider, model_id)),
    verdicts AS (
        SELECT *, kind IN ({_FAILED}) AS failed,
               CASE WHEN kind IN ({_FAILED}) THEN 'error' WHEN hits >= needed OR kind = {fixtures.ONE_WORD} THEN 'attack'
                    ELSE 'normal' END AS prediction FROM votes)
"""


def _todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = scoring.record_requests(eval_view(_sample(spark, sf_dir)))
    return fixtures.scripted(scoring.with_prompt(scoring.pending(requests), "balanced"))


@query(_flow_sql(_SCORED + f"""
    SELECT record_id, sample_rank AS record_index, model_name, prediction,
           CASE WHEN NOT failed AND kind <> {fixtures.ONE_WORD} THEN cast(0.5 + hits / 10.0 AS DOUBLE) END AS confidence,
           CASE WHEN failed THEN 'api_or_parse_error' WHEN kind = {fixtures.ONE_WORD} THEN 'single-word fallback'
                ELSE concat(cast(hits AS VARCHAR), ' rules') END AS reason,
           CASE WHEN failed THEN 0 ELSE cast(300 + hits AS BIGINT) END AS input_tokens,
           CASE WHEN failed THEN 0 ELSE cast(10 + hits AS BIGINT) END AS output_tokens,
           CASE WHEN failed THEN 'error' ELSE 'ok' END AS status,
           CASE kind WHEN {fixtures.ALWAYS_FAILS} THEN 'call failed after 5 tries: HTTP 500: busy'
                     WHEN {fixtures.REFUSED} THEN 'call failed after 5 tries: HTTP 400: busy'
                     WHEN {fixtures.NO_JSON} THEN 'no reply in the response body' WHEN {fixtures.EMPTY} THEN 'no reply in the response body'
                     WHEN {fixtures.NO_VERDICT} THEN 'no verdict in the reply: I cannot tell.' END AS error
    FROM verdicts"""))
def score_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sample through four classifiers, whose busy answers, lost connections and odd replies follow from the rows."""
    clock = calls.CountedClock()
    scored = scoring.score(_todo(spark, sf_dir), fixtures.Playback(clock), spark.sparkContext.defaultParallelism, clock=clock)
    return scoring.predictions_of(scored).select(
        "record_id", "record_index", "model_name", "prediction", "confidence", "reason", "input_tokens",
        "output_tokens", "status", "error",
    )


@query(_flow_sql(_SCORED + f"""
    , tried AS (
        SELECT *, CASE kind WHEN {fixtures.BUSY_TWICE} THEN 3 WHEN {fixtures.LOST_ONCE} THEN 2 WHEN {fixtures.ALWAYS_FAILS} THEN 5
                       WHEN {fixtures.REFUSED} THEN 5 ELSE 1 END AS tries,
               CASE kind WHEN {fixtures.BUSY_TWICE} THEN 2 + 4 WHEN {fixtures.LOST_ONCE} THEN 2
                         WHEN {fixtures.ALWAYS_FAILS} THEN 2 + 4 + 8 + 16 + 32 WHEN {fixtures.REFUSED} THEN 2 + 4 + 8 + 16 ELSE 0 END AS waited
        FROM verdicts)
    SELECT record_id, model_name, cast(round(tries * (sample_rank % 7 + 1) / 100.0 + waited, 3) AS DOUBLE) AS latency_s,
           kind IN ({fixtures.ALWAYS_FAILS}, {fixtures.REFUSED}) AS given_up
    FROM tried"""))
def retried_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each call takes with its retries, by a clock that only waiting moves."""
    clock = calls.CountedClock()
    scored = scoring.score(
        _todo(spark, sf_dir), fixtures.Playback(clock), spark.sparkContext.defaultParallelism, calls.RetryPolicy(jitter=0.0), clock=clock)
    return scored.select("record_id", "model_name", "latency_s", F.col("error").isNotNull().alias("given_up"))


@query(_flow_sql(_SCORED + "SELECT count(*) AS calls, cast(0 AS BIGINT) AS too_early FROM verdicts"))
def paced_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls under a rate for the whole job, and how many started earlier after the one before than their share allows."""
    clock, limit = calls.CountedClock(), 0.5
    running = min(4, spark.sparkContext.defaultParallelism)
    scored = scoring.score(
        _todo(spark, sf_dir), fixtures.Playback(clock), 4, calls.RetryPolicy(max_tries=1), clock=clock, calls_per_second=limit)
    # calls start at whole seconds here, and what is left of a second is cut off their ends
    at = F.unix_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ss") - F.floor("latency_s")
    before = F.lag("at").over(Window.partitionBy("part").orderBy("at"))
    gaps = scored.select(F.spark_partition_id().alias("part"), at.alias("at")).withColumn("gap", F.col("at") - before)
    return gaps.agg(F.count("*").alias("calls"), F.count_if(F.col("gap") < running / limit).alias("too_early"))


@query(_flow_sql(_SCORED + """
    SELECT record_id, model_name,
           CASE provider WHEN 'google' THEN 'contents' ELSE 'messages' END AS holds,
           CASE WHEN provider <> 'google' THEN model_id END AS model,
           CASE WHEN provider = 'google' THEN 512 ELSE 200 END AS most_tokens,
           provider <> 'anthropic' AS json_reply
    FROM verdicts"""))
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is sent for each record and model, read back from its JSON; the prompt must come back unchanged."""
    body = F.col("request_body")
    part = lambda path: F.get_json_object(body, path)
    google = F.col("provider") == "google"
    sent = F.when(google, part("$.contents[0].parts[0].text")).otherwise(part("$.messages[0].content"))
    return scoring.with_bodies(_todo(spark, sf_dir)).filter(sent == F.col("prompt")).select(
        "record_id", "model_name", F.when(google, "contents").otherwise("messages").alias("holds"), part("$.model").alias("model"),
        F.when(google, part("$.generationConfig.maxOutputTokens")).otherwise(part("$.max_tokens")).cast("int").alias("most_tokens"),
        F.when(google, part("$.generationConfig.responseMimeType") == "application/json")
        .otherwise(F.coalesce(part("$.response_format.type") == "json_object", F.lit(False))).alias("json_reply"))


@query(_flow_sql(_SCORED + f"""
    , judged AS (
        SELECT model_name, model_ord, label <> 'background' AS attack, prediction = 'attack' AS flagged FROM verdicts
        WHERE NOT failed),
    confusion AS (
        SELECT model_name, model_ord, count(*) FILTER (WHERE attack AND flagged) AS TP,
               count(*) FILTER (WHERE NOT attack AND flagged) AS FP,
               count(*) FILTER (WHERE NOT attack AND NOT flagged) AS TN,
               count(*) FILTER (WHERE attack AND NOT flagged) AS FN FROM judged GROUP BY ALL)
    SELECT model_name, TP, FP, TN, FN, {_rounded(_ratio('TP', '(TP + FP)'), 6)} AS precision,
           {_rounded(_ratio('TP', '(TP + FN)'), 6)} AS recall_sensitivity,
           {_rounded(_ratio('(TP + TN)', '(TP + FP + TN + FN)'), 6)} AS accuracy
    FROM confusion"""))
def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample, score, log, read back and judge: the whole evaluation."""
    clock = calls.CountedClock()
    sample = _sample(spark, sf_dir)
    result = evaluation_job.run_evaluation(
        api_view(sample), eval_view(sample), scratch_path(spark, "log"), fixtures.Playback(clock), "run1",
        policy="balanced", concurrency=spark.sparkContext.defaultParallelism, prepare=fixtures.scripted, clock=clock,
    )
    return result.metrics.select(
        "model_name", "TP", "FP", "TN", "FN", "precision", "recall_sensitivity", "accuracy"
    )


@query(_flow_sql(f"""
    , counted AS ({_PROFILE}),
    per_sample AS (SELECT sample, count(*) AS size FROM nested GROUP BY sample)
    SELECT section, key, n, pct AS value, cast(NULL AS VARCHAR) AS text FROM counted
    UNION ALL SELECT 'sample', 'rows', count(*), {_pct('count(*)', '(SELECT count(*) FROM flows)')}, NULL FROM sample
    UNION ALL SELECT 'sample_label', concat_ws('.', sample, label), count(*), {_pct('count(*)', 'any_value(size)', 2)},
                     NULL FROM nested JOIN per_sample USING (sample) GROUP BY sample, label
    UNION ALL SELECT 'margin', sample, count(*), {_rounded('1.96 * sqrt(0.25 / any_value(k)) * 100', 2)}, NULL
              FROM nested GROUP BY sample
    UNION ALL SELECT 'timestamps', 'first', NULL, NULL, min(timestamp) FROM sample
    UNION ALL SELECT 'timestamps', 'last', NULL, NULL, max(timestamp) FROM sample
    UNION ALL SELECT 'ids', 'unique', count(DISTINCT record_id), NULL, NULL FROM sample
    UNION ALL SELECT 'ids', 'duplicate', count(*) - count(DISTINCT record_id), NULL, NULL FROM sample
    UNION ALL SELECT 'targets', t.label, t.n, NULL, CASE WHEN t.n IS NULL THEN 'all' END
              FROM (VALUES ('background', 4700), ('blacklist', 290), ('anomaly-sshscan', NULL)) AS t(label, n)
    UNION ALL SELECT 'strata', label, count(*), {_pct('count(*)', '(SELECT count(*) FROM sample)', 2)}, NULL FROM sample GROUP BY label
    UNION ALL SELECT 'files', concat(sample, '_', v.name, '.jsonl', part.name), count(*), NULL, CASE part.name WHEN '' THEN 'complete' END
              FROM nested, (VALUES ('api'), ('eval')) AS v(name), (VALUES (''), ('.expected')) AS part(name)
              GROUP BY sample, v.name, part.name"""))
def sampling_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile, sample, export, verify and report: the whole sampling job. Sizes of files depend on how they are written."""
    report = sampling_job.run_sampling(flows(spark, sf_dir), scratch_path(spark, "sampling")).report
    return report.filter(~F.endswith("key", F.lit(".bytes")))


@query(_flow_sql(_SCORED + f"""
    , calls_of AS (
        SELECT model_name, model_ord, count(*) FILTER (WHERE NOT failed) AS calls, count(*) FILTER (WHERE failed) AS errors,
               coalesce(sum(300 + hits) FILTER (WHERE NOT failed), 0) AS input_tokens,
               coalesce(sum(10 + hits) FILTER (WHERE NOT failed), 0) AS output_tokens,
               count(*) FILTER (WHERE prediction = 'attack') AS pred_attack, count(*) FILTER (WHERE prediction = 'normal') AS pred_normal
        FROM verdicts GROUP BY ALL),
    prices AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {i!r}::DOUBLE, {o!r}::DOUBLE)" for m, (i, o) in PRICES.items())}) AS p(model_name, p_in, p_out)),
    costed AS (
        SELECT *, {_rounded('input_tokens / 1000.0::DOUBLE * p_in + output_tokens / 1000.0::DOUBLE * p_out', 6)} AS cost
        FROM calls_of JOIN prices USING (model_name)),
    size AS (SELECT count(*) AS n FROM sample),
    steps AS (SELECT model_name, unnest(range(1, cast(ceil(n / 100.0) AS BIGINT) + 1)) AS step, n FROM calls_of, size),
    done AS (
        SELECT s.model_name, least(s.step * 100, any_value(s.n)) AS completed, count(*) FILTER (WHERE NOT v.failed) AS calls
        FROM steps AS s JOIN verdicts AS v ON v.model_name = s.model_name AND v.sample_rank <= s.step * 100 GROUP BY s.model_name, s.step)
    SELECT 'truth' AS section, CASE WHEN label = 'background' THEN 'normal' ELSE 'attack' END AS key, count(*) AS n,
           cast(NULL AS DOUBLE) AS value, cast(NULL AS VARCHAR) AS text FROM sample GROUP BY key
    UNION ALL SELECT 'records', 'input', n, NULL, NULL FROM size
    UNION ALL SELECT 'records', 'processed', n, NULL, NULL FROM size
    UNION ALL SELECT 'records', 'limit', NULL, NULL, NULL
    UNION ALL SELECT 'records', 'matched_truth', n, NULL, NULL FROM size
    UNION ALL SELECT 'method', 'policy', NULL, NULL, 'balanced'
    UNION ALL SELECT 'method', 'resume', NULL, NULL, 'true'
    UNION ALL SELECT 'models', model_name || '.' || part.name, NULL, NULL, CASE part.name WHEN 'model_id' THEN model_id ELSE provider END
              FROM (SELECT DISTINCT model_name, model_id, provider FROM verdicts), (VALUES ('model_id'), ('provider')) AS part(name)
    UNION ALL SELECT 'calls', model_name || '.' || unnest(['calls', 'errors', 'pred_attack', 'pred_normal', 'input_tokens', 'output_tokens']), NULL,
              unnest([calls, errors, pred_attack, pred_normal, input_tokens, output_tokens])::DOUBLE, NULL FROM calls_of
    UNION ALL SELECT 'calls', model_name || '.estimated_cost', NULL, cost, NULL FROM costed
    UNION ALL SELECT 'calls', 'all.estimated_cost', NULL, {_rounded('sum(cast(cost AS DECIMAL(18, 6)))::DOUBLE', 6)}, NULL FROM costed
    UNION ALL SELECT 'checkpoints', concat(model_name, '.', completed, '.calls'), NULL, calls::DOUBLE, NULL FROM done"""))
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the whole evaluation, but for metrics and comparison, which have queries of their own, and some figures
    of calls and checkpoints that follow from the log."""
    sample, clock = _sample(spark, sf_dir), calls.CountedClock()
    result = evaluation_job.run_evaluation(
        api_view(sample), eval_view(sample), scratch_path(spark, "log"), fixtures.Playback(clock), "run1",
        policy="balanced", concurrency=spark.sparkContext.defaultParallelism, prepare=fixtures.scripted, clock=clock,
        report_folder=scratch_path(spark, "report"),
    )
    figures = ["calls", "errors", "pred_attack", "pred_normal", "input_tokens", "output_tokens", "estimated_cost"]
    figure = F.regexp_extract("key", r"[.]([a-z_]+)$", 1)
    return result.report.filter(
        F.col("section").isin("truth", "records", "method", "models")
        | ((F.col("section") == "calls") & figure.isin(figures)) | ((F.col("section") == "checkpoints") & (figure == "calls")))


@query(_flow_sql("SELECT count(*) AS sampled, cast(3 AS BIGINT) AS tables_during, cast(0 AS BIGINT) AS tables_after FROM sample"))
def scratch_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling job in a block that owns its tables: those of its result while it lasts, and none when it has ended."""
    table, exported = flows(spark, sf_dir), scratch_path(spark, "sampling")
    below = lambda: set(storage.glob(spark, f"{shared_dir(spark)}/flowtriage/*"))
    before = below()
    with scratch(spark):
        result = sampling_job.run_sampling(table, exported)
        sampled = result.sample.count()
        during = len(below() - before - {f for f in below() if f.endswith(exported.rsplit("/", 2)[1])})
    after = len(below() - before - {f for f in below() if f.endswith(exported.rsplit("/", 2)[1])})
    return spark.createDataFrame([(sampled, during, after)], "sampled bigint, tables_during bigint, tables_after bigint")


# -- streams

@query(_flow_sql(f"SELECT {_names(_SAMPLED)} FROM suspects"))
def stream_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suspects again, tagged while the flow files stream in."""
    target = scratch_path(spark, "suspects")
    width = max(2, spark.sparkContext.defaultParallelism // 2)
    stream = flow_source.stream_flows(spark, fixtures.flow_files(spark, sf_dir), width)
    live.stream_suspects(stream, target, scratch_path(spark, "state")).awaitTermination()
    return spark.read.parquet(target).select(*_SAMPLED)


@query(_log_sql("SELECT * EXCLUDE (skipped_resume, model_ord) FROM stats"))
def stream_call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counters after the last file of a log that grew by two runs."""
    path, target = scratch_path(spark, "log"), scratch_path(spark, "stats")
    log = _log(spark, sf_dir)
    state = scratch_path(spark, "state")
    for run in ("r0", "r1"):
        predictions.append_predictions(log.filter(F.col("run_id") == run), path, run)
        live.stream_call_stats(live.read_log_stream(spark, path), target, state).awaitTermination()
    return spark.read.parquet(target)


@query(_log_sql("SELECT * EXCLUDE (skipped_resume, model_ord) FROM stats"))
def stream_stats_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counters of a log whose writer repeated a batch: its calls count once."""
    path, target = scratch_path(spark, "log"), scratch_path(spark, "stats")
    log, state = _log(spark, sf_dir), scratch_path(spark, "state")
    for run in ("r0", "r0", "r1"):
        predictions.append_predictions(log.filter(F.col("run_id") == run), path, run)
        live.stream_call_stats(live.read_log_stream(spark, path), target, state).awaitTermination()
    return spark.read.parquet(target)


@query(_flow_sql(_SCORED + "SELECT record_id, model_name, prediction, 1 AS rows FROM verdicts"))
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records scored as they arrive; a second stream over all of them finds nothing left to do."""
    source, log = scratch_path(spark, "records"), scratch_path(spark, "log")
    eval_view(_sample(spark, sf_dir)).repartition(4, "record_id").write.parquet(source)
    clock, width = calls.CountedClock(), spark.sparkContext.defaultParallelism
    for run in ("run1", "run2"):
        records = spark.readStream.schema(SAMPLE_SCHEMA).option("maxFilesPerTrigger", 2).parquet(source)
        live.stream_scores(records, fixtures.Playback(clock), log, run, scratch_path(spark, "state"), policy="balanced",
                           concurrency=width, prepare=fixtures.scripted, clock=clock).awaitTermination()
    stored = predictions.read_log(spark, log)
    return stored.groupBy("record_id", "model_name", "prediction").agg(F.count("*").cast("int").alias("rows"))
