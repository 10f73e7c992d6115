"""Flow and prediction tables derived from the given tables.

Each table exists twice, as a Spark projection and as the same projection in
SQL, so that results can be compared with another engine.
"""

from __future__ import annotations

import json
import re
import sys
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowtriage.functions.replies import parse_reply
from flowtriage.operators.calls import Clock
from flowtriage.operators.rules import RULES
from flowtriage.session import scratch_path
from flowtriage.sources.flows import scan_flows

FLOWS = """
    SELECT {date}                                                                       AS timestamp,
           concat(cast(l_linenumber AS {text}), '.', lpad(cast(cast(l_quantity AS INT) AS {text}), 3, '0')) AS duration,
           concat('10.0.', cast(l_suppkey % 256 AS {text}), '.', cast(l_linenumber AS {text}))          AS src_ip,
           concat('42.219.', cast(l_partkey % 256 AS {text}), '.', cast(l_orderkey % 256 AS {text}))    AS dst_ip,
           cast(1024 + l_orderkey % 60000 AS {text})                                    AS src_port,
           CASE l_partkey % 40 WHEN 0 THEN '22' WHEN 1 THEN '23' WHEN 2 THEN '445' WHEN 3 THEN '3389'
                WHEN 4 THEN NULL ELSE cast(8000 + l_partkey % 500 AS {text}) END        AS dst_port,
           CASE (l_orderkey + l_linenumber) % 50 WHEN 0 THEN 'ICMP' WHEN 1 THEN 'icmp' WHEN 2 THEN NULL
                WHEN 3 THEN 'GRE' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'TCP' ELSE 'UDP' END END AS protocol,
           concat(l_returnflag, l_linestatus)                                           AS flags,
           cast(cast(l_quantity AS INT) AS {text})                                      AS fwd_pkts,
           cast(l_linenumber AS {text})                                                 AS bwd_pkts,
           CASE WHEN l_orderkey % 997 = 0 THEN 'n/a'
                ELSE cast(cast(l_quantity AS INT) * 21 AS {text}) END                   AS total_pkts,
           cast(cast(floor(l_extendedprice * 10) AS BIGINT) AS {text})                  AS total_bytes,
           CASE WHEN l_orderkey % 2500 = 1 THEN 'anomaly-sshscan'
                WHEN l_suppkey % 33 = 0 THEN 'blacklist'
                WHEN l_suppkey % 29 = 0 THEN 'anomaly-spam'
                WHEN l_orderkey % 7001 = 3 THEN '126'
                ELSE 'background' END                                                   AS label
    FROM {lineitem}
"""

# One row per document and model. Every 19th document is answered a second time
# by a later run; documents without a label row have no truth.
CALLS = """
    SELECT concat('d', cast(doc_id AS {text}))                              AS record_id,
           doc_id,
           m.model_name, m.model_ord, m.provider,
           doc_id * 3 + m.model_ord                                         AS record_index,
           CASE WHEN toxic = 1 THEN 'blacklist' ELSE 'background' END       AS label,
           (doc_id * 7 + m.model_ord * 3 + r.run * 5) % 11                  AS slot,
           r.run                                                            AS run,
           300 + doc_id % 50                                                AS input_tokens,
           10 + doc_id % 7                                                  AS output_tokens,
           500 + (doc_id * 37 + m.model_ord * 101 + r.run * 7) % 3000       AS latency_ms
    FROM {labels}
"""
MODELS = "('chatgpt', 0, 'openai'), ('gemini', 1, 'google'), ('deepseek', 2, 'deepseek'), ('claude', 3, 'anthropic')"

# reply text and the verdict expected from it, by slot
REPLIES = [
    ('{"label":"attack","confidence":0.9,"reason":"r"}', "attack", 0.9, "r"),
    ('```json\n{"label":"normal","confidence":0.4,"reason":""}\n```', "normal", 0.4, "valid_json_no_reason"),
    ('Answer: {"label":"Malicious","confidence":"1.7"} done', "attack", 1.0, "valid_json_no_reason"),
    ('[{"label":"benign","confidence":-1}]', "normal", 0.0, "valid_json_no_reason"),
    ("attack.", "attack", None, "single-word fallback"),
    ('{"label":"unknown"}', None, None, None),
    ("no verdict", None, None, None),
    ('{"label":"suspicious","confidence":"n/a","reason":"q"}', "attack", None, "q"),
    *[('{"label":"normal","confidence":0.7,"reason":"ok"}', "normal", 0.7, "ok")] * 3,
]


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def by_slot(position: int, sql_type: str) -> str:
    """CASE over slot for one part of REPLIES."""

    def literal(value: object) -> str:
        return quoted(value) if isinstance(value, str) or value is None else str(value)

    branches = " ".join(f"WHEN {i} THEN {literal(r[position])}" for i, r in enumerate(REPLIES))
    return f"cast(CASE slot {branches} END AS {sql_type})"


_STORED: dict[tuple[str, str], str] = {}

#: Rows that a task gets at most when a table is dealt out.
DEALT_ROWS = 2_000_000


def _spread(table: DataFrame) -> DataFrame:
    """The table as its row groups lie; dealt out if one task would read over twice its share of the rows.

    A row group is read by one task, so that a small file may keep one core busy. Counting reads the footers only.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    rows = table.groupBy(F.spark_partition_id()).count().agg(F.max("count").alias("largest"), F.sum("count").alias("all")).first()
    if not rows["all"] or rows["largest"] * cores <= 2 * rows["all"]:
        return table
    return table.repartition(max(cores, -(-rows["all"] // DEALT_ROWS)))


def derive_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen text columns over all of lineitem."""
    lineitem = _spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    sql = FLOWS.format(
        date="date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss')", text="STRING", lineitem="{lineitem}"
    )
    return spark.sql(sql, lineitem=lineitem)


def flow_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the flow table as Parquet with positional columns, derived once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = scratch_path(spark, "flows")
        derived = derive_flows(spark, sf_dir)
        derived.toDF(*[f"_c{i}" for i in range(len(derived.columns))]).write.parquet(path)
        _STORED[key] = path
    return _STORED[key]


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_flows(spark, flow_files(spark, sf_dir))


def flows_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows for one pass: out of the table if the session has it, else as they are derived.

    To write the table and read it again takes longer than to make its rows.
    """
    stored = (spark.sparkContext.applicationId, sf_dir) in _STORED
    return flows(spark, sf_dir) if stored else derive_flows(spark, sf_dir)


def flows_sql() -> str:
    return FLOWS.format(date="strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')", text="VARCHAR", lineitem="lineitem")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier calls over all documents, with their raw replies."""
    labelled = f"""{{table}}
        LATERAL VIEW inline(array{MODELS.join("()")}) m AS model_name, model_ord, provider
        LATERAL VIEW explode(if(doc_id % 19 = 0, array(0, 1), array(0))) r AS run"""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    rows = spark.sql(CALLS.format(text="STRING", labels=labelled), table=documents.join(labels, "doc_id", "left"))
    replies = [r[0] for r in REPLIES]
    literal = ", ".join("'" + r.replace("\\", "\\\\").replace("\n", "\\n").replace("'", "\\'") + "'" for r in replies)
    return rows.selectExpr(
        "*", f"element_at(array({literal}), cast(slot AS INT) + 1) AS raw_response"
    )


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls as log rows; every reply goes through the parser."""
    parsed = calls(spark, sf_dir).withColumn("verdict", parse_reply(F.col("raw_response")))
    ok = F.col("verdict").isNotNull()
    return parsed.select(
        F.lit("2026-05-03T00:00:00").alias("timestamp"), "record_index", "record_id", "model_name",
        F.concat(F.col("model_name"), F.lit("-id")).alias("model_id"),
        F.coalesce("verdict.prediction", F.lit("error")).alias("prediction"),
        F.col("verdict.confidence").alias("confidence"),
        F.coalesce("verdict.reason", F.lit("api_or_parse_error")).alias("reason"),
        "raw_response",
        F.when(ok, F.col("input_tokens")).otherwise(F.lit(0)).cast("bigint").alias("input_tokens"),
        F.when(ok, F.col("output_tokens")).otherwise(F.lit(0)).cast("bigint").alias("output_tokens"),
        F.when(ok, F.col("latency_ms") / 1000.0).otherwise(F.lit(0.0)).alias("latency_s"),
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.when(~ok, "no verdict").alias("error"),
        F.col("run").cast("bigint").alias("run_seq"),
        F.concat(F.lit("r"), F.col("run")).alias("run_id"),
        F.lit("main").alias("writer_id"),
        F.col("run").cast("bigint").alias("batch_id"),
    )


def prediction_log_sql() -> str:
    return f"""
    SELECT record_index, record_id, model_name, model_ord, coalesce(prediction, 'error') AS prediction, confidence,
           coalesce(reason, 'api_or_parse_error') AS reason, raw_response,
           CASE WHEN prediction IS NULL THEN 0 ELSE input_tokens END AS input_tokens,
           CASE WHEN prediction IS NULL THEN 0 ELSE output_tokens END AS output_tokens,
           CASE WHEN prediction IS NULL THEN 0.0 ELSE latency_ms / 1000.0 END AS latency_s,
           CASE WHEN prediction IS NULL THEN 'error' ELSE 'ok' END AS status,
           run, concat('r', cast(run AS VARCHAR)) AS run_id
    FROM ({calls_sql()})
    """


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth for every label row."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("record_id"),
        F.col("doc_id").alias("sample_rank"),
        F.when(F.col("toxic") == 1, "blacklist").otherwise("background").alias("label"),
    )


def eval_rows_sql() -> str:
    return """
    SELECT concat('d', cast(doc_id AS VARCHAR)) AS record_id, doc_id AS sample_rank,
           CASE WHEN toxic = 1 THEN 'blacklist' ELSE 'background' END AS label
    FROM labels
    """


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as records to process."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("record_id"), F.col("doc_id").alias("sample_rank")
    )


def calls_sql() -> str:
    labelled = f"""(SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id)) AS d, (VALUES {MODELS}) AS m(model_name, model_ord, provider)
        JOIN (VALUES (0), (1)) AS r(run) ON r.run = 0 OR doc_id % 19 = 0"""
    return f"""
    SELECT *, {by_slot(0, 'VARCHAR')} AS raw_response, {by_slot(1, 'VARCHAR')} AS prediction,
           {by_slot(2, 'DOUBLE')} AS confidence, {by_slot(3, 'VARCHAR')} AS reason
    FROM ({CALLS.format(text='VARCHAR', labels=labelled)})
    """


#: Rules a record must hit for each model to call it an attack.
MIN_HITS = {"chatgpt": 1, "gemini": 2, "deepseek": 3, "claude": 2}
#: What happens to a call, by the hash of its record and model modulo KINDS; all others get a plain reply at once.
KINDS = 16
BUSY_TWICE, ALWAYS_FAILS, LOST_ONCE, REFUSED, NO_JSON, NO_VERDICT, ONE_WORD, FENCED, EMPTY = range(9)
FAILED = (ALWAYS_FAILS, REFUSED, NO_JSON, NO_VERDICT, EMPTY)


def scripted(todo: DataFrame) -> DataFrame:
    """Adds `script`: statuses of the tries, seconds that each takes and the body of the last, all derived from the row."""
    found = todo.select("*", *[
        F.get_json_object("record", f"$.{c}").alias(f"_{c}") for c in ("total_pkts", "total_bytes", "dst_port", "protocol")])
    conditions = [re.sub(r"(total_pkts|total_bytes|dst_port|protocol)", r"_\1", r.condition) for r in RULES]
    hits = reduce(Column.__add__, [F.when(F.expr(c), 1).otherwise(0) for c in conditions])
    kind = F.conv(F.substring(F.md5(F.concat_ws("|", "record_id", "model_name").cast("binary")), 1, 4), 16, 10).cast("int") % KINDS
    needed = F.element_at(F.create_map(*[F.lit(x) for pair in MIN_HITS.items() for x in pair]), F.col("model_name"))
    plain = F.to_json(F.struct(
        F.when(F.col("_hits") >= needed, "attack").otherwise("normal").alias("label"),
        F.round(0.5 + F.col("_hits") / 10, 1).alias("confidence"), F.concat(F.col("_hits"), F.lit(" rules")).alias("reason")))
    reply = (
        F.when(F.col("_kind") == NO_VERDICT, "I cannot tell.").when(F.col("_kind") == ONE_WORD, "Attack.")
        .when(F.col("_kind") == FENCED, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).otherwise(plain))
    tokens_in, tokens_out = 300 + F.col("_hits"), 10 + F.col("_hits")
    text = F.array(F.struct(F.col("_reply").alias("text")))
    body = (
        F.when(F.col("_kind") == NO_JSON, "<html>busy</html>").when(F.col("_kind") == EMPTY, "{}")
        .when(F.col("provider") == "anthropic", F.to_json(F.struct(
            text.alias("content"), F.struct(tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens")).alias("usage"))))
        .when(F.col("provider") == "google", F.to_json(F.struct(
            F.array(F.struct(F.lit("STOP").alias("finishReason"), F.struct(text.alias("parts")).alias("content"))).alias("candidates"),
            F.struct(tokens_in.alias("promptTokenCount"), tokens_out.alias("candidatesTokenCount")).alias("usageMetadata"))))
        .otherwise(F.to_json(F.struct(
            F.array(F.struct(F.struct(F.col("_reply").alias("content")).alias("message"))).alias("choices"),
            F.struct(tokens_in.alias("prompt_tokens"), tokens_out.alias("completion_tokens")).alias("usage")))))
    statuses = (
        F.when(F.col("_kind") == BUSY_TWICE, F.array(*map(F.lit, (503, 429, 200)))).when(F.col("_kind") == ALWAYS_FAILS, F.array(F.lit(500)))
        .when(F.col("_kind") == LOST_ONCE, F.array(*map(F.lit, (0, 200)))).when(F.col("_kind") == REFUSED, F.array(F.lit(400))).otherwise(F.array(F.lit(200))))
    seconds = (F.col("record_index") % 7 + 1) / 100
    made = found.withColumns({"_hits": hits, "_kind": kind}).withColumn("_reply", reply)
    return made.withColumn("script", F.to_json(F.struct(statuses.alias("statuses"), seconds.alias("seconds"), body.alias("body")))).select(
        *todo.columns, "script")


class Playback:
    """Answers a request as its script says; a status of zero is a lost connection."""

    def __init__(self, clock: Clock):
        self.clock = clock

    def __call__(self, request: dict) -> tuple[int, str]:
        script = json.loads(request["script"])
        tries = request["tries"] = request.get("tries", 0) + 1
        self.clock.sleep(script["seconds"])
        status = script["statuses"][min(tries, len(script["statuses"])) - 1]
        if status == 0:
            raise ConnectionError("connection lost")
        return status, script["body"] if status == 200 else "busy"


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package
