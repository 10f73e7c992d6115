from __future__ import annotations

import json
import threading
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from urllib.parse import urlparse

import pytest

from flowtriage import catalog, fixtures
from flowtriage.plans import sampling_job
from flowtriage.schema import API_COLUMNS, EVAL_COLUMNS, FLOW_COLUMNS, FLOW_SCHEMA, PREDICTION_SCHEMA, SAMPLE_SCHEMA
from flowtriage.sources import exports, flows, jsonl, predictions


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_ingest(spark, tmp_path):
    lines = [",".join(f"{c}{i}" for c in FLOW_COLUMNS) for i in range(3)] + ["," * 12]
    source = write(tmp_path / "flows.csv", "\n".join(lines))
    flows.ingest_csv(spark, source, str(tmp_path / "parquet"))
    rows = flows.scan_flows(spark, str(tmp_path / "parquet")).collect()
    assert sorted(r.label or "" for r in rows) == ["", "label0", "label1", "label2"]
    assert any(all(v is None for v in r) for r in rows)
    assert list(tmp_path.joinpath("parquet").glob("*.snappy.parquet"))


def test_typed_ingest_lets_filters_reach_the_scan(spark, tmp_path):
    source = write(tmp_path / "flows.csv", "t,1.5,a,b,1,22,TCP,F,1,2,1500,n/a,background\n")
    flows.ingest_csv(spark, source, str(tmp_path / "typed"), typed=True)
    df = spark.read.parquet(str(tmp_path / "typed"))
    assert df.first().total_pkts == 1500 and df.first().total_bytes is None
    plan = df.filter("total_pkts > 1000").select("label")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(total_pkts,1000)" in plan


def test_strict_reader(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"record_id":"a","sample_rank":1}\n\n  \n{"record_id":"b","label":"x"}\n')
    rows = jsonl.read_jsonl_strict(spark, path, SAMPLE_SCHEMA).collect()
    assert [(r.record_id, r.sample_rank, r.label) for r in rows] == [("a", 1, None), ("b", None, "x")]


@pytest.mark.parametrize("line", ['{"record_id":"a"', '{"record_id":"a"} x', "[1]", "word"])
def test_strict_reader_refuses(spark, tmp_path, line):
    path = write(tmp_path / "bad.jsonl", '{"record_id":"ok"}\n' + line + "\n")
    with pytest.raises(Exception, match="invalid JSON in"):
        jsonl.read_jsonl_strict(spark, path, SAMPLE_SCHEMA).collect()


def test_intermediate_lines_are_packed(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(jsonl, "PACKED_LINES", 200)
    read = catalog.QUERIES["read_jsonl_strict"](spark, sf_dir)
    files = [Path(urlparse(f).path) for f in read.inputFiles()]
    plain = jsonl.to_jsonl(fixtures.flows(spark, sf_dir), FLOW_COLUMNS).selectExpr("sum(octet_length(value) + 1)").first()[0]
    assert sum(f.stat().st_size for f in files) < plain / 2
    assert max(r["count"] for r in spark.read.text([str(f) for f in files]).groupBy("_metadata.file_path").count().collect()) <= 200


@pytest.mark.parametrize("line", ["{", '{"label":"x"} y'])
def test_strict_reader_refuses_packed_lines(spark, tmp_path, line):
    lines = spark.createDataFrame([('{"label":"ok"}',), (line,)], "value string")
    lines.write.text(str(tmp_path / "bad"), compression="lz4")
    with pytest.raises(Exception, match="invalid JSON in"):
        jsonl.read_jsonl_strict(spark, str(tmp_path / "bad"), SAMPLE_SCHEMA).collect()


def test_prediction_log_last_line_wins(spark, tmp_path):
    lines = [
        '{"record_id":"a","model_name":"m","prediction":"attack"}', "garbage", '{"model_name":"m"}',
        '{"record_id":"","model_name":"m"}', '{"record_id":"b","model_name":"m","prediction":"attack"} tail',
        '{"record_id":"a","model_name":"m","prediction":"normal"}', '{"record_id":7,"model_name":"m"}', "",
        '{"record_id":"a","model_name":"n","prediction":"attack"}',
    ]
    path = write(tmp_path / "log.jsonl", "\n".join(lines))
    rows = predictions.read_prediction_log(spark, path).collect()
    assert {(r.record_id, r.model_name, r.prediction) for r in rows} == {
        ("a", "m", "normal"), ("7", "m", None), ("a", "n", "attack")}


def test_long_log_keeps_file_order_over_splits(spark, tmp_path):
    lines = [json.dumps({"record_id": str(i % 50), "model_name": "m", "record_index": i}) for i in range(20_000)]
    path = write(tmp_path / "log.jsonl", "\n".join(lines))
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = predictions.read_prediction_log(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    assert sorted(r.record_index for r in rows) == list(range(19_950, 20_000))


def test_missing_log_is_empty(spark, tmp_path):
    empty = predictions.read_prediction_log(spark, str(tmp_path / "none.jsonl"))
    assert empty.count() == 0 and empty.columns == PREDICTION_SCHEMA.names
    assert predictions.read_log(spark, str(tmp_path / "none")).count() == 0


def test_run_ids_are_plain(spark, sf_dir, tmp_path):
    log = fixtures.prediction_log(spark, sf_dir)
    with pytest.raises(ValueError):
        predictions.append_predictions(log, str(tmp_path / "log"), "a/b")
    assert predictions.run_sequence(spark, str(tmp_path / "log"), "r9") == 0
    predictions.append_predictions(log, str(tmp_path / "log"), "r9", 4)
    assert predictions.run_sequence(spark, str(tmp_path / "log"), "r10") == 1
    predictions.append_predictions(log, str(tmp_path / "log"), "r10")
    assert [predictions.run_sequence(spark, str(tmp_path / "log"), r) for r in ("r9", "r10", "r2")] == [0, 1, 2]


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sampling")
    return folder, sampling_job.run_sampling(fixtures.flows(spark, "/root/testdata/sf0.01"), str(folder))


def test_six_files_in_rank_order(result):
    folder, run = result
    rows = {name: [json.loads(line) for line in (folder / name).read_text().splitlines()] for name in (
        f"{s}_{v}.jsonl" for s in ("sample_1000", "sample_3000", "sample_5000") for v in ("api", "eval"))}
    assert {name: len(r) for name, r in rows.items()} == {
        "sample_1000_api.jsonl": 1000, "sample_1000_eval.jsonl": 1000, "sample_3000_api.jsonl": 3000,
        "sample_3000_eval.jsonl": 3000, "sample_5000_api.jsonl": 4994, "sample_5000_eval.jsonl": 4994}
    full = rows["sample_5000_eval.jsonl"]
    assert [r["sample_rank"] for r in full] == list(range(1, 4995))
    assert rows["sample_1000_eval.jsonl"] == full[:1000]
    for api, labelled in zip(rows["sample_5000_api.jsonl"], full):
        assert "label" not in api and "suspect_reason" not in api
        assert api == {k: v for k, v in labelled.items() if k in API_COLUMNS}
    assert any("dst_port" not in r for r in full)  # NULL columns are left out
    assert list(full[0]) == [c for c in EVAL_COLUMNS if c in full[0]]


def test_report_files(result):
    folder, run = result
    stored = [json.loads(line) for line in (folder / "processing_report.json").read_text().splitlines()]
    assert len(stored) == run.report.count()
    assert {r["key"]: r["value"] for r in stored if r["section"] == "margin"} == {
        "sample_1000": 3.1, "sample_3000": 1.79, "sample_5000": 1.39}
    text = (folder / "processing_report.txt").read_text().splitlines()
    assert [t for t in text if not t.startswith(" ")] == list(sampling_job.SECTIONS.values())


def test_verification_finds_missing_and_short_files(spark, tmp_path):
    short = write(tmp_path / "short.jsonl", "1\n2\n")
    empty = write(tmp_path / "empty.jsonl", "")
    expected = {short: 3, empty: 0, str(tmp_path / "gone.jsonl"): 1}
    rows = {r.file: r for r in exports.verify_export(spark, expected).collect()}
    assert (rows["short.jsonl"].line_count, rows["short.jsonl"].size_bytes, rows["short.jsonl"].line_count_ok) == (2, 4, False)
    assert rows["empty.jsonl"].line_count_ok
    assert rows["gone.jsonl"].line_count is None and not rows["gone.jsonl"].line_count_ok
    with pytest.raises(ValueError, match="short.jsonl: expected 3, got 2"):
        exports.require_complete(exports.verify_export(spark, expected))
    gone = exports.verify_export(spark, {str(tmp_path / "gone.jsonl"): 1})
    assert [r.line_count_ok for r in gone.collect()] == [False]


def test_sharded_export_is_verified_by_folder(spark, tmp_path):
    row = ", ".join(f"'x' AS {c}" for c in dict.fromkeys([*EVAL_COLUMNS, *API_COLUMNS]) if c != "sample_rank")
    sample = spark.sql(f"SELECT id + 1 AS sample_rank, {row} FROM range(50)")
    expected = exports.export_sharded(sample, str(tmp_path / "shards"), {"small": 20, "large": 80})
    found = {r.file: (r.line_count, r.line_count_ok) for r in exports.verify_export(spark, expected).collect()}
    assert found == {f"sample={s}/view={v}": (n, True) for s, n in (("small", 20), ("large", 50)) for v in exports.VIEWS}


def test_export_replaces_files_and_leaves_no_parts(spark, tmp_path):
    path = str(tmp_path / "one.jsonl")
    for n in (5, 3):
        jsonl.write_single_jsonl(spark.range(n).selectExpr("id AS sample_rank"), ["sample_rank"], path)
    assert [json.loads(x)["sample_rank"] for x in open(path)] == [0, 1, 2]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["one.jsonl"]


def test_no_suspects_stop_the_job(spark, tmp_path):
    with pytest.raises(ValueError, match="no suspects"):
        sampling_job.run_sampling(spark.createDataFrame([], FLOW_SCHEMA), str(tmp_path))


def test_runs_that_begin_together_get_numbers_of_their_own(spark, tmp_path):
    path = str(tmp_path / "log")
    with ThreadPoolExecutor(8) as pool:
        runs = [f"r{i // 2}" for i in range(16)]  # two writers each
        numbers = list(pool.map(lambda run: predictions.run_sequence(spark, path, run), runs))
    by_run = {}
    for run, n in zip(runs, numbers):
        by_run.setdefault(run, set()).add(predictions.run_sequence(spark, path, run))
    assert all(len(n) == 1 for n in by_run.values()) and len({min(n) for n in by_run.values()}) == 8


def test_a_file_is_replaced_in_one_step(spark, tmp_path):
    """Whoever looks while files are written again and again finds a whole one each time."""
    path, stop, seen = tmp_path / "one.jsonl", threading.Event(), []
    write_rows = lambda n: jsonl.write_single_jsonl(spark.range(n).selectExpr("id AS sample_rank"), ["sample_rank"], str(path))
    write_rows(3)

    def look():
        while not stop.is_set():
            seen.append(path.read_text().count("\n"))

    reader = threading.Thread(target=look)
    reader.start()
    for n in (5, 7, 3, 5):
        write_rows(n)
    stop.set()
    reader.join()
    assert set(seen) <= {3, 5, 7} and len(seen) > 10 and path.read_text().count("\n") == 5
    assert spark.read.text(str(path)).count() == 5 and not list(tmp_path.glob("*.parts-*"))
