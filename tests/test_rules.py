from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowtriage.functions.labels import binary_label
from flowtriage.operators import profile, rules
from flowtriage.operators.sampling import draw_sample, with_record_id
from flowtriage.schema import FLOW_COLUMNS, FLOW_SCHEMA, bind_flow_schema, drop_sensitive, typed_flows
from flowtriage.sources.flows import scan_typed_flows


def flow(**values):
    base = dict.fromkeys(FLOW_COLUMNS, "x") | {
        "dst_port": "80", "protocol": "TCP", "total_pkts": "1", "total_bytes": "1", "label": "background"}
    return tuple((base | values)[c] for c in FLOW_COLUMNS)


EDGES = [
    (flow(total_pkts="1000"), ""),
    (flow(total_pkts="1001"), "high_packet_count"),
    (flow(total_pkts="1001.9"), "high_packet_count"),
    (flow(total_pkts="1000.9"), ""),
    (flow(total_pkts="1e9"), ""),
    (flow(total_pkts=" 2000 "), "high_packet_count"),
    (flow(total_pkts=None, total_bytes="1000001"), "high_bytes"),
    (flow(total_bytes="1000000"), ""),
    (flow(total_bytes="99999999999999999999"), ""),
    (flow(dst_port="22"), "sensitive_port"),
    (flow(dst_port="445.0"), "sensitive_port"),
    (flow(dst_port=""), ""),
    (flow(protocol="icmp"), "icmp_traffic"),
    (flow(protocol=" ICMP"), ""),
    (flow(protocol=None, dst_port=None, total_pkts=None, total_bytes=None), ""),
    (flow(total_pkts="5000", total_bytes="5000000", dst_port="3389", protocol="Icmp", label=None),
     "high_packet_count,high_bytes,sensitive_port,icmp_traffic"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([row for row, _ in EDGES], FLOW_SCHEMA)


def test_reasons_at_the_edges(spark, edges):
    tagged = rules.tag_reasons(edges).collect()
    assert [r.suspect_reason for r in tagged] == [reason for _, reason in EDGES]


def test_suspects_are_the_tagged_rows(edges):
    assert sorted(r.suspect_reason for r in rules.suspects(edges).collect()) == sorted(r for _, r in EDGES if r)


def test_hits_as_array(edges):
    assert [",".join(r.rules) for r in rules.rules_hit(edges).collect()] == [reason for _, reason in EDGES]


def test_cube_marginals_equal_direct_counts(edges):
    cube = profile.profile_cube(edges)
    direct = {r.label: r.n for r in profile.label_distribution(edges).collect()}
    assert {r.label: r.n for r in profile.labels_of_cube(cube).collect()} == direct
    assert direct["None"] == 1
    flagged = edges.select(*rules.rule_flags())
    sums = flagged.agg(*[F.sum(r.name).alias(r.name) for r in rules.RULES]).first().asDict()
    assert {r.rule: r.matched_records for r in profile.rule_contributions(cube).collect()} == sums
    overlap = {r.suspect_reason: r.n for r in profile.rule_overlap(cube).collect()}
    found = rules.suspects(edges).groupBy("suspect_reason").count().collect()
    assert overlap == {r.suspect_reason: r["count"] for r in found}
    for rule, n in sums.items():
        assert n == sum(k for reason, k in overlap.items() if rule in reason.split(","))


def test_counts_come_most_frequent_first(edges):
    rows = [(-r.n, r.suspect_reason) for r in profile.rule_overlap(profile.profile_cube(edges)).collect()]
    assert rows == sorted(rows)


def scans(df, capsys):
    """Scans in the plans that were run, subqueries included."""
    df.collect()
    capsys.readouterr()
    df.explain("formatted")
    count, final = 0, True
    for line in capsys.readouterr().out.splitlines():
        final = "Final Plan" in line or (final and "Initial Plan" not in line)
        count += final and line.lstrip(" :").startswith("+- ") and "Scan parquet" in line
    return count


@pytest.mark.parametrize("counts", [
    profile.profile_report, profile.rule_overlap, profile.rule_contributions, profile.suspect_ratio])
def test_profile_reads_the_table_once(spark, edges, tmp_path, capsys, counts):
    edges.write.parquet(str(tmp_path / "flows"))
    assert scans(counts(profile.profile_cube(spark.read.parquet(str(tmp_path / "flows")))), capsys) == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], FLOW_SCHEMA)
    cube = profile.profile_cube(empty)
    assert profile.suspect_ratio(cube).first().asDict() == {
        "total_records": 0, "suspect_records": 0, "suspect_ratio_percent": 0.0}
    assert {(r.rule, r.matched_records, r.pct_of_full) for r in profile.rule_contributions(cube).collect()} == {
        (r.name, 0, 0.0) for r in rules.RULES}
    with pytest.raises(ValueError):
        rules.require_nonempty(rules.suspects(empty))


def test_column_count_is_checked(spark):
    with pytest.raises(ValueError):
        bind_flow_schema(spark.range(1))


def test_typed_view(edges):
    assert dict(typed_flows(edges).dtypes)["total_bytes"] == "bigint"
    assert [r.total_pkts for r in typed_flows(edges).collect()][4:7] == [None, 2000, None]


def test_golden_overlap_adds_up(spark):
    """Published counts per combination add up to the published counts per rule."""
    golden = {
        "sensitive_port": 95966655, "icmp_traffic": 10605192, "high_packet_count": 695981,
        "high_packet_count,high_bytes": 673410, "high_bytes": 190825,
        "high_packet_count,high_bytes,sensitive_port": 3021, "high_packet_count,sensitive_port": 2510,
        "high_packet_count,icmp_traffic": 1469, "high_bytes,sensitive_port": 42,
    }
    rows = [("background", *[int(r.name in reason.split(",")) for r in rules.RULES], n) for reason, n in golden.items()]
    rows.append(("background", 0, 0, 0, 0, 862526861 - sum(golden.values())))
    schema = "label string, " + ", ".join(f"{r.name} int" for r in rules.RULES) + ", n bigint"
    cube = spark.createDataFrame(rows, schema)
    found = {r.rule: (r.matched_records, r.pct_of_full) for r in profile.rule_contributions(cube).collect()}
    assert found == {
        "high_packet_count": (1376391, 0.1596), "high_bytes": (867298, 0.1006),
        "sensitive_port": (95972228, 11.1269), "icmp_traffic": (10606661, 1.2297)}
    assert profile.suspect_ratio(cube).first().suspect_ratio_percent == 12.5375
    overlap = profile.rule_overlap(cube).collect()
    assert [(r.suspect_reason, r.n) for r in overlap] == list(golden.items())
    assert overlap[0].pct_of_suspect == 88.7437 and overlap[4].pct_of_suspect == 0.1765


def test_binary_labels(spark):
    labels = ["background", " Background\n", "\xa0BACKGROUND", "", None, "126", "blacklist", "None"]
    rows = spark.createDataFrame([(x,) for x in labels], "label string").select(binary_label(F.col("label"))).collect()
    assert [r[0] for r in rows] == ["normal"] * 3 + ["attack"] * 5


def test_sensitive_columns_go(edges):
    assert "label" not in drop_sensitive(rules.tag_reasons(edges)).columns
    assert "suspect_reason" not in drop_sensitive(rules.tag_reasons(edges)).columns


def test_typed_flows_give_the_same_suspects_and_ids(spark, edges, tmp_path):
    odd = [{"total_pkts": "1500.7", "label": "a"}, {"dst_port": "22.0", "label": "b"}, {"total_bytes": "1000000.9", "label": "c"},
           {"protocol": "Icmp", "duration": "1e3", "label": "d"}, {"total_pkts": " 1001 ", "label": "e"}]
    flows = edges.unionByName(spark.createDataFrame([tuple(r.get(c) for c in FLOW_COLUMNS) for r in odd], FLOW_SCHEMA))
    typed_flows(flows).write.parquet(str(tmp_path / "typed"))
    typed = scan_typed_flows(spark, str(tmp_path / "typed"))
    same = lambda df: sorted(map(tuple, with_record_id(df).collect()), key=repr)
    assert same(rules.suspects(typed)) == same(rules.suspects(flows))
    assert {"a", "b", "d", "e"} <= {r.label for r in rules.suspects(typed).collect()}
    assert same(rules.tag_reasons(typed)) == same(rules.tag_reasons(flows))
    cube = lambda df: sorted(map(tuple, profile.profile_cube(df).collect()), key=repr)
    assert cube(typed) == cube(flows)
    pool = {r.label: r["count"] for r in rules.suspects(flows).groupBy("label").count().collect()}
    draw = lambda df: sorted(map(tuple, draw_sample(rules.hit_rows(df), pool, {"a": 1, "b": None}).collect()), key=repr)
    assert draw(typed) == draw(flows)
    plan = rules.hit_rows(typed)._jdf.queryExecution().executedPlan().toString()
    # one alternative that cannot be pushed would keep all of them back; the text of the plan ends within the list of ports
    assert "PushedFilters: [Or(Or(GreaterThan(total_pkts,1000),GreaterThan(total_bytes,1000000)),Or(In(dst_port, " in plan, plan
    own = [rules.Rule("long", "length(label) > 0", "has a label")]  # only over text
    assert same(rules.suspects(typed, own)) == same(rules.suspects(flows, own))
    with pytest.raises(ValueError):
        flows.write.parquet(str(tmp_path / "text"))
        scan_typed_flows(spark, str(tmp_path / "text"))
