"""Every SQL-checked query against DuckDB, and the shape of the plans."""

import re

import pytest
from pyspark.sql import functions as F
from compare import connect, difference

from wirelens.config import Settings
from wirelens.operators import features as ft
from wirelens.operators import flows as fl
from wirelens.operators import l2, ordered
from wirelens.plans.catalog import QUERIES
from wirelens.plans.oracle_sql import ORACLES
from wirelens.sources import trace

DATA = "/root/testdata/sf0.001"
# fits of models have no SQL counterpart
UNTIED = Settings(combine_ties=False)
ROWS_ONLY = {"isolation_forest_scores", "rf_attack_classes", "gbt_attack_classes", "training_report",
             "sequence_classifier", "score_flows"}


@pytest.fixture(scope="module")
def duck():
    con = connect(DATA)
    yield con
    con.close()


def test_only_model_fits_lack_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert difference(spark, duck, DATA, name, df) in (None, "no rows")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def raw_shuffles(df):
    """Keys of the exchanges that read the source without an aggregation in between."""
    out, depth_of_exchange = [], []
    for line in plan_of(df).splitlines():
        depth = len(line) - len(line.lstrip(" :|+-*()0123456789"))
        while depth_of_exchange and depth_of_exchange[-1][0] >= depth:
            depth_of_exchange.pop()
        if re.search(r"\bExchange hashpartitioning", line):
            depth_of_exchange.append((depth, line))
        elif "Aggregate" in line:
            depth_of_exchange.append((depth, None))
        elif "FileScan" in line and depth_of_exchange and depth_of_exchange[-1][1]:
            out.append(depth_of_exchange[-1][1])
    return out


def test_flows_are_sorted_by_numbers_first(spark):
    """Addresses mostly begin alike, so sorting by them first compares whole rows."""
    plan = plan_of(ft.flow_features(trace.packets(spark, DATA)))
    sorts = re.findall(r"\bSort \[(\w+)#", plan)
    assert sorts and set(sorts) <= {"_slot", "flow_no"}, sorts


@pytest.mark.parametrize("build", [
    lambda s: ft.flow_features(trace.packets(s, DATA), cfg=UNTIED),
    lambda s: ft.flow_features(trace.packets(s, DATA), "session", cfg=UNTIED),
    lambda s: fl.packet_gaps(trace.packets(s, DATA)),
    lambda s: fl.link_packets(trace.packets(s, DATA), "session").hint("shuffle_merge"),
    lambda s: l2.arp_spoofing(trace.l2_events(s, DATA)),
    lambda s: l2.stp_root_hijack(trace.l2_events(s, DATA)),
    lambda s: l2.stp_tc_flood(trace.l2_events(s, DATA)),
    lambda s: l2.vtp_attack(trace.l2_events(s, DATA)),
    lambda s: l2.cdp_flood(trace.l2_events(s, DATA)),
])
def test_raw_rows_shuffle_by_slot(spark, build):
    """A hot 5-tuple or segment must not send its rows to one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffles = raw_shuffles(build(spark))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffles and all("_slot" in s for s in shuffles), shuffles


def test_simultaneous_packets_are_combined_before_the_shuffle(spark):
    assert not raw_shuffles(ft.flow_features(trace.packets(spark, DATA)))


def test_scans_read_only_what_is_needed(spark):
    plan = plan_of(fl.assemble_flows(trace.packets(spark, DATA)).groupBy("src_ip").sum(
        "total_bytes"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "ts:" not in schema
    assert "Window" not in plan  # gap ordering is pruned when no gap feature is used


@pytest.mark.parametrize("mode", fl.MODES)
def test_null_ports_keep_their_packets(spark, mode):
    packets = trace.packets(spark, DATA).withColumns(
        {c: F.expr(f"if(protocol = 'TCP', NULL, {c})") for c in ("src_port", "dst_port")})
    assembled = fl.assemble_flows(packets, mode).agg(F.sum("packet_count")).first()[0]
    linked = fl.link_packets(packets, mode)
    assert linked.count() == assembled and linked.filter("src_port IS NULL").count() > 0
    assert fl.packet_gaps(packets).filter("gap_us IS NOT NULL").count() == \
        packets.count() - packets.select(*fl.FLOW_KEY).distinct().count()


def test_hot_segment_equals_even_load(spark):
    """A third of all events in one key and instant: results stay whole."""
    hot = spark.range(3000).selectExpr(
        "id AS seq", "CASE WHEN id % 3 = 0 THEN 7L ELSE id END AS t",
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'k' || id % 50 END AS k")
    out = ordered.row_index(hot, ["k"], "t", "seq", "i", 100)
    rows = {}
    for r in out.collect():
        rows.setdefault(r.k, []).append((r.t, r.seq, r.i))
    assert sum(map(len, rows.values())) == 3000
    for group in rows.values():
        assert [i for _, _, i in sorted(group)] == list(range(len(group)))
