"""Reports from rollups must equal the reports from rows."""

import pytest
from pyspark.sql import functions as F

from wirelens.operators import alerts as al
from wirelens.plans import catalog, rollups
from wirelens.plans import reports as rp
from wirelens.sources import sinks

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Flows and alerts stored in three batches that share minutes; one batch is stored twice, once
    with rows that must not stay."""
    root = str(tmp_path_factory.mktemp("rollups"))
    # a null key and a null score are rows like any other
    flows = catalog.scored(spark, DATA).withColumns({
        "src_ip": F.expr("if(id % 11 = 0, null, src_ip)"),
        "threat_score": F.expr("if(id % 13 = 0, null, threat_score)")})
    alerts = al.l3_alerts(catalog.scored(spark, DATA))
    for batch, part in ((0, 0), (1, 2), (1, 1), (2, 2)):
        def of(df):
            return df.filter(F.pmod(F.xxhash64("src_ip", "timestamp"), F.lit(3)) == part)
        sinks.store(root, flows=of(flows), alerts=of(alerts), batch_id=batch)
        rollups.store_rollup(rollups.roll_up(of(flows), of(alerts)), root, batch)
    return (rollups.read_rollup(spark, root), sinks.read_table(spark, root, "flows"),
            sinks.read_table(spark, root, "alerts"))


def same(got, want):
    def rows(df):
        return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert got.columns == want.columns and rows(got) == rows(want) and rows(want)


@pytest.mark.parametrize("shift", [0.0, 17.25, 59.999, 86_400.0])
def test_windowed_reports(stored, shift):
    rollup, flows, alerts = stored
    now = flows.agg(F.max("timestamp")).first()[0] + 20 + shift % 86_400
    for minutes in (1, 2, 1440):
        series = rollups.traffic_timeseries(rollup, flows, now, minutes)
        assert str(series.collect())  # a window may be empty
        if minutes > 1:
            same(series, rp.traffic_timeseries(flows, now, minutes))
            same(rollups.top_sources(rollup, flows, now, minutes, 5),
                 rp.top_sources(flows, now, minutes, 5))
            same(rollups.top_ports(rollup, flows, now, minutes, 5),
                 rp.top_ports(flows, now, minutes, 5))
    for later in (0, 3400, 90_000):
        same(rollups.recent_hour_counts(rollup, flows, alerts, now + later),
             rp.recent_hour_counts(flows, alerts, now + later))


def test_whole_reports(spark, stored):
    rollup, flows, alerts = stored
    same(rollups.average_threat(rollup), rp.average_threat(flows))
    same(rollups.attack_distribution(rollup), rp.attack_distribution(flows))
    same(rollups.protocol_distribution(rollup), rp.protocol_distribution(flows))
    same(rollups.store_counts(rollup.select("*")),
         rp.store_counts(flows, alerts, alerts).filter("table_name <> 'packets'"))
    assert flows.count() == catalog.scored(spark, DATA).count()  # the repeated batch stays one


def test_empty_tables(spark, stored):
    _, flows, alerts = stored
    none = flows.filter("false")
    rollup = rollups.roll_up(none, alerts.filter("false"))
    assert rollups.store_counts(rollup).count() == 0
    assert rollups.average_threat(rollup).first()[0] == 0
    assert rollups.top_sources(rollup, none, 0.0).count() == 0
    same(rollups.recent_hour_counts(rollup, none, none, 0.0), rp.recent_hour_counts(none, none, 0.0))
