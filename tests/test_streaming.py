"""Streams must equal the batch jobs on the same rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirelens.config import Settings
from wirelens.fixed_values import FEATURE_NAMES
from wirelens.operators import features as ft
from wirelens.operators.alerts import l3_alerts
from wirelens.operators.flows import assemble_flows
from wirelens.operators.scoring import threat_score
from wirelens.operators.sequence import sequence_score
from wirelens.plans.catalog import stand_in_scores
from wirelens.schemas import FLOW_KEY, PACKETS
from wirelens.sources import readers, sinks, trace
from wirelens.streaming import flows as sf
from wirelens.streaming import history

DATA = "/root/testdata/sf0.001"
FAR = 4_000_000_000_000_000


def in_files(df, path, parts, schema):
    """Write rows as ``parts`` files in time order, plus a last row that closes every window."""
    rows = df.select(*schema.fieldNames()).orderBy("ts_us").collect()
    step = -(-len(rows) // parts)
    spark = df.sparkSession
    chunks = [rows[i:i + step] for i in range(0, len(rows), step)]
    last = rows[-1].asDict() | {"ts_us": FAR, "timestamp": FAR / 1e6}
    chunks.append([tuple(last[f] for f in schema.fieldNames())])
    for chunk in chunks:
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)


def run(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return q


@pytest.fixture()
def packet_files(spark, tmp_path):
    path = str(tmp_path / "packets")
    packets = trace.packets(spark, DATA)
    in_files(packets, path, 4, PACKETS)
    return packets, path


def source(spark, path):
    return readers.read_packets(spark, path, streaming=True, maxFilesPerTrigger="1")


def test_flow_features(spark, packet_files, tmp_path):
    packets, path = packet_files
    stream = sf.stream_flow_features(source(spark, path))
    cols = ["id", *FLOW_KEY, "flow_no", "packet_count", "total_bytes", *FEATURE_NAMES]
    run(stream.writeStream.outputMode("append").format("memory").queryName("flows_out")
        .option("checkpointLocation", str(tmp_path / "cp")))
    got = sorted(map(str, spark.table("flows_out").select(cols).collect()))
    want = sorted(map(str, ft.flow_features(packets).select(cols).collect()))
    assert got == want and len(got) == 157


@pytest.fixture()
def keyed_state(spark):
    before = spark.conf.get(history.STATE_STORE)
    history.use_keyed_state(spark)
    yield
    spark.conf.set(history.STATE_STORE, before)


def test_sequence_history_across_batches(spark, packet_files, tmp_path, keyed_state):
    """Scores of a stream in several batches are those of the batch job, below the cap too."""
    packets, path = packet_files
    cfg = Settings(flow_window_s=5, slot_s=5, min_flow_packets=1)
    small = (F.col("total_bytes") + F.col("duration")) / 1e6  # a spread that no score caps
    stream = history.stream_sequence_scores(
        sf.stream_flow_features(source(spark, path), cfg, "2 seconds").withColumn("small", small),
        variance="small")
    query = run(stream.writeStream.outputMode("append").format("memory").queryName("scores_out")
                .option("checkpointLocation", str(tmp_path / "cp")))
    assert sum(p["sink"]["numOutputRows"] > 0 for p in query.recentProgress) >= 3
    cols = ["id", "src_ip", "last_us", "sequence_score"]
    got = sorted(map(str, spark.table("scores_out").select(cols).collect()))
    want = sequence_score(ft.flow_features(packets, cfg=cfg).withColumn("small", small),
                          variance="small")
    assert got == sorted(map(str, want.select(cols).collect()))
    scores = [r.sequence_score for r in want.select("sequence_score").collect()]
    assert len(set(scores)) > 100 and max(scores) < 1


def test_sequence_history_is_forgotten(spark, packet_files, tmp_path, keyed_state):
    """With no idle time a source starts anew in every batch that is a watermark later."""
    _, path = packet_files
    cfg = Settings(flow_window_s=5, slot_s=5, min_flow_packets=1)
    stream = history.stream_sequence_scores(
        sf.stream_flow_features(source(spark, path), cfg, "2 seconds"), idle_s=0)
    run(stream.writeStream.outputMode("append").format("memory").queryName("short_out")
        .option("checkpointLocation", str(tmp_path / "cp")))
    out = spark.table("short_out").agg(
        F.count_if(F.col("sequence_score") == 0), F.count_distinct("src_ip")).first()
    assert out[0] > out[1]


def test_recent_means():
    rng = random.Random(1)
    spreads = [rng.random() for _ in range(30)]
    for cut in (0, 1, 3, 4, 17):
        got = history.recent_means(spreads[max(0, cut - 4):cut], np.array(spreads[cut:]))
        want = [sum(spreads[max(0, i - 4):i + 1]) / min(i + 1, 5) for i in range(cut, 30)]
        assert np.allclose(got, want, rtol=0, atol=1e-15)


def test_sessions_have_the_numbers_of_the_batch_job(spark, tmp_path, keyed_state):
    """Several sessions per 5-tuple, gaps of exactly the timeout, single packets, several batches."""
    rng, rows, at = random.Random(3), [], {}
    for i in range(240):
        key = rng.choice("abc")
        at[key] = at.get(key, 0) + rng.choice([1, 2, 5_000_000, 5_000_000, 5_000_001, 9_000_000])
        rows.append(dict(dict.fromkeys(PACKETS.fieldNames()), packet_id=i, ts_us=at[key],
                         timestamp=at[key] / 1e6, src_ip=key, dst_ip="z", src_port=1, dst_port=2,
                         protocol="TCP", length=10, flags="S", payload_entropy=0.0))
    df = spark.createDataFrame([tuple(r[f] for f in PACKETS.fieldNames()) for r in rows], PACKETS)
    path, cfg = str(tmp_path / "packets"), Settings(flow_timeout_s=5, slot_s=5)
    in_files(df, path, 3, PACKETS)
    stream = sf.stream_session_flows(source(spark, path), cfg, "1 second")
    run(stream.writeStream.outputMode("append").format("memory").queryName("numbered_out")
        .option("checkpointLocation", str(tmp_path / "cp")))
    cols = ["id", "src_ip", "flow_no", "first_us", "last_us", "packet_count", "total_bytes"]
    got = sorted(map(str, spark.table("numbered_out").select(cols).collect()))
    want = assemble_flows(df, "session", cfg=cfg).select(cols).collect()
    assert got == sorted(map(str, want)) and max(r.flow_no for r in want) > 5


def test_sessions_and_rates(spark, packet_files, tmp_path, keyed_state):
    packets, path = packet_files
    run(sf.stream_session_flows(source(spark, path)).writeStream.outputMode("append")
        .format("memory").queryName("sessions_out")
        .option("checkpointLocation", str(tmp_path / "cp1")))
    out = spark.table("sessions_out")
    assert out.count() == 157
    assert out.agg(F.sum("packet_count")).first()[0] == 1000 - (172 - 157)
    run(sf.stream_rates(source(spark, path)).writeStream.outputMode("append").format("memory")
        .queryName("rates_out").option("checkpointLocation", str(tmp_path / "cp2")))
    rates = spark.table("rates_out").agg(F.sum("packets_per_sec"), F.sum("bytes_per_sec")).first()
    assert rates[0] == 1000
    assert rates[1] == packets.agg(F.sum("length")).first()[0]


def test_scored_flows_are_stored_once(spark, packet_files, tmp_path):
    packets, path = packet_files
    root = str(tmp_path / "tables")

    def score(batch, cfg):
        scored = threat_score(stand_in_scores(batch), cfg=cfg)
        return scored.select("id", "timestamp", *FLOW_KEY, "threat_score"), l3_alerts(scored, cfg)

    run(sf.store_scored_flows(sf.stream_flow_features(source(spark, path)), root,
                              str(tmp_path / "cp"), score,
                              lambda: Settings(threat_threshold=70)))
    stored = sinks.read_table(spark, root, "flows")
    assert stored.count() == 157
    expected = stored.filter("threat_score >= 70").count()
    assert sinks.read_table(spark, root, "alerts").count() == expected > 0
    run(sf.store_packets(source(spark, path), root, str(tmp_path / "cp_packets")))
    kept = sinks.read_table(spark, root, "packets").filter(f"ts_us < {FAR}")
    assert kept.count() == 1000
    from wirelens.plans.reports import flow_detail
    one = stored.orderBy("id").first()
    detail = flow_detail(stored, kept, one.id).collect()
    size = ft.flow_features(packets).filter(f"id = {one.id}").first().packet_count
    assert len(detail) == size and all(r.src_ip == one.src_ip for r in detail)


def test_l2_alerts(spark, tmp_path):
    from test_l2 import BASE, random_trace
    from wirelens.operators import l2
    from wirelens.schemas import L2_EVENTS
    from wirelens.streaming import l2 as sl2

    rng = random.Random(11)
    cfg = Settings(mac_flood_new_macs=8, cdp_flood_count=4, stp_tc_count=3, l2_slot_s=15)
    rows = []
    for e in random_trace(rng, 500, 300):
        full = dict.fromkeys(L2_EVENTS.fieldNames()) | {k: v for k, v in e.items() if k != "t"}
        full["ts_us"] = BASE + round(e["t"] * 1e6)
        full["timestamp"] = full["ts_us"] / 1e6
        rows.append(tuple(full[f] for f in L2_EVENTS.fieldNames()))
    trace_df = spark.createDataFrame(rows, L2_EVENTS)
    delay_s = 20
    # arrival out of order by less than the delay
    ordered = sorted(rows, key=lambda r: r[1] + rng.random() * (delay_s - 1) * 1e6)
    cuts = [0, 190, 200, 500]
    far = (10 ** 9, FAR, FAR / 1e6, "a", "UDLD") + (None,) * 15
    parts = [ordered[a:b] for a, b in zip(cuts, cuts[1:])] + [[far]]
    for i, part in enumerate(parts):
        sl2.process_batch(spark.createDataFrame(part, L2_EVENTS), i, f"{tmp_path}/s",
                          f"{tmp_path}/out", cfg, delay_s)
        if i == 1:  # a repeated batch changes nothing
            sl2.process_batch(spark.createDataFrame(part, L2_EVENTS), i, f"{tmp_path}/s",
                              f"{tmp_path}/out", cfg, delay_s)
    got = sinks.read_table(spark, f"{tmp_path}/out", "alerts")
    want = l2.l2_alerts(trace_df, cfg)
    cols = ["id", "category", "timestamp", "description"]
    assert sorted(map(str, got.select(cols).collect())) == \
        sorted(map(str, want.select(cols).collect()))
    status = sl2.current_status(spark, f"{tmp_path}/s", len(parts) - 1, cfg).collect()
    assert sorted(map(str, status)) == sorted(map(str, l2.l2_status(trace_df, cfg).collect()))


def test_l2_state_written_is_that_of_touched_keys(spark, tmp_path):
    """Many MACs and addresses are known; a batch about two of them writes these two only."""
    from test_l2 import BASE
    from wirelens.schemas import L2_EVENTS
    from wirelens.streaming import l2 as sl2

    def batch(number, hosts, at):
        rows = []
        for i, host in enumerate(hosts):
            full = dict.fromkeys(L2_EVENTS.fieldNames()) | {
                "segment": "s", "seq": number * 1000 + i, "type": "ARP", "op": "reply",
                "src_ip": f"10.0.0.{host}", "src_mac": f"m{host}", "ts_us": BASE + at * 10**6 + i}
            full["timestamp"] = full["ts_us"] / 1e6
            rows.append(tuple(full[f] for f in L2_EVENTS.fieldNames()))
        sl2.process_batch(spark.createDataFrame(rows, L2_EVENTS), number, f"{tmp_path}/s",
                          f"{tmp_path}/out", Settings(mac_flood_new_macs=1000), delay_s=0)
        return spark.read.parquet(f"{tmp_path}/s/lasting/level=0/run={number}").count()

    assert batch(0, range(200), 0) == 400
    assert batch(1, [3, 7], 100) == 4
    assert batch(2, [3, 500], 200) == 4
    assert sl2._lasting(spark, f"{tmp_path}/s").read(3).count() == 402
    status = sl2.current_status(spark, f"{tmp_path}/s", 2).first()
    assert (status.arp_table_size, status.known_mac_count) == (201, 201)


def test_keyed_table_runs(spark, tmp_path):
    """Latest rows after every batch, few runs, nothing left over, repeated batches included."""
    import glob

    from pyspark.sql import types as T
    from wirelens.streaming.keyed_table import KeyedTable, runs

    assert runs(0) == [] and runs(8) == [(1, 0)] and runs(74, 8) == [(2, 0), (1, 8), (0, 72), (0, 73)]
    schema = T.StructType().add("k", "long").add("v", "long")
    table, held = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], fanout=2), {}
    for b in range(7):
        rows = [(k, 10 * b + k) for k in {b, b // 2, 0}]
        for _ in range(1 + (b in (3, 4))):
            assert {r.k: r.v for r in table.read(b).collect()} == held
            table.write(b, spark.createDataFrame(rows, schema))
        held |= dict(rows)
        assert {r.k: r.v for r in table.read(b + 1).collect()} == held
        kept = {*runs(b + 1, 2), *runs(b, 2)}
        assert len(glob.glob(f"{tmp_path}/t/level=*/run=*")) == len(kept)


def test_l2_stream_runs(spark, tmp_path):
    from wirelens.streaming import l2 as sl2

    path = str(tmp_path / "events")
    trace.l2_events(spark, DATA).orderBy("seq").coalesce(1).write.parquet(path)
    stream = readers.read_l2_events(spark, path, streaming=True)
    run(sl2.l2_alert_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/cp",
                            delay_s=0))
    counts = {r.category: r["count"] for r in
              sinks.read_table(spark, f"{tmp_path}/out", "alerts").groupBy("category").count()
              .collect()}
    assert counts == {"MAC_FLOODING": 4, "ARP_SPOOFING": 13, "STP_ROOT_HIJACK": 11,
                      "STP_TC_FLOOD": 19, "CDP_FLOOD": 8, "DTP_SWITCH_SPOOFING": 4,
                      "VTP_ATTACK": 3, "VLAN_DOUBLE_TAGGING": 25}
