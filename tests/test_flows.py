"""Flow assembly and features on hand-made packets; expected values worked out from the formulas."""

import pytest
from pyspark.sql import functions as F

from wirelens.config import Settings
from wirelens.fixed_values import FEATURE_NAMES
from wirelens.operators import features as ft
from wirelens.operators import flows as fl
from wirelens.operators import inspect as ins
from wirelens.schemas import FLOW_KEY, PACKETS

BASE = 1_704_067_200_000_000
A, B = "10.0.0.1", "10.0.0.2"


def packet(t, length=100, src=A, dst=B, sp=40000, dp=9999, proto="TCP", flags="", entropy=0.0):
    return (BASE + round(t * 1e6), length, src, dst, sp, dp, proto, flags, entropy)


@pytest.fixture()
def make(spark):
    def build(*rows):
        data = [(i, r[0], r[0] / 1e6, r[2], r[3], r[4], r[5], r[6], r[1], r[7], r[8])
                for i, r in enumerate(rows)]
        return spark.createDataFrame(data, PACKETS)
    return build


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_single_packet_is_no_flow(make):
    assert fl.assemble_flows(make(packet(0))).count() == 0


def test_same_timestamp(make):
    f = one(ft.flow_features(make(packet(0, 100), packet(0, 300))))
    assert f.flow_duration == 0.0001
    assert f.flow_bytes_per_sec == pytest.approx(4_000_000)
    assert (f.packet_length_std, f.packet_length_variance) == (100.0, 10_000.0)


def test_three_packets_across_slots(make):
    f = one(ft.flow_features(make(packet(0, 40), packet(1, 60), packet(3, 80))))
    assert (f.flow_duration, f.flow_packets_per_sec) == (3.0, 1.0)
    assert (f.fwd_iat_mean, f.fwd_iat_std) == (1.5, 0.5)
    assert f.packet_length_mean == 60.0
    # the same gaps, cut by slot borders
    g = one(ft.flow_features(make(packet(9.5, 40), packet(10.5, 60), packet(12.5, 80)),
                             cfg=Settings(slot_s=1)))
    assert (g.fwd_iat_mean, g.fwd_iat_std) == (1.5, 0.5)


def test_flags_with_null(make):
    rows = [packet(i, flags=x) for i, x in enumerate(["S", "SA", "PA", "FA", None])]
    f = one(ft.flow_features(make(*rows)))
    assert (f.syn_flag_count, f.ack_flag_count, f.psh_flag_count, f.fin_flag_count,
            f.rst_flag_count) == (2, 3, 1, 1, 0)


def test_same_source_and_destination(make):
    f = one(ft.flow_features(make(*[packet(i, 100, A, A) for i in range(3)])))
    assert (f.total_fwd_packets, f.total_bwd_packets, f.down_up_ratio) == (3, 3, 1.0)
    assert (f.fwd_iat_mean, f.bwd_iat_mean) == (1.0, 1.0)


def test_direction(make):
    back = dict(src=B, dst=A, sp=9999, dp=40000)
    rows = make(packet(0), packet(1), packet(2, **back), packet(3, **back))
    directional = ft.flow_features(rows).collect()
    assert len(directional) == 2
    assert all((f.total_fwd_packets, f.total_bwd_packets) == (2, 0) for f in directional)
    both = one(ft.flow_features(rows, bidirectional=True))
    assert (both.src_ip, both.total_fwd_packets, both.total_bwd_packets) == (A, 2, 2)


def test_initiator_is_the_first_sender(make):
    back = dict(src=B, dst=A, sp=9999, dp=40000)
    f = one(ft.flow_features(make(packet(0, **back), packet(1), packet(2)), bidirectional=True))
    assert (f.src_ip, f.src_port, f.total_fwd_packets, f.total_bwd_packets) == (B, 9999, 1, 2)


def test_header_and_window_by_protocol(make):
    tcp = one(ft.flow_features(make(packet(0), packet(1))))
    udp = one(ft.flow_features(make(packet(0, proto="UDP"), packet(1, proto="UDP"))))
    assert (tcp.fwd_header_length, tcp.init_win_bytes_forward) == (40, 640)
    assert (udp.fwd_header_length, udp.init_win_bytes_forward) == (16, 0)


def _indicators(make, *rows, mode="whole"):
    f = ft.flow_features(make(*rows), mode)
    return one(f.select(ins.app_protocol().alias("app"), ins.anomaly_indicators().alias("ind")))


def test_syn_flood(make):
    rows = [packet(i * 0.0008, flags="S", dp=80) for i in range(51)]
    r = _indicators(make, *rows)
    assert r.ind == ["SYN_FLOOD_PATTERN", "HIGH_PACKET_RATE", "PORT_SCAN_PATTERN"]


def test_fifty_syn_is_not_enough(make):
    r = _indicators(make, *[packet(i * 0.2, flags="S") for i in range(50)])
    assert "SYN_FLOOD_PATTERN" not in r.ind


def test_entropy_and_ports(make):
    r = _indicators(make, *[packet(i * 0.04, dp=443, entropy=7.6) for i in range(50)])
    assert (r.app, r.ind) == ("HTTPS", ["HIGH_ENTROPY_PAYLOAD"])
    edge = _indicators(make, *[packet(i * 0.04, dp=443, sp=80, entropy=7.5) for i in range(50)])
    assert (edge.app, edge.ind) == ("HTTP", [])


def test_idle_gap(make):
    cfg = Settings(min_flow_packets=1)
    assert fl.assemble_flows(make(packet(0), packet(60)), "session", cfg=cfg).count() == 1
    assert fl.assemble_flows(make(packet(0), packet(61)), "session", cfg=cfg).count() == 2
    exact = make(packet(0), packet(60.000001))
    assert fl.assemble_flows(exact, "session", cfg=cfg).count() == 2


def test_sample_cap(make):
    for n, more in ((15, False), (16, True)):
        s = one(fl.sample_packets(make(*[packet(i) for i in range(n)])))
        assert (len(s.packets_sample), s.packets_sample_truncated) == (15, more)
        assert [p.packet_id for p in s.packets_sample] == list(range(15))


def test_ids_agree(make):
    rows = make(*[packet(i) for i in range(4)])
    ids = {r.id for r in fl.assemble_flows(rows).collect()}
    assert ids == {r.flow_id for r in fl.link_packets(rows).collect()}


def test_slot_width_does_not_matter(make):
    rows = make(*[packet(i * i * 0.37 % 170, 40 + i % 7, sp=i % 2, flags="SPA"[i % 3])
                  for i in range(120)])
    for mode in fl.MODES:
        results = []
        for cfg in (Settings(slot_s=1), Settings(slot_s=60), Settings(combine_ties=False)):
            f = ft.flow_features(rows, mode, cfg=cfg)
            results.append(sorted(map(str, f.select(*FLOW_KEY, *FEATURE_NAMES).collect())))
        assert results[0] == results[1] == results[2]


def test_copies(make):
    """A third of the packets are copies of one: sums and gaps count every copy."""
    rows = [packet(1, 50)] * 40 + [packet(i * 0.5, 60) for i in range(80)]
    f = one(ft.flow_features(make(*rows)))
    times = sorted([1.0] * 40 + [i * 0.5 for i in range(80)])
    gaps = [b - a for a, b in zip(times, times[1:])]
    mean = sum(gaps) / len(gaps)
    assert (f.packet_count, f.total_bytes) == (120, 40 * 50 + 80 * 60)
    assert f.fwd_iat_mean == pytest.approx(mean)
    assert f.fwd_iat_std == pytest.approx(
        (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5)


def test_feature_labels(spark):
    df = spark.createDataFrame([(n,) for n in ("fwd_iat_mean", "syn_flag_count", "idle_max",
                                               "down_up_ratio", "other")], "n string")
    out = {r.n: (r.g, r.l) for r in df.select(
        "n", ft.feature_group(F.col("n")).alias("g"), ft.feature_label(F.col("n")).alias("l"))
        .collect()}
    assert out["fwd_iat_mean"] == ("Timing", "Fwd Iat Mean")
    assert out["syn_flag_count"][0] == "TCP Flags"
    assert out["idle_max"][0] == "Timing"
    assert out["down_up_ratio"][0] == "Rate & Ratio"
    assert out["other"][0] == "Other"


def test_vector(make):
    df = ft.feature_vector(ft.flow_features(make(packet(0), packet(1))))
    v = one(df).features
    assert len(v) == 55 and v[1] == 2.0
    a = one(ft.flow_features(make(packet(0), packet(1))).select(ft.feature_array().alias("a"))).a
    assert list(v) == a


def test_packet_sample_limits_packets_before_the_join(spark):
    """Every plan path from the packets to the join of samples and flow numbers is ranked or summed."""
    packets = spark.createDataFrame(
        [(i, i * 1000, "a", "b", 1, 2, "TCP") for i in range(3000)] + [
            (9000 + i, 50 + i, "c", "b", 1, 2, "TCP") for i in range(3)],
        "packet_id long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, "
        "protocol string").selectExpr("*", "ts_us / 1e6 AS timestamp", "10 AS length", "'S' AS flags",
                                      "0d AS payload_entropy")
    out = fl.sample_packets(packets)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4  # before and after the shuffle, for slots and flows
    rows = {r.src_ip: r for r in out.collect()}
    assert [p.packet_id for p in rows["a"].packets_sample] == list(range(15))
    assert rows["a"].flow_packets == 3000 and rows["a"].packets_sample_truncated
    assert len(rows["c"].packets_sample) == 3 and not rows["c"].packets_sample_truncated
