"""Frame decoders, readers, migrations, sinks and settings."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from wirelens.config import Settings
from wirelens.functions.numbers import human_bytes, human_number, round_half_up
from wirelens.operators.alerts import as_alerts
from wirelens.schemas import ALERTS, L2_EVENTS, PACKETS
from wirelens.sources import frames, readers, sinks

DST, SRC = bytes.fromhex("aabbccddeeff"), bytes.fromhex("020000000001")


def ether(kind, body, dst=DST, tags=()):
    out = dst + SRC
    for t in tags:
        out += struct.pack(">HH", 0x8100, t)
    return out + struct.pack(">H", kind) + body


def ipv4(proto, payload, src=(192, 168, 1, 2), dst=(10, 0, 0, 255)):
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(payload), 0, 0, 64, proto, 0)
    return head + bytes(src) + bytes(dst) + payload


def tcp(sp, dp, flags, data=b""):
    return struct.pack(">HHIIHHHH", sp, dp, 0, 0, 0x5000 | flags, 0, 0, 0) + data


def entropy(data):
    return sum(-data.count(b) / len(data) * math.log2(data.count(b) / len(data))
               for b in set(data)) if data else 0.0


def rows(spark, decode, *data):
    df = spark.createDataFrame(list(enumerate(data)), "n int, frame binary")
    return {r.n: r for r in decode(df, "frame").collect()}


def test_ip_frames(spark):
    payloads = [
        (6, tcp(40000, 443, 0x12, b"hello")), (17, struct.pack(">HHHH", 5353, 53, 8, 0)),
        (1, bytes([8, 0, 0, 0])), (47, b"\x00" * 8), (6, tcp(1, 2, 0x1C3))]
    data = [ether(0x0800, ipv4(p, x)) for p, x in payloads]
    data += [ether(0x86DD, b"\x60" + b"\x00" * 50), ether(0x0800, ipv4(6, tcp(7, 8, 2)), tags=(5,))]
    out = rows(spark, frames.decode_ip_frames, *data)
    assert [out[i].protocol for i in range(5)] == ["TCP", "UDP", "ICMP", "OTHER", "TCP"]
    first = out[0]
    assert (first.src_ip, first.dst_ip) == ("192.168.1.2", "10.0.0.255")
    assert (first.src_port, first.dst_port, first.flags) == (40000, 443, "SA")
    assert first.length == len(data[0])
    assert first.payload_entropy == round(entropy(payloads[0][1]), 2)
    assert (out[1].src_port, out[1].dst_port, out[1].flags) == (5353, 53, "")
    assert (out[2].src_port, out[2].dst_port, out[2].flags) == (0, 0, "8")
    assert (out[3].src_port, out[3].flags) == (0, "")
    assert out[4].flags == "FSECN"
    assert 5 not in out and (out[6].src_port, out[6].flags) == (7, "S")


def test_stacked_tags_and_fragments(spark):
    body = ipv4(6, tcp(7, 8, 2))

    def at(offset):
        return body[:6] + struct.pack(">H", offset) + body[8:]

    out = rows(spark, frames.decode_ip_frames, ether(0x0800, body, tags=(5, 6)),
               ether(0x0800, at(0x2000)), ether(0x0800, at(185)))
    assert (out[0].protocol, out[0].src_port, out[0].src_ip) == ("TCP", 7, "192.168.1.2")
    assert (out[1].protocol, out[1].dst_port) == ("TCP", 8)  # the first fragment has the header
    assert (out[2].protocol, out[2].src_port, out[2].flags) == ("OTHER", 0, "")


def test_bare_ip_frames(spark):
    out = rows(spark, lambda d, c: frames.decode_ip_frames(d, c, ethernet=False),
               ipv4(6, tcp(1, 2, 0x10)))
    assert (out[0].dst_port, out[0].flags, out[0].length) == (2, "A", 40)


def arp(op):
    return struct.pack(">HHBBH", 1, 0x0800, 6, 4, op) + SRC + bytes([1, 2, 3, 4]) + DST \
        + bytes([5, 6, 7, 8])


def bpdu(size):
    body = bytes([0, 0, 0, 0, 0x81]) + bytes.fromhex("8000aabbccddee01") \
        + struct.pack(">I", 19) + bytes.fromhex("8001aabbccddee02")
    frame = bytes.fromhex("0180c2000000") + SRC + struct.pack(">H", 38) + b"\x42\x42\x03" + body
    return (frame + b"\x00" * 60)[:size]


def snap(pid):
    return bytes.fromhex("01000ccccccc") + SRC + struct.pack(">H", 30) + b"\xaa\xaa\x03" \
        + b"\x00\x00\x0c" + struct.pack(">H", pid) + b"\x00" * 8


def test_l2_frames(spark):
    data = [ether(0x0806, arp(2), tags=(1, 20)), ether(0x0806, arp(2), tags=(7,)),
            ether(0x0806, arp(1)), bpdu(52), bpdu(51), snap(0x2000), snap(0x2004), snap(0x9999),
            ether(0x0800, ipv4(6, tcp(1, 2, 2))), snap(0x2003), snap(0x2005), snap(0x0111),
            snap(0x2000)[:21]]
    out = rows(spark, frames.decode_l2_frames, *data)
    assert {n: r.type for n, r in out.items()} == {
        0: "VLAN_DOUBLE_TAG", 1: "ARP", 2: "ARP", 3: "STP", 5: "CDP", 6: "DTP", 9: "VTP",
        10: "PAGP", 11: "UDLD"}
    assert (out[0].outer_vlan, out[0].inner_vlan) == (1, 20)
    assert (out[1].op, out[2].op) == ("reply", "request")
    assert (out[1].src_mac, out[1].dst_mac) == ("02:00:00:00:00:01", "aa:bb:cc:dd:ee:ff")
    assert (out[1].src_ip, out[1].dst_ip, out[1].src_hw, out[1].dst_hw) == (
        "1.2.3.4", "5.6.7.8", "02:00:00:00:00:01", "aa:bb:cc:dd:ee:ff")
    s = out[3]
    assert (s.root_id, s.root_cost, s.bridge_id) == ("8000aabbccddee01", 19, "8001aabbccddee02")
    assert (s.topology_change, s.topology_change_ack) == (True, True)


def test_read_packets_pushes_the_filter(spark, tmp_path):
    data = [(i, i, i / 1e6, "a", "b", 1, 2, p, 60, "", 0.0)
            for i, p in enumerate(["TCP", "UDP", "ICMP", "OTHER"])]
    spark.createDataFrame(data, PACKETS).write.parquet(f"{tmp_path}/p")
    df = readers.read_packets(spark, f"{tmp_path}/p")
    assert df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(protocol" in plan.split("PushedFilters")[1]
    assert readers.read_packets(spark, f"{tmp_path}/p", protocols=None).count() == 4
    spark.createDataFrame(data, PACKETS).write.json(f"{tmp_path}/j")
    assert readers.read_packets(spark, f"{tmp_path}/j", fmt="json").count() == 3
    assert readers.read_packets(spark, f"{tmp_path}/p", streaming=True).isStreaming
    spark.createDataFrame([], L2_EVENTS).write.parquet(f"{tmp_path}/l2")
    assert readers.read_l2_events(spark, f"{tmp_path}/l2").count() == 0


def test_json_column(spark):
    df = spark.createDataFrame([("{\"a\": \"x\"}",), ("",), ("{bad",), (None,)], "j string")
    out = [r.v for r in readers.parse_json_col(df, "j", "map<string,string>", "v").collect()]
    assert out[0] == {"a": "x"} and not out[1] and not out[2] and not out[3]
    assert out[1] is not None and out[3] is not None


def test_ensure_columns(spark):
    df = readers.ensure_columns(spark.range(2), {"layer": ("string", "L3"), "id": ("long", 9)})
    assert [tuple(r) for r in df.collect()] == [(0, "L3"), (1, "L3")]


@pytest.mark.parametrize("label", ["Label", "label", "My label"])
def test_labelled_csv(spark, tmp_path, label):
    path = tmp_path / "flows.csv"
    path.write_text(f"Flow ID, Src IP, Flow Bytes/s, Count,{label}\n"
                    "1,1.1.1.1,1.5,2,BENIGN\n2,1.1.1.1,Infinity,2,DoS\n3,1.1.1.1,,2,DoS\n"
                    "4,1.1.1.1,2.5,3,DoS\n")
    out = readers.load_labelled_flows(spark, str(path))
    assert out.columns == ["Flow Bytes/s", "Count", "label"]
    assert sorted(tuple(r) for r in out.collect()) == [(1.5, 2, "BENIGN"), (2.5, 3, "DoS")]


def alert(i, score=80.0):
    return dict(id=i, timestamp=1_700_000_000.0 + i, attack_type='T "q", x', threat_score=score)


def test_store_and_export(spark, tmp_path):
    df = as_alerts(spark.createDataFrame([alert(i) for i in range(5)]))
    assert df.schema.fieldNames() == ALERTS.fieldNames()
    assert {(r.layer, r.acknowledged) for r in df.collect()} == {("L3", False)}
    for _ in range(2):
        sinks.store(str(tmp_path / "t"), alerts=df, batch_id=3)
    sinks.store(str(tmp_path / "t"), alerts=df, batch_id=4)
    stored = sinks.read_table(spark, str(tmp_path / "t"), "alerts")
    assert stored.count() == 10 and "dt" in stored.columns
    sinks.export_alerts(df, str(tmp_path / "j"), "json", limit=3)
    assert [r.id for r in spark.read.json(str(tmp_path / "j")).orderBy("id").collect()] == [2, 3, 4]
    sinks.export_alerts(df, str(tmp_path / "c"), "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert back.columns == ALERTS.fieldNames()
    assert {r.attack_type for r in back.collect()} == {'T "q", x'}
    with pytest.raises(ValueError):
        sinks.export_alerts(df, str(tmp_path / "x"), "xml")


def test_settings():
    assert Settings().updated(threat_threshold=50, anomaly_threshold=None).threat_threshold == 50
    for bad in ({"threat_threshold": 101}, {"anomaly_threshold": -0.1}, {"slot_s": 7},
                {"mac_flood_new_macs": 0}, {"l2_slot_s": 5}, {"no_such": 1}):
        with pytest.raises(ValueError):
            Settings().updated(**bad)


def test_display_numbers(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1536, 1048576, 5 * 1024 ** 3,
                                               1024 ** 4)], "n long")
    out = [tuple(r) for r in df.select(human_bytes("n"), human_number("n")).collect()]
    assert out == [("0 B", "0"), ("1023 B", "1.0K"), ("1 KB", "1.0K"), ("1.5 KB", "1.5K"),
                   ("1 MB", "1.0M"), ("5 GB", "5.4B"), ("1024 GB", "1099.5B")]
    x = spark.range(1).select(round_half_up(F.lit(1.005), 2).alias("x")).first().x
    assert x == 1.01


def test_numbers_beyond_a_long(spark, tmp_path):
    from decimal import Decimal

    from wirelens.plans import catalog

    df = spark.createDataFrame([(Decimal(10) ** 21,), (Decimal(10) ** 29 + 1,), (Decimal(53687091199),)],
                               "n decimal(38,0)")
    out = [tuple(r) for r in df.select(human_bytes("n"), human_number("n")).collect()]
    assert out == [("931322574615.5 GB", "1000000000000.0B"),
                   ("93132257461547851562.5 GB", "100000000000000000000.0B"), ("50 GB", "53.7B")]
    # one 5-tuple of 100 000 packets of 1500 bytes
    spark.range(100_000).selectExpr(
        "id AS event_id", "timestamp'2024-01-01' AS ts", "0L AS user_id", "'view' AS event_type",
        "1e5 AS value", """'{"k": 4}' AS props""").write.parquet(str(tmp_path / "events.parquet"))
    row = catalog.human_units(spark, str(tmp_path)).collect()
    assert [(r.n, r.bytes_text, r.number_text) for r in row] == [
        (None, "2095475792884.8 GB", "2250000000000.0B")]
