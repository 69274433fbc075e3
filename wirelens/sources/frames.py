"""Raw frames -> packet records and Layer-2 events, as column expressions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.fixed_values import (CISCO_MULTICAST, IP_PROTOCOLS, OTHER_PROTOCOL, SNAP_PROTOCOLS,
                                   STP_MULTICAST)
from wirelens.functions.entropy import byte_entropy

_TAG = "8100"
_IPV4, _ARP = "0800", "0806"
# TCP flag letters from the lowest bit up
_FLAG_BITS = "FSRPAUECN"


class _Hex:
    """Byte-offset access to the headers of a frame through their lower-case hex text."""

    # Ethernet with one tag, the longest IP header and a TCP header end within this many bytes
    HEADERS = 128

    def __init__(self, column: str) -> None:
        self.text = F.lower(F.hex(F.substring(F.col(column), 1, self.HEADERS)))
        self.size = F.octet_length(F.col(column))

    def take(self, offset: int | Column, count: int) -> Column:
        start = F.lit(offset) if isinstance(offset, int) else offset
        return F.substring(self.text, (start * 2 + 1).cast("int"), F.lit(count * 2))

    def number(self, offset: int | Column, count: int) -> Column:
        """Big-endian unsigned integer, null when the frame is too short."""
        digits = self.take(offset, count)
        return F.when(F.length(digits) == count * 2, F.conv(digits, 16, 10).cast("long"))

    def mac(self, offset: int | Column) -> Column:
        digits = self.take(offset, 6)
        return F.concat_ws(":", *[F.substring(digits, 2 * i + 1, 2) for i in range(6)])

    def ip(self, offset: int | Column) -> Column:
        start = F.lit(offset) if isinstance(offset, int) else offset
        return F.concat_ws(".", *[self.number(start + i, 1).cast("string") for i in range(4)])


def decode_ip_frames(df: DataFrame, frame_col: str, ethernet: bool = True) -> DataFrame:
    """A2: IPv4 frames -> packet fields; other frames are dropped, other columns are kept.

    ``ethernet=False`` takes frames that start at the IP header. One or two stacked VLAN tags are
    skipped. A fragment behind the first has no transport header: its protocol is the rest class and
    its ports are 0. The entropy covers the IP payload, the length covers the whole frame.
    """
    h = _Hex(frame_col)
    if ethernet:
        once = h.take(12, 2) == _TAG
        twice = once & (h.take(16, 2) == _TAG)
        base = F.when(twice, F.lit(22)).when(once, F.lit(18)).otherwise(F.lit(14))
        is_ip = h.take(base - 2, 2) == _IPV4
    else:
        base, is_ip = F.lit(0), F.lit(True)
    whole = (h.size >= base + 20) & (h.take(base, 1).startswith("4"))
    rows = df.filter(is_ip & whole).withColumn("_base", base)
    base = F.col("_base")
    rows = rows.withColumn("_body", base + h.number(base, 1).bitwiseAND(15) * 4) \
        .withColumn("_proto", h.number(base + 9, 1))
    body = F.col("_body")
    # a transport header must be present for its protocol to count
    room = h.size - body
    first = h.number(base + 6, 2).bitwiseAND(0x1FFF) == 0
    known = {6: first & (room >= 20), 17: first & (room >= 8), 1: first & (room >= 4)}
    protocol = F.lit(OTHER_PROTOCOL)
    for number, name in IP_PROTOCOLS.items():
        protocol = F.when((F.col("_proto") == number) & known[number], name).otherwise(protocol)
    rows = rows.withColumn("protocol", protocol)
    ported = F.col("protocol").isin("TCP", "UDP")
    bits = F.shiftleft(h.number(body + 12, 1).bitwiseAND(1), 8).bitwiseOR(h.number(body + 13, 1))
    letters = F.concat(*[F.when(bits.bitwiseAND(1 << i) != 0, c).otherwise("")
                         for i, c in enumerate(_FLAG_BITS)])
    end = F.least(h.size, (base + h.number(base + 2, 2)).cast("int"))
    payload = F.substring(F.col(frame_col), (body + 1).cast("int"),
                          F.greatest(end - body, F.lit(0)).cast("int"))
    return rows.withColumns({
        "src_ip": h.ip(base + 12), "dst_ip": h.ip(base + 16),
        "src_port": F.when(ported, h.number(body, 2)).otherwise(0).cast("int"),
        "dst_port": F.when(ported, h.number(body + 2, 2)).otherwise(0).cast("int"),
        "length": h.size.cast("int"),
        "flags": F.when(F.col("protocol") == "TCP", letters)
                  .when(F.col("protocol") == "ICMP", h.number(body, 1).cast("string"))
                  .otherwise(""),
        "payload_entropy": byte_entropy(payload),
    }).drop("_base", "_body", "_proto", frame_col)


def decode_l2_frames(df: DataFrame, frame_col: str) -> DataFrame:
    """A4: Ethernet frames -> Layer-2 event fields in rule order; unmatched frames are dropped."""
    h = _Hex(frame_col)
    dst = h.take(0, 6)
    outer, inner = h.take(12, 2) == _TAG, h.take(16, 2) == _TAG
    stacked = outer & inner & (h.size >= 20)
    net = F.when(outer, F.lit(18)).otherwise(F.lit(14))
    ether_type = F.when(outer, h.take(16, 2)).otherwise(h.take(12, 2))
    is_arp = (ether_type == _ARP) & (h.size >= net + 28)
    # Bridge data starts behind a 14-byte Ethernet and a 3-byte LLC header
    is_stp = (dst == STP_MULTICAST) & (h.size >= 17 + 35)
    # The protocol id sits behind Ethernet, LLC and a 3-byte organisation code
    snap = F.lit(None).cast("string")
    for pid, name in SNAP_PROTOCOLS.items():
        snap = F.when(h.number(20, 2) == pid, name).otherwise(snap)
    kind = (F.when(stacked, "VLAN_DOUBLE_TAG").when(is_arp, "ARP").when(is_stp, "STP")
            .when(dst == CISCO_MULTICAST, snap))
    rows = df.withColumn("type", kind).filter(F.col("type").isNotNull())

    def only(name: str, value: Column) -> Column:
        return F.when(F.col("type") == name, value)

    vlan = {"outer_vlan": 14, "inner_vlan": 18}
    return rows.withColumns({
        "src_mac": h.mac(6), "dst_mac": h.mac(0),
        "op": only("ARP", F.when(h.number(net + 6, 2) == 2, "reply").otherwise("request")),
        "src_hw": only("ARP", h.mac(net + 8)), "src_ip": only("ARP", h.ip(net + 14)),
        "dst_hw": only("ARP", h.mac(net + 18)), "dst_ip": only("ARP", h.ip(net + 24)),
        "root_id": only("STP", h.take(17 + 5, 8)),
        "root_cost": only("STP", h.number(17 + 13, 4)),
        "bridge_id": only("STP", h.take(17 + 17, 8)),
        "topology_change": only("STP", h.number(17 + 4, 1).bitwiseAND(0x01) != 0),
        "topology_change_ack": only("STP", h.number(17 + 4, 1).bitwiseAND(0x80) != 0),
        "revision": F.lit(None).cast("int"),
        **{c: only("VLAN_DOUBLE_TAG", h.number(at, 2).bitwiseAND(0x0FFF).cast("int"))
           for c, at in vlan.items()},
    }).drop(frame_col)
