"""Layer-2 rules: hand-made cases, and random traces against a plain sequential replay."""

import random
from collections import defaultdict

import pytest

from wirelens.config import Settings
from wirelens.operators import greedy, l2, ordered
from wirelens.schemas import L2_EVENTS

BASE = 1_704_067_200_000_000
FIELDS = L2_EVENTS.fieldNames()


@pytest.fixture()
def make(spark):
    def build(*events):
        rows = []
        for i, e in enumerate(events):
            full = dict.fromkeys(FIELDS)
            full |= {"segment": "s", "seq": i, "dst_mac": "ff"}
            full |= {k: v for k, v in e.items() if k != "t"}
            full["ts_us"] = BASE + round(e["t"] * 1e6)
            full["timestamp"] = full["ts_us"] / 1e6
            rows.append(tuple(full[f] for f in FIELDS))
        return spark.createDataFrame(rows, L2_EVENTS)
    return build


def arp(t, ip="1.1.1.1", mac="m1", op="reply", hw=None, **kw):
    return dict(t=t, type="ARP", op=op, src_ip=ip, src_mac=mac, src_hw=hw, **kw)


def stp(t, root=None, tc=False, mac="m"):
    return dict(t=t, type="STP", root_id=root, topology_change=tc, src_mac=mac)


def of(kind, t, mac="m", **kw):
    return dict(t=t, type=kind, src_mac=mac, **kw)


def seqs(df):
    return sorted(r.seq for r in df.select("seq").collect())


def by_case(make, rule, *cases):
    """Run a rule once over all cases, each in a segment of its own; positions that fired."""
    events = [dict(e, segment=f"s{i}") for i, case in enumerate(cases) for e in case]
    starts = [sum(len(c) for c in cases[:i]) for i in range(len(cases))]
    out = [[] for _ in cases]
    for r in rule(make(*events)).select("segment", "seq").collect():
        i = int(r.segment[1:])
        out[i].append(r.seq - starts[i])
    return [sorted(x) for x in out]


def test_arp(make):
    moves = [arp(i, mac=m) for i, m in enumerate(["m1", "m2", "m2", "m1"])]
    ignored = [arp(0), arp(1, mac="m2", op="request"), arp(2, ip="0.0.0.0"),
               arp(3, ip="0.0.0.0", mac="m2"), arp(4, mac=""), arp(5, ip=None, mac="m2")]
    empty_hw = [arp(0, mac="m1", hw=""), arp(1, mac="m2", hw="")]
    same_hw = [arp(0, mac="m1", hw="h"), arp(1, mac="m2", hw="h")]
    assert by_case(make, l2.arp_spoofing, moves, ignored, empty_hw, same_hw) == [
        [1, 3], [], [1], []]


def test_arp_record(make):
    r = l2.arp_spoofing(make(arp(0), arp(500, mac="m2"))).collect()[0]
    assert (r.threat_score, r.risk_level, r.layer) == (92.0, "HIGH RISK / ATTACK", "L2")
    assert r.details == {"ip": "1.1.1.1", "previous_mac": "m1", "new_mac": "m2"}
    assert r.description.startswith("IP 1.1.1.1 was bound to MAC m1, but a new ARP reply now "
                                    "claims it belongs to m2.")


def flood(n, span, start=0.0, prefix="x"):
    return [of("CDP", start + span * i / n, mac=f"{prefix}{i}") for i in range(n)]


def test_mac_flood(make):
    burst = flood(60, 5)
    alert = burst[39]["t"]
    alone = burst + [of("CDP", alert + 10, mac="late")]
    crowd = burst + flood(40, 3, alert + 6, "y") + [of("CDP", alert + 10, mac="late")]
    known = flood(39, 5) + flood(39, 5, 20) + [of("CDP", 25.5, mac="x0")]
    assert by_case(make, l2.mac_flooding, flood(40, 9.9), burst, alone, crowd, known) == [
        [39], [39], [39], [39, 100], []]


def test_flood_suppresses_binding(make):
    events = [arp(-1, ip="9.9.9.9", mac="old")] + flood(38, 5) \
        + [arp(6, ip="9.9.9.9", mac="new"), arp(7, ip="9.9.9.9", mac="old"),
           arp(8, ip="9.9.9.9", mac="new")]
    ev = make(*events)
    assert seqs(l2.mac_flooding(ev)) == [39]
    # the conflicting reply 39 raised the flood alert only and left the old binding in place
    assert seqs(l2.arp_spoofing(ev)) == [41]


def test_stp(make):
    roots = [stp(i * 100, r) for i, r in
             enumerate(["8000.x", "8000.x", "0001.y", "0001.y", "4000.z"])]
    changes = [stp(i, None, True) for i in range(6)]
    lowered = [stp(0, "5")] + [stp(1 + i, None, True) for i in range(4)] + [stp(6, "1", True)]
    edge = [stp(i * 2.5, None, True) for i in range(5)]
    late = [stp(i, None, True) for i in range(4)] + [stp(10.000001, None, True)]
    cases = (roots, changes, lowered, edge, late)
    assert by_case(make, l2.stp_root_hijack, *cases) == [[2], [], [5], [], []]
    assert by_case(make, l2.stp_tc_flood, *cases) == [[], [4, 5], [], [4], []]


def test_cdp(make):
    once = [of("CDP", i * 0.5) for i in range(20)]
    twice = [of("CDP", i * 0.25) for i in range(40)]
    shared = [of("CDP", i * 0.5, mac=m) for i in range(19) for m in ("a", "b")]
    assert by_case(make, l2.cdp_flood, once, twice, shared) == [[19], [19, 39], []]


def test_dtp_vtp_vlan(make):
    assert seqs(l2.dtp_spoofing(make(*[of("DTP", t) for t in (0, 10, 30, 45)]))) == [0, 2]
    revisions = [of("VTP", i * 50, revision=r) for i, r in
                 enumerate([10, 60, 61, 112, 5, 55, 106])]
    gap = [of("VTP", i, revision=r) for i, r in enumerate([10, None, 70])]
    assert by_case(make, l2.vtp_attack, revisions, gap) == [[3, 6], [2]]
    ev = make(of("VLAN_DOUBLE_TAG", 0, outer_vlan=1, inner_vlan=20), of("PAGP", 1), of("UDLD", 2))
    out = l2.l2_alerts(ev).collect()
    assert [r.category for r in out] == ["VLAN_DOUBLE_TAGGING"]
    assert out[0].details == {"outer_vlan": "1", "inner_vlan": "20"}


# --- sequential replay ----------------------------------------------------------------------------
def replay(events, cfg):
    """(category, seq) of every alert of one segment, one event after the other, in microseconds."""
    us = 1_000_000
    seen, sightings, flood_at = set(), [], None
    binding, root, tc, cdp, dtp, revision = {}, None, [], defaultdict(list), {}, None
    out = []
    for e in sorted(events, key=lambda e: (e["ts"], e["seq"])):
        t, mac, kind = e["ts"], e["src_mac"], e["type"]
        hit = None
        if kind in ("ARP", "CDP") and mac:
            sightings = [x for x in sightings if t - x[0] <= cfg.mac_flood_window_s * us]
            sightings.append((t, mac))
            new = mac not in seen
            seen.add(mac)
            if (new and len({m for _, m in sightings}) >= cfg.mac_flood_new_macs
                    and (flood_at is None or t - flood_at >= cfg.mac_flood_window_s * us)):
                flood_at, hit = t, "MAC_FLOODING"
        if hit is None and kind == "ARP" and e["op"] == "reply" and e["src_ip"] and mac:
            if binding.get(e["src_ip"], mac) != mac:
                hit = "ARP_SPOOFING"
            binding[e["src_ip"]] = mac
        elif hit is None and kind == "CDP":
            q = cdp[mac] = [x for x in cdp[mac] if t - x <= cfg.cdp_flood_window_s * us] + [t]
            if len(q) >= cfg.cdp_flood_count:
                cdp[mac], hit = [], "CDP_FLOOD"
        elif kind == "STP":
            if e["root_id"]:
                if root is not None and e["root_id"] < root:
                    hit = "STP_ROOT_HIJACK"
                root = e["root_id"] if root is None else min(root, e["root_id"])
            if e["topology_change"]:
                tc = [x for x in tc if t - x <= cfg.stp_tc_window_s * us] + [t]
                if hit is None and len(tc) >= cfg.stp_tc_count:
                    hit = "STP_TC_FLOOD"
        elif kind == "DTP" and t - dtp.get(mac, -10**18) >= cfg.dtp_cooldown_s * us:
            dtp[mac], hit = t, "DTP_SWITCH_SPOOFING"
        elif kind == "VTP" and e["revision"] is not None:
            if revision is not None and e["revision"] > revision + cfg.vtp_revision_jump:
                hit = "VTP_ATTACK"
            revision = e["revision"]
        elif kind == "VLAN_DOUBLE_TAG":
            hit = "VLAN_DOUBLE_TAGGING"
        if hit:
            out.append((hit, e["seq"]))
    return out


def random_trace(rng, n, ticks):
    """Few distinct times (many ties), few macs and addresses, all event types."""
    events = []
    for i in range(n):
        kind = rng.choice(["ARP", "ARP", "CDP", "CDP", "STP", "DTP", "VTP", "VLAN_DOUBLE_TAG"])
        events.append({
            "seq": i, "segment": rng.choice("ab"), "type": kind,
            "t": rng.choice([rng.randrange(ticks) * 0.5, rng.random() * ticks / 2]),
            "src_mac": rng.choice(["", f"m{rng.randrange(6)}", f"m{rng.randrange(6)}",
                                   f"m{rng.randrange(60)}"]),
            "op": rng.choice(["reply", "reply", "request"]),
            "src_ip": rng.choice(["", "ip1", "ip2", "ip3"]),
            "root_id": rng.choice([None, "", str(rng.randrange(1000, 9999))]),
            "topology_change": rng.random() < 0.5,
            "revision": rng.choice([None, rng.randrange(200)])})
    return events


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_equal_replay(make, seed):
    rng = random.Random(seed)
    cfg = Settings(mac_flood_new_macs=8, cdp_flood_count=4, stp_tc_count=3, l2_slot_s=15)
    events = random_trace(rng, 700, 300)
    got = sorted((r.segment, r.category, r.seq)
                 for r in l2.l2_alerts(make(*events), cfg).select("segment", "category", "seq")
                 .collect())
    want = []
    for seg in "ab":
        own = [dict(e, ts=BASE + round(e["t"] * 1e6)) for e in events if e["segment"] == seg]
        want += [(seg, c, s) for c, s in replay(own, cfg)]
    assert got == sorted(want)
    assert len({c for _, c, _ in got}) == 8


def spaced(rows, gap):
    """Rows (key, position, tie) that fire, one after the other."""
    want, last = [], {}
    for k, pos, tie in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if k not in last or pos - last[k] >= gap:
            last[k] = pos
            want.append((k, pos, tie))
    return sorted(want, key=str)


@pytest.mark.parametrize("gap,chunk", [(1, 16), (7, 100_000), (40, 16), (40, 300), (900, 16)])
def test_greedy_spacing(spark, gap, chunk):
    rng = random.Random(gap)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(5000), i) for i in range(1500)]
    rows += [("c", 10, 1), ("d", 7, 1), ("d", 9000, 2)]  # keys of one chunk next to keys of many
    df = spark.createDataFrame(rows, "k string, pos long, tie long")
    got = greedy.greedy_spacing(df, ["k"], "pos", "tie", gap, chunk)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == spaced(rows, gap)


def test_greedy_spacing_chunks_are_bounded(spark, tmp_path, monkeypatch):
    """A candidate at every tick of several gaps: no Arrow group is larger than a chunk."""
    plain, sizes = greedy._longs, str(tmp_path / "sizes")

    def noted(table, column):
        with open(sizes, "a") as file:
            file.write(f"{table.num_rows}\n")
        return plain(table, column)

    monkeypatch.setattr(greedy, "_longs", noted)
    rows = [("k", i, i) for i in range(4000)] + [("sparse", 997 * i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, pos long, tie long")
    got = greedy.greedy_spacing(df, ["k"], "pos", "tie", 1500, 128)
    assert sorted(map(tuple, got.collect()), key=str) == spaced(rows, 1500)
    with open(sizes) as file:
        assert max(map(int, file)) == 128


def test_ordered_next(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(300), i, rng.choice([None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t long, tie long, v long")
    got = {r.tie: r.n for r in ordered.ordered_next(df, ["k"], "t", "tie", "v", "n", 20).collect()}
    for k, t, tie, _ in rows:
        later = [v for (_, _, v) in sorted((x[1], x[2], x[3]) for x in rows if x[0] == k
                                           and x[3] is not None and (x[1], x[2]) >= (t, tie))]
        assert got[tie] == (later[0] if later else None)


def test_rolling_distinct_and_count(spark):
    rng = random.Random(5)
    rows = [("k", rng.randrange(400), i, f"v{rng.randrange(12)}") for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, tie long, v string")
    n = {r.tie: r.n for r in ordered.rolling_count(df, ["k"], "t", "tie", 20, "n", 50).collect()}
    d = {r.tie: r.d for r in
         ordered.rolling_distinct(df, ["k"], "t", "tie", "v", 20, "d", 50).collect()}
    upto = sorted((t, tie, v) for _, t, tie, v in rows)
    for i, (t, tie, _) in enumerate(upto):
        window = [x for x in upto[:i + 1] if t - x[0] <= 20]
        assert n[tie] == len(window)
        assert d[tie] == len({x[2] for x in window})


def test_neighbour_chunks_are_bounded(spark):
    df = spark.range(1000).withColumnRenamed("id", "i")
    sizes = ordered.neighbour_chunks(df, "i", 3, 4, size=50).groupBy("_slot").count().collect()
    assert max(r["count"] for r in sizes) <= 57
    assert ordered.neighbour_chunks(df, "i", 3, 4, size=50).filter("_own").count() == 1000


def test_status(make):
    events = [arp(0, mac="m1"), arp(1, ip="2.2.2.2", mac="m2"), of("CDP", 2, mac="m3"),
              stp(3, "5000", mac="r1"), stp(4, "4000", mac="r2"), stp(5, "4000", mac="r3"),
              of("VTP", 6, revision=7), of("VTP", 7, revision=3), of("VTP", 8, revision=None)]
    r = l2.l2_status(make(*events)).collect()[0]
    assert (r.arp_table_size, r.known_mac_count) == (2, 3)
    assert (r.stp_root_id, r.stp_root_mac, r.vtp_last_revision) == ("4000", "r2", 3)
