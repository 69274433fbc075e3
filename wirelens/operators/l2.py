"""Layer-2 detectors (G*): stateful rules over events ordered by (``ts_us``, ``seq``) per segment.

One segment may hold every event, so no rule groups rows by the bare segment: ordered scans are cut
into time slots, distinct counts run over span edges, and greedy rules work on chunks of candidates.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.config import DEFAULTS, Settings
from wirelens.fixed_values import L2_ALERTS
from wirelens.operators.greedy import cooldown, reset_on_fire
from wirelens.operators.ordered import (ordered_lag, presence_spans, rolling_count,
                                        running_min_before, running_sum)
from wirelens.operators.scoring import severity_band
from wirelens.schemas import L2_EVENTS
from wirelens.session import BROADCAST_ROWS, cut_lineage

SEG, TS, SEQ = "segment", "ts_us", "seq"
_US = 1_000_000
# what an alert needs of its event
_EVENT = [SEG, TS, SEQ, "timestamp", "type", "src_mac", "dst_mac", "src_ip", "dst_ip"]
_NO_MAC = ""

# What a rule has learned from earlier batches is kept as rows in the event schema, each under a
# type of its own (see ``learned_rows``). Rules read them next to new events; they raise no alert.
MAC_SEEN, MAC_FIRED, ARP_BOUND, STP_ROOT, STP_CHANGE, CDP_OPEN, DTP_FIRED, VTP_LAST = LEARNED = (
    "_MAC_SEEN", "_MAC_FIRED", "_ARP_BOUND", "_STP_ROOT", "_STP_CHANGE", "_CDP_OPEN",
    "_DTP_FIRED", "_VTP_LAST")


def _filled(name: str) -> Column:
    """The column with '' as null, as empty addresses count as missing."""
    return F.when(F.col(name) != "", F.col(name))


def _description(template: str, values: dict[str, Column]) -> Column:
    """Fill {name} marks; a missing value prints as None."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[
        F.coalesce(values[p].cast("string"), F.lit("None")) if i % 2 else F.lit(p)
        for i, p in enumerate(parts) if p])


def alert_record(df: DataFrame, category: str, details: dict[str, Column],
                 **other: Column) -> DataFrame:
    """Event rows that fired -> alert records. ``other`` only feeds the description."""
    fixed = L2_ALERTS[category]
    severity = F.lit(float(fixed["severity"]))
    values = {**{c: F.col(c) for c in df.columns}, **details, **other}
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    empty = F.create_map().cast("map<string,string>")
    return df.select(
        F.xxhash64(F.lit("L2"), F.lit(category), SEG, SEQ).alias("id"),
        "timestamp", F.lit(None).cast("bigint").alias("flow_id"), "src_ip", "dst_ip",
        F.lit(fixed["title"]).alias("attack_type"), severity.alias("threat_score"),
        F.lit(fixed["action"]).alias("recommended_action"),
        F.lit(False).alias("acknowledged"), F.lit("L2").alias("layer"),
        F.lit(category).alias("category"), "src_mac", "dst_mac",
        (F.create_map(*pairs) if pairs else empty).alias("details"),
        severity_band(severity).alias("risk_level"),
        _description(fixed["description"], values).alias("description"),
        SEG, TS, SEQ)


def _of_type(events: DataFrame, *types: str) -> DataFrame:
    return events.filter(F.col("type").isin(*types))


def _new(rows: DataFrame) -> DataFrame:
    """Without the rows that stand for earlier batches."""
    return rows.filter(~F.col("type").startswith("_"))


def mac_flood_candidates(events: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """First sightings of a MAC while the window holds enough distinct MACs."""
    window = cfg.mac_flood_window_s * _US
    seen = _of_type(events, "ARP", "CDP", MAC_SEEN).filter(_filled("src_mac").isNotNull()) \
        .select(*_EVENT)
    payload = [c for c in _EVENT if c not in (SEG, TS, SEQ, "src_mac")]
    edges = presence_spans(seen, [SEG], "src_mac", TS, SEQ, window, payload)
    present = running_sum(edges, [SEG], [TS, "_kind", SEQ], "_delta", "distinct_macs",
                          cfg.l2_slot_s * _US)
    crowded = present.filter(F.col("fresh") & (F.col("distinct_macs") >= cfg.mac_flood_new_macs))
    return _new(crowded).select(*_EVENT, "distinct_macs")


def mac_flood_events(events: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    earlier = _of_type(events, MAC_FIRED).select(
        *_EVENT, F.lit(None).cast("long").alias("distinct_macs"))
    return _new(cooldown(mac_flood_candidates(events, cfg).unionByName(earlier), [SEG], TS, SEQ,
                         cfg.mac_flood_window_s * _US))


def flood_firings(events: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """The flood events as a stored table: several rules exclude them, and none recomputes them."""
    return cut_lineage(mac_flood_events(events, cfg))


def mac_flooding(events: DataFrame, cfg: Settings = DEFAULTS, fired: DataFrame | None = None
                 ) -> DataFrame:
    """A burst of MACs; at most one alert per window length."""
    fired = mac_flood_events(events, cfg) if fired is None else fired
    return alert_record(fired, "MAC_FLOODING", {
        "distinct_macs_in_window": F.col("distinct_macs"),
        "window_seconds": F.lit(cfg.mac_flood_window_s)})


def without_flood(events: DataFrame, fired: DataFrame) -> DataFrame:
    """An event that raised a flood alert is not looked at by the other rules.

    Firings are at least one window apart per segment. They are counted, and only a small table is
    broadcast, which spares the events a shuffle.
    """
    side = fired.select(SEG, SEQ)
    small = side.count() <= BROADCAST_ROWS
    return events.join(F.broadcast(side) if small else side, [SEG, SEQ], "left_anti")


def arp_bindings(events: DataFrame) -> DataFrame:
    """ARP replies that bind an address: ``ip`` and ``mac`` are both present."""
    mac = F.coalesce(_filled("src_hw"), _filled("src_mac"))
    return (_of_type(events, "ARP", ARP_BOUND).filter(F.col("op") == "reply")
            .withColumns({"ip": _filled("src_ip"), "mac": mac})
            .filter(F.col("ip").isNotNull() & (F.col("ip") != "0.0.0.0")
                    & F.col("mac").isNotNull()))


def arp_spoofing(events: DataFrame, cfg: Settings = DEFAULTS, fired: DataFrame | None = None
                 ) -> DataFrame:
    """G1: a reply moves an address to another MAC than its previous reply did."""
    fired = flood_firings(events, cfg) if fired is None else fired
    bound = without_flood(arp_bindings(events).select(*_EVENT, "ip", "mac"), fired)
    moved = ordered_lag(bound, [SEG, "ip"], TS, SEQ, "mac", "previous", cfg.l2_slot_s * _US) \
        .filter(F.col("previous") != F.col("mac"))
    return alert_record(_new(moved), "ARP_SPOOFING", {
        "ip": F.col("ip"), "previous_mac": F.col("previous"), "new_mac": F.col("mac")})


def _stp_roots(events: DataFrame, cfg: Settings) -> DataFrame:
    rooted = _of_type(events, "STP", STP_ROOT).filter(_filled("root_id").isNotNull())
    lower = running_min_before(rooted.select(*_EVENT, "root_id"), [SEG], TS, SEQ, "root_id",
                               "previous_root", cfg.l2_slot_s * _US) \
        .filter(F.col("root_id") < F.col("previous_root"))
    return _new(lower)


def stp_root_hijack(events: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """A strictly lower root id than any seen before."""
    return alert_record(_stp_roots(events, cfg), "STP_ROOT_HIJACK", {
        "claimed_root_id": F.col("root_id"), "previous_root_id": F.col("previous_root")})


def stp_tc_flood(events: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Many topology changes in the window, unless the same event hijacked the root."""
    changes = _of_type(events, "STP", STP_CHANGE).filter("topology_change").select(*_EVENT)
    counted = rolling_count(changes, [SEG], TS, SEQ, cfg.stp_tc_window_s * _US, "changes",
                            cfg.l2_slot_s * _US).filter(F.col("changes") >= cfg.stp_tc_count)
    hijacks = _stp_roots(events, cfg).select(SEG, SEQ)
    return alert_record(
        _new(counted).join(hijacks, [SEG, SEQ], "left_anti"), "STP_TC_FLOOD",
        {"tc_count_in_window": F.col("changes")}, window_seconds=F.lit(cfg.stp_tc_window_s))


def _cdp_frames(events: DataFrame, fired: DataFrame) -> DataFrame:
    return without_flood(_of_type(events, "CDP", CDP_OPEN).select(*_EVENT), fired) \
        .withColumn("mac", F.coalesce("src_mac", F.lit(_NO_MAC)))


def _cdp_fired(frames: DataFrame, cfg: Settings) -> DataFrame:
    return reset_on_fire(frames, [SEG, "mac"], TS, SEQ, cfg.cdp_flood_window_s * _US,
                         cfg.cdp_flood_count, cfg.l2_slot_s * _US)


def cdp_flood(events: DataFrame, cfg: Settings = DEFAULTS, fired: DataFrame | None = None
              ) -> DataFrame:
    """Many frames of one MAC in the window, which an alert empties."""
    fired = flood_firings(events, cfg) if fired is None else fired
    return alert_record(_new(_cdp_fired(_cdp_frames(events, fired), cfg)), "CDP_FLOOD",
                        {"window_seconds": F.lit(cfg.cdp_flood_window_s)})


def _dtp_fired(events: DataFrame, cfg: Settings) -> DataFrame:
    frames = _of_type(events, "DTP", DTP_FIRED).select(*_EVENT) \
        .withColumn("mac", F.coalesce("src_mac", F.lit(_NO_MAC)))
    return cooldown(frames, [SEG, "mac"], TS, SEQ, cfg.dtp_cooldown_s * _US)


def dtp_spoofing(events: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Any trunk negotiation, once per MAC and cooldown."""
    return alert_record(_new(_dtp_fired(events, cfg)), "DTP_SWITCH_SPOOFING", {})


def vtp_attack(events: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """The revision jumps far above the previous one."""
    revisions = _of_type(events, "VTP", VTP_LAST).filter(F.col("revision").isNotNull()) \
        .select(*_EVENT, "revision")
    jumps = ordered_lag(revisions, [SEG], TS, SEQ, "revision", "previous", cfg.l2_slot_s * _US) \
        .filter(F.col("revision") > F.col("previous") + cfg.vtp_revision_jump)
    return alert_record(_new(jumps), "VTP_ATTACK", {
        "previous_revision": F.col("previous"), "new_revision": F.col("revision")})


def vlan_hopping(events: DataFrame) -> DataFrame:
    """Every double-tagged frame."""
    return alert_record(
        _of_type(events, "VLAN_DOUBLE_TAG").select(*_EVENT, "outer_vlan", "inner_vlan"),
        "VLAN_DOUBLE_TAGGING",
        {"outer_vlan": F.col("outer_vlan"), "inner_vlan": F.col("inner_vlan")})


def l2_alerts(events: DataFrame, cfg: Settings = DEFAULTS, fired: DataFrame | None = None
              ) -> DataFrame:
    """All rules, at most one alert per event."""
    fired = flood_firings(events, cfg) if fired is None else fired
    parts = [mac_flooding(events, cfg, fired), arp_spoofing(events, cfg, fired),
             stp_root_hijack(events, cfg), stp_tc_flood(events, cfg),
             cdp_flood(events, cfg, fired), dtp_spoofing(events, cfg), vtp_attack(events, cfg),
             vlan_hopping(events)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def l2_status(events: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """What the rules have learned so far, one row per segment."""
    fired = flood_firings(events, cfg)
    when = F.struct(TS, SEQ)
    arp = (without_flood(arp_bindings(events).select(SEG, SEQ, "ip"), fired)
           .select(SEG, "ip").distinct().groupBy(SEG)
           .agg(F.count(F.lit(1)).alias("arp_table_size")))
    macs = (_of_type(events, "ARP", "CDP", MAC_SEEN).filter(_filled("src_mac").isNotNull())
            .select(SEG, "src_mac").distinct().groupBy(SEG)
            .agg(F.count(F.lit(1)).alias("known_mac_count")))
    stp = F.col("type").isin("STP", STP_ROOT)
    root = F.when(stp, _filled("root_id"))
    learned = events.groupBy(SEG).agg(
        F.min(root).alias("stp_root_id"),
        F.min_by(F.when(stp, F.col("src_mac")), F.when(
            root.isNotNull(), F.struct(root.alias("r"), F.col(TS), F.col(SEQ))))
        .alias("stp_root_mac"),
        F.max_by("revision", F.when(F.col("type").isin("VTP", VTP_LAST)
                                            & F.col("revision").isNotNull(),
                                    when)).alias("vtp_last_revision"))
    # one small row per segment and part, put side by side by an aggregation
    parts = learned.unionByName(arp, allowMissingColumns=True) \
        .unionByName(macs, allowMissingColumns=True)
    counts = ["arp_table_size", "known_mac_count"]
    return parts.groupBy(SEG).agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts],
        *[F.max(c).alias(c) for c in ("stp_root_id", "stp_root_mac", "vtp_last_revision")])


def learned_rows(events: DataFrame, cfg: Settings, fired: DataFrame, now_us: int) -> DataFrame:
    """What later batches need to know of ``events`` (new events and earlier learned rows).

    Every part is an aggregate per address or a short window before ``now_us``; no event after
    ``now_us`` may have been processed.
    """
    columns = L2_EVENTS.fieldNames()
    latest = F.struct(TS, SEQ)

    def last_per(rows: DataFrame, *keys: str | Column) -> DataFrame:
        return (rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), latest).alias("r"))
                .select("r.*"))

    def kept(rows: DataFrame, kind: str) -> DataFrame:
        return rows.withColumn("type", F.lit(kind)).select(*columns)

    def within(rows: DataFrame, seconds: int) -> DataFrame:
        return rows.filter(F.col(TS) >= now_us - seconds * _US)

    def full(rows: DataFrame) -> DataFrame:
        """Pad rows of a few columns to the event schema."""
        return rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType)
            .alias(f.name) for f in L2_EVENTS.fields])

    sighted = _of_type(events, "ARP", "CDP", MAC_SEEN).filter(_filled("src_mac").isNotNull())
    flooded = full(fired).unionByName(_of_type(events, MAC_FIRED).select(*columns))
    bound = without_flood(arp_bindings(events), fired).withColumn("src_hw", F.col("mac"))
    rooted = _of_type(events, "STP", STP_ROOT).filter(_filled("root_id").isNotNull())
    lowest = (rooted.groupBy(SEG)
              .agg(F.min_by(F.struct(*columns), F.struct("root_id", TS, SEQ)).alias("r"))
              .select("r.*"))
    changes = _of_type(events, "STP", STP_CHANGE).filter("topology_change")
    frames = _cdp_frames(events, fired)
    cleared = _cdp_fired(frames, cfg).groupBy(SEG, "mac").agg(F.max(latest).alias("_cleared"))
    open_frames = within(frames, cfg.cdp_flood_window_s).join(cleared, [SEG, "mac"], "left") \
        .filter(F.col("_cleared").isNull() | (latest > F.col("_cleared")))
    trunks = full(within(_dtp_fired(events, cfg), cfg.dtp_cooldown_s))
    revised = _of_type(events, "VTP", VTP_LAST).filter(F.col("revision").isNotNull())
    parts = [
        kept(last_per(sighted.select(*columns), SEG, "src_mac"), MAC_SEEN),
        kept(last_per(flooded, SEG), MAC_FIRED),
        kept(last_per(bound.select(*columns, "ip"), SEG, "ip"), ARP_BOUND),
        kept(lowest, STP_ROOT),
        kept(within(changes, cfg.stp_tc_window_s), STP_CHANGE),
        kept(full(open_frames), CDP_OPEN),
        kept(trunks, DTP_FIRED),
        kept(last_per(revised.select(*columns), SEG), VTP_LAST),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
