"""Flow assembly.

Packets are first summed per (5-tuple, time slot); flows are then built from these slot sums. A
5-tuple that holds a third of all packets is thus spread over its slots, and sorting happens only
within a slot. The three modes differ only in how slots of a 5-tuple are put together:

* ``whole``    all slots of the 5-tuple
* ``tumbling`` slots of the same fixed window (the slot width divides the window)
* ``session``  a new flow where the gap between packets exceeds the timeout (a gap that long always
  lies between slots, as slots are no wider than the timeout)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.config import DEFAULTS, Settings
from wirelens.operators.ordered import SLOT, null_safe_join, slot_start
from wirelens.schemas import FLOW_KEY

MODES = ("whole", "tumbling", "session")
FLOW_NO = "flow_no"        # position of the flow within its 5-tuple: 0, window start or session no
_US = 1_000_000
# entropy is summed in integer millionths, so sums do not depend on the order of addition
ENTROPY_SCALE = 1_000_000

FLAG_COUNTS = {"fin": "F", "syn": "S", "rst": "R", "psh": "P", "ack": "A", "urg": "U", "ece": "E"}
# slot sums that simply add up over the slots of a flow
ADDED = ["n", "bytes", "bytes_sq", "entropy", "gap_n", "gap_sum", "gap_sq", *FLAG_COUNTS]


def _endpoint_key(packets: DataFrame) -> DataFrame:
    """Key both directions alike: ``side`` 0 leaves the lesser endpoint, 1 the greater one."""
    forward = F.struct("src_ip", "src_port") <= F.struct("dst_ip", "dst_port")

    def pick(a: str, b: str) -> Column:
        return F.when(forward, F.col(a)).otherwise(F.col(b))

    return packets.select(
        pick("src_ip", "dst_ip").alias("src_ip"), pick("dst_ip", "src_ip").alias("dst_ip"),
        pick("src_port", "dst_port").alias("src_port"),
        pick("dst_port", "src_port").alias("dst_port"),
        *[c for c in packets.columns if c not in FLOW_KEY[:4]],
        F.when(forward, 0).otherwise(1).alias("side"))


def packet_measures() -> list[Column]:
    """The per-packet integers that are summed: length, entropy and one 0/1 per TCP flag."""
    flags = F.coalesce(F.col("flags"), F.lit(""))
    return [
        F.col("length").cast("long").alias("length"),
        F.floor(F.coalesce(F.col("payload_entropy"), F.lit(0.0)) * ENTROPY_SCALE + 0.5)
        .alias("entropy"),
        *[F.contains(flags, F.lit(c)).cast("long").alias(n) for n, c in FLAG_COUNTS.items()]]


def slot_sums(packets: DataFrame, cfg: Settings = DEFAULTS, bidirectional: bool = False,
              gaps: bool = True) -> DataFrame:
    """One row per (5-tuple, slot, side) with every sum the features need.

    Only the squared gaps depend on packet order. With ``combine_ties`` packets of equal time are
    summed first, with map-side combining, so however many copies or simultaneous packets there are,
    the ordered window of a slot holds at most one row per microsecond. ``gaps=False`` leaves the
    ordering out. Within a slot all sums fit 64-bit integers.
    """
    df = _endpoint_key(packets) if bidirectional else packets.withColumn("side", F.lit(0))
    df = df.select(*FLOW_KEY, "side", "ts_us", "packet_id", *packet_measures())
    key = [*FLOW_KEY, "side"]
    if gaps and cfg.combine_ties:
        df = df.groupBy(*key, "ts_us").agg(*map(F.expr, [
            "count(1) AS n", "sum(length) AS bytes", "sum(length * length) AS bytes_sq",
            "min(length) AS len_min", "max(length) AS len_max", "sum(entropy) AS entropy",
            "min(packet_id) AS first_id", *[f"sum({f}) AS {f}" for f in FLAG_COUNTS]]))
    else:
        df = df.selectExpr(
            *key, "ts_us", "1L AS n", "length AS bytes", "length * length AS bytes_sq",
            "length AS len_min", "length AS len_max", "entropy", "packet_id AS first_id",
            *FLAG_COUNTS)
    df = df.withColumn(SLOT, slot_start("ts_us", cfg.slot_s * _US))
    if gaps:
        # sorted by the slot first, a number: addresses are texts that mostly begin alike
        order = Window.partitionBy(SLOT, *FLOW_KEY, "side").orderBy("ts_us", "first_id")
        df = df.withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(order))
    else:
        df = df.withColumn("gap", F.lit(0).cast("long"))
    return df.groupBy(*FLOW_KEY, SLOT, "side").agg(*map(F.expr, [
        "sum(n) AS n", "sum(bytes) AS bytes", "sum(bytes_sq) AS bytes_sq",
        "min(len_min) AS len_min", "max(len_max) AS len_max", "sum(entropy) AS entropy",
        "min(ts_us) AS first_us", "max(ts_us) AS last_us",
        # every packet of a slot but the first closes a gap, and the gaps add up to its span
        "sum(n) - 1 AS gap_n", "max(ts_us) - min(ts_us) AS gap_sum",
        "coalesce(sum(gap * gap), 0L) AS gap_sq",
        "min(struct(ts_us, first_id)).first_id AS first_id" if bidirectional
        else "0L AS first_id",
        *[f"sum({f}) AS {f}" for f in FLAG_COUNTS]]))


def number_flows(sums: DataFrame, mode: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """Add ``flow_no`` to slot sums. Only slot rows are grouped by the bare 5-tuple here."""
    if mode == "whole":
        return sums.withColumn(FLOW_NO, F.lit(0).cast("long"))
    if mode == "tumbling":
        return sums.withColumn(FLOW_NO, slot_start(SLOT, cfg.flow_window_s * _US))
    if mode != "session":
        raise ValueError(f"mode must be one of {MODES}")
    # both sides of a slot count for idleness: order by first packet, compare with the latest so far
    earlier = (Window.partitionBy(*FLOW_KEY).orderBy("first_us", "side")
               .rowsBetween(Window.unboundedPreceding, -1))
    upto = (Window.partitionBy(*FLOW_KEY).orderBy("first_us", "side")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    idle = F.col("first_us") - F.max("last_us").over(earlier) > cfg.flow_timeout_s * _US
    return (sums.withColumn("_new", F.coalesce(idle, F.lit(False)).cast("long"))
            .withColumn(FLOW_NO, F.sum("_new").over(upto)).drop("_new"))


def flow_sums(packets: DataFrame, mode: str = "tumbling", bidirectional: bool = False,
              cfg: Settings = DEFAULTS, gaps: bool = True) -> DataFrame:
    """One row per flow: forward (``f_``) and backward (``b_``) sums, and sums over both.

    Directional flows hold only packets of their own source, so backward sums are empty unless
    source and destination are the same address, when every packet counts in both directions.
    """
    sums = number_flows(slot_sums(packets, cfg, bidirectional, gaps), mode, cfg)
    # gaps across slot borders: previous slot of the same flow and side
    prior = Window.partitionBy(FLOW_NO, *FLOW_KEY, "side").orderBy(SLOT)
    sums = sums.withColumn("gap", F.col("first_us") - F.lag("last_us").over(prior))
    big = "decimal(38,0)"
    replaced = {
        "gap_n": "gap_n + int(gap IS NOT NULL)",
        "gap_sum": "gap_sum + coalesce(gap, 0)",
        "gap_sq": f"cast(gap_sq as {big}) + coalesce(cast(cast(gap as decimal(19,0))"
                  f" * cast(gap as decimal(19,0)) as {big}), cast(0 as {big}))",
        "bytes_sq": "cast(bytes_sq as decimal(28,0))",
    }
    sums = sums.selectExpr(*[c for c in sums.columns if c not in replaced and c != "gap"],
                           *[f"{x} AS {c}" for c, x in replaced.items()])
    flow = [*FLOW_KEY, FLOW_NO]
    if not bidirectional:
        out = sums.groupBy(*flow).agg(*map(F.expr, [
            "min(first_us) AS first_us", "max(last_us) AS last_us",
            *[f"sum({c}) AS f_{c}" for c in ADDED],
            "min(len_min) AS f_len_min", "max(len_max) AS f_len_max"]))
        return complete_directional(out)
    sided = sums.groupBy(*flow).agg(*map(F.expr, [
        "min(first_us) AS first_us", "max(last_us) AS last_us",
        "min_by(side, struct(first_us, first_id, side)) AS starter",
        *[f"coalesce(sum({c}) FILTER (WHERE side = {s}), 0) AS s{s}_{c}"
          for s in (0, 1) for c in ADDED],
        *[f"min(len_min) FILTER (WHERE side = {s}) AS s{s}_len_min" for s in (0, 1)],
        "min(len_min) AS len_min", "max(len_max) AS len_max"]))

    def swapped(a: str, b: str, out: str) -> str:
        return f"if(starter = 1, {b}, {a}) AS {out}"

    return sided.selectExpr(
        swapped("src_ip", "dst_ip", "src_ip"), swapped("dst_ip", "src_ip", "dst_ip"),
        swapped("src_port", "dst_port", "src_port"), swapped("dst_port", "src_port", "dst_port"),
        "protocol", FLOW_NO, "first_us", "last_us", "len_min", "len_max",
        *[swapped(f"s0_{c}", f"s1_{c}", f"f_{c}") for c in [*ADDED, "len_min"]],
        *[swapped(f"s1_{c}", f"s0_{c}", f"b_{c}") for c in ADDED],
        *[f"s0_{c} + s1_{c} AS {c}" for c in ADDED])


def complete_directional(forward: DataFrame) -> DataFrame:
    """Backward and overall sums of directional flows from their forward sums."""
    types = dict(forward.dtypes)
    return forward.selectExpr(
        "*", *[f"if(src_ip = dst_ip, f_{c}, cast(0 as {types[f'f_{c}']})) AS b_{c}"
               for c in ADDED],
        *[f"f_{c} AS {c}" for c in [*ADDED, "len_min", "len_max"]])


def flow_id() -> Column:
    """Id that depends only on the flow itself, so reruns and retries agree."""
    return F.xxhash64(*FLOW_KEY, FLOW_NO).alias("id")


def assemble_flows(packets: DataFrame, mode: str = "tumbling", bidirectional: bool = False,
                   cfg: Settings = DEFAULTS) -> DataFrame:
    """Flow records with at least ``min_flow_packets`` packets.

    Without gaps and with unused sums pruned by the optimizer, two map-side combined aggregations
    are left.
    """
    from wirelens.operators.features import duration

    sums = flow_sums(packets, mode, bidirectional, cfg, gaps=False)
    return sums.filter(F.col("n") >= cfg.min_flow_packets).select(
        flow_id(), (F.col("last_us") / 1e6).alias("timestamp"), *FLOW_KEY, FLOW_NO,
        "first_us", "last_us",
        F.col("n").alias("packet_count"), F.col("bytes").alias("total_bytes"),
        duration().alias("duration"))


def packet_gaps(packets: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """B8 per packet: microseconds since the previous packet of the 5-tuple, null on the first."""
    from wirelens.operators.ordered import ordered_lag

    lagged = ordered_lag(packets, FLOW_KEY, "ts_us", "packet_id", "ts_us", "_prev",
                         cfg.slot_s * _US)
    return lagged.withColumn("gap_us", F.col("ts_us") - F.col("_prev")).drop("_prev")


def flow_slots(packets: DataFrame, mode: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """(5-tuple, slot) -> flow number and packet count of the flow; one row per slot."""
    slot = slot_start("ts_us", cfg.slot_s * _US).alias(SLOT)
    sums = packets.groupBy(*FLOW_KEY, slot).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"))
    numbered = number_flows(sums.withColumn("side", F.lit(0)), mode, cfg)
    total = F.sum("n").over(Window.partitionBy(*FLOW_KEY, FLOW_NO))
    return (numbered.withColumn("flow_packets", total)
            .filter(F.col("flow_packets") >= cfg.min_flow_packets)
            .select(*FLOW_KEY, SLOT, FLOW_NO, "flow_packets"))


def link_packets(packets: DataFrame, mode: str = "tumbling", cfg: Settings = DEFAULTS
                 ) -> DataFrame:
    """Packets of emitted flows with their ``flow_id``.

    The join key holds the slot, so the packets of a hot flow are spread over its slots.
    """
    slots = flow_slots(packets, mode, cfg).withColumn("flow_id", F.xxhash64(*FLOW_KEY, FLOW_NO))
    return (packets.withColumn(SLOT, slot_start("ts_us", cfg.slot_s * _US))
            .transform(null_safe_join, slots, [*FLOW_KEY, SLOT]).drop(SLOT))


def with_flow_id(packets: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """B9 for tumbling flows without a join: the id follows from the packet alone.

    Packets of flows below the size limit get an id as well; no flow row carries it.
    """
    numbered = packets.withColumn(FLOW_NO, slot_start("ts_us", cfg.flow_window_s * _US))
    return numbered.withColumn("flow_id", F.xxhash64(*FLOW_KEY, FLOW_NO)).drop(FLOW_NO)


def sample_packets(packets: DataFrame, mode: str = "tumbling", cfg: Settings = DEFAULTS
                   ) -> DataFrame:
    """Per flow the first packets as an array, and whether more followed.

    The first packets of a flow are among the first of its slots, so each slot keeps no more than the
    sample size; Spark applies that limit on each map task before the shuffle. Only these packets meet
    the flow numbers and are ranked again per flow, so neither the join nor an array grows with a flow.
    """
    size = cfg.packet_sample_size
    order = ["ts_us", "packet_id"]
    slotted = packets.withColumn(SLOT, slot_start("ts_us", cfg.slot_s * _US))
    in_slot = F.row_number().over(Window.partitionBy(*FLOW_KEY, SLOT).orderBy(*order))
    first = slotted.withColumn("_rank", in_slot).filter(F.col("_rank") <= size).drop("_rank")
    slots = flow_slots(packets, mode, cfg).withColumn("flow_id", F.xxhash64(*FLOW_KEY, FLOW_NO))
    linked = null_safe_join(first, slots, [*FLOW_KEY, SLOT]).drop(SLOT)
    # by the flow's whole key: ids of 64 bits may meet among very many flows
    rank = F.row_number().over(Window.partitionBy(*FLOW_KEY, FLOW_NO).orderBy(*order))
    fields = ["ts_us", "packet_id", "timestamp", "length", "flags", "payload_entropy"]
    return (linked.withColumn("_rank", rank).filter(F.col("_rank") <= size)
            .groupBy("flow_id", *FLOW_KEY, FLOW_NO, "flow_packets")
            .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("packets_sample"))
            .withColumn("packets_sample_truncated", F.col("flow_packets") > size))


def newest(df: DataFrame, n: int, time: str = "timestamp", tie: Sequence[str] = ("id",)
           ) -> DataFrame:
    """The newest ``n`` rows."""
    return df.orderBy(F.desc(time), *[F.desc(c) for c in tie]).limit(n)
