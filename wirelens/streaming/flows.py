"""Flows from a packet stream.

Two chained event-time aggregations in append mode, all in the JVM: packets -> (5-tuple, slot), then
slots -> (5-tuple, flow window). The only order-dependent feature, the spread of packet gaps, needs
the packet times of one short slot, so that is all the first state keeps; the second keeps one small
struct per slot of a window. Results equal the batch job in ``tumbling`` mode.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from wirelens.config import DEFAULTS, Settings
from wirelens.operators.features import duration, features_of
from wirelens.operators.flows import (ADDED, FLAG_COUNTS, FLOW_NO, complete_directional, flow_id,
                                      packet_measures, with_flow_id)
from wirelens.schemas import FLOW_KEY
from wirelens.sources.sinks import store

WATERMARK = "30 seconds"
# end of a flow's window, by which later stateful operators tell time
EVENT_TIME = "event_time"
_US = 1_000_000


def with_event_time(df: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", watermark)


def stream_flow_sums(packets: DataFrame, cfg: Settings = DEFAULTS, watermark: str = WATERMARK,
                     slot_s: int = 1) -> DataFrame:
    """Streaming counterpart of ``flow_sums`` for directional tumbling flows."""
    if cfg.flow_window_s % slot_s:
        raise ValueError("slot_s must divide flow_window_s")
    df = with_event_time(packets, watermark).select(
        "ts", "ts_us", *FLOW_KEY, *packet_measures())
    slots = df.groupBy(*FLOW_KEY, F.window("ts", f"{slot_s} seconds").alias("slot")).agg(
        *map(F.expr, [
            "count(1) AS n", "sum(length) AS bytes", "sum(length * length) AS bytes_sq",
            "min(length) AS len_min", "max(length) AS len_max", "sum(entropy) AS entropy",
            "min(ts_us) AS first_us", "max(ts_us) AS last_us",
            "sort_array(collect_set(ts_us)) AS times",
            *[f"sum({f}) AS {f}" for f in FLAG_COUNTS]]))
    gap_sq = """aggregate(sequence(1, size(times) - 1), 0L,
        (s, i) -> s + (times[i] - times[i - 1]) * (times[i] - times[i - 1]))"""
    slots = slots.selectExpr(
        "*", "n - 1 AS gap_n", "last_us - first_us AS gap_sum",
        # equal times add no gap, so distinct times give the same sum
        f"if(size(times) > 1, {gap_sq}, 0L) AS gap_sq").drop("times")
    window = F.window(F.window_time("slot"), f"{cfg.flow_window_s} seconds").alias("flow_window")
    added = [c for c in ADDED if not c.startswith("gap_") and c != "bytes_sq"]
    flows = slots.groupBy(*FLOW_KEY, window).agg(*map(F.expr, [
        "min(first_us) AS first_us", "max(last_us) AS last_us",
        *[f"sum({c}) AS f_{c}" for c in added],
        "sum(cast(bytes_sq as decimal(28,0))) AS f_bytes_sq",
        "sum(cast(gap_sq as decimal(28,0))) AS f_slot_gap_sq",
        "min(len_min) AS f_len_min", "max(len_max) AS f_len_max",
        "array_sort(collect_list(struct(first_us, last_us))) AS spans"]))
    between = """aggregate(sequence(1, size(spans) - 1), cast(0 as decimal(28,0)), (s, i) ->
        cast(s + cast((spans[i].first_us - spans[i - 1].last_us)
                    * (spans[i].first_us - spans[i - 1].last_us) as decimal(28,0))
             as decimal(28,0)))"""
    flows = flows.selectExpr(
        "*", f"unix_micros(flow_window.start) AS {FLOW_NO}",
        # every packet but the first of the flow closes a gap, and the gaps add up to its duration
        "f_n - 1 AS f_gap_n", "last_us - first_us AS f_gap_sum",
        f"""cast(f_slot_gap_sq + if(size(spans) > 1, {between}, cast(0 as decimal(28,0)))
            as decimal(38,0)) AS f_gap_sq""", f"window_time(flow_window) AS {EVENT_TIME}") \
        .drop("spans", "f_slot_gap_sq", "flow_window")
    return complete_directional(flows)


def stream_flow_features(packets: DataFrame, cfg: Settings = DEFAULTS,
                         watermark: str = WATERMARK) -> DataFrame:
    """Flow records with features, emitted once the watermark has passed their window."""
    return features_of(stream_flow_sums(packets, cfg, watermark), cfg, [EVENT_TIME])


def stream_session_flows(packets: DataFrame, cfg: Settings = DEFAULTS,
                         watermark: str = WATERMARK) -> DataFrame:
    """B4 on a stream: flow records per session, with the numbers and ids of the batch job.

    Sessions of a 5-tuple leave the window operator in order of time; how many there were, those below
    the packet limit included, is keyed state. It needs the RocksDB state store
    (``history.use_keyed_state``).
    """
    # sessions that touch are merged, so only gaps longer than the timeout split, as in the batch job
    session = F.session_window("ts", f"{cfg.flow_timeout_s} seconds").alias("session")
    sums = with_event_time(packets, watermark).groupBy(*FLOW_KEY, session).agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.sum(F.col("length").cast("long")).alias("total_bytes"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")).drop("session")
    numbered = sums.select(
        F.to_json(F.struct(*FLOW_KEY)).alias("key"), F.col("first_us").alias("at"),
        F.to_json(F.struct(*sums.columns)).alias("row")).groupBy("key").transformWithStateInPandas(
        SessionNumbers(), "row string, number long", "Append", "None")
    return (numbered.select(F.from_json("row", sums.schema).alias("r"), F.col("number").alias(FLOW_NO))
            .select("r.*", FLOW_NO).filter(F.col("packet_count") >= cfg.min_flow_packets)
            .select(flow_id(), FLOW_NO, *FLOW_KEY, "first_us", "last_us", "packet_count",
                    "total_bytes", duration().alias("duration")))


class SessionNumbers(StatefulProcessor):
    """Rows (key, at, row) -> (row, number): their place among all rows of the key, by time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.following = handle.getValueState("following", "number long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable")
        held = self.following.get()
        first = held[0] if held is not None else 0
        self.following.update((first + len(frame),))
        yield pd.DataFrame({"row": frame["row"].to_numpy(),
                            "number": range(first, first + len(frame))})

    def close(self) -> None:
        pass


def stream_rates(packets: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """H14 on a stream: packets and bytes per second."""
    second = F.window("ts", "1 second")
    return with_event_time(packets, watermark).groupBy(second).agg(
        F.count(F.lit(1)).alias("packets_per_sec"),
        F.sum(F.col("length").cast("long")).alias("bytes_per_sec")).select(
        F.unix_micros("window.start").alias("second_us"), "packets_per_sec", "bytes_per_sec")


def stream_traffic(flows: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """H10 on a stream of scored flows: per UTC minute."""
    timed = flows.withColumn("ts", F.timestamp_micros("last_us")).withWatermark("ts", watermark)
    return timed.groupBy(F.window("ts", "1 minute")).agg(
        F.count(F.lit(1)).alias("flow_count"), F.sum("total_bytes").alias("byte_count"),
        F.avg("threat_score").alias("avg_threat")).select(
        F.unix_micros("window.start").alias("minute_us"), "flow_count", "byte_count",
        "avg_threat")


Scorer = Callable[[DataFrame, Settings], tuple[DataFrame, DataFrame]]


def store_scored_flows(features: DataFrame, root: str, checkpoint: str, score: Scorer,
                       settings: Callable[[], Settings] = lambda: DEFAULTS) -> DataStreamWriter:
    """Score each micro-batch of flow features and append flows and alerts.

    ``score`` returns (flows, alerts). Settings are read anew per batch, so a changed alert
    threshold takes effect without a restart. Batches are stored by id and replace themselves when
    repeated.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        flows, alerts = score(batch, settings())
        store(root, flows=flows, alerts=alerts, batch_id=batch_id)

    return (features.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .foreachBatch(write))


def store_packets(packets: DataFrame, root: str, checkpoint: str, cfg: Settings = DEFAULTS
                  ) -> DataStreamWriter:
    """A5: append every packet with the id of its flow. No state: the id is computed per row."""
    def write(batch: DataFrame, batch_id: int) -> None:
        store(root, packets=with_flow_id(batch, cfg), batch_id=batch_id)

    return (packets.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .foreachBatch(write))
