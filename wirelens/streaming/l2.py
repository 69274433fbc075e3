"""Layer-2 rules on a stream.

Each micro-batch runs the batch rules over its events plus the rows learned from earlier batches, so
hot segments stay split by time slot as in the batch job and no rule keeps a per-segment object. What
earlier batches have learned is kept in two parts:

* one row per MAC, bound address and segment in a keyed table (``keyed_table.py``): a batch looks up
  the keys its events touch, and MACs seen in the last window, and writes the keys that changed;
* events of the last few seconds: those held back for ordering, and those in the rules' open windows.
  Event time closes the windows, so this part is rewritten with each batch but does not grow.

Both are written under the batch id; a repeated batch reads the same predecessor and replaces its own
output. Batches are numbered without gaps, as ``foreachBatch`` numbers them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from wirelens.config import DEFAULTS, Settings
from wirelens.operators import l2
from wirelens.operators.alerts import as_alerts
from wirelens.operators.ordered import null_safe_join
from wirelens.schemas import L2_EVENTS
from wirelens.session import cut_lineage
from wirelens.sources.sinks import store
from wirelens.streaming.keyed_table import KeyedTable

_US = 1_000_000
# what is known of a key for good; rows of other learned types belong to open windows
_LASTING = (l2.MAC_SEEN, l2.MAC_FIRED, l2.ARP_BOUND, l2.STP_ROOT, l2.VTP_LAST)
_OF = "_of"  # the MAC or address that a lasting row is about, '' for those about a segment
_KEYS = ["type", l2.SEG, _OF]


def _lasting(spark: SparkSession, state: str) -> KeyedTable:
    schema = T.StructType([*L2_EVENTS.fields, T.StructField(_OF, T.StringType())])
    return KeyedTable(spark, f"{state}/lasting", schema, _KEYS)


def _recent(spark: SparkSession, state: str, batch_id: int) -> DataFrame:
    if batch_id < 0:
        return spark.createDataFrame([], L2_EVENTS)
    return spark.read.schema(L2_EVENTS).parquet(f"{state}/recent/batch={batch_id}")


def _with_key(learned: DataFrame) -> DataFrame:
    kind = F.col("type")
    return learned.withColumn(_OF, F.when(kind == l2.MAC_SEEN, F.col("src_mac")).when(
        kind == l2.ARP_BOUND, F.col("src_ip")).otherwise(F.lit("")))


def touched_keys(events: DataFrame) -> DataFrame:
    """(type, segment, _of) of the lasting rows that ``events`` may use or change."""
    def of(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias(_OF))

    kinds = F.array(of(l2.MAC_SEEN, F.col("src_mac")), of(l2.ARP_BOUND, F.col("src_ip")),
                    *[of(kind, F.lit("")) for kind in (l2.MAC_FIRED, l2.STP_ROOT, l2.VTP_LAST)])
    return events.select(l2.SEG, F.inline(kinds)).where(F.col(_OF).isNotNull()).distinct()


def looked_up(table: DataFrame, events: DataFrame, cfg: Settings) -> DataFrame:
    """Lasting rows of the touched keys, and of MACs that still count in the window of the events."""
    touched = touched_keys(events).withColumn("_hit", F.lit(True))
    since = events.agg(F.min(l2.TS)).first()[0]
    open_since = F.lit((since or 0) - cfg.mac_flood_window_s * _US)
    in_window = (F.col("type") == l2.MAC_SEEN) & (F.col(l2.TS) >= open_since)
    return null_safe_join(table, touched, _KEYS, "left").where(F.col("_hit") | in_window).drop("_hit")


def process_batch(batch: DataFrame, batch_id: int, state: str, sink: str,
                  cfg: Settings = DEFAULTS, delay_s: int = 30) -> None:
    """Alerts of one micro-batch.

    Events within ``delay_s`` of the newest time seen wait for the next batch, so events may arrive
    out of order by that much. Held-back rows carry their own event type; learned rows start
    with an underscore.
    """
    spark = batch.sparkSession
    lasting = _lasting(spark, state)
    earlier = _recent(spark, state, batch_id - 1)
    windows = earlier.filter(F.col("type").startswith("_"))
    waiting = earlier.filter(~F.col("type").startswith("_"))
    events = cut_lineage(batch.select(*L2_EVENTS.fieldNames()).unionByName(waiting))
    newest = events.agg(F.max("ts_us")).first()[0]
    target = f"{state}/recent/batch={batch_id}"
    if newest is None:
        lasting.write(batch_id, lasting.read(0))
        earlier.write.mode("overwrite").parquet(target)
        return
    # nothing up to the horizon can still be waiting, nothing after it has been processed
    horizon = newest - delay_s * _US
    fresh = events.filter(F.col("ts_us") <= horizon)
    known = cut_lineage(looked_up(lasting.read(batch_id), fresh, cfg))
    ready = fresh.unionByName(windows).unionByName(known.drop(_OF))
    fired = l2.flood_firings(ready, cfg)
    store(sink, alerts=as_alerts(l2.l2_alerts(ready, cfg, fired)), batch_id=batch_id)
    learned = cut_lineage(l2.learned_rows(ready, cfg, fired, horizon))
    held = events.filter(F.col("ts_us") > horizon)
    learned.where(~F.col("type").isin(*_LASTING)).unionByName(held) \
        .write.mode("overwrite").parquet(target)
    # an event is the last word on a key at most once, so a row of a known event is not news
    news = _with_key(learned.where(F.col("type").isin(*_LASTING)))
    lasting.write(batch_id, news.join(known.select(*_KEYS, l2.SEQ), [*_KEYS, l2.SEQ], "left_anti"))


def l2_alert_stream(events: DataFrame, sink: str, state: str, checkpoint: str,
                    settings: Callable[[], Settings] = lambda: DEFAULTS, delay_s: int = 30
                    ) -> DataStreamWriter:
    """Alerts appended to ``<sink>/alerts``; ``state`` belongs to this query alone."""
    def run(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, state, sink, settings(), delay_s)

    return (events.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .foreachBatch(run))


def current_status(spark: SparkSession, state: str, batch_id: int, cfg: Settings = DEFAULTS
                   ) -> DataFrame:
    """G10 from the state of a finished batch."""
    rows = _recent(spark, state, batch_id).filter(F.col("type").startswith("_"))
    lasting = _lasting(spark, state).read(batch_id + 1).drop(_OF)
    return l2.l2_status(rows.unionByName(lasting), cfg)
