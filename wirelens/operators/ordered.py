"""Order-dependent primitives that stay balanced when one key holds most rows.

A plain window over a hot key puts all its rows into one task. Here every ordered scan is cut into
time slots: the row-level window runs per (key, slot), a one-row-per-slot summary is folded over the
slots of each key, and the fold of the earlier slots is joined back to the rows of each slot. Raw
rows are shuffled once, on (key, slot); only slot summaries are ever grouped by the bare key.

Conventions: ``ts`` is an integer column, ``tie`` makes the order total, ``width`` is the slot width
in units of ``ts``. A null key is a key like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = "_slot"
_CARRY = "_carry"
_PART = "_part"


def slot_start(ts: Column | str, width: int) -> Column:
    """First tick of the slot a time falls into (exact integer arithmetic)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts - F.pmod(ts, F.lit(width))


def with_slot(df: DataFrame, ts: str, width: int) -> DataFrame:
    return df.withColumn(SLOT, slot_start(ts, width))


def null_safe_join(rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner"
                   ) -> DataFrame:
    """Join on equal keys where null equals null; the key columns of ``rows`` are kept."""
    other = side.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return rows.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def _carry_join(rows: DataFrame, slotted: DataFrame, keys: Sequence[str], summary: Column,
                fold: Callable[[Column], Column], *extra: Column) -> DataFrame:
    """Add ``_carry``: ``fold`` over the summaries of all earlier slots of the row's key."""
    per_slot = slotted.groupBy(*keys, SLOT).agg(summary.alias(_PART))
    earlier = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLOT)
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = per_slot.select(*keys, SLOT, fold(F.col(_PART)).over(earlier).alias(_CARRY))
    return null_safe_join(rows, carry, [*keys, SLOT], "left")


def ordered_lag(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, out: str,
                width: int) -> DataFrame:
    """``out`` = ``value`` of the previous row of the key. ``value`` must not be null."""
    slotted = with_slot(df, ts, width)
    w = Window.partitionBy(*keys, SLOT).orderBy(ts, tie)
    rows = slotted.withColumn(out, F.lag(value).over(w))
    rows = _carry_join(rows, slotted, keys, F.max_by(value, F.struct(ts, tie)), F.last)
    return rows.withColumn(out, F.coalesce(out, _CARRY)).drop(SLOT, _CARRY)


def ordered_next(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, out: str,
                 width: int) -> DataFrame:
    """``out`` = first non-null ``value`` at or after the row, null where none follows."""
    slotted = with_slot(df, ts, width)
    w = (Window.partitionBy(*keys, SLOT).orderBy(ts, tie)
         .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = slotted.withColumn(out, F.first(value, ignorenulls=True).over(w))
    when = F.when(F.col(value).isNotNull(), F.struct(ts, tie))
    per_slot = slotted.groupBy(*keys, SLOT).agg(F.min_by(value, when).alias(_PART))
    later = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(1, Window.unboundedFollowing)
    carry = per_slot.select(*keys, SLOT, F.first(_PART, ignorenulls=True).over(later).alias(_CARRY))
    rows = null_safe_join(rows, carry, [*keys, SLOT], "left")
    return rows.withColumn(out, F.coalesce(out, _CARRY)).drop(SLOT, _CARRY)


def running_min_before(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str,
                       out: str, width: int) -> DataFrame:
    """``out`` = least ``value`` over all earlier rows of the key, null on the first."""
    slotted = with_slot(df, ts, width)
    w = (Window.partitionBy(*keys, SLOT).orderBy(ts, tie)
         .rowsBetween(Window.unboundedPreceding, -1))
    rows = slotted.withColumn(out, F.min(value).over(w))
    rows = _carry_join(rows, slotted, keys, F.min(value), F.min)
    return rows.withColumn(out, F.least(out, _CARRY)).drop(SLOT, _CARRY)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
                width: int) -> DataFrame:
    """``out`` = running total of ``value``; ``order[0]`` is the time, the rest break ties."""
    slotted = with_slot(df, order[0], width)
    w = (Window.partitionBy(*keys, SLOT).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = slotted.withColumn(out, F.sum(value).over(w))
    rows = _carry_join(rows, slotted, keys, F.sum(value), F.sum)
    return (rows.withColumn(out, F.col(out) + F.coalesce(_CARRY, F.lit(0)))
            .drop(SLOT, _CARRY))


def row_index(df: DataFrame, keys: Sequence[str], ts: str, tie: str, out: str,
              width: int) -> DataFrame:
    """``out`` = 0-based position of the row within its key."""
    return (running_sum(df.withColumn(_PART + "1", F.lit(1).cast("long")), keys, [ts, tie],
                        _PART + "1", out, width)
            .withColumn(out, F.col(out) - 1).drop(_PART + "1"))


def _with_halo(df: DataFrame, ts: str, window: int, width: int) -> DataFrame:
    """Copy rows in the last ``window`` ticks of a slot into the next slot as well (``_own`` 0)."""
    if width < window:
        raise ValueError("slot width must be at least the window")
    slot = slot_start(ts, width)
    homes = F.when(F.col(ts) >= slot + (width - window), F.array(slot, slot + width)) \
        .otherwise(F.array(slot))
    return (df.withColumn(SLOT, F.explode(homes))
            .withColumn("_own", (F.col(SLOT) == slot).cast("long")))


def _window_size(keys: Sequence[str], ts: str, tie: str, window: int) -> Column:
    """Rows in [ts - window, ts] up to this one: rows so far minus rows that have expired."""
    part = Window.partitionBy(*keys, SLOT)
    seen = F.row_number().over(part.orderBy(ts, tie))
    expired = F.count(F.lit(1)).over(
        part.orderBy(ts).rangeBetween(Window.unboundedPreceding, -(window + 1)))
    return seen - expired


def rolling_count(df: DataFrame, keys: Sequence[str], ts: str, tie: str, window: int, out: str,
                  width: int) -> DataFrame:
    """``out`` = rows of the key in [ts - window, ts] up to and including this one."""
    rows = _with_halo(df, ts, window, width)
    return (rows.withColumn(out, _window_size(keys, ts, tie, window))
            .filter("_own = 1").drop(SLOT, "_own"))


def dense_rows(df: DataFrame, keys: Sequence[str], ts: str, tie: str, window: int, count: int,
               index: str, width: int) -> DataFrame:
    """Rows with at least ``count`` rows in their rolling window, numbered within their key.

    The filter runs before the slot carry is joined, so the join sees dense rows only.
    """
    so_far = (Window.partitionBy(*keys, SLOT).orderBy(ts, tie)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = (_with_halo(df, ts, window, width)
            .withColumns({"_n": _window_size(keys, ts, tie, window),
                          index: F.sum("_own").over(so_far)})
            .filter((F.col("_own") == 1) & (F.col("_n") >= count)).drop("_n", "_own"))
    rows = _carry_join(rows, with_slot(df, ts, width), keys, F.count(F.lit(1)), F.sum)
    return (rows.withColumn(index, F.col(index) - 1 + F.coalesce(_CARRY, F.lit(0)))
            .drop(SLOT, _CARRY))


def first_seen(df: DataFrame, keys: Sequence[str], ts: str, tie: str,
               payload: Sequence[str] = ()) -> DataFrame:
    """Earliest row of each key, as an aggregate with map-side combining (no per-key sort)."""
    cols = [ts, tie, *payload]
    return (df.groupBy(*keys).agg(F.min(F.struct(*cols)).alias("_first"))
            .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in cols]))


def presence_spans(df: DataFrame, keys: Sequence[str], value: str, ts: str, tie: str,
                   window: int, payload: Sequence[str] = ()) -> DataFrame:
    """Edges of the spans during which each value counts as present in a rolling window.

    A value is present at t when it occurred in [t - window, t]. Occurrences inside one cell of
    width ``window`` always belong to one span, so cells are aggregated first and only cells are
    ordered. Output: one +1 row at each span start, one -1 row just after each span end; ``fresh``
    marks the first span of a value ever.
    """
    cell = slot_start(ts, window)
    cells = (df.groupBy(*keys, value, cell.alias("_cell"))
             .agg(F.min(F.struct(ts, tie, *payload)).alias("_first"), F.max(ts).alias("_last")))
    w = Window.partitionBy(*keys, value).orderBy("_cell")
    cells = cells.select(
        *keys, value, "_first", "_last",
        F.lag("_last").over(w).alias("_prev"),
        F.lead(F.col(f"_first.{ts}")).over(w).alias("_next"))
    starts = F.col("_prev").isNull() | (F.col(f"_first.{ts}") - F.col("_prev") > window)
    ends = F.col("_next").isNull() | (F.col("_next") - F.col("_last") > window)
    null_payload = F.lit(None)
    edge_in = F.struct(
        F.col(f"_first.{ts}").alias(ts), F.lit(1).alias("_kind"),
        F.col(f"_first.{tie}").alias(tie), F.lit(1).cast("long").alias("_delta"),
        F.col("_prev").isNull().alias("fresh"),
        *[F.col(f"_first.{c}").alias(c) for c in payload])
    schema = {f.name: f.dataType for f in df.schema.fields}
    edge_out = F.struct(
        (F.col("_last") + (window + 1)).alias(ts), F.lit(0).alias("_kind"),
        F.lit(-1).cast(schema[tie]).alias(tie), F.lit(-1).cast("long").alias("_delta"),
        F.lit(False).alias("fresh"),
        *[null_payload.cast(schema[c]).alias(c) for c in payload])
    edges = F.filter(F.array(F.when(starts, edge_in), F.when(ends, edge_out)),
                     lambda e: e.isNotNull())
    return cells.select(*keys, value, F.inline(edges))


def rolling_distinct(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str,
                     window: int, out: str, width: int) -> DataFrame:
    """``out`` = distinct ``value`` in [ts - window, ts], up to and including each row.

    A running total over span edges replaces per-row sets, so memory does not grow with the number
    of values in a window.
    """
    edges = (presence_spans(df, keys, value, ts, tie, window)
             .select(*keys, ts, "_kind", tie, "_delta", F.lit(0).alias("_row"),
                     *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields
                       if f.name not in {*keys, ts, tie}]))
    rows = df.select(*keys, ts, F.lit(1).alias("_kind"), tie,
                     F.lit(0).cast("long").alias("_delta"), F.lit(1).alias("_row"),
                     *[F.col(c) for c in df.columns if c not in {*keys, ts, tie}])
    total = running_sum(rows.unionByName(edges), keys, [ts, "_kind", tie, "_row"], "_delta", out,
                        width)
    return total.filter("_row = 1").drop("_kind", "_delta", "_row")


def neighbour_chunks(df: DataFrame, index: str, before: int, after: int, size: int = 50_000
                     ) -> DataFrame:
    """Cut rows of a key into chunks of ``size`` consecutive positions, with halo rows.

    Adds ``_slot`` (the chunk) and ``_own``; windows over (key, ``_slot``) ordered by ``index`` see
    ``before`` rows back and ``after`` rows ahead of every own row. No chunk exceeds
    size + before + after rows, whatever the key holds.
    """
    if max(before, after) >= size:
        raise ValueError("halo must be smaller than the chunk")
    pos = F.col(index)
    chunk = F.floor(pos / size)
    within = F.pmod(pos, F.lit(size))
    homes = F.array_compact(F.array(
        chunk,
        F.when(within >= size - before, chunk + 1) if before else F.lit(None).cast("long"),
        F.when((within < after) & (chunk > 0), chunk - 1) if after else F.lit(None).cast("long")))
    return (df.withColumn(SLOT, F.explode(homes))
            .withColumn("_own", F.col(SLOT) == chunk))
