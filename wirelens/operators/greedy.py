"""Greedy spacing: fire at the first candidate, then at each next one at least ``gap`` further on.

Whether a candidate fires depends on the previous firing, so the rule is sequential. It is still cut
into chunks of a fixed number of candidates, however close together these lie:

1. each chunk maps every candidate that may be entered from outside to the last firing it leads to;
2. maps of neighbouring chunks are composed pair by pair, as often as it takes until one is left per
   key. Composing is one ordered scan: where the left map ends, the right one is entered at the first
   candidate a ``gap`` further on. Only candidates within one ``gap`` of a block's start can be entered,
   so coarser maps get no larger than that;
3. from the coarsest map down, every block learns from which position its candidates may fire: the
   left half from where its parent may, the right half from where the left one ends;
4. each chunk is replayed from there.

No Arrow group holds more than a chunk. Where every key is one chunk, step 4 is all there is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.operators.ordered import dense_rows, null_safe_join, ordered_next, row_index
from wirelens.session import cut_lineage

_BLOCK, _POS, _EXIT, _FROM = "_block", "_pos", "_exit", "_from"
# candidates of a chunk
ROWS_PER_CHUNK = 100_000
# candidates are distinct positions, so an ordered scan sees at most this many in one slot
_SLOT_TICKS = 1 << 22
_UNSET = -(2 ** 62)


def last_firing(pos: np.ndarray, exits: np.ndarray, gap: int) -> np.ndarray:
    """Follow the chain from every entry to its last firing in the array.

    ``pos`` is sorted; entry i leads to a firing at ``exits[i]`` and from there to the first entry
    at least ``gap`` further on.
    """
    n = len(pos)
    jump = np.append(np.searchsorted(pos, exits + gap), n)
    last = np.append(np.arange(n), n)
    while True:
        ahead = jump[last]
        step = ahead < n
        if not step.any():
            return exits[last[:n]]
        # pointer doubling: each round doubles the number of jumps taken
        last = np.where(step, last[ahead], last)


def firings(pos: np.ndarray, gap: int, start: int) -> np.ndarray:
    """Firings among sorted positions when none below ``start`` may fire."""
    out, i = [], int(np.searchsorted(pos, start))
    while i < len(pos):
        out.append(pos[i])
        i = int(np.searchsorted(pos, pos[i] + gap))
    return np.array(out, dtype="int64")


def _longs(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().astype("int64")


def _replayed(table: pa.Table, pos: str, gap: int, start: int) -> pa.Table:
    p = _longs(table, pos)
    return table.filter(pa.array(np.isin(p, firings(np.sort(p), gap, start))))


def _chunk_maps(spots: DataFrame, keys: Sequence[str], pos: str, gap: int) -> DataFrame:
    """(keys, _block, _pos, _exit) of the candidates of each chunk that can be entered."""
    def run(table: pa.Table) -> pa.Table:
        p = np.sort(_longs(table, pos))
        # one entry past the reachable range stands for "first candidate after it"
        reach = min(len(p), int(np.searchsorted(p, p[0] + gap)) + 1)
        first = pa.array(np.zeros(reach, dtype="int64"))
        head = {k: table.column(k).combine_chunks().take(first) for k in [*keys, _BLOCK]}
        return pa.table({**head, _POS: pa.array(p[:reach]),
                         _EXIT: pa.array(last_firing(p, p, gap)[:reach])})

    slim = spots.select(*keys, _BLOCK, pos)
    fields = [slim.schema[c] for c in (*keys, _BLOCK)]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in (_POS, _EXIT)])
    return slim.groupBy(*keys, _BLOCK).applyInArrow(run, schema)


def _composed(maps: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """The maps of pairs of neighbouring blocks."""
    parent = F.floor(F.col(_BLOCK) / 2)
    sided = maps.withColumn("_right", F.pmod(_BLOCK, F.lit(2)) == 1).withColumn(_BLOCK, parent)
    by = [*keys, _BLOCK]
    # a left block whose map goes beyond the gap leaves nothing of the right one in reach
    left = sided.where("not _right").groupBy(*by).agg(
        (F.min(_POS) + gap).alias("_end"), F.max(_POS).alias("_last"))
    right = null_safe_join(sided.where("_right"), left, by).where("_last < _end")
    past = right.where(F.col(_POS) >= F.col("_end")).groupBy(*by).agg(F.min(_POS).alias("_stop"))
    right = null_safe_join(right, past, by, "left").where(
        (F.col(_POS) < F.col("_end")) | (F.col(_POS) == F.col("_stop")))
    entered = ordered_next(
        sided.select(*by, _POS, _EXIT, F.when(F.col("_right"), F.col(_POS)).otherwise(
            F.col(_EXIT) + gap).alias("_at"), F.col("_right").cast("int").alias("_kind"),
            F.when(F.col("_right"), F.col(_EXIT)).alias("_value")),
        by, "_at", "_kind", "_value", "_next", _SLOT_TICKS)
    followed = entered.where("_kind = 0").select(
        *by, _POS, F.coalesce("_next", _EXIT).alias(_EXIT))
    return followed.unionByName(right.select(*by, _POS, _EXIT))


def greedy_spacing(df: DataFrame, keys: Sequence[str], pos: str, tie: str, gap: int,
                   rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """Rows of ``df`` that fire. Of rows equal in (keys, pos) only the lowest ``tie`` can.

    Candidates, and the maps of every level, are written once; each is read by several steps.
    """
    keys = list(keys)
    payload = [c for c in df.columns if c not in {*keys, pos, tie}]
    spots = (df.groupBy(*keys, F.col(pos).cast("long").alias(pos))
             .agg(F.min(F.struct(tie, *payload)).alias("_row")).select(*keys, pos, "_row.*"))
    spots = cut_lineage(spots)
    names = list(df.columns)
    out = T.StructType([spots.schema[c] for c in names])
    most = spots.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    if most <= rows:  # every key is one chunk, and nothing came before it
        return spots.select(*names).groupBy(*keys).applyInArrow(
            lambda table: _replayed(table, pos, gap, _UNSET), out)
    numbered = row_index(spots, keys, pos, tie, "_n", _SLOT_TICKS)
    spots = cut_lineage(numbered.withColumn(_BLOCK, F.floor(F.col("_n") / rows)).drop("_n"))
    by = [*keys, _BLOCK]
    levels = ((most - 1) // rows).bit_length()
    maps = []
    for level in range(levels):
        finer = _composed(maps[-1], keys, gap) if level else _chunk_maps(spots, keys, pos, gap)
        maps.append(cut_lineage(finer))

    # the coarsest level has one block per key, whose candidates may fire from the first one on
    starts = spots.select(*keys).distinct().select(
        *keys, F.lit(0).cast("long").alias(_BLOCK), F.lit(_UNSET).cast("long").alias(_FROM))
    for level in reversed(range(levels)):
        left = starts.withColumn(_BLOCK, F.col(_BLOCK) * 2)
        ends = null_safe_join(maps[level], left, by).where(F.col(_POS) >= F.col(_FROM)) \
            .groupBy(*by).agg(F.min_by(_EXIT, _POS).alias(_EXIT))
        right = null_safe_join(left, ends, by, "left").select(
            *keys, (F.col(_BLOCK) + 1).alias(_BLOCK),
            F.coalesce(F.col(_EXIT) + gap, F.col(_FROM)).alias(_FROM))
        starts = cut_lineage(left.unionByName(right))

    def replay(table: pa.Table, start: pa.Table) -> pa.Table:
        if not table.num_rows:  # a block beyond the last of its key
            return table.select(names)
        return _replayed(table, pos, gap, int(_longs(start, _FROM)[0])).select(names)

    return spots.groupBy(*by).cogroup(starts.groupBy(*by)).applyInArrow(replay, out)


def cooldown(df: DataFrame, keys: Sequence[str], ts: str, tie: str, window: int) -> DataFrame:
    """Rows that fire when none fired in the ``window`` ticks before them."""
    return greedy_spacing(df, keys, ts, tie, window)


def reset_on_fire(df: DataFrame, keys: Sequence[str], ts: str, tie: str, window: int, count: int,
                  width: int) -> DataFrame:
    """Rows at which the ``window`` holds ``count`` rows, when firing empties the window.

    With rows numbered per key, row j fires when it and the ``count`` - 1 rows before it lie within
    the window and none of these came before the last firing: greedy spacing by ``count`` rows over
    the rows whose plain rolling count is at least ``count``.
    """
    dense = dense_rows(df, keys, ts, tie, window, count, "_index", width)
    return greedy_spacing(dense, keys, "_index", tie, count).drop("_index")
