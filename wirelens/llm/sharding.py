"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered 0 to n-1 in the order of a hash of their content, so the numbering does not depend
on files or partitions. The number is permuted by a Feistel network over a grid of a x b cells,
a = ceil(sqrt(n)), b = ceil(n / a); fewer than a cells lie beyond n, and cycle walking (permuting
again until the number is below n) leaves them after at most that many steps. A permuted number p
lies in shard ``p mod shards`` at slot ``p div shards``: counts differ by one at most.

Nulls: a null text counts no bytes and has the checksum of the empty text; null ids are numbered like
any value. Identical rows are counted first and numbered together, so they cannot make one task hot.
An empty table gives an empty result. A very long text is read whole for its size and checksum, and only
these move. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = 65_536  # copies of one row that are unfolded from one array
_BUCKET_BITS = 12  # numbering: 4096 ranges of the hash


def feistel(number: Column, a: Column, b: Column, seed: int, rounds: int) -> Column:
    """One pass through the network: a permutation of 0 .. a*b-1."""
    def turn(state: Column, step: Column) -> Column:
        left, right = state["l"], state["r"]
        on_left = F.pmod(left + F.pmod(F.xxhash64(right, step), a), a)
        on_right = F.pmod(right + F.pmod(F.xxhash64(left, step), b), b)
        even = step % 2 == 0
        return F.struct(F.when(even, on_left).otherwise(left).alias("l"),
                        F.when(even, right).otherwise(on_right).alias("r"))

    start = F.struct(((number - F.pmod(number, b)) / b).cast("long").alias("l"),
                     F.pmod(number, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(seed), F.lit(seed + rounds - 1)).cast("array<long>"),
                       start, turn, lambda s: s["l"] * b + s["r"])


def shard(docs: DataFrame, shards: int = 24, seed: int = 2024, rounds: int = 6,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, under law ``rows``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    content = ["doc_id", "size", "text_crc32"]
    kinds = (rows.groupBy(*content).agg(F.count("*").alias("copies"))
             .withColumn("h", F.xxhash64(*content))
             .withColumn("bucket", F.shiftrightunsigned("h", 64 - _BUCKET_BITS)))
    # at most 4096 rows, whatever the input
    every = Window.orderBy("bucket")
    offsets = (kinds.groupBy("bucket").agg(F.sum("copies").alias("held"))
               .withColumn("before", F.sum("held").over(every) - F.col("held"))
               .withColumn("n", F.sum("held").over(Window.partitionBy()))
               .withColumn("a", F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long"))
               .withColumn("b", F.ceil(F.col("n") / F.col("a")).cast("long"))
               .drop("held"))
    inside = Window.partitionBy("bucket").orderBy("h", *content)
    first = F.sum("copies").over(inside) - F.col("copies") + F.col("before")
    numbered = (kinds.join(F.broadcast(offsets), "bucket").withColumn("first", first)
                .withColumn("at", F.explode(F.expr(f"sequence(0L, copies - 1, {_CHUNK}L)")))
                .withColumn("r", F.explode(F.expr(
                    f"sequence(first + at, first + least(at + {_CHUNK}L, copies) - 1)"))))
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    once = numbered.withColumn("p", feistel(F.col("r"), a, b, seed, rounds))
    walked = F.aggregate(
        F.sequence(F.lit(1).cast("long"), a * b - n), F.col("p"),
        lambda p, _: F.when(p < n, p).otherwise(feistel(p, a, b, seed, rounds)))
    placed = once.withColumn("p", F.when(F.col("p") < n, F.col("p")).otherwise(walked))
    return placed.select(
        *content, F.lit("rows").alias("law"), F.pmod("p", F.lit(shards)).cast("int").alias("shard"),
        ((F.col("p") - F.pmod("p", F.lit(shards))) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
