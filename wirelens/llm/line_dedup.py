"""Lines that many documents share go, by a sharded minimal perfect hash over line hashes.

Every line of at least ``min_chars`` code points is hashed to 128 bits. The distinct hashes that two
documents or more share are counted and cut into shards of some 65 000; a line of one document only
can never go, so it is not indexed. A shard is a minimal perfect hash (levels of bit arrays: a key
takes a bit that no other wants, all others go on to the next level; the rank of the bit is the slot)
over three arrays in slot order: a 64-bit fingerprint, the count of documents and the largest id.
Documents send (id, hash) probes of 24 bytes to the shards; lines are never joined. A probe meets its
slot, and the fingerprint tells strangers apart. A shard that gets more than a million probes is
probed in blocks of at most that many, so a line found everywhere makes no task large.

Nulls: a null text is one empty line. Rows without an id count for nothing and stay as they are.
Repeated rows count each; all rows of the largest id keep the line. An empty table gives an empty
result. Very long texts are read whole; memory is that of the longest text. Columns of the input travel
in one struct, so that none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm import scratch

_STRIP = b" \t\n\x0b\x0c\r"
_GOLDEN = 0x9E3779B97F4A7C15
_SHARD = 1 << 16  # keys of a shard
_BLOCK = 1 << 20  # probes of a block


def key_hashes(data: bytes, min_chars: int) -> list[bytes | None]:
    """A hash per line of a text in UTF-8, None for lines whose key is too short."""
    out: list[bytes | None] = []
    for line in data.lower().split(b"\n"):  # bytes lower their ASCII letters only
        key = line.strip(_STRIP)
        long = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h1.view(np.uint64) + np.uint64(_GOLDEN * (level + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30)) ^ h2.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) % np.uint64(size)


class PerfectHash:
    """Slots 0 to n-1 for n distinct pairs of 64-bit integers, some five bits a key."""

    def __init__(self, sizes: list[int], words: np.ndarray, ranks: np.ndarray) -> None:
        self.sizes, self.words, self.ranks = sizes, words, ranks

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        while h1.size:
            size = max(64, -(-2 * h1.size // 64) * 64)
            place = _place(h1, h2, len(sizes), size)
            wanted = np.bincount(place.astype(np.int64), minlength=size)
            sizes.append(size)
            bits.append(np.packbits(wanted == 1, bitorder="little").view("<u8"))
            rest = wanted[place] > 1
            h1, h2 = h1[rest], h2[rest]
        words = np.concatenate(bits) if bits else np.zeros(0, "<u8")
        held = np.bitwise_count(words).astype(np.uint32)
        return cls(sizes, words, (np.cumsum(held, dtype=np.uint32) - held).astype(np.uint32))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each pair; pairs that were not built in get some slot or -1."""
        out = np.full(h1.size, -1, np.int64)
        open_, start = np.arange(h1.size), 0
        for level, size in enumerate(self.sizes):
            place = _place(h1[open_], h2[open_], level, size)
            at = start + (place >> np.uint64(6)).astype(np.int64)
            bit = np.uint64(1) << (place & np.uint64(63))
            hit = (self.words[at] & bit) != 0
            below = np.bitwise_count(self.words[at] & (bit - np.uint64(1)))
            out[open_[hit]] = (self.ranks[at] + below)[hit]
            open_ = open_[~hit]
            start += size // 64
        return out


_INDEX = ("shard int, sizes array<int>, words binary, ranks binary, fingerprints binary, "
          "counts binary, largest binary")


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _build(keys: pa.Table) -> pa.Table:
    h1, h2 = _longs(keys["h1"]), _longs(keys["h2"])
    perfect = PerfectHash.build(h1, h2)
    slots = perfect.slots(h1, h2)
    arrays = [np.empty(h1.size, kind) for kind in (np.int64, np.int32, np.int64)]
    for array, values in zip(arrays, (h2, np.minimum(_longs(keys["n"]), 2**31 - 1),
                                      _longs(keys["largest"])), strict=True):
        array[slots] = values
    row = [keys["shard"][0].as_py(), perfect.sizes, perfect.words.tobytes(),
           perfect.ranks.tobytes(), *[a.tobytes() for a in arrays]]
    kinds = [pa.int32(), pa.list_(pa.int32())] + [pa.binary()] * 5
    names = [part.split()[0] for part in _INDEX.split(", ")]
    return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)


def line_hashes(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(id, h1, h2): the distinct keys of every document, stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [set(key_hashes(t.as_py() or b"", min_chars)) - {None}
                         for t in batch.column(1)]
                pairs = np.frombuffer(b"".join(b"".join(s) for s in found), ">i8").reshape(-1, 2)
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False),
                                [len(s) for s in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), *[pa.array(pairs[:, i].astype(np.int64))
                                                  for i in (0, 1)]], ["id", "h1", "h2"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").cast("binary")).where("id is not null")
    return scratch.table(rows.mapInArrow(run, "id long, h1 long, h2 long"), "line-hashes")


def index(hashes: DataFrame) -> tuple[DataFrame, int]:
    """The stored shards, one row each, and their number."""
    keys = (hashes.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("largest"))
            .where("n > 1"))
    keys = scratch.table(keys, "line-counts")
    shards = max(1, -(-keys.count() // _SHARD))
    keys = keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return scratch.table(keys.groupBy("shard").applyInArrow(_build, _INDEX), "line-index"), shards


def shared_lines(hashes: DataFrame, min_docs: int) -> DataFrame:
    """(id, h1, h2): the keys that a document must give up."""
    def probe(probes: pa.Table, shard: pa.Table) -> pa.Table:
        ids, h1, h2 = (_longs(probes[c]) for c in ("id", "h1", "h2"))
        go = np.zeros(ids.size, bool)
        if shard.num_rows and ids.size:
            row = shard.slice(0, 1).to_pylist()[0]
            perfect = PerfectHash(row["sizes"], np.frombuffer(row["words"], "<u8"),
                                  np.frombuffer(row["ranks"], "<u4"))
            fingerprints = np.frombuffer(row["fingerprints"], np.int64)
            counts = np.frombuffer(row["counts"], np.int32)
            largest = np.frombuffer(row["largest"], np.int64)
            slots = perfect.slots(h1, h2)
            go = ((slots >= 0) & (fingerprints[slots] == h2) & (counts[slots] >= min_docs)
                  & (largest[slots] != ids))
        return pa.table([ids[go], h1[go], h2[go]], names=["id", "h1", "h2"])

    shards, number = index(hashes)
    probes = hashes.withColumn("shard", F.pmod("h1", F.lit(number)).cast("int"))
    blocks = scratch.table(probes.groupBy("shard").agg(
        F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks")), "blocks")
    dealt = probes.join(blocks, "shard").withColumn(
        "block", F.pmod(F.monotonically_increasing_id(), F.col("blocks")).cast("int"))
    copies = shards.join(blocks, "shard").withColumn(
        "block", F.explode(F.expr("sequence(0, blocks - 1)")))
    return (dealt.drop("blocks").groupBy("shard", "block")
            .cogroup(copies.drop("blocks").groupBy("shard", "block"))
            .applyInArrow(probe, "id long, h1 long, h2 long"))


def drop_shared_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, kept_text, n_lines, n_dropped) of every row of ``docs``; ``row`` holds its columns."""
    hashes = line_hashes(docs, min_chars, id_col, text_col)
    gone = shared_lines(hashes, min_docs).groupBy("id").agg(
        F.collect_set(F.struct("h1", "h2")).alias("gone"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       F.col(id_col).cast("long").alias("key"),
                       F.col(text_col).cast("string").cast("binary").alias("data"))
    joined = rows.join(gone, rows["key"] == gone["id"], "left").select("row", "data", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rest = [_rest(t.as_py() or b"", g.as_py(), min_chars)
                        for t, g in zip(batch.column(1), batch.column(2), strict=True)]
                texts, lines, dropped = zip(*rest, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()),
                     pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                    ["row", "kept_text", "n_lines", "n_dropped"])

    row = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(
        run, f"row {row}, kept_text string, n_lines long, n_dropped long")


def _rest(data: bytes, gone: list[dict] | None, min_chars: int) -> tuple[bytes, int, int]:
    lines = data.split(b"\n")
    if not gone:
        return data, len(lines), 0
    hashes = {np.array([g["h1"], g["h2"]], ">i8").tobytes() for g in gone}
    kept = [line for line, h in zip(lines, key_hashes(data, min_chars), strict=True)
            if h not in hashes]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


ORACLE = """
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM texts),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (coalesce(k.doc_id <> s.largest, false))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                       FILTER (NOT coalesce(k.doc_id <> s.largest, false)), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON k.key = s.key
GROUP BY k.doc_id
"""
