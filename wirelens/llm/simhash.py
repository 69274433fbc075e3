"""SimHash near-duplicates through an inverted index over positional bytes.

Fingerprints that differ in at most ``max_bits`` bits share at least ``8 - max_bits`` of their eight
positional bytes. The guaranteed number of shared bytes is used as the posting key: a fingerprint is
listed once under every choice of that many positions, with the bytes found there. A pair meets in a
list exactly when its tally of shared bytes reaches the guaranteed minimum, so the count filter needs
no counter per pair. Lists are then verified by bit count, and a list hands on a spanning forest of
its links only, never all its pairs.

Nulls: a null text is an empty text, whose fingerprint is zero; zero links like any other. A null id
is a document of its own class if nothing else shares its class, else it takes the least id there.
Repeated rows stay repeated. An empty table gives an empty result. A very long text is read whole, in blocks
of words. Rows travel in one struct, so that no column can clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm import scratch
from wirelens.llm.components import components
from wirelens.llm.words import word_blocks

SEED = 42


def fingerprint(text: bytes, width: int = 3) -> int:
    """64 bits, each the majority of that bit over the hashes of all ``width``-word shingles."""
    ones, total, carry = np.zeros(64, "int64"), 0, []
    for words in word_blocks(text.lower()):
        words = carry + words
        shingles = [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)]
        if shingles:
            ones += _bits(shingles)
            total += len(shingles)
        carry = words[max(0, len(words) - width + 1):]
    if not total:
        if not carry:
            return 0
        ones, total = _bits([b" ".join(carry)]), 1
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def _bits(shingles: list[bytes]) -> np.ndarray:
    ones = np.zeros(64, "int64")
    for at in range(0, len(shingles), 1 << 16):
        part = shingles[at:at + (1 << 16)]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in part], ">u8")
        ones += np.unpackbits(hashes.view("uint8").reshape(-1, 8), axis=1).sum(0, dtype="int64")
    return ones


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text",
                 with_row: bool = False) -> DataFrame:
    """(id, fp) of every row, with the whole row as a struct if asked for; fp holds the 64 bits as a
    signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                bits = np.fromiter((fingerprint((t.as_py() or "").encode(), width)
                                    for t in batch.column(1)), "uint64", batch.num_rows)
                columns = [batch.column(0), pa.array(bits.view("int64")), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, ["id", "fp", "row"][:len(columns)])

    inner = docs.select(F.col(id_col).cast("long").alias("id"),
                        F.col(text_col).cast("string").alias("t"),
                        *[F.struct(*[docs[c] for c in docs.columns]).alias("row")] * with_row)
    schema = "id long, fp long"
    if with_row:
        schema += f", row {inner.schema['row'].dataType.simpleString()}"
    return inner.mapInArrow(run, schema)


def postings(fps: DataFrame, max_bits: int) -> DataFrame:
    """(key, fp): one row per fingerprint and choice of ``8 - max_bits`` byte positions."""
    kept = 8 - max_bits
    choices = list(itertools.combinations(range(8), kept))
    if kept < 1 or len(choices) << (8 * kept) > 1 << 63:
        raise ValueError("max_bits must be between 2 and 7")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = (256 ** np.arange(kept)).astype("int64")
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            cells = fp.view("uint8").reshape(-1, 8).astype("int64")
            for n, choice in enumerate(choices):
                key = cells[:, choice] @ scale + (n << (8 * kept))
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0)], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def forest(fps: np.ndarray, max_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints, breadth first: what has been
    reached is not looked at again, so a dense group costs about its size."""
    ends, starts, rest = [], [], fps
    while rest.size > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= max_bits
            if near.any():
                found, rest = rest[near], rest[~near]
                ends.append(found)
                starts.append(np.full(found.size, at))
                queue.extend(found)
    return ends, starts


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """(u, v): links among distinct fingerprints (column fp) that hold every component together."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.r_[0, edges], np.r_[edges, keys.size]
            sizes = ends - starts
            two = starts[sizes == 2]
            near = np.bitwise_count(values[two] ^ values[two + 1]) <= max_bits
            us, vs = [values[two][near]], [values[two + 1][near]]
            for at, to in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
                found = forest(values[at:to], max_bits)
                us += found[0]
                vs += found[1]
            u, v = np.concatenate(us), np.concatenate(vs)
            if u.size:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.view("int64")), pa.array(v.view("int64"))], ["u", "v"])

        keys, values = np.empty(0, "int64"), np.empty(0, "uint64")
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
            values = np.r_[values, batch.column(1).to_numpy(zero_copy_only=False).view("uint64")]
            open_at = int(np.searchsorted(keys, keys[-1]))  # this list may go on in the next batch
            if open_at:
                yield from out(keys[:open_at], values[:open_at])
                keys, values = keys[open_at:], values[open_at:]
        if keys.size:
            yield from out(keys, values)

    return (postings(fps, max_bits).repartition("key").sortWithinPartitions("key", "fp")
            .mapInArrow(scan, "u long, v long"))


def _merged(classes: DataFrame, edges: DataFrame, node: str, key: str) -> DataFrame:
    """(key, root, component_id) of every class (node, key, first): the least node and the least id
    that links reach. Stored, so that a join on a key with very many copies can be split."""
    roots = components(edges).withColumnRenamed("node", "at")
    named = classes.select(F.col(node).alias("own"), F.col(key).alias("named"), "first")
    linked = roots.join(named, F.col("at") == F.col("own")).select("own", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    return scratch.table(
        named.join(linked.join(least, "root").select("own", "root", "least"), "own", "left")
        .select(F.col("named").alias(key), F.coalesce("root", "own").alias("root"),
                F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least"))
                .alias("component_id")), "merged")


def merge(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root, component_id) of every fingerprint of ``rows`` (id, fp)."""
    classes = scratch.table(rows.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    return _merged(classes, links(classes, max_bits), "fp", "fp")


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: fingerprint and the least id that links reach."""
    rows = scratch.table(fingerprints(docs, width, id_col, text_col), "fingerprints")
    return rows.join(merge(rows, max_bits), "fp").select(
        F.col("id").alias("doc_id"), "fp", "component_id")


def representatives(docs: DataFrame, width: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row of every group of linked texts, with the columns of ``docs``: the row of the least id,
    any one where several rows have it or no row has an id."""
    rows = scratch.table(fingerprints(docs, width, id_col, text_col, with_row=True), "rows")
    return _one_each(rows, merge(rows.select("id", "fp"), max_bits), "fp")


def _one_each(rows: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    least = F.col("id").eqNullSafe(F.col("component_id"))
    again = (rows.select("id", key).join(merged, key).where(least).groupBy("root").count()
             .where("count > 1").select("root", F.lit(True).alias("again")))
    merged = scratch.table(merged.join(again, "root", "left"), "merged")
    once = rows.join(merged.where("again is null"), key).where(least)
    more = rows.join(merged.where("again"), key).where(least).dropDuplicates(["root"])
    return once.unionByName(more).select("row.*")
