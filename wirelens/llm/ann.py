"""Nearest neighbours by an inverted multi-index.

Each vector, scaled to length one, is cut into two halves that are quantised on their own, so a few
centroids per half make a grid of cells. A query walks the cells by the sum of its two centroid
distances with a heap, gathers the entries of the cells until a share of the index has been seen, and
reranks these entries by exact cosine on the original vectors.

Equal vectors are one entry with the ids that can be in a result (one more than asked for), counted
together before they are shuffled, so a vector with very many copies is an entry like any other.
Entries are dealt by hash into shards of bounded size, queries into blocks of bounded size; every
block meets every shard once, and each meeting keeps a query's best only.

Nulls: vectors that are null or zero or hold null, infinite or undefined components take no part, nor
do vectors of another length than the most frequent one (of several, the longest). Null ids take no
part. A repeated row is one candidate and one query. No valid vectors, no rows. Columns other than id and
vector are not read.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.llm import scratch

SHARD_BYTES = 32 << 20
BLOCK = 4096


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part, v as doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(
        finite & F.exists("v", lambda x: x != 0))
    # -0.0 and 0.0 are the same component
    rows = scratch.table(rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))), "vectors")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def entries(rows: DataFrame, top: int) -> DataFrame:
    """(v, ids): distinct vectors with their ``top`` least ids."""
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(tuple(v), []).append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(v) for v in held], pa.list_(pa.float64())),
                 pa.array([sorted(set(ids))[:top] for ids in held.values()],
                          pa.list_(pa.int64()))], ["v", "ids"])

    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, top)
    return (rows.mapInArrow(combine, "v array<double>, ids array<long>")
            .groupBy("v").agg(least.alias("ids")))


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T
                      + (centroids * centroids).sum(1), 0)


def _centroids(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = _distances(x, out).argmin(1)
        sums = np.zeros_like(out)
        np.add.at(sums, nearest, x)
        held = np.bincount(nearest, minlength=len(out))
        out = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], out)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def codebooks(index: DataFrame, cells: int = 32, sample: int = 8192, rounds: int = 12,
              seed: int = 1) -> bytes:
    """Two sets of ``cells`` centroids from the ``sample`` entries of the least hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(b.column(1)) for b in batches if b.num_rows]
        out = io.BytesIO()
        if parts:
            x = _unit(np.concatenate(parts))
            half = (x.shape[1] + 1) // 2
            np.savez(out, a=_centroids(x[:, :half], cells, rounds, seed),
                     b=_centroids(x[:, half:], cells, rounds, seed + 1))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    chosen = index.select(F.xxhash64("v").alias("h"), "v").orderBy("h", "v").limit(sample)
    return bytes(chosen.coalesce(1).mapInArrow(run, "model binary").first()["model"])


class Shard:
    """The inverted multi-index of one shard."""

    def __init__(self, matrix: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        self.matrix, self.a, self.b = matrix, a, b
        self.norm = np.sqrt((matrix * matrix).sum(axis=1))
        unit = matrix / self.norm[:, None]
        half = a.shape[1]
        cell = (_distances(unit[:, :half], a).argmin(1) * len(b)
                + _distances(unit[:, half:], b).argmin(1))
        self.order = cell.argsort(kind="stable")
        self.starts = np.searchsorted(cell[self.order], np.arange(len(a) * len(b) + 1))

    def gather(self, da: np.ndarray, db: np.ndarray, enough: int) -> np.ndarray:
        """Entries of the cells nearest by summed distance, ``enough`` or all."""
        ra, rb = da.argsort(), db.argsort()
        sa, sb = da[ra].tolist(), db[rb].tolist()
        first = (ra * len(rb)).tolist()
        second = rb.tolist()
        heap, found, held = [(sa[0] + sb[0], 0, 0)], [], 0
        starts = self.starts
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            cell = first[i] + second[j]
            at, to = starts[cell], starts[cell + 1]
            if to > at:
                found.append(self.order[at:to])
                held += to - at
            if j + 1 < len(sb):
                heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(sa):  # each pair has one way in
                heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
        return np.concatenate(found) if found else np.empty(0, "int64")

    def nearest(self, queries: np.ndarray, enough: int, top: int, least: np.ndarray
                ) -> Iterator[tuple[int, int, float]]:
        """(query, entry, cosine) of the ``top`` best gathered entries of every query; of equal ones
        those of the ``least`` ids."""
        unit = _unit(queries)
        half = self.a.shape[1]
        das, dbs = _distances(unit[:, :half], self.a), _distances(unit[:, half:], self.b)
        for q, vector in enumerate(queries):
            found = self.gather(das[q], dbs[q], enough)
            rough = self.matrix[found] @ vector / self.norm[found]
            length = math.sqrt((vector * vector).sum())
            if found.size > top:  # all that can be as good as the last one, up to rounding
                last = np.partition(rough, -top)[-top]
                found = found[rough >= last - 8 * (vector.size + 8) * np.finfo("f8").eps * length]
            # one order of summation, whatever else was gathered
            exact = (self.matrix[found] * vector).sum(axis=1) / (self.norm[found] * length)
            for i in np.lexsort((least[found], -exact))[:top]:
                yield q, int(found[i]), float(exact[i])


def search(vectors: DataFrame, every: int = 50, k: int = 5, share: float = 0.5, cells: int = 32,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of every query, a vector whose id is
    divisible by ``every``, among all others, from the nearest ``share`` of the index."""
    rows = valid(vectors, id_col, vector_col)
    index = scratch.table(entries(rows, k + 1), "entries")
    asked = rows.where(F.col("id") % every == 0).distinct()
    queries = scratch.table(asked.groupBy("v").agg(F.min("id").alias("q")), "queries")
    model = codebooks(index, cells)
    count, dims = index.agg(F.count("*"), F.max(F.size("v"))).first()
    shards = max(1, -(-count * (dims or 1) * 8 // SHARD_BYTES))
    blocks = max(1, -(-queries.count() // BLOCK))
    enough = max(1024, math.ceil(share * count / shards))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = [], [], []
        if left.num_rows and right.num_rows and model:
            books = np.load(io.BytesIO(model))
            shard = Shard(_matrix(right["v"].combine_chunks()), books["a"], books["b"])
            names, ids = left["q"].to_pylist(), right["ids"].to_pylist()
            least = np.array([i[0] for i in ids])
            for q, entry, score in shard.nearest(_matrix(left["v"].combine_chunks()), enough, k + 1,
                                                 least):
                for i in ids[entry]:
                    out[0].append(names[q])
                    out[1].append(i)
                    out[2].append(score)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                         pa.array(out[2], pa.float64())], ["q", "id", "score"])

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.select("q", "v", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"),
                          numbers(shards).alias("shard"))
    right = index.select("ids", "v", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"),
                         numbers(blocks).alias("block"))
    found = (left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard"))
             .applyInArrow(meet, "q long, id long, score double"))
    best = F.slice(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("far"), "id"))), 1, k + 1)
    answers = scratch.table(found.groupBy("q").agg(best.alias("best")), "answers")
    # a query's own entry is in the answer of its vector; copies of one vector share the answer
    mine = asked.join(queries, "v").select(F.col("id").alias("query_id"), "q")
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    return (mine.join(answers, "q").select("query_id", F.posexplode(others).alias("rank", "b"))
            .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"),
                    F.col("b.id").alias("vec_id"), (-F.col("b.far")).alias("score")))
