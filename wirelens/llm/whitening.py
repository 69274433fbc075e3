"""Embedding whitening by spectral divide and conquer on polar decompositions (QDWH).

Vectors are put on a fixed grid of integers, so that counts, sums and squared deviations are exact. One
pass adds up the sums, a second the covariance of the centred vectors; its size is that of the vectors,
whatever the table. On the driver the covariance is split: the polar factor of V - shift*I is plus one
on the eigenvectors above the shift and minus one on those below, so half of it plus the identity is a
spectral projector; orthonormal bases of its range and of the rest turn V into two smaller blocks, and
these are split in turn until every block is one component. The polar factor comes from the dynamically
weighted Halley iteration. The leading components, divided by the roots of their eigenvalues, are
broadcast (vector length times components) and applied where the rows are.

Nulls: rows whose vector is null, empty or holds null or non-finite entries take no part, nor do vectors of
another length than the most frequent one (of equally frequent ones the longest). A null id is kept. Entries
beyond 2^56 are taken as 2^56, with their sign. Repeated rows count each. Components without variance (less than a
trillionth of the whole) have whitened values of 0 and are left out of the identity error. A deviation
that no long can hold is null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EPS = np.finfo(float).eps
_SCALE, _OFFSET, _LARGEST = 64.0, 1_000_000, float(1 << 62)
_ROWS = 1024  # vectors that a task holds as doubles at once


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH with QR-based first steps."""
    n = len(a)
    eye = np.eye(n)
    x = a / np.linalg.norm(a)
    try:
        low = 1.0 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(1.0, max(low, 1e-17))
    for _ in range(30):
        square = low * low
        d = np.cbrt(4.0 * (1.0 - square) / (square * square))
        root = np.sqrt(1.0 + d)
        wa = root + 0.5 * np.sqrt(8.0 - 4.0 * d + 8.0 * (2.0 - square) / (square * root))
        wb = (wa - 1.0) ** 2 / 4.0
        wc = wa + wb - 1.0
        if wc > 100.0:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * (x.T @ x), x.T).T
        new = (new + new.T) / 2.0
        moved = np.linalg.norm(new - x)
        x = new
        low = min(1.0, low * (wa + wb * square) / (1.0 + wc * square))
        if moved < np.cbrt(_EPS) and 1.0 - low < 1e-12:
            break
    return x


def _bases(a: np.ndarray, shift: float, rng: np.random.Generator
           ) -> tuple[float, np.ndarray, int] | None:
    """(size of the block off the diagonal, orthonormal basis, dimension of the part above)."""
    shifted = a - shift * np.eye(len(a))
    if not shifted.any():
        return None
    projector = (polar(shifted) + np.eye(len(a))) / 2.0
    above = int(round(float(np.trace(projector))))
    if not 0 < above < len(a):
        return None
    start = projector @ rng.standard_normal((len(a), above))
    for _ in range(2):  # one subspace step after the first
        q = np.linalg.qr(start, mode="complete")[0]
        start = projector @ q[:, :above]
    off = float(np.linalg.norm(q[:, above:].T @ a @ q[:, :above]))
    return off, q, above


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their eigenvectors as columns."""
    n = len(v)
    rng = np.random.default_rng(7)
    scale = float(np.linalg.norm(v))
    todo = [((v + v.T) / 2.0, np.eye(n))]
    vectors: list[np.ndarray] = []
    while todo:
        a, basis = todo.pop()
        mean = float(np.trace(a)) / len(a)
        spread = float(np.linalg.norm(a - mean * np.eye(len(a))))
        if len(a) == 1 or spread <= 4 * _EPS * scale:
            vectors.append(basis)
            continue
        best = None
        # the median halves the block; the mean always has eigenvalues on both sides; the others
        # move a shift off an eigenvalue that it happens to hit
        width = spread / np.sqrt(len(a))
        for shift in (float(np.median(np.diag(a))), mean, mean + width / 7, mean - width / 7,
                      mean + width / 3, mean - width / 3):
            found = _bases(a, shift, rng)
            if found and (best is None or found[0] < best[0]):
                best = found
            if best and best[0] <= 20 * _EPS * scale:
                break
        if best is None:
            vectors.append(basis)
            continue
        _, q, above = best
        for part in (q[:, :above], q[:, above:]):
            block = part.T @ a @ part
            todo.append(((block + block.T) / 2.0, basis @ part))
    out = np.hstack(vectors) if vectors else np.zeros((0, 0))
    values = np.einsum("ij,ij->j", out, v @ out)
    order = np.argsort(-values, kind="stable")
    return values[order], out[:, order]


def grid(batch: pa.RecordBatch, column: int, length: int | None
         ) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integer vectors) of the rows of a batch that take part, by length of vector."""
    lists = batch.column(column)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    lengths = np.where(np.isnan(lengths), 0, lengths).astype(np.int64)
    for size in np.unique(lengths) if length is None else [length]:
        rows = np.flatnonzero(lengths == size)
        for at in range(0, rows.size if size else 0, _ROWS):
            take = pa.array(rows[at:at + _ROWS])
            flat = lists.take(take).flatten().to_numpy(zero_copy_only=False).astype(float)
            values = flat.reshape(-1, size)
            good = np.isfinite(values).all(axis=1)
            with np.errstate(over="ignore"):
                steps = np.clip(np.floor(_SCALE * values[good]), -_LARGEST, _LARGEST)
            ids = batch.column(0).take(take).filter(pa.array(good))
            yield ids, steps.astype(np.int64) + _OFFSET


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` in integers that do not overflow below ``bound``."""
    return x if bound < 1 << 62 else x.astype(object)


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors of the most frequent length and the exact sum of each of their entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for _, x in grid(batch, 1, None):
                if not len(x):
                    continue
                held = total.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                part = _exact(x, int(np.abs(x).max()) * len(x)).sum(axis=0)
                held[0] += len(x)
                held[1] = [a + int(b) for a, b in zip(held[1], part, strict=True)]
        rows = [(size, i, n, Decimal(s)) for size, (n, row) in total.items()
                for i, s in enumerate(row)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
            ["length", "dim", "n", "total"])

    found = vectors.mapInArrow(run, "length long, dim int, n long, total decimal(38,0)").groupBy(
        "length", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    top = found.where("dim = 0").orderBy(F.desc("n"), F.desc("length")).limit(1)
    rows = found.join(F.broadcast(top.select("length")), "length").orderBy("dim").collect()
    return (rows[0]["n"] if rows else 0), [int(r["total"]) for r in rows]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """Exact n*x - S."""
    bound = n * int(np.abs(x).max(initial=1)) + max(map(abs, total))
    return n * _exact(x, bound) - np.array(total, np.int64 if bound < 1 << 62 else object)


def second_moments(vectors: DataFrame, length: int, size: int,
                   transform: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all vectors of the outer product of ``transform`` of the integer vectors, which gives
    rows of ``size`` doubles. Tasks send one row per row of their matrix; these are added up in a
    stream by Spark, so no task holds more than one matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for _, x in grid(batch, 1, length):
                y = transform(x)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
            ["i", "v"])

    rows = vectors.mapInArrow(run, "i int, v array<double>").groupBy("i").agg(
        F.array(*[F.sum(F.col("v")[j]) for j in range(size)]).alias("v")).collect()
    out = np.zeros((size, size))
    for r in rows:
        out[r["i"]] = r["v"]
    return (out + out.T) / 2.0


_RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
           "identity_error double")


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and
    each of its ``components`` leading components (all, if the vectors are shorter)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
    n, total = sums(rows)
    if not n:
        return spark.createDataFrame([], _RESULT)
    length = len(total)

    def middle(x: np.ndarray) -> np.ndarray:
        return (centred(x, n, total) / n).astype(float)

    covariance = second_moments(rows, length, length, middle) / n
    values, axes = eigen(covariance)
    trace = float(np.trace(covariance))
    number = min(components, length)
    values, axes = values[:number], axes[:, :number]
    live = values > 1e-12 * trace
    scaled = np.where(live, axes / np.sqrt(np.where(live, values, 1.0)), 0.0)
    shared = spark.sparkContext.broadcast(scaled)
    explained = values / trace if trace > 0 else np.zeros(number)

    # the centred vectors add up to exactly 0, so their projections need no mean of their own
    found = second_moments(rows, length, number, lambda x: middle(x) @ shared.value) / n
    error = float(np.abs(found - np.diag(live.astype(float))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = shared.value
        for batch in batches:
            for ids, x in grid(batch, 1, length):
                if not len(x):
                    continue
                apart = centred(x, n, total)
                most = int(np.abs(apart).max(initial=0))
                deviation = (_exact(apart, most * most * length) ** 2).sum(axis=1)
                longs = [int(d) if d < 1 << 63 else None for d in deviation]
                white = (apart / n).astype(float) @ axes
                each = np.repeat(np.arange(len(x)), number)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(each)),
                     pa.array(np.tile(np.arange(1, number + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(each.size, n)), pa.array(longs, pa.int64()).take(pa.array(each)),
                     pa.array(white.ravel()), pa.array(np.tile(explained, len(x))),
                     pa.array(np.full(each.size, error))],
                    [part.split()[0] for part in _RESULT.split(", ")])

    return rows.mapInArrow(run, _RESULT)
