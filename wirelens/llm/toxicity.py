"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its distinct words and their four-letter beginnings, hashed to a fixed number
of cells. Besides a weight, each cell has a short vector; the products of the vectors of two terms add
to the score, so that a pair (an insult next to the name of a group) can weigh more or less than its
words alone. Every cell of enough texts has a weight; those of cells that do not stand out are held down
by an absolute penalty. Cells that stand out alone or in a pair have vectors. It is fitted by stochastic
gradients on a bounded sample of labelled texts, those with the least hashes of their id, and never sees labels of the held-out fold, nor lang, source or id.

Nulls: a null text is an empty text; it gets the score of the bias. A null id hashes like the empty
text, so it is held out. Null labels are not labels; of several labels of one id, and of several texts
of one id, the largest label and the least text are learned from. Repeated rows stay repeated. An
empty table gives an empty result; a very long text is read whole, in blocks; columns to keep travel in one
struct, so that none can clash; without labels of both kinds every score is the share of toxic
labels, or zero.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.llm import scratch
from wirelens.llm.words import word_blocks

CELLS = 1 << 18
FACTORS = 4
FOLDS = 5
_TERM = re.compile(rb"[a-z0-9\x80-\xff]+")
_PREFIX = 4
PENALTY = 0.3  # mean slope of a cell's texts below which its weight stays zero
_KNOWN = 100_000  # words whose cells a worker remembers before it starts anew


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def _cells(word: bytes) -> tuple[int, ...]:
    out = []
    for term in _TERM.findall(word):
        out.append(xxhash.xxh64_intdigest(term) % CELLS)
        if len(term) > _PREFIX:
            out.append(xxhash.xxh64_intdigest(b"^" + term[:_PREFIX]) % CELLS)
    return tuple(out)


def cells(text: bytes) -> np.ndarray:
    """Distinct cells of a text's terms, sorted."""
    known = scratch.kept(("toxicity_cells",), dict)
    found: set[int] = set()
    for words in word_blocks(text):
        for word in {w.lower() for w in set(words)}:
            at = known.get(word)
            if at is None:
                if len(known) >= _KNOWN:
                    known.clear()
                at = known[word] = _cells(word)
            found.update(at)
    return np.sort(np.fromiter(found, "int32", len(found)))


class Machine:
    """bias + sum of weights + half of (square of summed vectors - sum of squared vectors)."""

    def __init__(self, bias: float, weight: np.ndarray, vector: np.ndarray) -> None:
        self.bias, self.weight, self.vector = bias, weight, vector

    def margin(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of texts whose cells lie end to end in ``flat``."""
        owner = np.repeat(np.arange(sizes.size), sizes)
        out = self.bias + np.bincount(owner, self.weight[flat], sizes.size)
        for vector in self.vector.T:
            part = vector[flat]
            out += 0.5 * (np.bincount(owner, part, sizes.size) ** 2
                          - np.bincount(owner, part * part, sizes.size))
        return out

    def probability(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(flat, sizes), -35, 35)))

    def dump(self) -> bytes:
        out = io.BytesIO()
        used = np.flatnonzero((self.weight != 0) | self.vector.any(axis=1))
        np.savez(out, bias=self.bias, used=used.astype("int32"), weight=self.weight[used],
                 vector=self.vector[used])
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Machine:
        held = np.load(io.BytesIO(blob))
        weight, vector = np.zeros(CELLS, "float32"), np.zeros((CELLS, FACTORS), "float32")
        weight[held["used"]], vector[held["used"]] = held["weight"], held["vector"]
        return cls(float(held["bias"]), weight, vector)


def telling(texts: list[np.ndarray], toxic: np.ndarray, share: float, least: int = 6,
            sigmas: float = 5.0) -> np.ndarray:
    """Cells of at least ``least`` texts whose toxic share is off the general one by ``sigmas``
    standard errors. Thousands of harmless words each a little off would else outweigh an insult in a
    long text."""
    seen, bad = np.zeros(CELLS), np.zeros(CELLS)
    for text, label in zip(texts, toxic, strict=True):  # a text names a cell once
        seen[text] += 1
        bad[text] += label
    apart = np.abs(bad - share * seen) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    return (seen >= least) & (apart >= sigmas)


def paired(texts: list[np.ndarray], toxic: np.ndarray, share: float, least: int = 6,
           chance: float = 0.01) -> np.ndarray:
    """Cells of pairs found together in at least ``least`` texts whose toxic share lies beyond the
    general one and both cells' own, by more than ``chance`` allows over all pairs (Chernoff bound).
    Pairs are counted one cell at a time; the work grows with the squared cells of a text."""
    flat = np.concatenate(texts).astype("int64")
    sizes = np.array([t.size for t in texts])
    seen = np.bincount(flat, minlength=CELLS)
    bad = np.bincount(flat, np.repeat(toxic, sizes), CELLS)
    count = int((seen >= least).sum())
    out = np.zeros(CELLS, bool)
    if count < 2:
        return out
    limit = np.log(count * count / 2 / chance)
    # a pair of fewer toxic and fewer clean texts cannot pass the limit whatever its share
    used = np.flatnonzero((seen >= least) & ((bad * -np.log(share) >= limit) |
                                             ((seen - bad) * -np.log(1 - share) >= limit)))
    if used.size < 2:
        return out
    place = np.full(CELLS, -1)
    place[used] = np.arange(used.size)
    flat, owner = place[flat], np.repeat(np.arange(sizes.size), sizes)
    flat, owner = flat[flat >= 0], owner[flat >= 0]
    ends = np.cumsum(np.bincount(owner, minlength=sizes.size))
    own = bad[used] / seen[used]
    for a, held in enumerate(np.split(flat.argsort(kind="stable"), np.cumsum(seen[used])[:-1])):
        # cells of a text are sorted: those behind this one
        after = [flat[k + 1:ends[owner[k]]] for k in held]
        n = np.bincount(np.concatenate(after), minlength=used.size)
        after = [x for x, k in zip(after, held, strict=True) if toxic[owner[k]]]
        bad = np.bincount(np.concatenate([flat[:0], *after]), minlength=used.size)
        at = np.flatnonzero(n >= least)
        rate = bad[at] / n[at]
        high = np.maximum(np.maximum(own[a], own[at]), share)
        low = np.minimum(np.minimum(own[a], own[at]), share)
        base = np.clip(np.where(rate > high, high, np.where(rate < low, low, rate)), 1e-6, 1 - 1e-6)
        rate = np.clip(rate, 1e-12, 1 - 1e-12)
        far = n[at] * (rate * np.log(rate / base) + (1 - rate) * np.log((1 - rate) / (1 - base)))
        hit = at[(far > limit) & (np.abs(rate - base) > 1e-5)]
        if hit.size:
            out[used[hit]] = out[used[a]] = True
    return out


def fit(texts: list[np.ndarray], toxic: np.ndarray, epochs: int = 6, rate: float = 0.1,
        decay: float = 1e-5, seed: int = 7, least: int = 6, penalty: float = PENALTY) -> Machine:
    """Adagrad on logistic loss, 128 texts a step: first the cells that tell alone, then all others of
    ``least`` texts; each step also moves the weights of those that tell in no pair towards zero by
    ``penalty``. Texts of the same cells
    count once, or the words of a text with many copies would all seem to tell."""
    rng = np.random.default_rng(seed)
    once: dict[bytes, int] = {}
    for i, t in enumerate(texts):
        at = once.setdefault(t.tobytes(), i)
        toxic[at] = max(toxic[at], toxic[i])
    texts, toxic = [texts[i] for i in once.values()], toxic[list(once.values())]
    share = float(np.clip(toxic.mean(), 1e-9, 1 - 1e-9)) if toxic.size else 1e-9
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(CELLS, "float32"),
                      np.zeros((CELLS, FACTORS), "float32"))
    if not 0 < toxic.sum() < toxic.size:
        return machine
    alone = telling(texts, toxic, share, least)
    company = alone | paired(texts, toxic, share, least)
    held = np.bincount(np.concatenate(texts), minlength=CELLS) >= least
    texts = [t[held[t]] for t in texts]
    machine.vector[alone] = rng.normal(0, 0.01, (int(alone.sum()), FACTORS))
    other = company & ~alone
    seen_w, seen_v = np.full(CELLS, 1e-3, "float32"), np.full((CELLS, FACTORS), 1e-3, "float32")
    for epoch in range(2 * epochs):  # the cells that do not tell learn what the others leave
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 128):
            part = order[at:at + 128]
            flat = np.concatenate([texts[i] for i in part])
            sizes = np.array([texts[i].size for i in part])
            owner = np.repeat(np.arange(part.size), sizes)
            slope = machine.probability(flat, sizes) - toxic[part]
            late = epoch >= epochs
            if epoch == epochs and at == 0:
                machine.vector[other] = rng.normal(0, 0.01, (int(other.sum()), FACTORS))
            if not late:
                machine.bias -= 0.05 * float(slope.mean())
            everything, owners = flat, owner
            chosen = alone[flat] != late
            flat, owner = flat[chosen], owner[chosen]
            cell, place = np.unique(flat, return_inverse=True)
            weight = machine.weight[cell]
            step = np.bincount(place, slope[owner], cell.size) + decay * weight
            seen_w[cell] += step * step
            weight = weight - rate * step / np.sqrt(seen_w[cell])
            pull = np.where(company[cell], 0, rate * penalty / np.sqrt(seen_w[cell]))
            machine.weight[cell] = np.sign(weight) * np.maximum(np.abs(weight) - pull, 0)
            chosen = company[flat]
            flat, owner = flat[chosen], owner[chosen]
            cell, place = np.unique(flat, return_inverse=True)
            sums = [np.bincount(owners, machine.vector[everything, f], part.size)
                    for f in range(FACTORS)] if late else None
            for f in range(FACTORS):
                vector = machine.vector[cell, f]
                summed = sums[f] if late else np.bincount(owner, vector[place], part.size)
                step = np.bincount(place, slope[owner] * (summed[owner] - vector[place]), cell.size)
                step = step + decay * vector
                seen_v[cell, f] += step * step
                machine.vector[cell, f] = vector - 0.2 * rate * step / np.sqrt(seen_v[cell, f])
    return machine


def _featured(docs: DataFrame) -> DataFrame:
    """(toxic, cells) of (toxic, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1),
                     pa.array([cells((t.as_py() or "").encode()) for t in batch.column(2)],
                              pa.list_(pa.int32()))], ["place", "toxic", "cells"])

    return docs.mapInArrow(run, "place long, toxic int, cells array<int>")


def train(docs: DataFrame, labels: DataFrame, sample: int = 16_384, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> bytes:
    """A model fitted on at most ``sample`` labelled texts outside the held-out fold. The sample's ids
    are few enough to broadcast; one task fits the model."""
    known = (labels.select(F.col(id_col).cast("long").alias("id"),
                           F.col(label_col).cast("int").alias("toxic"))
             .where("id is not null and toxic is not null").where(~held_out(F.col("id")))
             .groupBy("id").agg(F.max("toxic").alias("toxic"))
             .withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(sample))
    texts = docs.select(F.col(id_col).cast("long").alias("id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    chosen = (texts.join(F.broadcast(known), "id").groupBy("id")
              .agg(F.min("t").alias("t"), F.first("place").alias("place"),
                   F.first("toxic").alias("toxic")).select("place", "toxic", "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, np.ndarray]] = []
        for batch in batches:
            rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                        (np.asarray(c.values, "int32") for c in batch.column(2)), strict=True)
        rows.sort(key=lambda r: (r[0], r[1]))
        model = fit([r[2] for r in rows], np.array([r[1] > 0 for r in rows], "float64"))
        yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], ["model"])

    return bytes(_featured(chosen).coalesce(1).mapInArrow(run, "model binary").first()["model"])


def judged(docs: DataFrame, model: bytes, keep: list[str], text_col: str = "text") -> DataFrame:
    """(row, score, predicted): ``row`` holds the columns ``keep``, so that none can clash."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 5 MB, by its cells
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"),
                       F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = scratch.kept(("toxicity", xxhash.xxh64_intdigest(shared.value)),
                               lambda: Machine.load(shared.value))
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                found = [cells((t.as_py() or "").encode()) for t in batch.column(1)]
                sizes = np.array([f.size for f in found])
                scores = machine.probability(np.concatenate(found), sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(scores, pa.float64())], ["row", "score"])

    row_type = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {row_type}, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every row (doc_id by default), ``score`` and ``predicted``."""
    return judged(docs, model, keep or [id_col], text_col).select("row.*", "score", "predicted")
