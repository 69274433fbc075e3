"""Byte-level BPE by backtracking over longest matches.

Bytes are read as Latin-1 characters, so that one automaton finds every vocabulary entry at every
position of a piece. Two adjacent tokens are compatible when merging by rank never joins them across
their border; this depends on the two alone and is memoised. A sequence of reachable tokens whose
neighbours are all compatible is the one that rank-ordered merging gives, so the encoder walks through
a piece, takes the longest compatible match and steps back from positions that lead nowhere, each of
which it visits once: linear time, where merging by rank is quadratic on long pieces.

Nulls: a null text is an empty text: no tokens, and the digests of empty strings. Repeated rows stay
repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm import scratch

_NEVER = 1 << 62
_PIECES = 1_000_000  # pieces and pairs that a worker remembers before it starts anew
_PAIRS = 600_000
_SHORT = 64  # characters of a piece that is remembered


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in blob.splitlines() if line.strip())}


class _Memo(dict):
    """Values of a function, found without a call once known; forgotten all at once when full. Long
    keys are not worth remembering."""

    def __init__(self, function: Callable, limit: int) -> None:
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        value = self.function(key)
        if len(key) < _SHORT:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes and decodes the pieces of texts; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = [len(t) for t in self.tokens]
        self.by_decimal = {str(rank): token for token, rank in ranks.items()}
        self.matches = ahocorasick.Automaton()
        self.left: dict[int, tuple[int, ...]] = {}  # growing pieces at the left edge of a token
        self.right: dict[int, tuple[int, ...]] = {}
        # ids of a piece as text: one string takes less room and time than a tuple of numbers
        self.pieces = _Memo(lambda p: ",".join(map(str, self.piece(p.encode()))), _PIECES)
        self.pairs = _Memo(lambda pair: self._holds(self.right[pair[0]], self.left[pair[1]]), _PAIRS)
        for token, rank in sorted(ranks.items(), key=lambda entry: entry[1]):
            parts = [token] if len(token) == 1 else self._parts(token, rank)
            if len(parts) > 2:
                continue  # merging never builds it; it only stands for a whole piece
            first, last = ranks[parts[0]], ranks[parts[-1]]
            self.left[rank] = (*self.left[first], rank) if len(parts) == 2 else (rank,)
            self.right[rank] = (*self.right[last], rank) if len(parts) == 2 else (rank,)
            self.matches.add_word(token.decode("latin-1"), rank)
        self.matches.make_automaton()
        # the next shorter match at the same place
        self.shorter = [-1] * len(self.tokens)
        for rank in self.left:
            token = self.tokens[rank]
            self.shorter[rank] = next((r for end in range(len(token) - 1, 0, -1)
                                       if (r := ranks.get(token[:end], -1)) in self.left), -1)

    def _parts(self, token: bytes, rank: int) -> list[bytes]:
        """What merges of lower rank leave of a token: two parts, if it can be built at all."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i)
                           for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if any(self.ranks.get(p, _NEVER) not in self.left for p in parts):
            return [b""] * 3
        return parts

    def _holds(self, right: tuple[int, ...], left: tuple[int, ...]) -> bool:
        """Whether merging the bytes of two tokens keeps the border between them."""
        i = j = 0
        while True:
            grow_a = right[i + 1] if i + 1 < len(right) else _NEVER
            grow_b = left[j + 1] if j + 1 < len(left) else _NEVER
            across = self.ranks.get(self.tokens[right[i]] + self.tokens[left[j]], _NEVER)
            # equal ranks merge from the left: a's own merge, then the border, then b's own
            if across < grow_a and across <= grow_b:
                return False
            if grow_a == grow_b == _NEVER:
                return True
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1

    def piece(self, piece: bytes) -> Sequence[int]:
        """Token ids of one match of the pattern: longest matches first, shorter ones where they lead
        nowhere. Some five bytes a byte of the piece and its ids are all that is held."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        lengths, shorter, pairs = self.lengths, self.shorter, self.pairs
        size = len(piece)
        longest = [-1] * size if size < _SHORT else array("i", [-1]) * size
        for end, token in self.matches.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[token]] = token  # ends rise: the last one of a start stays
        out = [] if size < _SHORT else array("i")
        dead = bytearray(size + 1)
        at, token, last = 0, longest[0], -1
        while True:
            while token >= 0:
                to = at + lengths[token]
                if not dead[to] and (last < 0 or pairs[last, token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if to == size:
                    return out
                at, last, token = to, token, longest[to]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
                last, token = out[-1] if out else -1, shorter[token]

    def written(self, text: str) -> Iterator[str]:
        """Ids of a whole text in decimals, joined by commas, in runs of bounded length."""
        found = (m[0] for m in self.pattern.finditer(text)) if len(text) > 1 << 21 else iter(
            self.pattern.findall(text))
        while run := list(itertools.islice(found, 1 << 18)):
            yield ",".join(map(self.pieces.__getitem__, run))

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of a whole text, in runs of bounded length."""
        for run in self.written(text):
            yield list(map(int, run.split(",")))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def read(self, written: str) -> list[bytes]:
        """The tokens that written ids stand for."""
        return list(map(self.by_decimal.__getitem__, written.split(",")))


def _digests(coder: Encoder, text: str) -> tuple[int, str, str]:
    ids_hash, text_hash, count = hashlib.sha256(), hashlib.sha256(), 0
    for run in coder.written(text):
        if count:
            ids_hash.update(b",")
        ids_hash.update(run.encode())
        tokens = coder.read(run)
        text_hash.update(b"".join(tokens))
        count += len(tokens)
    return count, ids_hash.hexdigest(), text_hash.hexdigest()


def _coder(blob: bytes, pattern: str) -> Encoder:
    return scratch.kept(("byte_bpe", hashlib.sha256(blob).digest(), pattern),
                        lambda: Encoder(read_ranks(blob), pattern))


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, and its ``ids`` if asked for.

    ``vocabulary`` is the path of a rank file on the driver; it goes to the tasks as a broadcast of
    under a megabyte. The ids of a text are one array, so ``with_ids`` needs memory for it.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        blob = spark.sparkContext.broadcast(file.read())
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (
        ", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(blob.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t.as_py() or "" for t in batch.column(1)]
                rows = [_digests(coder, t) for t in texts]
                columns = [batch.column(0)] + [
                    pa.array(c, k) for c, k in zip(
                        zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()),
                        strict=True)]
                if with_ids:
                    columns.append(pa.array(
                        [list(itertools.chain.from_iterable(coder.encode(t))) for t in texts],
                        pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, schema)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a binary column ``decoded``: the bytes that its ids stand for."""
    with open(vocabulary, "rb") as file:
        blob = encoded.sparkSession.sparkContext.broadcast(file.read())

    @F.arrow_udf("binary")
    def unfold(ids: pa.Array) -> pa.Array:
        tokens = scratch.kept(("byte_bpe_tokens", hashlib.sha256(blob.value).digest()),
                              lambda: {r: t for t, r in read_ranks(blob.value).items()})
        return pa.array([None if row is None else b"".join(map(tokens.__getitem__, row))
                         for row in ids.to_pylist()], pa.binary())

    return encoded.withColumn("decoded", unfold(F.col(ids_col)))
