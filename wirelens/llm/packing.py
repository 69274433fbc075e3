"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Pieces go, longest first, into the open bin that they fill
best. If none has room, a bin is opened: for every permitted size that holds the piece, the lengths
still to be placed tell how far such a bin would be filled and to which size it would then be cut, and
the size with the least cost per token is taken. At the end every bin is downsized to the shortest
permitted length that holds its contents, so sizes are chosen jointly with the packing and once more
by the outcome.

Lengths are byte-level BPE tokens and one end mark a text. Texts longer than the longest length are cut
into pieces before a word, and inside a word that is longer itself, at a token border between two
characters; nothing is dropped. The pieces of a text hold the tokens of the whole text.

Every task packs the rows of its own partition, a bounded buffer at a time, so nothing is shuffled and
no key can be hot; each buffer leaves a few bins partly filled. The bins follow the partitions of the
input and are the same whenever it is read the same way.

Nulls: a null or empty text counts as one token, its end mark. Null ids and repeated rows are packed
like any row. Very long texts are walked through word by word; a single unbroken word takes some five
bytes a byte. Only the id and text columns are read, so other columns may have any name. An empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm import scratch
from wirelens.llm.byte_bpe import Encoder, read_ranks

SIZES = (512, 1024, 2048, 4096)
START = 64.0  # what a sequence costs beside its tokens, in tokens
ATTENTION = 1 / 16_384  # what a token costs for every token of its sequence, as a share of a token
# white space as the tokenizers' patterns have it; Python's own class has four control characters more
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_WORDS = 500_000  # words whose token counts a worker remembers
_LONG = 64  # characters of a word that is not remembered


def cost(size: int) -> float:
    """What a sequence of ``size`` tokens costs: its tokens, a part that grows with its square, and a
    fixed part for starting one."""
    return size + size * size * ATTENTION + START


def fill(gap: int, lengths: list[int], hi: int) -> int:
    """Tokens that the longest fitting ones of ``lengths[:hi]`` (ascending) leave in a gap, one after
    the other."""
    free = gap
    while hi and free:
        hi = bisect.bisect_right(lengths, free, 0, hi)
        if not hi:
            break
        n = lengths[hi - 1]
        lo = bisect.bisect_left(lengths, n, 0, hi)
        free -= n * min(hi - lo, free // n)
        hi = lo
    return gap - free


def open_size(piece: int, lengths: list[int], hi: int, rest: int, sizes: tuple[int, ...]) -> int:
    """Size of the bin to open for a piece: the least cost per token it is expected to hold in the end.
    ``lengths[:hi]`` (ascending) are still to be placed; ``rest`` is what they have more than the room
    of the bins already open."""
    def per_token(size: int) -> float:
        held = piece + min(fill(size - piece, lengths, hi), max(rest, 0))
        return cost(sizes[bisect.bisect_left(sizes, held)]) / held

    return min((s for s in sizes if s >= piece), key=lambda s: (per_token(s), s))


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every length, and the final size of every bin. Lengths are positive and at
    most the largest size."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    rising = sorted(lengths)
    rest = sum(lengths)  # less the room of the open bins
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    used: list[int] = []
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for done, i in enumerate(order, 1):
        n = lengths[i]
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b = len(used)
            used.append(0)
            free = open_size(n, rising, len(rising) - done, rest - n, sizes)
            rest -= free
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if free > n:
            bisect.insort(room, (free - n, b))
    return bins, offsets, [sizes[bisect.bisect_left(sizes, u)] for u in used]


class Lengths(dict):
    """Counts tokens; one per Python worker: the token counts of the words met lately.

    No match of the pattern may reach from a word into the white space after it, so words are counted
    one by one. Short ones go to the tokenizer library once and are remembered; long ones, on which it
    may take quadratic time, to the linear encoder.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks, self.pattern = ranks, pattern
        self.encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks,
                                        special_tokens={}).encode_ordinary

    @functools.cached_property
    def linear(self) -> Encoder:
        return Encoder(self.ranks, self.pattern)

    def __missing__(self, word: str) -> int:
        if len(word) > _LONG:
            return sum(len(self.linear.piece(m[0].encode()))
                       for m in self.linear.pattern.finditer(word))
        if len(self) >= _WORDS:
            self.clear()
        count = self[word] = len(self.encode(word))
        return count

    def pieces(self, text: str, longest: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, tokens) of the pieces of a text in code points: its tokens and an end mark, at
        most ``longest`` each."""
        words: Iterable[str] = (m[0] for m in _WORD.finditer(text))
        if len(text) < 1 << 20:  # most texts are short: one count, no search for borders
            words = _WORD.findall(text)
            total = sum(map(self.__getitem__, words))
            if total < longest:
                yield 0, len(text), total + 1
                return
        start = at = n = 0
        for word in words:
            tokens = self[word]
            if n + tokens > longest:
                if n:
                    yield start, at, n
                start, n = at, 0
            n += tokens
            if n > longest:
                *full, (first, _, n) = self.inside(word, longest)
                yield from ((start + a, start + b, k) for a, b, k in full)
                start += first
            at += len(word)
        if n == longest:
            yield start, len(text), n
            start, n = len(text), 0
        yield start, len(text), n + 1

    def inside(self, word: str, longest: int) -> Iterator[tuple[int, int, int]]:
        """A word in runs of at most ``longest`` tokens that begin and end between characters."""
        start = at = n = 0  # code points before the run, code points so far, tokens of the run
        border = before = 0  # the last token border between characters, and the run's tokens before it
        for match in self.linear.pattern.finditer(word):
            for token in self.linear.piece(match[0].encode()):
                heads = [b & 0xC0 != 0x80 for b in self.linear.tokens[token]]
                if heads[0]:
                    border, before = at, n
                if n == longest:
                    yield start, border, before
                    start, n, before = border, n - before, 0
                n += 1
                at += sum(heads)
        yield start, at, n


def best_fit(docs: DataFrame, vocabulary: str, pattern: str, sizes: tuple[int, ...] = SIZES,
             buffer: int = 16_384, buffer_chars: int = 64 << 20, id_col: str = "doc_id",
             text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start and end in the text, n_tokens, bin_id, bin_size,
    bin_offset, and the piece's text if asked for.

    ``vocabulary`` is the path of a rank file on the driver; it goes to the tasks as a broadcast of
    under a megabyte. The least size must hold a character, however many tokens it takes: four.
    """
    sizes = tuple(sorted(sizes))
    if sizes[0] < 4:
        raise ValueError("sizes must be 4 at least")
    with open(vocabulary, "rb") as file:
        blob = docs.sparkSession.sparkContext.broadcast(file.read())
    names = ["doc_id", "piece", "start", "end", "n_tokens", "bin_id", "bin_size", "bin_offset",
             "text"][:8 + with_text]
    schema = ("doc_id long, piece int, start long, end long, n_tokens int, bin_id string, "
              "bin_size int, bin_offset int" + ", text string" * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        lengths = scratch.kept(("packing", hashlib.sha256(blob.value).digest(), pattern),
                               lambda: Lengths(read_ranks(blob.value), pattern))
        held: list[tuple] = []
        chars = number = 0
        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1), strict=True):
                text = value.as_py() or ""
                for n, (start, end, tokens) in enumerate(lengths.pieces(text, sizes[-1])):
                    kept = text[start:end] if with_text else None
                    held.append((doc.as_py(), n, start, end, tokens, kept))
                    chars += len(kept or "")
                if len(held) >= buffer or chars >= buffer_chars:
                    yield from flush(held, f"{task}-{number}")
                    held, chars, number = [], 0, number + 1
        if held:
            yield from flush(held, f"{task}-{number}")

    def flush(held: list[tuple], prefix: str) -> Iterator[pa.RecordBatch]:
        bins, offsets, final = pack([h[4] for h in held], sizes)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(),
                 pa.int32(), pa.string()]
        for at in range(0, len(held), 1024):
            rows = [(*h[:5], f"{prefix}-{b}", final[b], o, h[5]) for h, b, o in zip(
                held[at:at + 1024], bins[at:at + 1024], offsets[at:at + 1024], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k, _ in zip(zip(*rows, strict=True), kinds, names,
                                                   strict=False)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, schema)
