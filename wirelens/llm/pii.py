"""Personal data by fixed patterns and a semi-Markov conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers. The random field adds spans that
the patterns miss, such as phone numbers without a country code or spelt-out addresses. It scores
whole candidate spans: the shape of the span, its digits and checksum, and the words around it. A
dynamic programme over the tokens of a zone chooses boundaries and kinds together; entities have at
most ``LONGEST`` tokens, so its cost is linear. Only zones around digits, at-signs and spelt-out signs
are looked at; all other tokens are outside of any entity.

The field is trained on the table itself: spans that the patterns find in a bounded sample of texts,
as they stand and rewritten into forms that the patterns miss, against the rest of their zones and
against numbers that are no personal data. A predicted span is added where it overlaps no pattern's
span and its score is at least ``MARGIN`` above staying outside.

Nulls: a null text is an empty text without spans. A very long text is read whole (the bounds above are
of the fit only); masking replaces the text column alone. Repeated rows stay repeated; an empty table gives
an empty result; a table without personal data trains no field, and only the patterns count.
"""

from __future__ import annotations

import hashlib
import io
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm import scratch

KINDS = ("email", "ip", "card", "phone")
LONGEST = 20  # tokens of an entity
MARGIN = 2.0
CELLS = 1 << 13
Span = tuple[int, int, int]  # start, kind, end

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a match ends at the end of a run of digits, so it can only start at the start of one
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def is_card(text: str) -> bool:
    digits = _NO_DIGIT.sub("", text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def is_phone(text: str) -> bool:
    return 9 <= len(_NO_DIGIT.sub("", text)) <= 15


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from their at-signs: looking for the local part first would try every
    word, and every letter of a long one."""
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done and (m := _DOMAIN.match(text, at)):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, 0, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by start, then kind."""
    out = list(_emails(text))
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if is_ip(m[0])]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if is_card(m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if is_phone(m[0])]
    return sorted(out)


# the random field

_TRIGGER = re.compile(r"[0-9]{2}|[\[(]at[\])]|[A-Za-z0-9] at [\w. -]{1,40}? dot [a-z]|@", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
_AROUND = 40
_ZONE = 4000  # characters; longer zones are cut at white space


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around triggers, cut at white space."""
    start = end = -1
    for m in _TRIGGER.finditer(text):
        if end < 0 or m.start() - _AROUND > end or end - start > _ZONE:
            if end >= 0:
                yield start, end
            start = max(m.start() - _AROUND, end, 0)
        end = max(end, min(len(text), m.end() + _AROUND))
        while end < len(text) and not text[end].isspace() and end - m.end() < 2 * _AROUND:
            end += 1
    if end >= 0:
        yield start, end


def _shape(tokens: list[str]) -> str:
    return "".join("a" if t[0].isalpha() else f"9{min(len(t), 6)}" if t[0] in "0123456789"
                   else " " if t.isspace() else t for t in tokens)


def _features(tokens: list[str], i: int, j: int) -> list[int]:
    """Cells of the whole span tokens[i:j]."""
    span = tokens[i:j]
    text = "".join(span)
    digits = _NO_DIGIT.sub("", text)
    low = text.lower()
    shape = _shape(span)
    numbers = [t for t in span if t[0] in "0123456789"]
    before = [t for t in tokens[max(0, i - 4):i] if not t.isspace()]
    left = tokens[i - 1] if i else " "
    right = tokens[j] if j < len(tokens) else " "
    names = [
        "one", "s:" + shape, "c:" + re.sub(r"9\d", "9", shape), f"d:{min(len(digits), 20)}",
        f"luhn:{12 <= len(digits) <= 19 and luhn(digits)}:{any(t[0].isalpha() for t in span)}",
        f"four:{len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)}"
        f":{text.count('.')}",
        f"plus:{span[0] == '+'}:{len(digits) >= 9}",
        f"at:{'@' in text or bool(re.search(r'[ (\[]at[ )\]]', low))}"
        f":{'.' in text or ' dot ' in low or '[dot]' in low or '(dot)' in low}"
        f":{bool(re.search(r'[a-z]$', low))}",
        f"letters:{sum(t[0].isalpha() for t in span) if not digits else -1}:{' ' in text}",
        f"gap:{_gaps(span)}:{bool(digits)}",
        f"ends:{low.endswith((' dot', ' at'))}:{low.startswith(('dot ', 'at '))}",
        "l:" + ("a" if left[0].isalnum() else " " if left.isspace() else left),
        "r:" + ("a" if right[0].isalnum() else " " if right.isspace() else right),
        "w:" + (before[-1].lower() if before else ""), f"n:{min(j - i, 21)}",
    ]
    return [xxhash.xxh64_intdigest(n) % CELLS for n in names]


_SIGNS = {"at", "dot", "@", "(", ")", "[", "]", "."}


def _gaps(span: list[str]) -> int:
    """White spaces between plain words, three at most."""
    return min(3, sum(t.isspace() and span[k - 1][0].isalpha() and span[k + 1][0].isalpha()
                      and not {span[k - 1].lower(), span[k + 1].lower()} & _SIGNS
                      for k, t in enumerate(span) if 0 < k < len(span) - 1))


def candidates(tokens: list[str]) -> list[tuple[int, int]]:
    """Spans that may be entities: they start and end in a word, number or sign of a number, hold a
    number or an at-sign, spelt out or not, and no line break."""
    out = []
    signs = [t[0] in "0123456789@" or t.lower() == "at" for t in tokens]
    inner = [t[0].isalnum() for t in tokens]
    for i, first in enumerate(tokens):
        if not (inner[i] or first in "+("):
            continue
        marked = 0
        for j in range(i, min(len(tokens), i + LONGEST)):
            if "\n" in tokens[j]:
                break
            marked += signs[j]
            if marked and inner[j] and not (j == i and len(first) < 4):
                out.append((i, j + 1))
    return out


class Field:
    """Weights by cell and kind; zones are decoded by dynamic programming."""

    def __init__(self, weight: np.ndarray) -> None:
        self.weight = weight

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.save(out, self.weight.astype("float32"))
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Field | None:
        return cls(np.load(io.BytesIO(blob)).astype("float64")) if blob else None

    def decode(self, text: str) -> list[tuple[int, int, int, float]]:
        """(start, kind, end, score) of the best segmentation of a zone."""
        tokens = _TOKEN.findall(text)
        spans = candidates(tokens)
        if not spans:
            return []
        scores = self.weight[np.array([_features(tokens, i, j) for i, j in spans])].sum(axis=1)
        kinds = scores.argmax(axis=1)
        ending: dict[int, list[tuple[int, int, float]]] = {}
        for (i, j), kind, row in zip(spans, kinds.tolist(), scores, strict=True):
            if row[kind] > 0:
                ending.setdefault(j, []).append((i, kind, float(row[kind])))
        best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
        for j in range(1, len(tokens) + 1):
            best[j] = best[j - 1]
            for i, kind, score in ending.get(j, ()):
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, kind, score)
        at = np.r_[0, np.cumsum([len(t) for t in tokens])]
        out, j = [], len(tokens)
        while j > 0:
            if back[j] is None:
                j -= 1
                continue
            i, kind, score = back[j]
            out.append((int(at[i]), kind, int(at[j]), score))
            j = i
        return out[::-1]

    def learn(self, zone: Zone, rate: float, seen: np.ndarray) -> None:
        """One gradient step on the conditional likelihood of a zone's spans."""
        n, i, j = zone.tokens, zone.i, zone.j
        scores = self.weight[zone.cells].sum(axis=1)
        whole = np.logaddexp.reduce(scores, axis=1).tolist()
        ends, starts = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for a, b, w in zip(i.tolist(), j.tolist(), whole, strict=True):
            ends[b].append((a, w))
            starts[a].append((b, w))
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for b in range(1, n + 1):
            ahead[b] = _total([ahead[b - 1], *(ahead[a] + w for a, w in ends[b])])
        for a in range(n - 1, -1, -1):
            behind[a] = _total([behind[a + 1], *(behind[b] + w for b, w in starts[a])])
        around = np.array(ahead)[i] + np.array(behind)[j] - ahead[n]
        wrong = np.exp(around[:, None] + scores) - zone.gold
        hit, place = np.unique(zone.cells, return_inverse=True)
        step = np.zeros((hit.size, len(KINDS)))
        np.add.at(step, place.ravel(), np.repeat(wrong, zone.cells.shape[1], axis=0))
        step += 1e-3 * self.weight[hit]
        seen[hit] += step * step
        self.weight[hit] -= rate * step / np.sqrt(seen[hit])


class Zone:
    """The candidate spans of a zone with their cells, and which of them are entities."""

    def __init__(self, tokens: list[str], gold: set[tuple[int, int, int]]) -> None:
        spans = candidates(tokens)
        spans += sorted({(i, j) for i, j, _ in gold} - set(spans))
        self.tokens = len(tokens)
        self.i, self.j = (np.array(c, "int64") for c in zip(*spans, strict=True))
        self.cells = np.array([_features(tokens, i, j) for i, j in spans])
        self.gold = np.array([[(i, j, k) in gold for k in range(len(KINDS))] for i, j in spans],
                             "float64")


def _total(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def rewritten(kind: int, text: str, rng: random.Random) -> str:
    """The same datum in a form that the patterns miss, or as it stands."""
    digits = _NO_DIGIT.sub("", text)
    if kind == 0:
        if rng.random() < 0.5:
            text = _DIGIT.sub(lambda m: "abcdefghij"[int(m[0])], text)
        at = rng.choice((" at ", " [at] ", "[at]", " (at) ", "(at)", " @ "))
        dot = rng.choice((" dot ", " [dot] ", "[dot]", ".")) if at != " @ " else "."
        return text.replace("@", at).replace(".", dot)
    if kind == 2:
        sign = rng.choice((".", "/", " - ", "  "))
        return sign.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    if kind == 3:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}",
                           f"001 {a} {b} {c}", f"{a} {b} {c}"))
    return text


def harmless(rng: random.Random) -> str:
    """A number that is no personal data."""
    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    while True:
        text = rng.choice((
            digits(rng.randint(2, 12)), f"{digits(1)}.{digits(1)}.{digits(1)}",
            f"{digits(1)}.{digits(2)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}",
            f"1{digits(1)}:{digits(2)}:{digits(2)}", f"{digits(2)},{digits(3)}.{digits(2)}",
            digits(16), f"{digits(4)} {digits(4)}", f"{digits(4)}-{digits(4)}",
            hashlib.sha256(digits(6).encode()).hexdigest()[:rng.randint(12, 40)],
            "AK" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(18)),
            f"{digits(3)}.{digits(3)}.{300 + int(digits(2))}.{digits(2)}",
            f"1{digits(3)}-1{digits(3)}", f"({digits(2)})", f"{digits(3)}-{digits(2)}"))
        if not base_spans(text):
            return text


def examples(text: str, rng: random.Random) -> Iterator[tuple[list[str], set[tuple[int, int, int]]]]:
    """(tokens, gold spans) of a text's zones, as they stand and rewritten."""
    spans = base_spans(text)
    for start, end in zones(text):
        inside = [s for s in spans if start <= s[0] and s[2] <= end]
        for change in (False, True, True):
            parts, gold, at = [], set(), start
            tokens: list[str] = []
            for a, kind, b in inside:
                if a < at:
                    continue  # overlaps the one before
                tokens += _TOKEN.findall(text[at:a])
                if change:
                    tokens += _TOKEN.findall(harmless(rng) + " ")
                span = rewritten(kind, text[a:b], rng) if change else text[a:b]
                parts = _TOKEN.findall(span)
                gold.add((len(tokens), len(tokens) + len(parts), kind))
                tokens += parts
                at = b
            tokens += _TOKEN.findall(text[at:end])
            if change:
                tokens += _TOKEN.findall(" " + harmless(rng))
            if all(j - i <= LONGEST for i, j, _ in gold) and len(tokens) <= 400:
                yield tokens, gold


def fit(texts: list[str], epochs: int = 15, seed: int = 3) -> bytes:
    rng = random.Random(seed)
    rows = [e for t in texts for e in examples(t, rng)]
    if not any(gold for _, gold in rows):
        return b""
    field = Field(np.zeros((CELLS, len(KINDS))))
    field.weight[xxhash.xxh64_intdigest("one") % CELLS] = -2.0
    seen = np.full(field.weight.shape, 1e-2)
    prepared = [Zone(tokens, gold) for tokens, gold in rows if gold or candidates(tokens)]
    for _ in range(epochs):
        rng.shuffle(prepared)
        for zone in prepared:
            field.learn(zone, 0.3, seen)
    return field.dump()


def train(docs: DataFrame, sample: int = 400, text_col: str = "text") -> bytes:
    """A field fitted on zones of the ``sample`` texts of the least hashes among those that may hold
    personal data."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t.as_py() for b in batches for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([fit(sorted(texts))], pa.binary())], ["model"])

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Zones with a span only, so that the sample is small whatever the texts are."""
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = []
                for t in whole.column(0).slice(at, 256):
                    text = t.as_py() or ""
                    out += [text[a - 60 if a > 60 else 0:b + 60] for a, _, b in base_spans(text)[:4]]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["t"])

    may = docs.select(F.col(text_col).cast("string").alias("t")).where(
        F.col("t").rlike(r"[0-9]{3}|@"))
    chosen = (may.mapInArrow(shorten, "t string").distinct()
              .orderBy(F.xxhash64("t"), "t").limit(sample))
    return bytes(chosen.coalesce(1).mapInArrow(run, "model binary").first()["model"])


def find(text: str, field: Field | None) -> tuple[list[Span], list[Span]]:
    """(pattern spans, all spans) by start, then kind."""
    base = base_spans(text)
    added = []
    for start, end in zones(text) if field else ():
        for a, kind, b, score in field.decode(text[start:end]):
            a, b = a + start, b + start
            if kind == 2 and not is_card(text[a:b]):
                continue  # a number without the checksum is no card, whatever stands around it
            if score >= MARGIN and all(b <= s[0] or s[2] <= a for s in base):
                added.append((a, kind, b))
    return base, sorted({*base, *added}) if added else base


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def detect(docs: DataFrame, model: bytes, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; offsets count code
    points, ends are exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 128 KB
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field.load(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                counts: list[list[int]] = [[], [], [], []]
                digests, written = [], []
                for t in batch.column(1):
                    base, spans = find(t.as_py() or "", field)
                    for k, n in enumerate(counts):
                        n.append(sum(s[1] == k for s in base))
                    digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                    written.append(_written(spans))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
                     pa.array(digests), pa.array(written)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
             "spans string")


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data of ``text_col`` replaced by the names of their kinds."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def hide(texts: pa.Array) -> pa.Array:
        field = Field.load(shared.value)
        out = []
        for t in texts:
            text = t.as_py()
            spans = find(text, field)[1] if text else []
            out.append(masked(text, spans) if spans else text)
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, hide(F.col(text_col).cast("string")))
