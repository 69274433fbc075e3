"""Main text of web pages: the maximum-scoring run of words and tags.

A page is a sequence of words and tags. Words score positive, tags negative; how much depends on the
element a word stands in and on the kind of tag, learned from labelled pages: pages that mark their
content themselves with exactly one ``article`` or ``main`` element. One linear scan finds the
contiguous region of highest total. Words that stand in an element which is never content (menus,
sidebars, footers, forms, scripts, adverts, notices, comments, by element name or by a word of its
class, id or role) score nothing, their tags next to nothing, and are left out of the region's text.
A name is no verdict on what holds the page: a form or an element with such a word counts as a wrapper,
and its word for nothing, if it holds an ``article`` or ``main`` or more than half of the page's words
(a comment section, whose comments may be articles, only if it holds a ``main`` or ``h1``). Words that
tell of a layout (``has-sidebar``) and ids of headings and paragraphs are no such words either.

Nulls: a null html is an empty page. A page without any word outside such elements gives the empty
string; of equally good regions the first and longest is taken. Repeated rows stay repeated; an empty table gives
an empty result. Unclosed tags, comments and attributes end with the page. A very long page is read whole;
its tags and runs of words are held at once. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: names of HTML
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe",
       "object", "canvas", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
        "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details",
         "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
         "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "nav", "ol", "p",
         "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr",
         "ul"}
NEVER = {"nav", "aside", "footer", "form", "button", "select", "option", "datalist", "dialog", "menu",
         "head", "fieldset", "label", "input"}
# words of a class, id or role that name what is never content
MARKS = {"ad", "ads", "adv", "advert", "advertisement", "adbox", "adslot", "banner", "sponsor",
         "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb",
         "breadcrumbs", "sidebar", "sidenav", "aside", "complementary", "footer", "contentinfo",
         "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "cookie",
         "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter",
         "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related",
         "recommended", "recommendations", "widget", "toolbar", "pagination", "pager", "skip",
         "masthead", "search", "alert", "disclaimer", "copyright", "legal"}
CONTENT = ("article", "main")
# marks of reader comments, whose parts may be articles themselves
TALK = {"comment", "comments", "commentlist", "disqus", "respond", "replies", "reply"}
# class names that begin so tell of the layout, not of the element
LAYOUT = {"has", "no", "with", "without", "hide", "show", "is"}
# words that are marks outside of an article only; inside they name a topic
TOPICS = {"legal", "copyright", "disclaimer", "search", "reply", "login", "skip"}
# elements whose id is a place to jump to
PLACES = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "tr", "dt", "dd", "span", "a",
          "section", "figure", "blockquote", "em", "b", "i", "strong", "img"}
# an element of these names ends open ones of the first set, unless one of the second lies between
ENDS = {"option": ({"option"}, {"select", "datalist", "optgroup"}),
        "optgroup": ({"option", "optgroup"}, {"select"}),
        "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}),
        "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
        "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
        "tfoot": ({"tbody", "thead", "tfoot"}, {"table"})}
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""",
                   re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", raw text, ""), ("open" | "close" | "void", name, attributes) in page order."""
    at, n = 0, len(page)
    while at < n:
        to = page.find("<", at)
        if to < 0:
            to = n
        if to > at:
            yield "text", page[at:to], ""
            at = to
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        m = _NAME.match(page, at + 1)
        if not m:
            if page[at + 1:at + 2] in ("!", "?", "/"):
                end = page.find(">", at)
                at = n if end < 0 else end + 1
            else:  # a bare sign
                yield "text", "<", ""
                at += 1
            continue
        end = _tag_end(page, m.end())
        name, closing = m[1].lower(), page[at + 1] == "/"
        attributes = page[m.end():end]
        at = min(end + 1, n)
        if closing:
            yield "close", name, ""
        elif name in VOID:
            yield "void", name, attributes
        elif name in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = n if end < 0 else end + 1
        else:
            yield "open", name, attributes


def _tag_end(page: str, at: int) -> int:
    """Place of the ``>`` that ends a tag; quoted values may hold others."""
    first = page.find(">", at)
    if first < 0:
        return len(page)
    if page.find('"', at, first) < 0 and page.find("'", at, first) < 0:
        return first
    quoted = re.compile(r"""[^"'>]*(?:=\s*(?:"[^"]*"|'[^']*')[^"'>]*)*>""").match(page, at)
    return quoted.end() - 1 if quoted else first


def _marks(name: str, attributes: str, in_content: bool) -> set[str]:
    """Words of the class, id or role that name what is never content; "" if the element is hidden."""
    found: set[str] = set()
    if not attributes or name in ("html", "body") or name in CONTENT:
        return found
    for m in _ATTR.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or kind == "aria-hidden" and value == "true":
            found.add("")
        if kind == "id" and name in PLACES and value.lower() not in MARKS:
            continue
        if kind in ("class", "id", "role"):
            for token in value.split():
                parts = [w.lower() for w in _PART.findall(token)]
                if parts and parts[0] not in LAYOUT:
                    found.update(MARKS.intersection(parts))
    return found - TOPICS if in_content else found


class _Open:
    """Open elements of a page: any can be found by its name in constant time."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool, bool]] = []  # name, number, never content, in content
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, number: int, never: bool, content: bool) -> None:
        depth = len(self.stack)
        self.at.setdefault(name, []).append(depth)
        if name in BLOCK:
            self.blocks.append(depth)
        self.stack.append((name, number, never, content))

    def last(self, names: set[str]) -> int:
        return max((places[-1] for name in names if (places := self.at.get(name))), default=-1)

    def cut(self, depth: int) -> list[tuple[str, int, bool, bool]]:
        gone = self.stack[depth:]
        for name, *_ in gone:
            self.at[name].pop()
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()
        del self.stack[depth:]
        return gone

    def make_room(self, name: str) -> list[tuple[str, int, bool, bool]]:
        """Elements that the start of one of this name ends, as HTML has it."""
        gone = []
        if name in BLOCK and self.blocks and self.stack[self.blocks[-1]][0] == "p":
            gone = self.cut(self.blocks[-1])
        if name in ENDS:
            ended, between = ENDS[name]
            depth = self.last(ended)
            if depth >= 0 and depth > self.last(between):
                gone = self.cut(depth) + gone
        return gone


def _wrappers(events: list[tuple[str, str, str]]) -> set[int]:
    """Numbers of the events that open a marked element or a form which holds the page's content."""
    open_ = _Open()
    marked: dict[int, tuple[bool, int, bool, bool]] = {}  # talk, words before, article, main
    held: dict[int, tuple[bool, int, bool]] = {}
    words = 0
    articles = mains = heads = 0

    def closed(gone: list) -> None:
        for _, number, _, _ in gone:
            if number in marked:
                talk, before, *seen = marked.pop(number)
                inside = mains + heads > seen[1] if talk else articles + mains > seen[0]
                held[number] = (talk, words - before, inside)

    for number, (event, name, attributes) in enumerate(events):
        if event == "text":
            if not (open_.stack and open_.stack[-1][2]):
                words += len(name.split())
        elif event == "close":
            places = open_.at.get(name)
            if places:
                closed(open_.cut(places[-1]))
        elif event == "open":
            closed(open_.make_room(name))
            hard, content = (open_.stack[-1][2], open_.stack[-1][3]) if open_.stack else (False,) * 2
            marks = _marks(name, attributes, content)
            if not hard and "" not in marks and (name == "form" or marks and name not in NEVER):
                marked[number] = (bool(marks & TALK), words, articles + mains, mains + heads)
            articles += name == "article"
            mains += name == "main"
            heads += name == "h1"
            hard = hard or "" in marks or name in NEVER and name != "form"
            open_.push(name, number, hard, content or name in CONTENT)
    closed(open_.cut(0))
    return {number for number, (talk, size, inside) in held.items()
            if inside or not talk and 2 * size > words}


def items(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(kind, text, inside the content element, tag name): kind is ``w:`` and the element of a run of
    words, ``t:`` and a tag, or ``never`` and ``never-tag`` for what is no content wherever it
    stands."""
    events = list(scan(page))
    wrappers = _wrappers(events)
    open_ = _Open()
    for number, (event, name, attributes) in enumerate(events):
        never, content = open_.stack[-1][2:] if open_.stack else (False, False)
        if event == "text":
            if not name.isspace():
                block = open_.blocks[-1] if open_.blocks else -1
                depth = max(block, open_.last({"a"}))
                holder = open_.stack[depth][0] if depth >= 0 else ""
                yield ("never" if never else f"w:{holder}"), name, content, ""
            else:
                yield "space", name, content, ""
        elif event == "close":
            places = open_.at.get(name)
            if places:
                never = open_.stack[places[-1]][2]
                open_.cut(places[-1])
            yield "never-tag" if never else f"t:/{name}", "", content and name not in CONTENT, name
        elif event == "void":
            yield "never-tag" if never else f"t:{name}", "", content, name
        else:
            open_.make_room(name)
            never, content = open_.stack[-1][2:] if open_.stack else (False, False)
            if number not in wrappers:
                never = (never or name in NEVER or name == "header" and not content
                         or bool(_marks(name, attributes, content)))
            open_.push(name, number, never, content or name in CONTENT)
            yield "never-tag" if never else f"t:{name}", "", content, name


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Scores by kind from counts inside and outside of labelled content: words between 0.05 and 1,
    tags between -2 and -0.1, the more negative the more they belong outside."""
    out = {}
    for kind in {k for k, _ in counts}:
        odds = math.log(counts.get((kind, True), 0) + 1) - math.log(counts.get((kind, False), 0) + 1)
        if kind.startswith("w:"):
            out[kind] = min(1.0, max(0.05, 0.5 + odds / 8))
        elif kind.startswith("t:"):
            out[kind] = -min(2.0, max(0.1, 1.0 - odds))
    return out


# scores of kinds that no labelled page shows; a short heading outweighs its tags
WORD, LINK_WORD, TAG, TEXT_TAG, NEVER_TAG = 0.5, 0.05, -0.5, -0.1, -0.1
TEXT_TAGS = {f"t:{slash}{name}" for slash in ("", "/")
             for name in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "em", "b", "i", "strong", "span")}


def _score(learned: dict[str, float], kind: str) -> float:
    if kind.startswith("w:"):
        return learned.get(kind, LINK_WORD if kind == "w:a" else WORD)
    if kind.startswith("t:"):
        return learned.get(kind, TEXT_TAG if kind in TEXT_TAGS else TAG)
    return NEVER_TAG if kind == "never-tag" else 0.0


def extract(page: str, learned: dict[str, float]) -> str:
    """Blocks of the best region, joined by newlines."""
    tokens = list(items(page))
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, text, _, _) in enumerate(tokens):
        gain = _score(learned, kind)
        if kind.startswith("w:"):
            gain *= len(text.split())
        if total <= 0:
            total, start = 0.0, i
        total += gain
        if total > best or total == best > 0 and region[0] == start:
            best, region = total, (start, i + 1)
    blocks, block = [], []
    for kind, text, _, name in tokens[region[0]:region[1]]:
        if kind.startswith("w:") or kind == "space":
            block.append(text)
        elif kind == "never":
            continue
        elif name in BLOCK:
            blocks.append(block)
            block = []
        elif name == "br":
            block.append(" ")
    lines = (" ".join(html.unescape("".join(b)).split()) for b in [*blocks, block])
    return "\n".join(x for x in lines if x)


def count_kinds(page: str) -> Counter:
    """(kind, inside) counts of a labelled page; nothing from pages that do not mark their content."""
    low = page.lower()
    if not any(low.count(f"<{c}") == 1 and f"</{c}" in low for c in CONTENT):
        return Counter()
    out: Counter = Counter()
    for kind, text, inside, _ in items(page):
        if kind.startswith("w:"):
            out[kind, inside] += len(text.split())
        elif kind.startswith("t:"):
            out[kind, inside] += 1
    return out


def learn(pages: DataFrame, sample: int = 2000, html_col: str = "html") -> dict[str, float]:
    """Weights from at most ``sample`` pages, those of the least hashes of their html."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                total += count_kinds(page.as_py() or "")
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in total], pa.string()), pa.array([c for _, c in total], pa.bool_()),
             pa.array(list(total.values()), pa.int64())], ["kind", "inside", "n"])

    marked = pages.select(F.col(html_col).cast("string").alias("h")).where(
        F.lower("h").rlike("<(article|main)[ >]"))
    # the hashes are chosen first, so that no task gathers pages of all others; copies count once
    marked = marked.withColumn("hash", F.xxhash64("h"))
    cut = marked.select("hash").distinct().orderBy("hash").limit(sample).agg(F.max("hash")).first()
    chosen = marked.where(F.col("hash") <= F.lit(cut[0])).dropDuplicates(["hash"])
    # element names are the page authors' own: keep the thousand most frequent kinds
    rows = (chosen.select("h").mapInArrow(run, "kind string, inside boolean, n long")
            .groupBy("kind", "inside").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "kind", "inside").limit(1000).collect())
    return weights({(r["kind"], r["inside"]): r["n"] for r in rows})


def main_text(pages: DataFrame, learned: dict[str, float] | None = None, id_col: str = "page_id",
              url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row, with weights learned from the table itself unless
    given."""
    learned = learn(pages, html_col=html_col) if learned is None else learned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [extract(p.as_py() or "", learned) for p in batch.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                     pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"),
                        F.col(html_col).cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
