"""Corpus operators against brute force, and on nulls, repeats, empty tables and clashing names."""

import collections
import gzip
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash

import corpus_pipeline
from wirelens.llm import (ann, byte_bpe, html_text, packing, pii, quality, sharding, simhash,
                          toxicity, warc)

DATA = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, score double, "
        "fp long, row string, id long, n_words long, root long")
ODD = ["", None, " \n\t ", "one", "one two", "same text here", "same text here", "a.b@c.de x",
       "word " * 3000, "Ünï cödé 4111 1111 1111 1111 and +1 (425) 555-0735", "x" * 70_000]


def odd_docs(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "same text here"), (None, None), (3, "one")]
    return spark.createDataFrame(
        [(i, t, None if (i or 0) % 2 else "en", "s", 1, 0.5, 9, "r", 7, 8, 6) for i, t in rows], DOCS)


def texts(spark, table="documents", column="text", key="doc_id"):
    rows = spark.read.parquet(f"{DATA}/{table}.parquet").select(key, column).collect()
    return {r[0]: r[1] for r in rows}


def collected(df, key):
    return {r[key]: r for r in df.collect()}


def test_html_extraction(spark):
    pages = texts(spark, "pages", "html", "page_id")
    got = collected(html_text.main_text(spark.read.parquet(f"{DATA}/pages.parquet")), "page_id")
    for i, page in pages.items():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [" ".join(html_text.html.unescape(re.sub(r"<[^>]+>", "", b)).split())
                  for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[i]["text"] == "\n".join(b for b in blocks if b)
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_html_boilerplate_is_left_out():
    page = ("<body><header><h1>Site</h1></header><ul class='menu'><li><a href=x>Home</a></ul><div><h1>"
            "Title &amp; more</h1><p>First   <a href=q>linked</a> words that go on for a while."
            "<p>Second &lt;b&gt; para<div class='ad-box'>Buy now</div><p>and the last one here.</div>"
            "<section id=comments><p>I liked reading all of this very much indeed.</section>"
            "<footer>foot</footer>")
    assert html_text.extract(page, {}) == (
        "Title & more\nFirst linked words that go on for a while.\nSecond <b> para\n"
        "and the last one here.")
    for odd in ("", "<", "<!-- x", "<script>x", "<div " * 999, "<!--" * 999, "<p x='" * 999):
        assert isinstance(html_text.extract(odd, {}), str)


BODY = " ".join(f"word{i}" for i in range(120))
ARTICLE = f"<article><h1>Preface</h1><p>{BODY}</p></article>"


@pytest.mark.parametrize("before", [
    "<select>" + "<option>one" * 300 + "</select>", "<nav><table>" + "<tr><td>menu" * 200 + "</table></nav>",
    "<nav>" + "<span>menu" * 260 + "</nav>", "<dl class=menu>" + "<dt>a<dd>b" * 200 + "</dl>",
    "<form>" + "<label>a <input>" * 300 + "</form>", "<ul class='nav'>" + "<li><b>menu" * 300 + "</ul>"])
def test_html_unclosed_tags_before_the_article(before):
    page = f"<body><div>{before}</div>{ARTICLE}<footer>foot</footer>"
    assert html_text.extract(page, {}) == f"Preface\n{BODY}"


@pytest.mark.parametrize("wrapper", [
    *[f"<div class='{c}'>" for c in (
        "page has-sidebar", "no-sidebar", "share", "related", "search-page", "alert", "with-banner",
        "sidebar-left", "widget legal")], "<form action=x>", "<div id=search-results>",
    "<section class=comments-open><main>"])
@pytest.mark.parametrize("marked", [True, False])
def test_html_wrappers_do_not_hide_the_page(wrapper, marked):
    article = ARTICLE if marked else f"<div><h1>Preface</h1><p>{BODY}</p></div>"
    page = (f"<body>{wrapper}<nav>Home Away</nav>{article}<div class='ad-box'>Buy now</div>"
            "<div class=comments><article>I liked it</article></div></div><footer>foot</footer>")
    assert html_text.extract(page, {}) == f"Preface\n{BODY}"


def test_html_marked_words_inside_the_article():
    page = (f"<article><h2 id='reply-to-critics'>Reply</h2><p class='legal'>{BODY}</p>"
            "<section id=search-methods><p>More of it</section><div class='share'>Share me</div>"
            "<div class='newsletter-box'>Subscribe</div><p hidden>no</p></article>")
    assert html_text.extract(page, {}) == f"Reply\n{BODY}\nMore of it"


def test_html_long_comments_are_no_article():
    talk = "".join(f"<article class=comment><p>{BODY}</p></article>" for _ in range(5))
    page = f"<body>{ARTICLE}<section class='comments'>{talk}</section>"
    assert html_text.extract(page, {}) == f"Preface\n{BODY}"


def test_html_pages_of_the_table_in_wrappers_and_without_marks(spark):
    """Every page as it is, inside a marked wrapper or form, and without its article tag."""
    pages = texts(spark, "pages", "html", "page_id")
    learned = html_text.learn(spark.read.parquet(f"{DATA}/pages.parquet"))
    for page in pages.values():
        want = html_text.extract(page, learned)
        assert want
        inner = re.search(r"<body[^>]*>(.*?)(?:</body>|$)", page, re.S)[1]
        for start, end in (("<div class='page has-sidebar'>", "</div>"), ("<form>", "</form>"),
                           ("<div class='related'>", "</div>")):
            assert html_text.extract(page.replace(inner, start + inner + end), learned) == want
        assert html_text.extract(page.replace("<article>", "<div>").replace(
            "</article>", "</div>"), learned) == want


def test_html_odd_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, 5), (None, None, "<p>a b c", 5), (1, "u", "", 5)],
                                 "page_id long, url string, html string, n_chars int")
    assert sorted(r["text"] for r in html_text.main_text(rows).collect()) == ["", "", "a b c"]
    assert html_text.main_text(rows.where("false")).count() == 0


def test_sharding_law_and_permutation(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    once = sharding.shard(docs, shards=7).collect()
    assert sorted(once) == sorted(sharding.shard(docs.repartition(5), shards=7).collect())
    by_shard = collections.defaultdict(list)
    for r in once:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = [len(s) for s in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1
    held = texts(spark)
    for r in once:
        data = held[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 50, 997])
def test_sharding_walks_whole_cycles(spark, n):
    """Every row has a place of its own for any n, also where the grid is larger than n."""
    rows = sharding.shard(spark.range(n).selectExpr("id % 5 as doc_id", "'x' as text"), 3).collect()
    assert sorted(r["slot"] * 3 + r["shard"] for r in rows) == list(range(n))


def test_sharding_odd_rows(spark):
    docs = odd_docs(spark)
    assert sharding.shard(docs, 4).count() == docs.count()
    assert sharding.shard(docs.where("false"), 4).count() == 0


def test_toxicity_learns_terms_and_pairs():
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(300)]
    rows, toxic = [], []
    for i in range(1200):
        words = list(rng.choice(plain, 30))
        kind = i % 6
        words += {0: ["zork"], 1: ["zork", "grupo"], 2: ["grupo"]}.get(kind, [])
        rows.append(toxicity.cells(" ".join(words).encode()))
        toxic.append(kind == 1)  # an insult only next to the name of a group
    model = toxicity.Machine.load(toxicity.fit(rows, np.array(toxic, "float64"), epochs=30).dump())
    found = model.probability(np.concatenate(rows), np.array([r.size for r in rows])) >= 0.5
    assert (found == np.array(toxic)).mean() > 0.97


def test_toxicity_pairs_of_terms_that_tell_nothing_alone():
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(300)]
    rows, toxic = [], []
    for i in range(2400):  # half of the texts with the insult, with the group and with neither
        kind = i % 8
        words = list(rng.choice(plain, 30)) + ["zork"] * (kind < 4) + ["grup"] * (kind in (0, 1, 4, 5))
        rows.append(toxicity.cells(" ".join(words).encode()))
        toxic.append(kind in (0, 1) or kind > 5)
    toxic = np.array(toxic, "float64")
    pair = [int(toxicity.cells(w)[0]) for w in (b"zork", b"grup")]
    assert [toxic[[c in r for r in rows]].mean() for c in pair] == [toxic.mean()] * 2
    assert not toxicity.telling(rows, toxic, toxic.mean())[pair].any()
    assert toxicity.paired(rows, toxic, toxic.mean())[pair].all()
    model = toxicity.Machine.load(toxicity.fit(rows, toxic.copy(), epochs=30).dump())
    found = model.probability(np.concatenate(rows), np.array([r.size for r in rows])) >= 0.5
    assert (found == (toxic > 0)).mean() > 0.95


def test_toxicity_rare_terms():
    """Labels are balanced, so ten texts of an insult are not five standard errors."""
    rng = np.random.default_rng(1)
    rows, toxic = [], []
    for i in range(1200):
        words = [f"w{j}" for j in rng.integers(0, 300, 15)] + ["zork" if i % 2 else "fine"]
        if i < 20:
            words[-1] = "qux" if i % 2 else "fine"
        rows.append(toxicity.cells(" ".join(words).encode()))
        toxic.append(i % 2)
    model = toxicity.fit(rows, np.array(toxic, "float64"))
    assert model.weight[toxicity.cells(b"qux")[0]] > 0.3


def test_toxicity_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels)
    scores = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(scores) == docs.count()
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    fold = [i for i in known if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(scores[i]["predicted"] == (scores[i]["score"] >= 0.5) for i in scores)
    right = [scores[i]["predicted"] == known[i] for i in fold]
    assert np.mean(right) > 0.9
    # labels of the held-out fold change nothing
    other = labels.withColumn("toxic", toxicity.F.when(
        toxicity.held_out(toxicity.F.col("doc_id")), 1).otherwise(toxicity.F.col("toxic")))
    assert toxicity.train(docs, other) == model


def test_toxicity_odd_rows(spark):
    docs, none = odd_docs(spark), "doc_id long, toxic int"
    model = toxicity.train(docs, spark.createDataFrame([(None, 1), (1, None)], none))
    rows = toxicity.judged(docs, model, docs.columns)
    assert rows.count() == docs.count()
    assert {r["predicted"] for r in rows.select("predicted").collect()} == {0}
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_bpe_equals_the_tokenizer(spark):
    ranks = byte_bpe.read_ranks(open(VOCABULARY, "rb").read())
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                              special_tokens={})
    docs = odd_docs(spark).select("doc_id", "text").union(
        spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id + 100", "text"))
    rows = byte_bpe.decode(byte_bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY)
    want = collections.Counter()
    for r in docs.collect():
        ids = exact.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256((r["text"] or "").encode()).hexdigest(),
             (r["text"] or "").encode()] += 1
    assert want == collections.Counter(
        (r[0], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], bytes(r["decoded"]))
        for r in rows.collect())
    coder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for text in ("a" * 5000, " " * 999 + "x", "é" * 777, "abab" * 900, "\n" * 99, "日本語" * 99):
        assert [i for run in coder.encode(text) for i in run] == exact.encode_ordinary(text)


def packing_lengths():
    return packing.Lengths(byte_bpe.read_ranks(open(VOCABULARY, "rb").read()),
                           public_tokenizers.PATTERN)


def one_size_cost(lengths, size):
    """Best fit into bins of one size, each downsized at the end."""
    bins, _, _ = packing.pack(lengths, (size,))
    used = collections.Counter()
    for n, b in zip(lengths, bins, strict=True):
        used[b] += n
    return sum(packing.cost(min(s for s in packing.SIZES if s >= u)) for u in used.values())


def test_packing_places():
    for lengths in ([], [1], [4096] * 3, [513, 511, 1, 2000, 2096, 4000, 90], [1] * 9000):
        bins, offsets, final = packing.pack(lengths)
        held = collections.defaultdict(list)
        for n, b, o in zip(lengths, bins, offsets, strict=True):
            held[b].append((o, n))
        for b, parts in held.items():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert final[b] == min(s for s in packing.SIZES if s >= at)


def test_packing_fill_equals_plain_greedy():
    rng = random.Random(7)
    for _ in range(300):
        lengths = sorted(rng.choice((1, 2, 3, 7, 50, 51, 400)) for _ in range(rng.randrange(30)))
        gap, free = rng.randrange(600), 0
        free = gap
        for n in reversed(lengths):
            free -= n * (n <= free)
        assert packing.fill(gap, lengths, len(lengths)) == gap - free


def test_packing_chooses_all_sizes_and_beats_one_size(spark):
    lengths = packing_lengths()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    tokens = [n for r in docs.collect() for _, _, n in lengths.pieces(r["text"] or "", 4096)]
    bins, _, final = packing.pack(tokens)
    assert set(final) == set(packing.SIZES)
    total = sum(map(packing.cost, final))
    assert all(total < one_size_cost(tokens, s) for s in packing.SIZES if s >= max(tokens))
    # a bin is opened no larger than what is left can fill
    assert packing.open_size(600, [], 0, 0, packing.SIZES) == 1024
    assert packing.open_size(90, [], 0, 0, packing.SIZES) == 512
    assert packing.open_size(1500, [548] * 9, 9, 4932, packing.SIZES) == 2048


def test_packing_pieces_hold_the_tokens_of_the_text(spark):
    lengths = packing_lengths()
    ranks = byte_bpe.read_ranks(open(VOCABULARY, "rb").read())
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                              special_tokens={})
    odd = ["", " ", "\x1c\x1d a\x85b\u3000c  ", "日本語の文章" * 3000, "x" * 50_000, "😀" * 5000,
           "'s 't ' s\n\n\n  don't", "1,234.5 €99 " * 900, "  \n" * 9000, "word " * 300_000]
    for text in [*odd, *texts(spark).values()]:
        for longest in (16, 4096):
            got = list(lengths.pieces(text or "", longest))
            ids = exact.encode_ordinary(text or "")
            assert sum(n for *_, n in got) == len(ids) + 1
            assert all(0 < n <= longest for *_, n in got)
            assert got[0][0] == 0 and got[-1][1] == len(text or "")
            assert all(a[1] == b[0] for a, b in zip(got, got[1:]))
            if longest == 16 and len(text or "") < 3000:  # each border lies between two tokens
                borders = {0, *itertools.accumulate(len(ranks_of) for ranks_of in map(
                    exact.decode_single_token_bytes, ids))}
                assert all(len(text[:end].encode()) in borders for _, end, _ in got if text)
    assert len(list(lengths.pieces("日本語の文章" * 3000, 4096))) > 1
    spaces = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    assert [c for c in spaces if regex.match(r"\s", c)] == [
        c for c in spaces if re.match(f"[{packing._SPACE}]", c)]


def test_packing(spark):
    docs = odd_docs(spark).unionByName(
        spark.read.parquet(f"{DATA}/documents.parquet"), allowMissingColumns=True)
    rows = packing.best_fit(docs, VOCABULARY, public_tokenizers.PATTERN, sizes=(64, 128)).collect()
    whole = collections.defaultdict(str)
    filled, room = collections.Counter(), {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        if r["doc_id"] is not None and r["doc_id"] > len(ODD):
            whole[r["doc_id"]] += r["text"]
        filled[r["bin_id"]] += r["n_tokens"]
        room[r["bin_id"]] = r["bin_size"]
    assert all(filled[b] <= room[b] for b in room)
    assert all(t == texts_of[i] for texts_of in [texts(spark)] for i, t in whole.items())
    tokens = byte_bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, with_ids=False)
    assert sum(filled.values()) == tokens.selectExpr("sum(n_tokens + 1)").first()[0]
    assert packing.best_fit(docs.where("false"), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_warc_round_trip(spark):
    long = "<p>" + "copy " * 40
    rows = [(i, f"http://x/{i}?q=ä b", h) for i, h in enumerate(
        [long, "short", "short", long, None, "", "z" * 3_000_000])] + [
        (None, None, long), (3, "again", long), (None, None, "only nulls " * 20)]
    pages = spark.createDataFrame([(*r, "c") for r in rows],
                                  "page_id long, url string, html string, digest string")
    got = warc.round_trip(pages).collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = h == long and i != 0
        want.append((i, len(data), hashlib.sha256(data).hexdigest(),
                     "revisit" if revisit else "response", 0 if revisit else None))
    key = str
    assert sorted(((r[0], r[1], r[2], r[3], r[4]) for r in got), key=key) == sorted(want, key=key)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_header_of_any_length(spark):
    rows = [(1, "http://x/" + "\u65e5" * 120_000, "<p>one"), (2, "http://x/b", "<p>two")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collected(warc.round_trip(pages), "page_id")
    assert {i: warc.hashlib.sha256(h.encode()).hexdigest() for i, _, h in rows} == {
        i: r["payload_digest"] for i, r in got.items()}
    archives = spark.createDataFrame([("a", 3)], "archive string, records long")
    with pytest.raises(ValueError, match="2 of 3"):
        warc.whole(spark.createDataFrame([("a",)] * 2, "archive string"), archives)


def test_warc_ranges_own_their_records(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    listed = warc.write(warc.classify(pages), f"file://{tmp_path}/w", archive_bytes=20_000)
    held = texts(spark, "pages", "html", "page_id")
    for size in (97, 5000, 1 << 20):
        rows = warc.read(listed, range_bytes=size, with_payload=True).collect()
        assert sorted(r["page_id"] for r in rows) == sorted(held)
        assert all(bytes(r["payload"]).decode() == held[r["page_id"]]
                   for r in rows if r["record_type"] == "response")
    for path in (tmp_path / "w").glob("*.warc.gz"):
        assert gzip.decompress(path.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_warc_reads_every_range_in_a_task_of_its_own(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    listed = warc.write(warc.classify(pages), f"{tmp_path}/w", archive_bytes=20_000)
    ranges = sum(-(-r["size"] // 5000) for r in listed.collect())
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        read = warc.read(listed, range_bytes=5000)
        assert read.rdd.getNumPartitions() == ranges > 10
        assert all(r["archive"].startswith("file:///") for r in read.select("archive").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "false")


def test_warc_reads_records_of_other_writers(spark, tmp_path):
    def member(fields, block, level=6):
        head = "\r\n".join(["WARC/1.0", *fields, f"content-length:{len(block)}"])
        return gzip.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n", level)

    http = b"HTTP/1.1 200 OK\r\nServer:x\r\n\r\n"
    inner = member(["WARC-Type:response", "Content-Type: application/http", "Page-ID: 9"], http + b"no")
    parts = [
        member(["WARC-Type: warcinfo", "Content-Type: application/warc-fields"], b"software: x\r\n"),
        member(["WARC-Type:response", "CONTENT-TYPE:application/http; msgtype=response", "Page-ID:1",
                "WARC-Payload-Digest: sha1:ABC", "WARC-Target-URI:http://a/"], http + b"<p>one"),
        # a record that holds an archive, stored and not compressed: its members are no records
        member(["WARC-Type: resource", "Page-ID: 2"], b"x" * 3000 + inner + b"y" * 3000, level=0),
        member(["WARC-Type: metadata"], b""),
        member(["WARC-Type: revisit", "Content-Type: application/http", "Page-ID: 3",
                "WARC-Payload-Digest: sha1:ABC"], http)]
    data = b"".join(parts)
    (tmp_path / "other.warc.gz").write_bytes(data)
    listed = spark.createDataFrame([(f"file://{tmp_path}/other.warc.gz", len(data))],
                                   "archive string, size long")
    for size in (100, 4000, 1 << 20):
        got = sorted(map(tuple, warc.read(listed, size, with_payload=True).select(
            "offset", "record_type", "page_id", "payload_bytes", "payload").collect()))
        assert [r[1:4] for r in got] == [("warcinfo", None, 13), ("response", 1, 6),
                                         ("resource", 2, 6000 + len(inner)), ("metadata", None, 0),
                                         ("revisit", 3, 0)]
        assert bytes(got[1][4]) == b"<p>one" and got[4][4] is None


def test_multi_index_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    got = collections.defaultdict(list)
    for r in ann.search(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in (i for i in rows if i % 50 == 0):
        cos = {i: v @ rows[q] / math.sqrt((v @ v) * (rows[q] @ rows[q]))
               for i, v in rows.items() if i != q}
        best = sorted(cos, key=lambda i: (-cos[i], i))[:5]
        hit += len(set(best) & {i for i, _ in got[q]})
        assert all(abs(cos[i] - s) < 1e-12 for i, s in got[q])
    assert hit >= 0.9 * 5 * len(got)


def test_multi_index_odd_rows(spark):
    rows = [(i, [1.0, 2.0, float(i // 10)]) for i in range(1, 40)] + [
        (50, [1.0, 2.0, 3.0]), (100, None), (150, [0.0, 0.0, 0.0]), (200, [1.0, None, 2.0]),
        (250, [1.0, float("nan"), 2.0]), (300, [1.0, float("inf"), 2.0]), (350, [1.0]),
        (None, [1.0, 2.0, 3.0]), (50, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame([(*r, "s") for r in rows],
                                  "vec_id long, embedding array<float>, score string")
    got = ann.search(table).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(50, i) for i in range(30, 35)]
    assert ann.search(table.where("false")).count() == 0


def test_multi_index_ties_go_to_the_least_ids(spark):
    """Seventy distinct vectors at one cosine, also as multiples by powers of two."""
    ids = [i for i in np.random.default_rng(5).permutation(np.arange(1, 72)) if i != 50]
    rows = [(int(i), [1.0 * 2 ** (n % 10)] + [2.0 ** (n % 10) * (n // 10 == j) for j in range(7)])
            for n, i in enumerate(ids)]
    table = spark.createDataFrame([*rows, (50, [1.0] + [0.0] * 7)],
                                  "vec_id long, embedding array<float>")
    got = ann.search(table).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(50, i) for i in range(1, 6)]


def quality_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered), failed)


def test_quality_counts_and_verdicts(spark):
    docs = odd_docs(spark).unionByName(spark.read.parquet(
        "/root/testdata/sf0.01/documents.parquet").where("doc_id >= 100"), allowMissingColumns=True)
    rows = quality.quality(docs, keep=["doc_id", "text", "fp"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r)[3:9] == quality_of(r["text"])
        assert not (r["base_failed"] and r["kept"])
    known = {r[0]: r[1] for r in spark.read.parquet(
        "/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality").collect()}
    clean = [r["kept"] for r in rows if known.get(r["doc_id"]) == 1 and not r["base_failed"]]
    junk = [r["kept"] for r in rows if known.get(r["doc_id"]) == 0]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.05
    assert quality.quality(docs.where("false")).count() == 0


def plain_verdicts(rows, reach=6.0, least=50):
    """The limits of every group from quantiles of its sorted sketch values, and the verdicts."""
    def value(x):
        return 0.0 if x < 1e-9 else 1.02 ** math.ceil(math.log(x) / math.log(1.02)) * 2 / 2.02

    def quartiles(values):
        values = sorted(map(value, values))
        return [values[math.ceil(q * len(values)) - 1] for q in (0.25, 0.75)]

    healthy = [r for r in rows if not r["base_failed"]]
    good = [True] * len(rows)
    for rate, counted in quality.RATES.items():
        at = collections.defaultdict(list)
        for r in healthy:
            for key in ((), (r["lang"],), (r["lang"], r["source"])):
                at[key].append(r[rate])
        spread = {k: quartiles(v) for k, v in at.items()}
        full = sorted(spread[k][1] - spread[k][0] for k, v in at.items()
                      if len(k) == 2 and len(v) >= least)
        usual = full[math.ceil(0.5 * len(full)) - 1] if full else 0.0
        for i, r in enumerate(rows):
            keys = [k for k in ((r["lang"], r["source"]), (r["lang"],), ()) if k in at]
            q1, q3 = spread[next((k for k in keys if len(at[k]) >= least or not k), ())]
            margin = reach * max(q3 - q1, usual)
            if counted is None:
                good[i] &= (q1 - margin) / 1.02 <= r[rate] <= (q3 + margin) * 1.02
            else:
                events, trials, unit = counted
                good[i] &= r[events] <= r[trials] * ((q3 + margin) * 1.02) + reach * unit
    return [g and not r["base_failed"] for g, r in zip(good, rows, strict=True)]


def test_quality_verdicts_equal_plain_sketches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 3 > 0")
    rows = quality.measures(docs).select("row.doc_id", "row.lang", "row.source", "n_words", "n_lines",
                                         "n_symbols", "n_dup_lines", "n_repeat_words", "n_echoes",
                                         "base_failed", *quality.RATES).collect()
    got = {r["doc_id"]: r["kept"] for r in quality.quality(docs, keep=["doc_id"], least=20).collect()}
    want = plain_verdicts([r.asDict() for r in rows], least=20)
    assert got == {r["doc_id"]: w for r, w in zip(rows, want, strict=True)}
    assert 0 < sum(want) < len(want) - sum(r["base_failed"] for r in rows)


def test_quality_milder_junk_in_a_clean_source(spark):
    """Texts a little out of line beside spotless ones; a few events are no offence."""
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]

    def text(i):
        out = list(rng.permutation(words)[:120])
        if i < 10:
            out[::4] = [w + "*" for w in out[::4]]  # a quarter of a symbol a word
        elif i < 20:
            out[1:40:2] = out[0:40:2]  # twenty echoes
        elif i < 30:
            out[5] += "*"
            out[8] = out[7]
        return "\n".join(" ".join(out[j:j + 10]) for j in range(0, 120, 10))

    docs = spark.createDataFrame([(i, text(i), "en", "s") for i in range(310)],
                                 "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(docs, keep=["doc_id"]).collect()}
    assert [i for i in sorted(kept) if not kept[i]] == list(range(20))


def test_quality_sketch_error(spark):
    values = [1.0 + i * 0.37 for i in range(1, 400)]
    rows = spark.createDataFrame([("g", v, v, v, v, v) for v in values],
                                 ["g", *quality.RATES]).repartition(4)
    for r in quality.quartiles(quality.sketch(rows, ["g"]), ["g"]).collect():
        assert abs(r["q1"] / values[len(values) // 4] - 1) < 0.02
        assert abs(r["q3"] / values[3 * len(values) // 4] - 1) < 0.02


def brute_components(fps, bits):
    values = sorted(set(fps))
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {v: top(v) for v in values}


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or (
        [b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


@pytest.mark.parametrize("bits", [2, 4, 5])
def test_simhash_components(spark, bits):
    docs = odd_docs(spark).select("doc_id", "text").union(
        spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id + 100", "text"))
    held = docs.collect()
    fps = [plain_fingerprint(r["text"]) for r in held]
    roots = brute_components(fps, bits)
    least = {}
    for r, f in zip(held, fps, strict=True):
        if r["doc_id"] is not None:
            least[roots[f]] = min(least.get(roots[f], r["doc_id"]), r["doc_id"])
    got = simhash.near_duplicates(docs, max_bits=bits).collect()
    assert collections.Counter((r[0], r[1] % (1 << 64), r[2]) for r in got) == collections.Counter(
        (r["doc_id"], f, least.get(roots[f])) for r, f in zip(held, fps, strict=True))
    stay = simhash.representatives(docs, max_bits=bits).collect()
    assert len(stay) == len(set(roots.values()))
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_simhash_chain_and_dense_group(spark):
    """A chain of links and a dense group hold together, whatever lists their members meet in."""
    chain = [0]
    for b in range(0, 60, 2):
        chain.append(chain[-1] ^ (3 << b))
    dense = [(1 << 63) | (1 << a) | (1 << b) for a in range(12) for b in range(a)]
    fps = sorted({v - (1 << 64) if v >> 63 else v for v in chain + dense})
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(table, 2)).collect()}
    want = brute_components([f % (1 << 64) for f in fps], 2)
    groups = collections.defaultdict(set)
    for f in fps:
        groups[want[f % (1 << 64)]].add(got.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len(set(got.values())) == len(groups)


def test_near_dedup_stage_equals_brute_force(spark):
    """Of each component of fingerprints (three words, two bits) the least id stays."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        base = [f"w{i}" for i in rng.integers(0, 10**6, 150)]
        for edits in (0, 0, 1, 1, 2, 8):  # words in a row
            words, at = list(base), rng.integers(5, 100)
            words[at:at + edits] = [f"e{i}" for i in rng.integers(0, 10**6, edits)]
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \n")]
    docs = spark.createDataFrame(rows + [(None, "same text")], "doc_id long, text string")
    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    want = [rows[r][0] for r in set(root)]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1
    assert 40 < len(want) < len(rows)


def test_pii_patterns():
    found = [(pii.KINDS[k], t[a:b]) for t in (
        "a.b@c.de, x@y z@q.w.v and 1.2.3.4.5 or 300.1.1.1",
        "4111 1111 1111 1111 no 4111111111111112 call +1 (425) 555-0735 now")
        for a, k, b in pii.base_spans(t)]
    assert found == [("email", "a.b@c.de"), ("email", "z@q.w.v"), ("ip", "1.2.3.4"),
                     ("card", "4111 1111 1111 1111"), ("phone", "+1 (425) 555-0735")]
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for t in ("a@b@c.d e@f.g@h.i", "@x.y", "a@b.c.@d.e", "x" * 50_000 + "@" + "y" * 9):
        assert [(a, b) for a, k, b in pii.base_spans(t) if k == 0] == [
            m.span() for m in email.finditer(t[-200:])]


def test_pii_field_adds_and_keeps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs)
    field = pii.Field.load(model)
    base, spans = pii.find("reach us: tel 425-555-0735 or so. Version 2.0 of 2021-05-06", field)
    assert not base and [s[1] for s in spans] == [3]
    rows = pii.detect(docs, model).collect()
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(held)
    for r in rows:
        base = pii.base_spans(held[r["doc_id"]])
        written = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r["spans"].split(","))
    assert sum(len(r["spans"].split(",")) for r in rows if r["spans"]) <= 1.05 * sum(
        r[f"n_{k}"] for r in rows for k in pii.KINDS)


def test_pii_odd_rows(spark):
    docs = odd_docs(spark)
    assert pii.detect(docs, pii.train(docs)).count() == docs.count()
    assert pii.train(docs.where("false")) == b"" and pii.mask(docs.where("false"), b"").count() == 0
    hidden = [r["text"] for r in pii.mask(docs, b"").collect()]
    assert "<EMAIL> x" in hidden and "Ünï cödé <CARD> and <PHONE>" in hidden and None in hidden


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.scratch.table(stage(spark, docs, DATA), "t")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and after.keys() <= before.keys()
        if name == "pii":
            assert after.keys() == before.keys() and not any(map(pii.base_spans, after.values()))
        else:
            assert all(before[i] == t for i, t in after.items())
    packed = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == after.keys()


def test_pipeline_takes_odd_rows(spark):
    docs = odd_docs(spark)
    for part in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, part, DATA).collect()
