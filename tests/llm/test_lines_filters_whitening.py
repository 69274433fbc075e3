"""Line dedup, filter audit and whitening against brute force and on odd tables."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest
from compare import connect, difference
from test_corpus import DATA, collected, odd_docs

from wirelens.llm import filter_audit, line_dedup, whitening

SPACES = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_filter_audit"])
def test_queries_equal_their_sql(spark, name):
    assert difference(spark, connect(DATA), DATA, name) is None


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(-2**63, 2**63 - 1, (2, n))
    perfect = line_dedup.PerfectHash.build(h1, h2)
    assert sorted(perfect.slots(h1, h2)) == list(range(n))
    other = perfect.slots(*rng.integers(-2**63, 2**63 - 1, (2, 100)))
    assert other.max(initial=-1) < n


def plain_lines(rows, min_docs, min_chars):
    """Rows (id, text) without the lines that many documents share, one by one."""
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))

    holders = collections.defaultdict(list)
    for i, text in rows:
        if i is not None:
            for k in {key(x) for x in (text or "").split("\n")}:
                if len(k) >= min_chars:
                    holders[k].append(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < min_docs
                or max(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def dropped(df, **settings):
    found = line_dedup.drop_shared_lines(df, **settings).select(
        "row.doc_id", "kept_text", "n_lines", "n_dropped").collect()
    return sorted(map(tuple, found), key=str)


def test_line_dedup_equals_plain_loop(spark):
    rng = np.random.default_rng(3)
    pool = ["A Shared Line of WORDS", "  a shared line of words\t", "ünï ÜNÏ line of words", "short", "",
            "x" * 5000, "another line with words "]
    rows = [(None if i % 11 == 0 else i % 50, None if i % 13 == 0 else "\n".join(
        list(rng.choice(pool, 4)) + [f"a line of its own {i}"])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for min_docs in (2, 5):
        assert dropped(df, min_docs=min_docs, min_chars=15) == plain_lines(rows, min_docs, 15)


def test_line_dedup_in_many_shards_and_blocks(spark, monkeypatch):
    """Small shards and blocks: one line is in all documents, so its shard has many blocks."""
    monkeypatch.setattr(line_dedup, "_SHARD", 8)
    monkeypatch.setattr(line_dedup, "_BLOCK", 50)
    rows = [(i, f"everywhere\nfound with {i % 70}\nonly with {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = line_dedup.line_hashes(df, 5, "doc_id", "text")
    shards, number = line_dedup.index(hashes)
    assert number == shards.count() == 9  # 71 lines of two documents or more
    assert dropped(df, min_docs=4, min_chars=5) == plain_lines(rows, 4, 5)


def test_line_dedup_odd_rows(spark):
    docs = odd_docs(spark)
    found = line_dedup.drop_shared_lines(docs, min_docs=2, min_chars=3)
    assert found.count() == docs.count()
    assert found.select("row.*").columns == docs.columns
    assert line_dedup.drop_shared_lines(docs.where("false")).count() == 0


def plain_audit(docs, labels):
    """Every order of the filters, applied to the rows one after the other."""
    def fails(i, row):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", row["text"] or "") if w]
        text = row["text"] or ""
        smaller = any((r["text"] or "") == text and r["doc_id"] is not None and row["doc_id"] is not None
                      and r["doc_id"] < row["doc_id"] for r in docs)
        return {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                "D": bool(re.search(r"[#$%&*|]", text)), "E": smaller}

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    judged = [(r["source"] or "", r["doc_id"], fails(i, r)) for i, r in enumerate(docs)]
    out = set()
    for part in {p for p, _, _ in judged}:
        rows = [(i, f) for p, i, f in judged if p == part]
        shapley, steps = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, name in enumerate(order, 1):
                gone = [r for r in left if r[1][name]]
                left = [r for r in left if not r[1][name]]
                shapley[name] += len(gone)
                failing = [r for r in rows if r[1][name]]
                steps.append((name, (
                    part, "".join(order), step, len(left), len(gone), len(failing) - len(gone),
                    sum(sum(r[1].values()) == 1 for r in failing), sum(r[0] in good for r in gone),
                    sum(r[0] in toxic for r in gone))))
        out |= {(*row, shapley[name]) for name, row in steps}
    return out


def test_audit_equals_plain_chain(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "_BLOCK", 20)  # copies are compared in several blocks
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(80)] + ["AB", "C", "a#b", "d|"]
    texts = [None, "", "x" * 20_000] + [" ".join(rng.choice(vocabulary[:rng.integers(5, 84)],
                                                          rng.integers(1, 120))) for _ in range(40)]
    rows = [(None if i % 17 == 0 else i % 60, texts[int(rng.integers(len(texts)))],
             [None, "", "s", "t"][i % 4], i) for i in range(120)]
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 60, 2)]
    labels += [(0, 1, None), (None, 1, 1), (4, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs.repartition(3), table)
    want = plain_audit([r.asDict() for r in docs.collect()], labels)
    assert {tuple(r) for r in got.collect()} == want


def test_audit_survivors_and_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = filter_audit.measured(docs, labels)
    fails = filter_audit.relations(rows)
    audited = filter_audit.audit(docs, labels).where("filter_order = 'DBAEC'").groupBy("step").sum(
        "kept").collect()
    kept = {r[0]: r[1] for r in audited}
    for n in range(1, 6):
        assert filter_audit.survivors(rows, fails, "DBAEC"[:n]).count() == kept[n]
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    assert filter_audit.audit(odd_docs(spark), labels.where("false")).count() == 600


@pytest.mark.parametrize("name", ["random", "repeated", "deficient", "graded", "hit", "zero"])
def test_eigen_against_numpy(name):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    values = {"random": rng.random(24), "repeated": np.repeat([3.0, 2.0, 1.0], 8),
              "deficient": np.r_[np.ones(3), np.zeros(21)], "graded": 10.0 ** -np.arange(24),
              "zero": np.zeros(24)}
    v = np.diag(np.arange(24.0)) if name == "hit" else (q * values[name]) @ q.T
    found, vectors = whitening.eigen(v)
    np.testing.assert_allclose(found, np.sort(np.linalg.eigvalsh(v))[::-1], atol=1e-13 * 24)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(24), atol=1e-13)
    np.testing.assert_allclose(v @ vectors, vectors * found, atol=1e-12)


def test_polar_factor():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    u = whitening.polar(a)
    np.testing.assert_allclose(u @ u, np.eye(12), atol=1e-13)
    values, vectors = np.linalg.eigh(a)
    np.testing.assert_allclose(u, (vectors * np.sign(values)) @ vectors.T, atol=1e-12)


def test_whitening_equals_numpy(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    held = {r["vec_id"]: r["embedding"] for r in df.collect()}
    x = np.floor(64 * np.array(list(held.values()))).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    want = (n * x - total) / n @ axes[:, :32] / np.sqrt(values[:32])
    got = whitening.whiten(df.repartition(3)).collect()
    assert len(got) == 32 * n
    place = {i: at for at, i in enumerate(held)}
    deviation = ((n * x - total) ** 2).sum(axis=1)
    for r in got:
        at, c = place[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[at]
        assert abs(abs(r["whitened"]) - abs(want[at, c])) < 1e-8
        assert abs(r["explained"] - values[c] / values.sum()) < 1e-12
        assert r["identity_error"] < 1e-9


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (None, [0.5, 0.5]), (2, [3.0, 1.0]), (4, None), (5, []),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, n int")
    got = whitening.whiten(df).collect()
    assert collections.Counter(r["vec_id"] for r in got) == {1: 2, 2: 4, None: 2}
    assert all(r["n"] == 4 and r["identity_error"] < 1e-9 for r in got)
    assert whitening.whiten(df.where("false")).count() == 0
    alone = whitening.whiten(df.where("vec_id = 1")).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(0.0, 0.0, 0.0)] * 2
    huge = whitening.whiten(spark.createDataFrame(
        [(i, [(-1.0) ** i * 1e300, float(i)]) for i in range(5)], df.select("vec_id", "embedding").schema))
    assert {r["deviation"] for r in huge.collect()} == {None}


def test_digest_of_the_query_is_that_of_the_kept_text(spark):
    from wirelens.llm import queries

    got = collected(queries.op11_line_dedup(spark, DATA), "doc_id")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    for i, text, lines, gone in plain_lines([tuple(r) for r in docs], 5, 40):
        assert (got[i]["n_lines"], got[i]["n_dropped"]) == (lines, gone)
        assert got[i]["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()
