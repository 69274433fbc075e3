"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

One table of failing rows is stored per filter. For every filter and every set of filters that may run
before it (a prefix), a left-anti join of its table against those of the prefix gives what it removes,
the left-semi join what the prefix has taken from it already (redundant). Both joins meet on the row
number alone, with the membership in the prefix as a further condition, so all prefixes share one
shuffle of narrow rows. What the steps of an order remove are disjoint sets: the survivors of a prefix
are all rows less these.

Rows are told apart by a number given when they are measured, so repeated rows and null ids count like
any others. Nulls: a null text is empty, a null part is the empty string, a null id has no label and is
neither smaller nor larger than another. Of equal texts all but those of the least id fail E. A row may
have several labels; one of a kind is enough. An empty table gives an empty result. Very long texts are
read whole. Columns of the input other than id, text and part are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.llm import scratch

SPACE = r"[\x20\x09-\x0D]+"
_BLOCK = 1 << 20  # rows of equal texts that are compared in one group


def measured(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             part_col: str = "source") -> DataFrame:
    """(row, id, part, good, toxic, A, B, C, D, h1, h2), stored: the verdicts of the four filters that
    judge a text by itself, two hashes of the text, and the labels."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("words", F.filter(F.split("t", SPACE), lambda w: w != ""))
    rows = rows.select(
        "id", "part", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"),
        (F.size("words") < 50).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 65 * F.size("words")).alias("B"),
        (100 * F.regexp_count("t", F.lit("[A-Z]")) > 5 * F.length("t")).alias("C"),
        F.col("t").rlike(r"[#$%&*|]").alias("D"))
    marks = (labels.select(F.col("doc_id").cast("long").alias("labelled"),
                           (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("x"))
             .where("labelled is not null").groupBy("labelled")
             .agg(F.max("q").alias("good"), F.max("x").alias("toxic")))
    joined = rows.join(marks, rows["id"] == marks["labelled"], "left")
    return scratch.table(joined.select(
        F.monotonically_increasing_id().alias("row"), "id", "part",
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"), "A", "B", "C", "D", "h1", "h2"), "measured")


def later_copies(rows: DataFrame) -> DataFrame:
    """Rows whose text has a row of smaller id. Equal texts are first compared in blocks of bounded
    size, then the least of each block, so that no group of copies grows with the table."""
    blocks = max(1, rows.count() // _BLOCK)
    least = Window.partitionBy("h1", "h2", "block")
    inside = (rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
              .withColumn("later", F.coalesce(F.col("id") > F.min("id").over(least), F.lit(False))))
    left = inside.where("not later").withColumn("later", F.coalesce(
        F.col("id") > F.min("id").over(Window.partitionBy("h1", "h2")), F.lit(False)))
    return inside.where("later").unionByName(left.where("later")).drop("block", "later")


def relations(rows: DataFrame) -> dict[str, DataFrame]:
    """One stored table (row, part, good, toxic) of failing rows per filter."""
    failing = {name: rows.where(name) for name in "ABCD"} | {"E": later_copies(rows)}
    return {name: scratch.table(found.select("row", "part", "good", "toxic"), f"fails-{name}")
            for name, found in failing.items()}


def survivors(rows: DataFrame, fails: Mapping[str, DataFrame], prefix: str) -> DataFrame:
    """The rows that none of the filters named in ``prefix`` removes."""
    for name in prefix:
        rows = rows.join(fails[name].select("row"), "row", "left_anti")
    return rows


def _every(fails: Mapping[str, DataFrame]) -> DataFrame:
    """All failures in one frame; ``bit`` names the filter."""
    out = None
    for i, name in enumerate(sorted(fails)):
        one = fails[name].withColumn("bit", F.lit(1 << i))
        out = one if out is None else out.unionByName(one)
    return out


def removals(fails: Mapping[str, DataFrame]) -> DataFrame:
    """(part, bit, prefix, removed, redundant, good_lost, toxic_lost) of every filter after every
    prefix; combinations without any failure have no row."""
    every = _every(fails)
    candidates = every.repartition("row").withColumn("prefix", F.explode(F.expr(
        f"filter(sequence(0, {(1 << len(fails)) - 1}), p -> (p & bit) = 0)")))
    before = every.select(F.col("row").alias("other"), F.col("bit").alias("its"))
    met = (F.col("row") == F.col("other")) & (F.col("prefix").bitwiseAND(F.col("its")) != 0)
    removed = candidates.join(before, met, "left_anti").withColumn("left", F.lit(1))
    redundant = candidates.join(before, met, "left_semi").withColumn("left", F.lit(0))

    def total(condition: Column) -> Column:
        return F.sum(condition.cast("long"))

    left = F.col("left") == 1
    return removed.unionByName(redundant).groupBy("part", "bit", "prefix").agg(
        total(left).alias("removed"), total(~left).alias("redundant"),
        total(left & F.col("good")).alias("good_lost"),
        total(left & F.col("toxic")).alias("toxic_lost"))


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley) for every part, order of the filters and step."""
    rows = measured(docs, labels, **columns)
    fails = relations(rows)
    names = "".join(sorted(fails))
    counts = F.struct("removed", "redundant", "good_lost", "toxic_lost")
    # at most 80 entries a part
    known = removals(fails).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(
        (F.col("bit") * 64 + F.col("prefix")).alias("key"), counts.alias("value")))).alias("found"))
    parts = rows.groupBy("part").agg(F.count("*").alias("total"))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(names)])

    steps = (parts.join(known, "part", "left").withColumn("filter_order", F.explode(orders))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
             .withColumn("letter", F.expr("substring(filter_order, step, 1)")))
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(1 << i))])
    steps = (steps.withColumn("bit", place[F.col("letter")])
             .withColumn("prefix", F.aggregate(
                 F.expr("slice(split(filter_order, ''), 1, step - 1)"), F.lit(0),
                 lambda a, x: a + place[x])))

    def at(prefix: Column, field: str) -> Column:
        return F.coalesce(F.col("found")[F.col("bit") * 64 + prefix][field], F.lit(0).cast("long"))

    others = F.lit((1 << len(names)) - 1) - F.col("bit")
    shown = steps.select(
        "part", "total", "filter_order", "step", "letter",
        *[at(F.col("prefix"), f).alias(f) for f in ("removed", "redundant")],
        at(others, "removed").alias("unique_fails"),
        *[at(F.col("prefix"), f).alias(f) for f in ("good_lost", "toxic_lost")])
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    return shown.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("removed").over(so_far)).alias("kept"), "removed", "redundant",
        "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley"))


# the same counts from the signature of failures of each row, by part
ORACLE = r"""
WITH marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good,
         coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id),
texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                     lambda w: w <> '') AS words
  FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM texts GROUP BY t),
signed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(words) < 50)::INT
         + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
         + 4 * (100 * length(regexp_replace(x.t, '[^A-Z]', '', 'g')) > 5 * length(x.t))::INT
         + 8 * regexp_matches(x.t, '[#$%&*|]')::INT
         + 16 * coalesce(x.doc_id > first_id, false)::INT AS sig
  FROM texts x JOIN firsts f ON x.t = f.t LEFT JOIN marks m ON x.doc_id = m.doc_id),
cells AS (
  SELECT part, sig, count(*) AS n, count(*) FILTER (good) AS good,
         count(*) FILTER (toxic) AS toxic
  FROM signed GROUP BY part, sig),
totals AS (SELECT part, sum(n) AS total FROM cells GROUP BY part),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, s.step, bits[s.step] AS bit,
         coalesce(list_sum(bits[1:s.step - 1]), 0)::INT AS prefix
  FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
told AS (
  SELECT t.part, filter_order, step::INT AS step, bit, max(total) AS total,
         coalesce(sum(n) FILTER (sig & (bit | prefix) <> 0), 0) AS gone,
         coalesce(sum(n) FILTER (sig & bit <> 0 AND sig & prefix = 0), 0) AS removed,
         coalesce(sum(n) FILTER (sig & bit <> 0 AND sig & prefix <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (sig = bit), 0) AS unique_fails,
         coalesce(sum(c.good) FILTER (sig & bit <> 0 AND sig & prefix = 0), 0) AS good_lost,
         coalesce(sum(c.toxic) FILTER (sig & bit <> 0 AND sig & prefix = 0), 0) AS toxic_lost
  FROM totals t CROSS JOIN steps JOIN cells c ON c.part = t.part
  GROUP BY t.part, filter_order, step, bit)
SELECT part, filter_order, step, (total - gone)::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM told
"""
