"""Quality rules with thresholds that adapt to each language and source.

Five rates are taken from every text: symbols per word, characters per word, the shares of repeated
lines, of repeated words and of words that echo the one before. Their values are counted in logarithmic
cells of one per cent width (a DDSketch): such sketches are mergeable counts with a proven relative
error, so a source's sketch, its language's and the whole corpus's come from the same counts. The limit
of a rate lies ``reach`` interquartile ranges beyond the quartile of its group; a group that is more
uniform than the median group is taken to spread like that one. Groups of fewer than ``least`` texts
use the sketch of their language, and languages of fewer the one of the corpus. The limits are joined
back to the texts, and four of them are held against counts: a text is out of line when it has more
than ``reach`` events (symbols, repeated lines, repeated windows, echoes) over what the limit gives a
text of its length, so that a few events in a short text of a spotless source are no offence.

Nulls: a null text has no words and fails the base rules; a null language or source is a group of its
own. Repeated rows count as often as they occur. An empty table gives an empty result. Very long texts
are read whole. Columns of the input never mix with the operator's own: the row travels in one struct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.llm import scratch

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
# events of a rate, what they are counted against, and how many one incident makes: a repeated window
# repeats 2 * WINDOW words. The length of words has no events; it is held against both limits.
RATES = {"symbol_rate": ("n_symbols", "n_words", 1), "word_length": None,
         "dup_line_rate": ("n_dup_lines", "n_lines", 1),
         "repeat_rate": ("n_repeat_words", "n_words", 2 * WINDOW),
         "echo_rate": ("n_echoes", "n_words", 1)}
_GAMMA = 1.02


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def repeat_words(hashes: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of ``size`` words found twice or more, first ones included."""
    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(
            h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, j: (
            x["h"].eqNullSafe(F.get(s, j - 1)["h"]) | x["h"].eqNullSafe(F.get(s, j + 1)["h"]))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
        return F.aggregate(starts, start, lambda a, x: F.struct(
            (a["n"] + F.least(F.lit(size), x - a["last"])).alias("n"), x.alias("last")),
            lambda a: a["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - size),
                          lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
    found = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w))
                .otherwise(0))
    return F.when(F.size(hashes) >= size, found).otherwise(0).cast("long")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` as struct ``row`` with the counts of its text, ``base_failed`` and the rates."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("t"))
    split = split.withColumn("words", F.filter(F.split("t", SPACE), lambda w: w != ""))
    split = split.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = split.select(
        "row", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(
            F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))
            ).alias("lines"),
        repeat_words(F.col("hashes")).alias("n_repeat_words"),
        F.size(F.filter("hashes", lambda h, i: h.eqNullSafe(F.get("hashes", i - 1)))).alias("echoes"))
    words = F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        "row", "n_words", "word_chars", "n_symbols",
        F.col("lines.dup").cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.col("lines.n").cast("long").alias("n_lines"), F.col("echoes").cast("long").alias("n_echoes"),
        ((F.col("n_words") < 20)
         | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / words).alias("symbol_rate"),
        (F.col("word_chars") / words).alias("word_length"),
        (F.col("lines.dup") / F.greatest(F.col("lines.n"), F.lit(1))).alias("dup_line_rate"),
        (F.col("n_repeat_words") / words).alias("repeat_rate"),
        (F.col("echoes") / words).alias("echo_rate"))


def sketch(values: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, rate, cell, held): counts of the logarithmic cells of every rate."""
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).alias("value"))
                                for r in RATES]))
    cell = F.when(F.col("r.value") < 1e-9, F.lit(-2000)).otherwise(
        F.ceil(F.log(F.col("r.value")) / F.log(F.lit(_GAMMA)))).cast("int")
    return (values.select(*groups, rates.alias("r"))
            .groupBy(*groups, F.col("r.rate").alias("rate"), cell.alias("cell"))
            .agg(F.count("*").alias("held")))


def quartiles(cells: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, rate, n, q1, q3) of a sketch, read to one per cent."""
    merged = cells.groupBy(*groups, "rate", "cell").agg(F.sum("held").alias("held"))
    key = [*groups, "rate"]
    upto = Window.partitionBy(*key).orderBy("cell")
    value = F.when(F.col("cell") <= -2000, 0.0).otherwise(
        F.pow(F.lit(_GAMMA), F.col("cell")) * 2 / (1 + _GAMMA))

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("value")))

    return (merged.withColumn("upto", F.sum("held").over(upto))
            .withColumn("n", F.sum("held").over(Window.partitionBy(*key)))
            .withColumn("value", value).groupBy(*key)
            .agg(F.max("n").alias("n"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3")))


def thresholds(cells: DataFrame, groups: list[str], reach: float, least: int) -> DataFrame:
    """(groups, limits): one row per finest group with the low and high limit of every rate."""
    out = None
    for depth in range(len(groups), -1, -1):
        part = quartiles(cells, groups[:depth]).withColumnsRenamed(
            {"n": f"n{depth}", "q1": f"q1_{depth}", "q3": f"q3_{depth}"})
        if out is None:
            out = part
        else:
            same = [out[g].eqNullSafe(part[g]) for g in groups[:depth]] + [
                out["rate"] == part["rate"]]
            out = out.join(part, same).select(*[out[c] for c in out.columns],
                                              *part.columns[depth + 1:])

    def chosen(name: str) -> Column:
        options = [F.when(F.col(f"n{d}") >= least, F.col(f"{name}_{d}"))
                   for d in range(len(groups), 0, -1)]
        return F.coalesce(*options, F.col(f"{name}_0"))

    q1, q3 = chosen("q1"), chosen("q3")
    # one row per rate; a group more uniform than the median one has the spread of that one
    finest = len(groups)
    usual = out.groupBy("rate").agg(F.coalesce(F.percentile_approx(
        F.when(F.col(f"n{finest}") >= least, F.col(f"q3_{finest}") - F.col(f"q1_{finest}")), 0.5),
        F.lit(0.0)).alias("usual"))
    margin = reach * F.greatest(q3 - q1, F.col("usual"))
    # a cell's width further out, which is how exact the sketch is
    limits = out.join(F.broadcast(usual), "rate").select(
        *groups, "rate", F.struct(((q1 - margin) / _GAMMA).alias("low"),
                                  ((q3 + margin) * _GAMMA).alias("high")).alias("limit"))
    return limits.groupBy(*groups).agg(*[
        F.max(F.when(F.col("rate") == r, F.col("limit"))).alias(r) for r in RATES])


def in_line(reach: float) -> Column:
    """Whether the counts and rates of a text keep to the ``limits`` beside them."""
    good = F.lit(True)
    for rate, counted in RATES.items():
        low, high = F.col(f"limits.{rate}.low"), F.col(f"limits.{rate}.high")
        if counted is None:
            good = good & F.col(rate).between(low, high)
        else:
            events, trials, unit = counted
            good = good & (F.col(events) <= F.col(trials) * high + reach * unit)
    return good


def judged(docs: DataFrame, reach: float = 6.0, least: int = 50, text_col: str = "text",
            groups: tuple[str, ...] = ("lang", "source"),
            keep: list[str] | None = None) -> DataFrame:
    """(row, counts, base_failed, kept): ``row`` holds the columns ``keep`` of the input (all by
    default), so that none can clash. The measured rows are stored once, for the sketches and for the verdict."""
    keep = docs.columns if keep is None else keep
    names = [f"g{i}" for i in range(len(groups))]
    inner = docs.select(*dict.fromkeys([*keep, *groups, text_col]))
    rows = measures(inner, text_col)
    rows = rows.select(
        F.struct(*[F.col("row")[c].alias(c) for c in keep]).alias("row"),
        *[F.col("row")[g].cast("string").alias(n) for g, n in zip(groups, names, strict=True)],
        *rows.columns[1:])
    rows = scratch.table(rows, "measured")
    healthy = rows.where("not base_failed")
    limits = scratch.table(
        thresholds(scratch.table(sketch(healthy, names), "sketch"), names, reach, least), "limits")
    joined = rows.alias("r").join(
        limits.select(*names, F.struct(*RATES).alias("limits")).alias("l"),
        [F.col(f"r.{n}").eqNullSafe(F.col(f"l.{n}")) for n in names], "left")
    return joined.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), False).otherwise(F.coalesce(in_line(reach), F.lit(True))).alias("kept"))


def quality(docs: DataFrame, keep: list[str] | None = None, **settings: object) -> DataFrame:
    """Every row with the columns ``keep``, its counts, ``base_failed`` and ``kept``."""
    found = judged(docs, keep=keep, **settings)
    return found.select("row.*", *found.columns[1:])
