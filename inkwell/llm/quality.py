"""Quality rules whose cutoffs follow quantile sketches of each language and source.

A sketch is a table of (group, metric, bucket, count). Bucket ``b`` of a value keeps its five leading binary digits, so a quantile
read from a sketch is within one part in sixteen of the exact one, and sketches merge by adding counts: partial aggregation builds
them before the shuffle, sources add up to languages and languages to the corpus.

A rule's cutoff lies a multiple of the distance between a high quantile and the median beyond that quantile, or likewise below a low
one; no value is fixed in advance. Where a group hardly ever has what a rule looks for, its quantile and spread are 0 and any of it is
too much. A group's cutoff is averaged with its language's, by its number of rows against ``PRIOR``, and a language's with the
corpus's; so a group of a few rows leans on its parent, a large one follows itself, and there is no size at which that changes.

Defined results: a null or blank text has no words and all counts 0; a text is measured as a whole however long it is; null ``lang``
or ``source`` is a group of its own; repeated rows each get a row and each count; of ties none matters, as rows are not ranked; an
empty table gives an empty result; further input columns are carried through ``judge`` unless a column of the result has their name,
which then wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.store import bind, cut, write

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Reject a value above ``high + times * (high - median)`` or, with ``low`` set, below ``low - times * (median - low)``.

    ``high`` and ``low`` are percentages: the quantiles of the value's own group.
    """

    metric: str
    high: int
    times: int
    low: int | None = None


#: Values are per thousand, ``length`` is thousandths of a character per word. Signs of damage are judged by the better half of a
#: group, signs that sound documents also show by the group's tail.
RULES = (
    Rule("length", high=90, times=2, low=10),
    Rule("symbols", high=75, times=4),
    Rule("lines", high=99, times=1),
    Rule("repeats", high=99, times=1),
)
#: Rows that the parent's cutoff counts for.
PRIOR = 20
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1)), " "), "")


def _repeated(windows: Column) -> Column:
    """Of the hashes of all three-word windows in order: how many words stand in one that occurs again."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def starts(ranked: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(ranked, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(ranked, j + 1)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ranked, same), lambda e: e["i"]))

    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(bind(bind(ranked, starts), covered))


def measure(text: Column) -> Column:
    """A struct of counts of one text, all in JVM expressions and in linear or sorting time."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        windows = F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.struct(n.cast("long").alias("n_words"), bind(windows, _repeated).cast("long").alias("n_repeat_words"))

    def of_lines(rows: Column) -> Column:
        return F.struct(F.size(rows).cast("long").alias("n_lines"), (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"))

    def of_solid(solid: Column) -> Column:
        n = F.length(solid)
        return F.struct(n.cast("long").alias("word_chars"), (n - F.length(F.translate(solid, SYMBOLS, ""))).cast("long").alias("n_symbols"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    return F.struct(bind(_words(text), of_words).alias("w"), bind(lines, of_lines).alias("l"), bind(F.translate(text, BLANKS, ""), of_solid).alias("c"))


def bucket(value: Column) -> Column:
    """The value with all binary digits after its five leading ones cleared: the least value of its bucket."""
    drop = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def metrics() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * 1000 / F.col(b))).otherwise(0).cast("long")
    return {"length": per("word_chars", "n_words"), "symbols": per("n_symbols", "word_chars"), "lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words")}


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, metric, b, n) over the rows that pass the base rules."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("b")) for k, v in metrics().items()])).alias("s")
    return counted.where(~F.col("base_failed")).select("lang", "source", values).groupBy("lang", "source", "s.metric", "s.b").agg(F.count("*").alias("n"))


def cutoffs(sketch: DataFrame, keys: list[str], rules=RULES) -> DataFrame:
    """One row per group: the number of its rows, and its own cutoffs as ``<metric>_high`` and ``<metric>_low``."""
    merged = sketch.groupBy(*keys, "metric", "b").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("b")), "total": F.sum("n").over(group)})
    at = lambda rule, percent: F.min(F.when((F.col("metric") == rule.metric) & (F.col("upto") * 100 >= F.col("total") * percent), F.col("b")))
    found: dict[str, Column] = {}
    for r in rules:
        found[f"{r.metric}_high"] = at(r, r.high) * (r.times + 1) - at(r, 50) * r.times
        if r.low is not None:
            found[f"{r.metric}_low"] = F.greatest(at(r, r.low) * (r.times + 1) - at(r, 50) * r.times, F.lit(0))
    return ranked.groupBy(*keys).agg(F.max("total").alias("total"), *[v.alias(k) for k, v in found.items()])


def shrunk(sketch: DataFrame, rules=RULES, prior: int = PRIOR) -> DataFrame:
    """(t_lang, t_source, cutoffs): each group's cutoffs, averaged with its language's and the corpus's."""
    named = lambda keys, tag: (t := cutoffs(sketch, keys, rules)).select(*[F.col(c).alias(f"{tag}_{c}") for c in t.columns])
    fine, coarse, whole = named(["lang", "source"], "f"), named(["lang"], "c"), named([], "w")
    # one row of the whole corpus meets one row per group here; documents take no part
    table = fine.join(coarse, F.col("f_lang").eqNullSafe(F.col("c_lang")), "left").join(F.broadcast(whole), F.lit(True), "left")
    wanted = [c for r in rules for c in ([f"{r.metric}_high"] + ([f"{r.metric}_low"] if r.low is not None else []))]
    language = lambda c: F.expr(f"(c_total * c_{c} + {prior} * w_{c}) div (c_total + {prior})")
    table = table.select("*", *[language(c).alias(f"l_{c}") for c in wanted])
    return table.select(F.col("f_lang").alias("t_lang"), F.col("f_source").alias("t_source"), *[F.expr(f"(f_total * f_{c} + {prior} * l_{c}) div (f_total + {prior})").alias(c) for c in wanted])


def judge(docs: DataFrame, rules=RULES, prior: int = PRIOR, label: str = "quality") -> DataFrame:
    """Every row of ``docs`` with its counts, ``base_failed`` and ``kept``; the text itself is not carried.

    The counts are made once and written as a narrow table. Cutoffs have one row per language and source; they are joined back
    by those keys, and Spark picks a broadcast only below its own measured threshold, else a sort-merge join that splits hot groups.
    """
    clash = {"n_words", "n_repeat_words", "n_lines", "n_dup_lines", "word_chars", "n_symbols", "base_failed", "kept", "m", "text"}
    names = {c.lower() for c in clash}
    carried = [c for c in docs.columns if c.lower() not in names and not c.lower().endswith(("_high", "_low"))]
    counted = docs.select(*[F.col(f"`{c}`") for c in carried], measure(F.col("text")).alias("m")).select(*[F.col(f"`{c}`") for c in carried], "m.w.*", "m.l.*", "m.c.*")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    counted = cut(counted.withColumn("base_failed", failed), label)
    sketch = write(sketches(counted), f"{label}-sketch")
    table = cut(shrunk(sketch.frame, rules, prior), f"{label}-cutoffs")
    sketch.drop()
    joined = counted.join(table, counted["lang"].eqNullSafe(table["t_lang"]) & counted["source"].eqNullSafe(table["t_source"]), "left")
    value, bad = metrics(), F.lit(False)
    for r in rules:
        bad = bad | (bucket(value[r.metric]) > F.col(f"{r.metric}_high"))
        if r.low is not None:
            bad = bad | (bucket(value[r.metric]) < F.col(f"{r.metric}_low"))
    return joined.select(*[counted[f"`{c}`"] for c in counted.columns], (~F.col("base_failed") & ~F.coalesce(bad, F.lit(False))).alias("kept"))
