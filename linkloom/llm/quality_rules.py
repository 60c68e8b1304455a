"""Quality rules with adaptive thresholds, in DataFrame expressions only.

Each text gets counts: words ``[^\\x20\\x09-\\x0D]+``, code points in words, symbols of
``[#*$%&|<>]``, lines with a word that repeat an earlier line, words inside 3-word windows that
occur twice or more. Fixed base rules reject texts of under 50 words or with over half of their
words in repeated windows.

The adaptive part replaces fixed cutoffs. Four ratios (code points, symbols, repeated lines and
repeated words, in thousandths) go into quantile sketches per (lang, source). A sketch is a table
of counts by bucket; buckets are exact up to 32 and then keep the five leading bits, so a quantile
is off by 1/32 at most. Such sketches merge by adding counts: tasks pre-aggregate, a hot source
costs no task more than its distinct buckets, and sketches of a language or of everything are sums
of the same table. A group's distribution is mixed with its language's, which weighs as much as ``GROUP``
texts, and the language's in the same way with that of all texts, so that no size switches a rule over.
Quantiles are those of the mixture. A ratio is an outlier above q75 + ``REACH`` * max(q75 - q50, least spread), or for code points also below q25 -
``REACH`` * max(q50 - q25, least spread). The verdicts come from a join of texts with thresholds. Where most
texts have a ratio of zero, its quartiles are zero and the least spread alone sets its threshold.

Defined cases: null and empty texts have zero counts and fail the base rules; null lang or source
forms a group of its own; repeated rows count each time; long texts are counted whole; an empty
table gives an empty result. Columns that clash with those added here (see ``ADDED``) are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm.store import Tables

WORD, LINE, SYMBOL = r"[^\x20\x09-\x0D]+", r"(?md)^[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D][^\n]*", r"[#*$%&|<>]"
MIN_WORDS, GROUP, REACH = 50, 200, 8
#: Ratios in thousandths: name, numerator, denominator, least spread, whether small values are outliers too.
RATIOS = (
    ("word_chars", "word_chars", "n_words", 200, True),
    ("symbols", "n_symbols", "n_words", 25, False),
    ("dup_lines", "n_dup_lines", "n_lines", 65, False),
    ("repeats", "n_repeat_words", "n_words", 40, False),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
ADDED = (*COUNTS, "base_failed", "outliers", "kept")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(starts: Column) -> Column:
    """Words covered by 3-word windows at these ascending distinct starts."""
    nexts = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.element_at(starts, -1) + 3))
    return F.aggregate(F.zip_with(starts, nexts, lambda a, b: F.least(b - a, F.lit(3).cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc + x)


def _positions_by_text(words: Column) -> Column:
    """Starts of windows found twice or more, by comparing the windows' texts."""
    windows = F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.cast("long").alias("i")))
    same = lambda s, i, d: F.coalesce(F.get(s, i).getField("w") == F.get(s, i + d).getField("w"), F.lit(False))
    return _let(F.array_sort(windows), lambda s: F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x.getField("i").alias("i"), (same(s, i, 1) | same(s, i, -1)).alias("t"))), lambda x: x.getField("t")), lambda x: x.getField("i")))


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more in the text.

    Each window becomes one long, its start in the low bits and a hash above them, so that sorting
    is a primitive sort. Neighbours of equal hash are windows found twice. Should any such
    neighbours differ in text (a collision), the windows' texts are sorted instead: always exact.
    """
    bits = F.ceil(F.log2(F.size(words).cast("double") + 1)).cast("int")

    def from_sorted(s: Column, low: Column) -> Column:
        at = lambda x: x.bitwiseAND(low)
        high = lambda x: x.bitwiseAND(F.bitwise_not(low))
        n = F.size(s)
        twins = F.filter(F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: F.when(high(a) == high(b), F.struct(at(a).alias("a"), at(b).alias("b")))), lambda p: p.isNotNull())
        differ = lambda p, d: F.get(words, (p.getField("a") + d).cast("int")) != F.get(words, (p.getField("b") + d).cast("int"))

        def counted(pairs: Column) -> Column:
            collided = F.exists(pairs, lambda p: differ(p, 0) | differ(p, 1) | differ(p, 2))
            starts = F.when(collided, F.sort_array(_positions_by_text(words))).otherwise(F.sort_array(F.array_distinct(F.concat(F.transform(pairs, lambda p: p.getField("a")), F.transform(pairs, lambda p: p.getField("b"))))))
            return F.when(F.size(pairs) == 0, F.lit(0).cast("long")).otherwise(_let(starts, _covered))

        return _let(twins, counted)

    def packed(low: Column) -> Column:
        return F.sort_array(F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))

    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(low, lambda b: _let(packed(b), lambda s: from_sorted(s, b))))


def with_counts(docs: DataFrame, text_col: str = "text", carry_text: bool = True) -> DataFrame:
    """docs with the six counts of ``COUNTS`` as long columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words, lines = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.regexp_extract_all(text, F.lit(LINE), F.lit(0))
    whole = F.struct(
        F.size(words).cast("long").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        _let(words, _repeat_words).alias("n_repeat_words"),
    )
    kept = [c for c in docs.columns if c not in ADDED and (carry_text or c != text_col)]
    counted = docs.select(*kept, F.explode(F.array(whole)).alias("_counts"))  # explode keeps the counts from being computed once for each use
    of = {"n_lines": "lines.n", "n_dup_lines": "lines.dup"}
    return counted.select(*kept, *(F.col(f"_counts.{of.get(c, c)}").alias(c) for c in COUNTS))


def _ratio(top: str, under: str) -> Column:
    return F.floor(1000 * F.col(top) / F.greatest(F.col(under), F.lit(1))).cast("long")


def bucket(value: Column) -> Column:
    """The lower end of a value's bucket: the value itself up to 32, then its five leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): the mergeable sketches of texts that pass the base rules."""
    each = F.array(*(F.struct(F.lit(name).alias("ratio"), bucket(_ratio(top, under)).alias("bucket")) for name, top, under, *_ in RATIOS))
    rows = counted.where(~F.col("base_failed")).select("lang", "source", F.explode(each).alias("r"))
    return rows.groupBy("lang", "source", F.col("r.ratio").alias("ratio"), F.col("r.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _mixed(sketch: DataFrame) -> DataFrame:
    """(lang, source, ratio, q25, q50, q75) of every group, from its sketch mixed with its language's and that of all texts.

    A row is made for each group and bucket in use, some hundred to a ratio.
    """
    total = lambda by: Window.partitionBy(*by)
    until = lambda by: total(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = sketch.groupBy("ratio", "bucket").agg(F.sum("n").alias("n"))
    whole = whole.select("ratio", "bucket", F.sum("n").over(until(["ratio"])).alias("a_c"), F.sum("n").over(total(["ratio"])).alias("a_n"))
    named = lambda df, by: df.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n")).select(*(F.col(c).alias(f"_{c}") for c in (*by, "ratio", "bucket")), "n")
    grid = sketch.select("lang", "source", "ratio").distinct().join(whole, "ratio")
    for by, to in ((["lang", "source"], "g"), (["lang"], "l")):
        part = named(sketch, by)
        same = (grid.ratio == part._ratio) & (grid.bucket == part._bucket)
        for c in by:
            same &= grid[c].eqNullSafe(part[f"_{c}"])
        grid = grid.join(part, same, "left").select(*grid.columns, F.coalesce("n", F.lit(0)).alias(f"{to}_x"))
    key = ["lang", "source", "ratio"]
    grid = grid.withColumns({f"{to}_{s}": F.sum(f"{to}_x").over(w(key)) for to in ("g", "l") for s, w in (("c", until), ("n", total))})
    parent = (F.col("l_c") + GROUP * (F.col("a_c") / F.col("a_n"))) / (F.col("l_n") + GROUP)
    mixed = grid.withColumn("f", (F.col("g_c") + GROUP * parent) / (F.col("g_n") + GROUP))
    return mixed.groupBy(*key).agg(*(F.min(F.when(F.col("f") >= q, F.col("bucket"))).alias(f"q{round(100 * q)}") for q in (0.25, 0.5, 0.75)))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, <ratio>_low, <ratio>_high) for every group."""
    rows = _mixed(sketch)
    least = reduce(lambda acc, r: acc.when(F.col("ratio") == r[0], r[3]), RATIOS[1:], F.when(F.col("ratio") == RATIOS[0][0], RATIOS[0][3]))
    ends = rows.select("lang", "source", "ratio", (F.col("q25") - REACH * F.greatest(F.col("q50") - F.col("q25"), least)).alias("low"), (F.col("q75") + REACH * F.greatest(F.col("q75") - F.col("q50"), least)).alias("high"))
    return ends.groupBy("lang", "source").agg(*(F.max(F.when(F.col("ratio") == name, F.col(end))).alias(f"{name}_{end}") for name, *_ in RATIOS for end in ("low", "high")))


def quality_rules(docs: DataFrame, text_col: str = "text", carry_text: bool = True) -> DataFrame:
    """Every row of docs with its counts, base_failed, outliers (names of ratios out of range) and kept; without carry_text the text is left out, and so not written in between."""
    tables = Tables(docs.sparkSession)
    few = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = tables.write(with_counts(docs, text_col, carry_text).withColumn("base_failed", few), "counted")
    ends = tables.write(thresholds(tables.write(sketches(counted), "sketches")).withColumnsRenamed({"lang": "_lang", "source": "_source"}), "thresholds")
    joined = counted.join(ends, counted.lang.eqNullSafe(ends._lang) & counted.source.eqNullSafe(ends._source), "left")
    out = [F.when((_ratio(top, under) > F.col(f"{name}_high")) | (F.lit(both) & (_ratio(top, under) < F.col(f"{name}_low"))), F.lit(name)) for name, top, under, _, both in RATIOS]
    judged = joined.select(*counted.columns, F.array_compact(F.array(*out)).alias("outliers"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("outliers") == 0))
