"""Allowlists: patterns with '*', matched against whole urls, case-sensitively."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.sources.shared import Tables


def to_regex(pattern: str) -> str:
    """An anchored regex of one pattern."""
    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def regex_column(pattern: Column) -> Column:
    """to_regex as a column expression."""
    return F.concat(F.lit("^"), F.array_join(F.transform(F.split(pattern, r"\*"), text.escape_regex), ".*"), F.lit("$"))


def matches(url: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches: exact patterns as a set, the others as one alternation."""
    exact, wild = [p for p in patterns if "*" not in p], [to_regex(p) for p in patterns if "*" in p]
    hit = url.isin(exact) if exact else F.lit(False)
    return hit | url.rlike("|".join(f"(?:{p})" for p in wild)) if wild else hit


def split_active(flagged: DataFrame, patterns: list[str]) -> DataFrame:
    """flagged with ``suppressed``."""
    return flagged.withColumn("suppressed", F.coalesce(matches(F.col("url"), patterns), F.lit(False)))


#: Regexes that one row of a lookup holds.
_TOGETHER = 64
#: Rows of pattern parts up to which each task gets all of them.
_FEW = 10_000
#: Tasks among which the urls of a part that most of them have are dealt for counting.
_DEALT = 16


def _keys(url: Column, lengths: Column) -> Column:
    """The heads, tails and substrings of a url of the given lengths, as (where, part)."""
    cut = lambda x: F.when(x["where"] == "head", F.array(F.left(url, x["n"]))).when(x["where"] == "tail", F.array(F.right(url, x["n"]))).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(url) - x["n"] + 1), lambda at: F.substring(url, at, x["n"])))
    )
    fitting = F.filter(lengths, lambda x: x["n"] <= F.length(url))
    return F.flatten(F.transform(fitting, lambda x: F.transform(cut(x), lambda y: F.struct(x["where"].alias("where"), y.alias("part")))))


def _literals(patterns: DataFrame, column: str) -> DataFrame:
    """(regex, where, part, of): every literal part of the patterns with a wildcard, as head, tail or inner part, and how many its pattern has; a pattern of wildcards alone has the empty inner part."""
    parts, last = F.split(column, r"\*"), F.size(F.split(column, r"\*")) - 1
    placed = F.transform(parts, lambda x, i: F.struct(F.when(i == 0, "head").when(i == last, "tail").otherwise("inner").alias("where"), x.alias("part")))
    named = F.filter(placed, lambda x: x["part"] != "")
    none = F.array(F.struct(F.lit("inner").alias("where"), F.lit("").alias("part")))
    return patterns.where(F.col(column).contains("*")).select(regex_column(F.col(column)).alias("regex"), F.size(named).alias("of"), F.explode(F.when(F.size(named) > 0, named).otherwise(none)).alias("x")).select("regex", "x.*", "of").distinct()


def _looked_up(urls: DataFrame, literals: DataFrame) -> DataFrame:
    """(url, where, part): where each url is looked up. The lengths are one row, of lengths that urls have, some hundreds at most."""
    lengths = literals.select("where", F.length("part").alias("n")).distinct().groupBy().agg(F.collect_list(F.struct("where", "n")).alias("_lengths"))
    return urls.crossJoin(lengths).select("url", F.explode(_keys(F.col("url"), F.col("_lengths"))).alias("x")).select("url", "x.*")


def _to_build(parts: DataFrame, few: bool) -> DataFrame:
    """The side of pattern parts in a join with places of urls, as a hash table: the places are some dozens for each url, and a sort of them takes memory for all of a task's, of one part for all urls."""
    return F.broadcast(parts) if few else parts.hint("shuffle_hash")


def rarest_literals(urls: DataFrame, literals: DataFrame) -> DataFrame:
    """(regex, where, part, urls): of each pattern's literal parts the one that the fewest urls have, all urls counted. A part that no url has rules its pattern out. Patterns of one part have no choice, and null urls."""
    some, one = literals.where("of > 1"), literals.where("of <= 1")
    parts, few = some.select("where", "part").distinct(), some.limit(_FEW + 1).count() <= _FEW
    looked_up, keys = _looked_up(urls, some), ["where", "part"]
    if not few:
        looked_up, keys = looked_up.withColumn("_deal", F.pmod(F.xxhash64("url"), F.lit(_DEALT))), [*keys, "_deal"]
        parts = parts.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_DEALT - 1).cast("long"))))
    counts = looked_up.join(_to_build(parts, few), keys, "left_semi").groupBy("where", "part").agg(F.count(F.lit(1)).alias("urls"))
    counted = some.join(counts, ["where", "part"], "left").withColumn("urls", F.coalesce("urls", F.lit(0)))
    first = F.min(F.struct("urls", (-F.length("part")).alias("_n"), "where", "part"))
    chosen = counted.groupBy("regex").agg(first.alias("x")).select("regex", "x.where", "x.part", "x.urls").where(F.col("urls") > 0)
    return chosen.unionByName(one.select("regex", "where", "part", F.lit(None).cast("long").alias("urls")))


def split_by_table(flagged: DataFrame, patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """As split_active, for a table of patterns of any size.

    Exact patterns join by equality. A wildcard pattern joins by that of its literal parts which
    the fewest urls have: of 10,000 patterns ``https://*/x`` each meets the urls that end in its x, not all.
    Patterns that share their rarest part are matched by lists of regexes, of which the first hit counts.
    """
    tables = Tables(flagged.sparkSession)
    exact = patterns.where(~F.col(column).contains("*")).select(F.col(column).alias("url")).distinct()
    literals = tables.write(_literals(patterns, column), "literals")
    urls = tables.write(flagged.select("url").where(F.col("url").isNotNull()).distinct(), "urls")
    marked = flagged.join(exact.withColumn("_exact", F.lit(True)), "url", "left").withColumn("suppressed", F.col("_exact").isNotNull()).drop("_exact")
    if literals.isEmpty():
        return marked
    rarest = tables.write(rarest_literals(urls, literals), "rarest")
    sizes = rarest.groupBy("where", "part").agg(F.ceil(F.count(F.lit(1)) / _TOGETHER).alias("_lists"))
    listed = rarest.join(sizes, ["where", "part"]).groupBy("where", "part", F.pmod(F.xxhash64("regex"), "_lists").alias("_list"))
    lists = listed.agg(F.collect_list("regex").alias("_regexes"))
    hit = F.exists("_regexes", lambda r: F.rlike(F.col("url"), r))
    few = rarest.limit(_FEW + 1).count() <= _FEW
    hits = _looked_up(urls, rarest).join(_to_build(lists, few), ["where", "part"]).where(hit).select("url").distinct()
    return marked.join(hits.withColumn("_wild", F.lit(True)), "url", "left").withColumn("suppressed", F.col("suppressed") | F.col("_wild").isNotNull()).drop("_wild")


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(pattern) of an allowlist's lines: trimmed, comment lines and inline ' #' comments cut, blanks left out."""
    t = text.trim(F.col(column))
    kept = F.when((t != "") & ~t.startswith("#"), text.trim(F.regexp_extract(t, r"(?s)^(.*?)(?:\s+#.*)?$", 1)))
    return lines.select(kept.alias("pattern")).where(F.col("pattern").isNotNull() & (F.col("pattern") != ""))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(pattern) of an allowlist file."""
    return parse_lines(spark.read.text(path))


def export_lines(flagged: DataFrame, source: str = "source") -> DataFrame:
    """(value): 'url   # reason - found on: source' lines of flagged links."""
    on = F.coalesce(F.nullif(F.col(source), F.lit("")), F.lit("(start)"))
    return flagged.select(F.concat(F.col("url"), F.lit("   # "), F.col("reason"), F.lit(" — found on: "), on).alias("value"))
