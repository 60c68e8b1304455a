"""How the test tables stand in for crawl tables. Bindings only; they say nothing about the tables themselves.

Line items are link occurrences (order page to part destination), parts are destinations whose status
follows from their key, labels are verdicts on documents, events are journal and log lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import http

STATUSES = (200, 200, 301, 404, 410, 403, 429, 500, 0, 418)
START = "https://site.example/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def status(key: Column) -> Column:
    """A status that follows from a key."""
    return F.element_at(F.array(*map(F.lit, STATUSES)), (key % 10 + 1).cast("int"))


def error(key: Column) -> Column:
    """An error text where the status is 0."""
    return F.when(status(key) == 0, F.when(key % 20 == 8, "socket timeout").otherwise("ENOTFOUND"))


def kind(key: Column) -> Column:
    return F.when(key % 3 == 0, "external").otherwise("internal")


def url(key: Column) -> Column:
    """A part's url, on one of seven outer hosts if external, else in one of eleven folders."""
    outer = F.format_string("https://ext%d.example.net/p%d", key % 7, key)
    return F.when(key % 3 == 0, outer).otherwise(F.format_string("https://site.example/d%d/p%d", key % 11, key))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_url, pos, target, host, link_class) of all line items."""
    key = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.format_string("https://site.example/o%d", "l_orderkey").alias("page_url"), F.col("l_linenumber").alias("pos"), url(key).alias("target"),
        F.when(key % 3 == 0, F.format_string("ext%d.example.net", key % 7)).otherwise("site.example").alias("host"), kind(key).alias("link_class"),
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, referrer, first_seen) of all line items; the order key ranks pages."""
    rows = table(spark, sf_dir, "lineitem").select(url(F.col("l_partkey")).alias("target"), F.format_string("https://site.example/o%d", "l_orderkey").alias("referrer"), F.struct(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b")).alias("first_seen"))
    return rows.groupBy("target", "referrer").agg(F.min("first_seen").alias("first_seen"))


def outcomes(spark: SparkSession, sf_dir: str, turn: int = 0) -> DataFrame:
    """(url, status, error) of every part; each turn shifts the keys."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(url(key).alias("url"), status(key + 3 * turn).alias("status"), error(key + 3 * turn).alias("error"))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged rows of every part that isn't ok; source is empty for every fifth."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", url(key).alias("url"), kind(key).alias("kind"), http.disposition(status(key), error(key)).alias("disposition"), http.detail(status(key), error(key)).alias("reason"))
    return rows.where(F.col("disposition") != "ok").select("url", "reason", F.when(key % 5 == 0, "").otherwise("https://site.example/s").alias("source"), "kind", "disposition")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, internal, external) of every order page with line items."""
    own = F.col("link_class")
    return links(spark, sf_dir).groupBy(F.col("page_url").alias("url")).agg(F.count_if(own == "internal").alias("internal"), F.count_if(own == "external").alias("external"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, source, kind, disposition, verdict) of every document; labels are verdicts, without label untriaged."""
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    said = F.when(F.col("toxic") == 1, "broken").when(F.col("quality") == 1, "working").otherwise("untriaged")
    rows = docs.select("doc_id", "source").join(marks.select("doc_id", said.alias("verdict")), "doc_id", "left")
    key = F.col("doc_id")
    return rows.select(
        F.format_string("https://%s.example/d%d", "source", "doc_id").alias("url"), "source", kind(key).alias("kind"),
        F.when(key % 4 == 1, "blocked").otherwise("broken").alias("disposition"), F.coalesce("verdict", F.lit("untriaged")).alias("verdict"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal events of all events; every 500th marks a new session."""
    kinds = {"view": "v", "click": "p", "error": "e", "signup": "k", "purchase": "b"}
    key, other = F.col("event_id"), F.col("event_id") % 200
    t = F.when(key % 500 == 0, "r")
    for name, code in kinds.items():
        t = t.when(F.col("event_type") == name, code)
    page = F.col("t") == "p"
    rows = table(spark, sf_dir, "events").select(key.alias("line"), t.alias("t"), F.format_string("https://site.example/u%d", "user_id").alias("u"), (key % 3).cast("int").alias("d"), other.alias("_o"))
    return rows.select(
        "line", "t", "u", "d", F.when(page, 200).cast("int").alias("s"), F.lit("title").alias("ti"), F.lit("image/png").alias("ct"), F.when(F.col("t").isin("e", "b"), "HTTP 404").alias("r"), F.lit(None).cast("string").alias("k"), F.lit("(start)").alias("src"),
        F.when(page, F.array(F.format_string("https://site.example/u%d", "_o"))).alias("in"), F.when(page, F.array(F.array(F.format_string("https://ext.example.net/%d", F.col("_o") % 50), F.lit("ext.example.net")))).alias("ex"), F.lit(None).cast("array<string>").alias("oo"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, value): a progress line for every event."""
    key, u = F.col("event_id"), F.format_string("https://site.example/u%d", "user_id")
    value = (
        F.when(F.col("event_type") == "click", F.format_string("2024-01-01T00:00:00Z OK d1 200 %s int=2 ext=1 extTotal=%d", u, key)).when(F.col("event_type") == "error", F.format_string("2024-01-01T00:00:00Z ERR %s :: HTTP 404 :: found on x", u))
        .when(F.col("event_type") == "purchase", F.format_string("2024-01-01T00:00:00Z BLOCKED %s :: HTTP 403 :: found on x", u)).when(F.col("event_type") == "signup", F.format_string("2024-01-01T00:00:00Z SKIP %s :: image/png", u))
        .otherwise(F.format_string("# extcheck %d/99999 %s HTTP 200 %s", key, F.when(key % 4 == 0, "err").when(key % 4 == 1, "blocked").otherwise("ok"), u))
    )
    return table(spark, sf_dir, "events").select(key.alias("line"), value.alias("value"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, file, app, host, v): twenty state files of all events; every seventh is not a state, every fifth of another host."""
    pos = (F.col("user_id") % 20).alias("pos")
    rows = table(spark, sf_dir, "events").select(pos, F.format_string("%s%d", F.when(F.col("event_id") % 9 == 0, "other:").otherwise("cwfix:h0:"), F.col("event_id") % 300).alias("key"), F.col("event_id"))
    last = rows.groupBy("pos", "key").agg(F.max("event_id").cast("string").alias("value"))
    maps = last.groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("v"))
    return maps.select("pos", F.format_string("f%d", "pos").alias("file"), F.when(F.col("pos") % 7 == 3, "else").otherwise("linkloom-fixes").alias("app"), F.when(F.col("pos") % 5 == 4, "h1").otherwise("h0").alias("host"), "v")
