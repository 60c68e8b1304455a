"""Readers of the files that crawls and their tools leave, and of pages recorded as parquet."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import schemas, text

PAIR = ["url", "foundOn"]


def corpus(pages: DataFrame, content_type: str = "text/html; charset=utf-8") -> DataFrame:
    """Responses (schemas.RESPONSE) from a table of (url, html), all of status 200."""
    empty = {"retry_after": "string", "doc": "binary", "doc_type": "string", "error": "string"}
    return pages.select("url", F.lit(200).alias("status"), F.lit(content_type).alias("content_type"), "html", *(F.lit(None).cast(k).alias(c) for c, k in empty.items()))


def documents(spark: SparkSession, path: str, max_bytes: int = 25 * 1024 * 1024) -> DataFrame:
    """(url, doc) of files; a longer file is read up to the cap."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), F.substring("content", 1, max_bytes).alias("doc"))


def report(spark: SparkSession, path: str) -> DataFrame:
    """A report JSON, one row; missing parts are null."""
    return spark.read.schema(schemas.REPORT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def combined(spark: SparkSession, path: str) -> DataFrame:
    """A combined report JSON, one row."""
    return spark.read.schema(schemas.COMBINED).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def entities(saved: DataFrame) -> dict[str, DataFrame]:
    """Tables of saved reports: pages, external, out_of_scope, flagged (errors and suppressed ones together, and blocked), refs.

    Kinds default to internal; a flagged link's source is its first referrer.
    """

    def rows(column: str) -> DataFrame:
        return saved.select(F.explode(column).alias("x")).select("x.*")

    def flagged(column: str, disposition: str) -> DataFrame:
        return rows(column).select("url", "reason", F.coalesce(F.get("foundOn", F.lit(0)), F.lit("")).alias("source"), F.coalesce("kind", F.lit("internal")).alias("kind"), F.lit(disposition).alias("disposition"))

    lists = ["externalLinks", "outOfScopeLinks", "errors", "suppressedErrors", "blocked"]
    refs = rows(lists[0]).select(*PAIR)
    for column in lists[1:]:
        refs = refs.unionByName(rows(column).select(*PAIR))
    edges = refs.select(F.col("url").alias("target"), F.posexplode("foundOn").alias("first_seen", "referrer")).groupBy("target", "referrer").agg(F.min("first_seen").alias("first_seen"))
    return {
        "pages": rows("internalPages"),
        "external": rows("externalLinks").select("url", "host", "status"),
        "out_of_scope": rows("outOfScopeLinks").select("url"),
        "flagged": flagged("errors", "broken").unionByName(flagged("suppressedErrors", "broken")).unionByName(flagged("blocked", "blocked")),
        "refs": edges,
    }


def start_host(saved: DataFrame) -> DataFrame:
    """(host): of the first page, else of the first error."""
    first = F.coalesce(F.get("internalPages.url", F.lit(0)), F.get("errors.url", F.lit(0)))
    return saved.select(F.lower(F.regexp_extract(first, schemas.HOST, 1)).alias("host"))


def site_reports(spark: SparkSession, index_path: str) -> tuple[DataFrame, DataFrame]:
    """(reports with their jsonFile, sites whose report is missing) of a combined report; paths are relative to it."""
    sites = combined(spark, index_path).select(F.explode("sites").alias("s")).select("s.url", "s.host", "s.jsonFile")
    folder = posixpath.dirname(index_path)
    files = [r.jsonFile for r in sites.select("jsonFile").where(F.col("jsonFile") != "").distinct().collect()]  # one per site
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    paths = {f: posixpath.join(folder, f) for f in files}
    there = {f: p for f, p in paths.items() if hadoop(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(p))}
    name = F.regexp_replace("_metadata.file_name", "%20", " ")
    if there:
        reports = spark.read.schema(schemas.REPORT).option("multiLine", True).json(list(there.values())).select(name.alias("jsonFile"), "*").where(F.col("crawledAt").isNotNull() | F.col("internalPages").isNotNull())
    else:
        reports = spark.createDataFrame([], f"jsonFile string, {schemas.REPORT}")
    return reports, sites.join(reports.select("jsonFile").distinct(), "jsonFile", "left_anti")


def events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Journal events of text lines; blank, torn and unknown lines are left out. Other columns (line, say) stay."""
    parsed = lines.withColumn("_e", F.from_json(column, schemas.EVENT, {"mode": "PERMISSIVE"})).where(F.col("_e.t").isNotNull())
    return parsed.select(*(c for c in lines.columns if c != column), "_e.*")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): one text file's lines with their places, from its single-file text."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).where(F.col("value") != "")


def journal(spark: SparkSession, path: str) -> DataFrame:
    """Events of a journal file with their lines; an empty or missing text gives no events."""
    return events(numbered(spark, path))


def log_parts(spark: SparkSession, folder: str, stem: str = "crawl-progress", ext: str = ".log") -> DataFrame:
    """(part, line, value) of a log's parts by number, in any order; orderBy(part, line) merges them. The '#META' heads are left out."""
    name = F.regexp_extract("_metadata.file_name", rf"^{re.escape(stem)}\.part(\d+){re.escape(ext)}$", 1)
    whole = spark.read.text(posixpath.join(folder, f"{stem}.part*{ext}"), wholetext=True)
    rows = whole.select(name.cast("int").alias("part"), F.posexplode(F.split("value", "\n")).alias("line", "value")).where(F.col("part").isNotNull())
    return rows.where(~(F.col("value").startswith("#META ") & (F.col("line") == 0)) & (F.col("value") != ""))


def manifest_parts(spark: SparkSession, path: str) -> DataFrame:
    """(part, file, started, bytes, lines) of a log's manifest."""
    saved = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)
    return saved.select(F.explode("parts").alias("p")).select("p.*")


def part_meta(spark: SparkSession, folder: str, stem: str = "crawl-progress", ext: str = ".log") -> DataFrame:
    """(file, meta): the '#META' JSON at the head of each part."""
    rows = spark.read.text(posixpath.join(folder, f"{stem}.part*{ext}")).where(F.col("value").startswith("#META "))
    return rows.select(F.col("_metadata.file_name").alias("file"), F.substring("value", 7, 1 << 30).alias("meta"))


def parse_url_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """(url) of a list's lines; '#' cuts anywhere, blanks are dropped."""
    t = text.trim(F.regexp_replace(column, "#.*$", ""))
    return lines.select(t.alias("url")).where(F.col("url") != "")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a list file."""
    return parse_url_list(spark.read.text(path))


def domain_list(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a domain list: comment lines and inline ' #' comments cut."""
    from linkloom.operators.allowlist import parse_lines

    return parse_lines(spark.read.text(path)).select(F.col("pattern").alias("url"))


def flag(value: Column) -> Column:
    """1, true, yes and on are true."""
    return F.lower(text.trim(value)).isin("1", "true", "yes", "on")


def settings(spark: SparkSession, path: str, known: list[str]) -> DataFrame:
    """(key, value) of a key=value file: comments and unknown keys left out; the last of equal keys wins."""
    return parse_settings(spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")), known)


def parse_settings(rows: DataFrame, known: list[str]) -> DataFrame:
    """(key, value) of (line, value) rows of key=value text."""
    t = text.trim(F.col("value"))
    pairs = rows.where((t != "") & ~t.startswith("#") & t.contains("=")).select("line", text.trim(F.substring_index(t, "=", 1)).alias("key"), text.trim(F.regexp_extract(t, r"(?s)^[^=]*=(.*)$", 1)).alias("value"))
    return pairs.where(F.col("key").isin(known)).groupBy("key").agg(F.max_by("value", "line").alias("value"))


def states(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(pos, file, app, host, v) of state files in the order of the paths; unreadable ones have null app."""
    order = {posixpath.basename(p): i for i, p in enumerate(paths)}
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", schemas.STATE).alias("s"))
    at = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    return whole.select(at[F.col("file")].alias("pos"), "file", "s.app", "s.host", "s.v")


def robots_delay(lines: DataFrame, user_agent: str, by: list[str] | None = None) -> DataFrame:
    """(by..., delay): crawl delay in seconds for an agent, from (by..., line, value) lines of robots.txt.

    Agents in a row share a group. The last group for the agent wins, else the last for '*', else 0; an
    empty agent matches all. Disallow lines are not read.
    """
    from pyspark.sql.window import Window

    by = by or []
    t = text.trim(F.regexp_replace("value", "#.*$", ""))
    pairs = lines.withColumn("_t", t).where(F.col("_t").contains(":"))
    pairs = pairs.select(*by, "line", F.lower(text.trim(F.substring_index("_t", ":", 1))).alias("field"), text.trim(F.regexp_extract("_t", r"(?s)^[^:]*:(.*)$", 1)).alias("value"))
    order = Window.partitionBy(*by).orderBy("line") if by else Window.orderBy("line")  # one file's lines
    agent = F.col("field") == "user-agent"
    starts = agent & ~F.coalesce(F.lag(agent).over(order), F.lit(False))
    rows = pairs.withColumn("group", F.sum(starts.cast("int")).over(order)).where(F.col("group") > 0)
    number = F.regexp_extract("value", r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    delays = rows.where((F.col("field") == "crawl-delay") & (number != "")).groupBy(*by, "group").agg(F.max_by(number.cast("double"), "line").alias("delay"))
    agents = rows.where(agent).select(*by, "group", "line", F.lower("value").alias("agent")).join(delays, [*by, "group"])
    mine = F.lit(user_agent.lower()).contains(F.col("agent")) & (F.col("agent") != "*") if user_agent else F.lit(False)
    picked = agents.groupBy(*by).agg(F.max_by(F.when(mine, F.col("delay")), F.when(mine, F.col("line"))).alias("_own"), F.max_by("delay", F.when(F.col("agent") == "*", F.col("line"))).alias("_star"))
    out = lines.select(*by).distinct().join(picked, by, "left") if by else picked
    return out.select(*by, F.coalesce("_own", "_star", F.lit(0.0)).alias("delay"))
