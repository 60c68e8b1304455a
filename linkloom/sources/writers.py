"""Writers of reports, logs, journals, allowlists and state files.

Files that are replaced are written beside and renamed, so that a reader sees the old or the new one.
"""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import urls
from linkloom.operators import allowlist, classify, measures
from linkloom.operators.running import next_value, running_sum
from linkloom.plans.config import CrawlConfig, effective
from linkloom.sources import exports
from linkloom.sources.shared import Tables


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_file(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One text file of a value column: written beside as one part, then renamed over the old file."""
    spark = rows.sparkSession
    beside = posixpath.join(posixpath.dirname(path), f".{uuid.uuid4().hex}")
    (rows.orderBy(*order) if order else rows).select("value").coalesce(1).write.text(beside)
    folder, fs = _fs(spark, beside)
    part = next(str(s.getPath()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    target, _ = _fs(spark, path)
    fs.delete(target, False)
    if not fs.rename(_fs(spark, part)[0], target):
        raise OSError(f"{path} could not be replaced")
    fs.delete(folder, True)


def backup_once(spark: SparkSession, path: str) -> None:
    """A '.bak' copy of a file unless there is one."""
    source, fs = _fs(spark, path)
    copy, _ = _fs(spark, path + ".bak")
    if not fs.exists(copy):
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, copy, False, spark._jsc.hadoopConfiguration())


def found_on(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """rows with foundOn: all referrers, else the source, else none."""
    own = F.when(F.coalesce("source", F.lit("")) != "", F.array("source")).otherwise(F.array().cast("array<string>")) if "source" in rows.columns else F.array().cast("array<string>")
    return rows.join(lists, rows.url == lists.target, "left").withColumn("foundOn", F.coalesce("found_on", own)).drop("target", "found_on")


def report_json(tables: dict[str, DataFrame], config: CrawlConfig, crawled_at: str, partial: bool = False, queued: int = 0, retries: int = 0, runtime_ms: int = 0, settings: dict | None = None, known: bool = True, log: dict | None = None) -> DataFrame:
    """(value): a report's JSON in one row.

    tables are pages, external, out_of_scope, flagged (with suppressed) and refs. A report is one document,
    so its lists are collected into one row; larger crawls are kept as tables instead (see ``write_tables``).
    """
    flagged = Tables(tables["flagged"].sparkSession).write(tables["flagged"], "flagged")
    lists = classify.referrer_lists(tables["refs"])
    whole = measures.summary(tables["pages"], tables["external"], tables["out_of_scope"], flagged, tables["refs"], queued, retries, runtime_ms)
    parts = [whole.select(F.struct(*whole.columns).alias("summary"))]

    def gather(rows: DataFrame, columns: list[str], name: str, order: list[str]) -> None:
        items = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("_o"), F.struct(*columns).alias("x"))))
        parts.append(rows.agg(F.transform(items, lambda i: i["x"]).alias(name)))

    gather(tables["pages"], ["url", "title", "status", "depth", "internal", "external"], "internalPages", ["depth", "url"])
    gather(found_on(tables["external"], lists), ["url", "host", "status", "foundOn"], "externalLinks", ["url"])
    gather(found_on(tables["out_of_scope"], lists), ["url", "foundOn"], "outOfScopeLinks", ["url"])
    listed = found_on(flagged.withColumn("kind", F.coalesce("kind", F.lit("internal"))), lists)
    broken = F.col("disposition") == "broken"
    for name, rows in (("errors", listed.where(broken & ~F.col("suppressed"))), ("suppressedErrors", listed.where(broken & F.col("suppressed"))), ("blocked", listed.where(~broken))):
        gather(rows, ["url", "reason", "kind", "foundOn"], name, ["url", "reason"])
    row = parts[0]
    for one in parts[1:]:
        row = row.crossJoin(one)  # one row each
    head = {"crawledAt": F.lit(crawled_at), "partial": F.lit(partial), "scope": F.lit(config.prefix() or "(whole domain)")}
    if known:
        head["settings"] = F.parse_json(F.lit(json.dumps(effective(settings, config))))
    head["log"] = F.parse_json(F.lit(json.dumps(log or {"manifest": "", "singleFile": not config.log_max_bytes, "parts": []})))
    return row.select(F.to_json(F.struct(*(c.alias(n) for n, c in head.items()), *row.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """The same state as parquet tables, for crawls of any size."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(posixpath.join(folder, name))


def combined_json(sites: DataFrame, crawled_at: str) -> DataFrame:
    """(value): the JSON of several sites (url, host, status, reportFile, jsonFile, summary, errors, blocked); unstarted ones are queued."""
    rows = sites.withColumn("status", F.coalesce("status", F.lit("queued")))
    items = F.sort_array(F.collect_list(F.struct(F.col("index"), F.struct("url", "host", "status", "reportFile", "jsonFile", "summary", "errors", "blocked").alias("x"))))
    return rows.agg(F.to_json(F.struct(F.lit(crawled_at).alias("crawledAt"), F.transform(items, lambda i: i["x"]).alias("sites"))).alias("value"))


def browser_json(pages: DataFrame, external: DataFrame, errors: DataFrame, lists: DataFrame) -> DataFrame:
    """(value): the smaller JSON of summary, pages, externals with foundOn, and errors."""
    gather = lambda rows, cols, name: rows.agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    row = gather(pages, ["url", "title", "status", "depth", "internal", "external"], "pages").crossJoin(gather(found_on(external, lists), ["url", "host", "foundOn"], "externals")).crossJoin(gather(errors, ["url", "reason", "source"], "errors"))
    counts = F.struct(*(F.size(c).alias(c) for c in ("pages", "externals", "errors"))).alias("summary")
    return row.select(F.to_json(F.struct(counts, *row.columns)).alias("value"))


def verdicts_json(verdicts: DataFrame, rendered_at: str, driver: str, source: str) -> DataFrame:
    """(value): rendering verdicts with their counts."""
    counts = F.struct(*(F.count_if(F.col("disposition") == d).alias(d) for d in ("ok", "broken", "blocked")))
    items = F.sort_array(F.collect_list(F.struct("url", "kind", "was", "status", "disposition", "note", "title", "finalUrl")))
    row = verdicts.agg(F.count(F.lit(1)).alias("total"), counts.alias("summary"), items.alias("results"))
    return row.select(F.to_json(F.struct(F.lit(rendered_at).alias("renderedAt"), F.lit(driver).alias("driver"), F.lit(source).alias("source"), "total", "summary", "results")).alias("value"))


def state_json(rows: DataFrame, host: str, app: str) -> DataFrame:
    """(value): (key, value) rows as a state file."""
    items = F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value"))))
    return rows.agg(F.to_json(F.struct(F.lit(app).alias("app"), F.lit(host).alias("host"), items.alias("v"))).alias("value"))


def append_journal(events: DataFrame, folder: str) -> None:
    """Events as JSON lines, appended as new files; null fields are left out."""
    events.write.mode("append").option("ignoreNullFields", True).json(folder)


def split_log(lines: DataFrame, max_bytes: int, head_bytes: int = 0) -> DataFrame:
    """(part, line, value) of (line, value) rows: a line begins a new part when it would pass max_bytes.

    Running sums give each line the bytes before and after it, and so the line that would begin the next
    part if a part began here. From the first line on these pointers are followed by doubling: each round
    joins twice as long jumps, so rounds number the logarithm of the parts.
    """
    if max_bytes <= 0:
        return lines.select(F.lit(1).alias("part"), "line", "value")
    tables = Tables(lines.sparkSession)
    sized = running_sum(lines.select("line", "value"), F.octet_length("value") + 1, "end")
    sized = tables.write(sized.withColumn("full", F.greatest(F.col("end"), F.col("end") - F.octet_length("value") - 1 + (max_bytes - head_bytes))), "log-lines")
    jumps = tables.write(_first_beyond(sized, max_bytes), "jumps")
    starts = tables.write(sized.agg(F.min("line").alias("line")).where("line is not null"), "starts")
    while True:
        both = tables.write(starts.union(starts.join(jumps, "line").select("to")).distinct(), "starts")
        if both.count() == starts.count():
            break
        longer = jumps.join(jumps.select(F.col("line").alias("to"), F.col("to").alias("_to")), "to").select("line", F.col("_to").alias("to"))
        starts, jumps = both, tables.write(longer, "jumps")
    marked = sized.select("line", "value").join(starts.withColumn("_begins", F.lit(1)), "line", "left")
    return running_sum(marked, F.coalesce("_begins", F.lit(0)), "part").select(F.col("part").cast("int").alias("part"), "line", "value")


def _first_beyond(sized: DataFrame, width: int) -> DataFrame:
    """(line, to): of each line the first one that ends beyond its ``full``; lines without one are left out.

    Ends and bounds meet in buckets of ``width`` bytes; a bound with no end behind it in its bucket takes
    the first end of the next bucket that has one.
    """
    ends = sized.select(F.col("end").alias("at"), F.lit(0).alias("kind"), "line")
    bounds = sized.select(F.col("full").alias("at"), F.lit(1).alias("kind"), "line")
    both = ends.union(bounds).withColumn("bucket", F.floor(F.col("at") / width))
    end_line = F.when(F.col("kind") == 0, F.col("line"))
    behind = Window.partitionBy("bucket").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)  # from the end: a frame of following rows is gone through anew for each row
    found = both.withColumn("to", F.last(end_line, ignorenulls=True).over(behind)).where("kind = 1")
    firsts = both.groupBy("bucket").agg(F.min(end_line).alias("first"))  # one row per bucket, of which a part has about one
    after = next_value(firsts, "first", "after", "bucket").select("bucket", "after")
    return found.join(after, "bucket").select("line", F.coalesce("to", "after").alias("to")).where("to is not null")


def manifest(parts: DataFrame, head_bytes: int = 0) -> DataFrame:
    """(part, lines, bytes) of (part, line, value) rows; each line ends in a line feed."""
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("lines"), (F.sum(F.octet_length("value") + 1) + head_bytes).alias("bytes"))


def merged_log(parts: DataFrame, run: str = "", complete: bool = True) -> DataFrame:
    """(part, line, value): a heading, then all parts' lines; orderBy(part, line) gives the composite log."""
    n = parts.agg(F.count_distinct("part").alias("n"))
    tail = f" (run {run}{'' if complete else ', INCOMPLETE'})" if run else ""
    first = n.select(F.lit(0).alias("part"), F.lit(-1).cast("long").alias("line"), F.format_string(f"# composite log reconstructed from %d part(s){tail}", "n").alias("value"))
    return first.unionByName(parts.select("part", F.col("line").cast("long").alias("line"), "value"))


def suggested_allowlist(active: DataFrame, path: str, at: str, known: str) -> bool:
    """Write the suggestion file of active errors; nothing is written without any."""
    if active.isEmpty():
        return False
    head = [f"# Broken links found {at}, not yet in {known}.", "# Keep a line to stop its link from being flagged, delete it otherwise.", "# '*' is a wildcard, '#' begins a comment."]
    rows = active.sparkSession.createDataFrame([(0, i, h) for i, h in enumerate(head)], "a int, b long, value string")
    body = allowlist.export_lines(active).select(F.lit(1).alias("a"), F.xxhash64("value").alias("b"), "value")
    write_file(rows.unionByName(body), path, ["a", "b"])
    return True


def picked_allowlist(flagged: DataFrame, picked: DataFrame) -> DataFrame:
    """(value): allowlist lines of the ticked rows (url)."""
    return allowlist.export_lines(flagged.join(picked.select("url").distinct(), "url", "left_semi"))


def sidecar(path: str) -> str:
    """'x.json' to 'x.recheck.json'."""
    stem, dot, ext = path.rpartition(".")
    return f"{stem}.recheck.{ext}" if dot and "/" not in ext else f"{path}.recheck"


def bulk_export(data: DataFrame, groups: DataFrame, folder: str, packed: bool = False) -> None:
    """One folder of JSON per export group: data (group, ...) joined with groups (group, file), a folder for each file.

    With many groups the folders are better packed into zip archives (of 10,000 files at most), which ``exports.read_archives`` reads.
    """
    rows = data.join(groups.select("group", "file"), "group")
    exports.write_groups(rows.select("file", F.to_json(F.struct(*(c for c in rows.columns if c != "file"))).alias("value")), folder, packed)


def site_names(sites: DataFrame, stem: str, ext: str) -> DataFrame:
    """sites (index, host) with the file of each."""
    return sites.withColumn("file", urls.site_path(stem, F.col("index"), F.col("host"), ext))


def log_line(kind: str, *columns: Column) -> Column:
    """A progress line's text; kinds as in ``streaming.progress``."""
    forms = {"OK": "%s OK d%d %d %s int=%d ext=%d extTotal=%d", "ERR": "%s ERR %s :: %s :: found on %s", "BLOCKED": "%s BLOCKED %s :: %s :: found on %s", "SKIP": "%s SKIP %s :: %s", "brokenref": "# brokenref %s %s <- %s"}
    return F.format_string(forms[kind], *columns)
