"""Progress logs as streams: parsing, live counters, idle warnings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from linkloom.sources.shared import Tables
from linkloom.sources.tail import TailSource

#: Fixed patterns of the line grammar.
RESULT = r"^\S+\s+(OK|ERR|SKIP|BLOCKED)\s+(.*)$"
STATS = r"^# resume-stats crawled=(\d+) good=(\d+) broken=(\d+) blocked=(\d+) external=(\d+)"
RECHECK = r"^RECHK (ok|broken|blocked) (.*)$"
IDLE_MS, FIRST_MS = 10_000, 5_000


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines of files that appear in a folder; the checkpoint keeps what has been read."""
    return spark.readStream.text(folder)


def tail(spark: SparkSession, folder: str, glob: str = "*", max_lines: int = 0, positions: str | None = None) -> DataFrame:
    """A stream (file, start, value) of the lines of files that grow, so that a run is watched while it writes."""
    spark.dataSource.register(TailSource)
    given = {"glob": glob, "max_lines": str(max_lines)} | ({"positions": positions} if positions else {})
    return spark.readStream.format(TailSource.name()).options(**given).load(folder)


def parse(rows: DataFrame, column: str = "value") -> DataFrame:
    """rows with tag and numbers of each line: OK, ERR, SKIP, BLOCKED, stats, recheck, extcheck, backoff, site, done; null for other lines."""
    v = F.regexp_replace(column, "\r$", "")
    n = lambda p, g=1: F.nullif(F.regexp_extract(v, p, g), F.lit("")).cast("long")
    result = F.regexp_extract(v, RESULT, 1)
    tag = (
        F.when(v.rlike(r"^DONE_-?\d+"), "done").when(result != "", result).when(v.rlike(STATS), "stats").when(v.startswith("# recheck-start total="), "recheck-start").when(v.rlike(RECHECK), "recheck")
        .when(v.startswith("# recheck-done"), "recheck-done").when(v.rlike(r"^# extcheck \d+/\d+ \w+"), "extcheck").when(v.startswith("# BACKOFF"), "backoff").when(v.rlike(r"^# === site \d+/\d+"), "site")
    )
    ext = n(r"extTotal=(\d+)")
    return rows.withColumns(
        {
            "tag": tag,
            "subject": F.when(result != "", F.regexp_extract(v, RESULT, 2)).when(tag == "recheck", F.regexp_extract(v, RECHECK, 2)),
            "verdict": F.when(tag == "recheck", F.regexp_extract(v, RECHECK, 1)).when(tag == "extcheck", F.regexp_extract(v, r"^# extcheck \d+/\d+ (\w+)", 1)),
            "crawled": F.when(tag == "stats", n(STATS, 1)),
            "good": F.when(tag == "stats", n(STATS, 2)),
            "broken": F.when(tag == "stats", n(STATS, 3)),
            "blocked": F.when(tag == "stats", n(STATS, 4)),
            "external": F.when(tag == "stats", n(STATS, 5)).when(result != "", ext),
            "checked": F.when(tag == "extcheck", n(r"^# extcheck (\d+)")),
            "total": F.when(tag == "extcheck", n(r"^# extcheck \d+/(\d+)")).when(tag == "recheck-start", n(r"total=(\d+)")),
            "until_ms": F.when(tag == "backoff", n(r"untilMs=(\d+)")),
            "code": F.when(tag == "done", n(r"^DONE_(-?\d+)")),
            "stopped": F.when(tag == "recheck-done", v.contains(" stopped=1")),
        }
    )


def counters(parsed: DataFrame, by: list[str] | None = None, at: str = "line") -> DataFrame:
    """Live counters of parsed lines in order ``at``; works on batches and on streams in complete or update mode.

    Results and re-checks add up, resume statistics are added to them, external totals and waits are the last seen.
    """
    tag, verdict = F.col("tag"), F.col("verdict")
    visits, again = tag.isin("OK", "ERR", "SKIP", "BLOCKED"), tag == "recheck"
    added = lambda c: F.coalesce(F.sum(F.col(c)), F.lit(0))
    last = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, F.col(at)))
    return parsed.groupBy(*(by or [])).agg(
        (F.count_if(visits | again) + added("crawled")).alias("crawled"),
        (F.count_if((tag == "OK") | again & (verdict == "ok")) + added("good")).alias("good"),
        (F.count_if((tag == "ERR") | again & (verdict == "broken")) + added("broken")).alias("broken"),
        (F.count_if((tag == "BLOCKED") | again & (verdict == "blocked") | (tag == "extcheck") & (verdict == "blocked")) + added("blocked")).alias("blocked"),
        F.coalesce(last("external", F.col("external").isNotNull()), F.lit(0)).alias("external"),
        F.coalesce(last("checked", tag == "extcheck"), F.lit(0)).alias("ext_checked"),
        F.coalesce(last("total", tag == "extcheck"), F.lit(0)).alias("ext_total"),
        F.count_if((tag == "extcheck") & (verdict == "err")).alias("ext_bad"),
        F.coalesce(F.sum(F.when(tag == "recheck-start", F.col("total"))), F.lit(0)).alias("recheck_total"),
        last("until_ms", F.col("until_ms").isNotNull()).alias("backoff_until"),
        last("code", tag == "done").alias("done_code"),
    )


def recent(parsed: DataFrame, most: int = 5, at: str = "line") -> DataFrame:
    """The newest result lines, as 'TAG  text'."""
    label = F.when(F.col("tag") == "recheck", F.col("verdict")).otherwise(F.col("tag"))
    rows = parsed.where(F.col("subject").isNotNull()).select(at, F.concat(label, F.lit("  "), F.col("subject")).alias("text"))
    return rows.orderBy(F.desc(at)).limit(most)


def rate_per_minute(n: Column, seconds: Column) -> Column:
    """Rounded results a minute."""
    return F.when(seconds > 0, F.floor(n / seconds * 60 + 0.5)).otherwise(0)


def backoff_left(until_ms: Column, now_ms: Column) -> Column:
    """Milliseconds of waiting left."""
    return F.greatest(until_ms - now_ms, F.lit(0))


def per_window(parsed: DataFrame, ts: str, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Extension: results by tumbling event-time window with a watermark."""
    return parsed.withWatermark(ts, late).groupBy(F.window(ts, width), "tag").agg(F.count(F.lit(1)).alias("n"))


def idle_alerts(stream: DataFrame, key: str = "run", idle_ms: int = IDLE_MS) -> DataFrame:
    """(run, alert, results) rows of a stream of parsed lines: 'idle' when no result came for idle_ms of processing time, 'active' otherwise."""

    def update(run: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            alert = "idle" if n else "no first page"
        else:
            n += sum(int(f["tag"].isin(["OK", "ERR", "SKIP", "BLOCKED", "recheck"]).sum()) for f in frames)
            alert = "active"
        state.update((n,))
        state.setTimeoutDuration(idle_ms if n else min(idle_ms, FIRST_MS))
        yield pd.DataFrame({key: [run[0]], "alert": [alert], "results": [n]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} string, alert string, results long", "n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def _ranges(rows: DataFrame, by: str, at: str) -> DataFrame:
    """rows as a written table in ranges (_part) of (by, at), so that a busy host spreads over several."""
    return Tables(rows.sparkSession).write(rows.repartitionByRange(by, at).withColumn("_part", F.spark_partition_id()), "ranges")


def _before(parts: DataFrame, by: str, fold: Callable[[str], Column], column: str) -> DataFrame:
    """(by, _part, column): the fold of a host's ranges before each, from a row per host and range."""
    return parts.select(by, "_part", fold(column).over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias(column))


def rate_slots(requests: DataFrame, gap_ms: float, by: str = "host", at: str = "t") -> DataFrame:
    """When rate-limited requests start: slot = max(own time, slot before + gap), per host.

    In closed form: with i the place in order, slot_i = i * gap + max over j <= i of (t_j - j * gap). Places
    and maxima are taken within ranges of a host's requests and carried from range to range.
    """
    order, key = Window.partitionBy(by, "_part").orderBy(at), [by, "_part"]
    rows = _ranges(requests, by, at)
    first = _before(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_first")), by, F.sum, "_first")
    placed = rows.withColumn("_i", F.row_number().over(order) - 1).join(first, key).withColumn("_i", F.col("_i") + F.coalesce("_first", F.lit(0)))
    placed = placed.withColumn("_lead", F.col(at) - F.col("_i") * gap_ms)
    most = _before(placed.groupBy(*key).agg(F.max("_lead").alias("_most")), by, F.max, "_most")
    own = F.max("_lead").over(order.rowsBetween(Window.unboundedPreceding, 0))
    joined = placed.withColumn("_own", own).join(most, key)
    return joined.withColumn("slot", F.greatest("_own", "_most") + F.col("_i") * gap_ms).drop("_i", "_first", "_lead", "_own", "_most", "_part")


def streak(answers: DataFrame, by: str = "host", at: str = "t") -> DataFrame:
    """answers (throttled) with the streak after each: one more per throttled answer, one less per other, never below 0.

    In closed form: the running sum of +1 and -1 less its running minimum below 0, both carried from range
    to range of a host's answers.
    """
    order, key = Window.partitionBy(by, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0), [by, "_part"]
    step = F.when(F.col("throttled"), 1).otherwise(-1)
    rows = _ranges(answers, by, at)
    base = _before(rows.groupBy(*key).agg(F.sum(step).alias("_base")), by, F.sum, "_base")
    summed = rows.withColumn("_s", F.sum(step).over(order)).join(base, key).withColumn("_s", F.col("_s") + F.coalesce("_base", F.lit(0)))
    low = _before(summed.groupBy(*key).agg(F.min("_s").alias("_low")), by, F.min, "_low")
    joined = summed.withColumn("_own", F.min("_s").over(order)).join(low, key)
    return joined.withColumn("streak", F.col("_s") - F.least(F.lit(0), F.col("_own"), F.col("_low"))).drop("_s", "_base", "_own", "_low", "_part")
