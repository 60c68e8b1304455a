"""Folding a crawl's append-only journal into resumable state, in batch.

A journal is a table of events (schemas.EVENT) with ``line``, its place in the file. Completions are
p (page with links), k (not HTML), e (error) and b (blocked); the first completion of a url wins. v is a visit,
r the boundary between sessions, meta the head.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators.classify import first_wins
from linkloom.operators.running import running_sum

COMPLETIONS = ("p", "k", "e", "b")


def sessions(events: DataFrame) -> DataFrame:
    """Events with ``session``, the number of boundaries before them, as a running count over spans of lines."""
    mark = (F.col("t") == "r").cast("long")
    return running_sum(events, mark, "session").withColumn("session", F.col("session") - mark)


def completions(events: DataFrame) -> DataFrame:
    """The first completion of each url."""
    return first_wins(events.where(F.col("t").isin(*COMPLETIONS)), ["u"], ["line"])


def head(events: DataFrame) -> DataFrame:
    """The first meta event."""
    return events.where(F.col("t") == "meta").orderBy("line").limit(1)


def pages(done: DataFrame) -> DataFrame:
    """Page rows of completions p and k."""
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    skipped = F.concat(F.lit("(non-HTML: "), F.coalesce(F.nullif("ct", F.lit("")), F.lit("?")), F.lit(")"))
    page = F.col("t") == "p"
    return done.where(F.col("t").isin("p", "k")).select(
        F.col("u").alias("url"), F.when(page, F.col("ti")).otherwise(skipped).alias("title"), F.col("s").alias("status"), F.col("d").alias("depth"), F.when(page, size("in")).otherwise(0).alias("internal"), F.when(page, size("ex")).otherwise(0).alias("external")
    )


def flagged(done: DataFrame) -> DataFrame:
    """Flagged rows of completions e and b; no kind means internal."""
    disposition = F.when(F.col("t") == "e", "broken").otherwise("blocked")
    return done.where(F.col("t").isin("e", "b")).select(F.col("u").alias("url"), F.col("r").alias("reason"), F.col("src").alias("source"), F.coalesce("k", F.lit("internal")).alias("kind"), disposition.alias("disposition"))


def links(done: DataFrame) -> DataFrame:
    """(page_url, pos, link_class, target, host, page_line, depth): what pages link to, in journal order."""
    inner = F.transform(F.coalesce("in", F.array().cast("array<string>")), lambda x, i: F.struct(F.lit("internal").alias("link_class"), x.alias("target"), F.lit(None).cast("string").alias("host"), i.alias("pos")))
    outer = F.transform(F.coalesce("ex", F.array().cast("array<array<string>>")), lambda x, i: F.struct(F.lit("external").alias("link_class"), F.get(x, F.lit(0)).alias("target"), F.get(x, F.lit(1)).alias("host"), (i + 1_000_000).alias("pos")))
    other = F.transform(F.coalesce("oo", F.array().cast("array<string>")), lambda x, i: F.struct(F.lit("out_of_scope").alias("link_class"), x.alias("target"), F.lit(None).cast("string").alias("host"), (i + 2_000_000).alias("pos")))
    rows = done.where(F.col("t") == "p").select(F.col("u").alias("page_url"), F.col("line").alias("page_line"), F.col("d").alias("depth"), F.explode(F.concat(inner, outer, other)).alias("x"))
    return rows.select("page_url", "x.pos", "x.link_class", "x.target", "x.host", "page_line", "depth")


def enqueued(found: DataFrame, start_url: str | None, max_depth: int | None) -> DataFrame:
    """(url, depth, parent) of what entered the frontier: internal targets of pages below the depth limit, first finder first."""
    kept = found.where(F.col("link_class") == "internal")
    if max_depth is not None:
        kept = kept.where(F.col("depth") < max_depth)
    first = kept.groupBy(F.col("target").alias("url")).agg(F.min(F.struct("page_line", "pos", "depth", "page_url")).alias("_f"))
    out = first.select("url", (F.col("_f.depth") + 1).alias("depth"), F.col("_f.page_url").alias("parent"))
    return out if start_url is None else out.where(F.col("url") != start_url)


def attempts(events: DataFrame) -> DataFrame:
    """(url, sessions): in how many sessions a url was visited."""
    return sessions(events.where(F.col("t").isin("r", "v")).select("line", "t", "u")).where(F.col("t") == "v").groupBy(F.col("u").alias("url")).agg(F.count_distinct("session").alias("sessions"))


def quarantined(events: DataFrame) -> DataFrame:
    """(url, sessions) visited in two or more sessions and never completed."""
    return attempts(events).where(F.col("sessions") >= 2).join(completions(events).select(F.col("u").alias("url")), "url", "left_anti")


def fold(events: DataFrame, start_url: str, max_depth: int | None) -> dict[str, DataFrame]:
    """The state to resume from: pages, flagged (with quarantined urls of the frontier), links, frontier."""
    start = events.sparkSession.createDataFrame([(start_url,)], "url string").select(urls.normalize(F.coalesce(urls.canonical(F.col("url")), F.col("url"))).alias("url"))
    done = completions(events)
    found = links(done)
    queue = enqueued(found, None, max_depth).join(start, "url", "left_anti")
    seed = start.select("url", F.lit(0).alias("depth"), F.lit("(start)").alias("parent"))
    open_ = seed.unionByName(queue).join(done.select(F.col("u").alias("url")), "url", "left_anti")
    bad = open_.join(quarantined(events), "url")
    # the start url is queued again whenever it has not been completed, even after two sessions
    bad = bad.where(F.col("parent") != "(start)")
    why = F.format_string("quarantined — aborted the crawler %d× without completing (likely a page that crashes it)", "sessions")
    held = bad.select("url", why.alias("reason"), F.col("parent").alias("source"), F.lit("internal").alias("kind"), F.lit("blocked").alias("disposition"))
    return {"pages": pages(done), "flagged": flagged(done).unionByName(held), "links": found, "frontier": open_.join(bad.select("url"), "url", "left_anti")}


def resume_stats(events: DataFrame) -> DataFrame:
    """One row: completed, good (pages with links read), broken, blocked, external destinations."""
    done = completions(events)
    counts = done.agg(F.count(F.lit(1)).alias("crawled"), *(F.count_if(F.col("t") == t).alias(a) for t, a in (("p", "good"), ("e", "broken"), ("b", "blocked"))))
    ext = links(done).where(F.col("link_class") == "external").agg(F.count_distinct("target").alias("external"))
    return counts.crossJoin(ext)  # one row each


def running_external(events: DataFrame) -> DataFrame:
    """(line, total): distinct external urls found up to each page, in journal order.

    A url counts on the line that found it first.
    """
    done = completions(events)
    found = links(done).where(F.col("link_class") == "external")
    new = found.groupBy("target").agg(F.min("page_line").alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("_new"))
    rows = done.where(F.col("t") == "p").select("line").join(new, "line", "left")
    return running_sum(rows, F.coalesce("_new", F.lit(0)), "total").select("line", "total")
