"""Counts of a crawl, overall and by site. All are partial aggregates; lists appear only in reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text


def link_instances(pages: DataFrame) -> DataFrame:
    """Occurrences of internal and external links over all pages; out-of-scope ones don't count."""
    return pages.agg(F.coalesce(F.sum(F.coalesce("internal", F.lit(0)) + F.coalesce("external", F.lit(0))), F.lit(0)).alias("link_instances"))


def instances_by_target(refs: DataFrame) -> DataFrame:
    """(url, refs): distinct referrers of each target."""
    return refs.groupBy(F.col("target").alias("url")).agg(F.count_distinct("referrer").alias("refs"))


def broken_instances(active: DataFrame, refs: DataFrame) -> DataFrame:
    """Sum over active errors of their distinct referrers, at least 1 each."""
    n = F.greatest(F.coalesce("refs", F.lit(0)), F.lit(1))
    return active.join(instances_by_target(refs), "url", "left").agg(F.coalesce(F.sum(n), F.lit(0)).alias("broken_instances"))


def is_external(kind: str = "kind") -> Column:
    """Any kind but 'external', and none, is internal."""
    return F.coalesce(F.col(kind) == "external", F.lit(False))


def broken_by_kind(active: DataFrame) -> DataFrame:
    """Broken internal, external and all."""
    return active.agg(F.count_if(~is_external()).alias("internal"), F.count_if(is_external()).alias("external"), F.count(F.lit(1)).alias("total"))


def blocked_counts(blocked: DataFrame) -> DataFrame:
    """Blocked rows, and blocked urls."""
    return blocked.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("url").alias("urls"))


def destinations(pages: DataFrame, external: DataFrame) -> DataFrame:
    """Pages, external destinations, and both."""
    p, e = pages.agg(F.count(F.lit(1)).alias("pages")), external.agg(F.count(F.lit(1)).alias("external"))
    return p.crossJoin(e).withColumn("total", F.col("pages") + F.col("external"))  # one row each


def referrer_pages(active: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct pages that link to an active error."""
    return refs.join(active.select(F.col("url").alias("target")).distinct(), "target", "left_semi").agg(F.count_distinct("referrer").alias("referrer_pages"))


def shares(part: str, whole: str) -> Column:
    """Percent text of one count in another."""
    return text.share(F.col(part).cast("double"), F.col(whole).cast("double"))


def summary(pages: DataFrame, external: DataFrame, out_of_scope: DataFrame, flagged: DataFrame, refs: DataFrame, queued: int = 0, retries: int = 0, runtime_ms: int = 0) -> DataFrame:
    """One row of the twelve counters of a report. flagged has ``suppressed`` and ``disposition``."""
    errors = flagged.where(F.col("disposition") == "broken")
    active = errors.where(~F.col("suppressed"))
    parts = [
        pages.agg(F.count(F.lit(1)).alias("pagesCrawled")).withColumn("queued", F.lit(queued).cast("long")),
        external.agg(F.count(F.lit(1)).alias("externalLinks")),
        link_instances(pages).toDF("linkInstances"),
        broken_instances(active, refs).toDF("brokenLinkInstances"),
        out_of_scope.agg(F.count(F.lit(1)).alias("outOfScope")),
        flagged.agg(
            F.count_if((F.col("disposition") == "broken") & ~F.col("suppressed") & ~is_external()).alias("errorsInternal"),
            F.count_if((F.col("disposition") == "broken") & ~F.col("suppressed") & is_external()).alias("errorsExternal"),
            F.count_if(F.col("disposition") == "blocked").alias("blocked"),
            F.count_if((F.col("disposition") == "broken") & F.col("suppressed")).alias("suppressed"),
        ),
    ]
    out = parts[0]
    for one in parts[1:]:
        out = out.crossJoin(one)  # one row each
    return out.withColumns({"retries": F.lit(retries).cast("long"), "runtimeMs": F.lit(runtime_ms).cast("long")})


def after_render(saved: DataFrame, flagged: DataFrame) -> DataFrame:
    """A saved summary row after a rendering check: only the two error counts and blocked are counted anew."""
    new = flagged.agg(
        F.count_if((F.col("disposition") == "broken") & ~is_external()).alias("errorsInternal"),
        F.count_if((F.col("disposition") == "broken") & is_external()).alias("errorsExternal"),
        F.count_if(F.col("disposition") == "blocked").alias("blocked"),
    )
    return saved.drop("errorsInternal", "errorsExternal", "blocked").crossJoin(new)


def by_site(pages: DataFrame, flagged: DataFrame, site: str = "site") -> DataFrame:
    """Per-site counts with a grand total (site null)."""
    p = pages.groupBy(site).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.col("internal") + F.col("external")).alias("instances"))
    f = flagged.groupBy(site).agg(F.count_if(F.col("disposition") == "broken").alias("broken"), F.count_if(F.col("disposition") == "blocked").alias("blocked"))
    both = p.join(f, site, "full").fillna(0, ["pages", "instances", "broken", "blocked"])
    return both.rollup(site).agg(*(F.sum(c).alias(c) for c in ("pages", "instances", "broken", "blocked")))


def group_count(rows: DataFrame, key: Column) -> DataFrame:
    """How many groups a key makes."""
    return rows.agg(F.count_distinct(key).alias("groups"))


def broken_references(active: DataFrame, refs: DataFrame) -> DataFrame:
    """(kind, url, referrer): every referrer of every active error; its source where none is known."""
    joined = active.join(refs.select(F.col("target").alias("url"), "referrer"), "url", "left")
    return joined.select(F.coalesce("kind", F.lit("internal")).alias("kind"), "url", F.coalesce("referrer", F.nullif("source", F.lit(""))).alias("referrer")).where(F.col("referrer").isNotNull())
