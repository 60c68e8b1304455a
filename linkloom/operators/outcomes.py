"""Later verdicts on flagged links: external checks, second passes, re-probes, rendering checks.

Flagged rows are (url, reason, source, kind, disposition) with disposition broken or blocked.
Outcomes are (url, status, error[, title]) rows, one per url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import http, urls
from linkloom.operators.classify import first_wins

COLUMNS = ["url", "reason", "source", "kind", "disposition"]


def judged(outcomes: DataFrame) -> DataFrame:
    """Outcomes with verdict and detail."""
    return outcomes.select("url", http.disposition(F.col("status"), F.col("error")).alias("verdict"), http.detail(F.col("status"), F.col("error")).alias("detail"))


def _reason(kind: Column, verdict: Column, detail: Column) -> Column:
    return F.when((kind == "external") & (verdict == "broken"), F.concat(F.lit("external unreachable ("), detail, F.lit(")"))).otherwise(detail)


def check_external(external: DataFrame, outcomes: DataFrame, first_referrer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(external with status ok, blocked or err; flagged external links, their source the first referrer)."""
    seen = external.drop("status").join(judged(outcomes), "url", "left")
    status = F.when(F.col("verdict") == "broken", "err").otherwise(F.col("verdict"))
    bad = seen.where(F.col("verdict").isin("broken", "blocked")).join(first_referrer, F.col("url") == F.col("target"), "left")
    kind = F.lit("external")
    flagged = bad.select("url", _reason(kind, F.col("verdict"), F.col("detail")).alias("reason"), F.coalesce("source", F.lit("")).alias("source"), kind.alias("kind"), F.col("verdict").alias("disposition"))
    return seen.select("url", "host", status.alias("status")), flagged


def second_pass(flagged: DataFrame, outcomes: DataFrame) -> DataFrame:
    """flagged after one more test of the broken links: ok ones go, blocked ones move with the new reason, the others keep their first reason. Blocked links aren't tested."""
    joined = flagged.join(judged(outcomes), "url", "left").withColumn("again", F.when(F.col("disposition") == "broken", F.col("verdict")))
    kept = joined.where(F.coalesce(F.col("again") != "ok", F.lit(True)))
    moved = F.col("again") == "blocked"
    return kept.select("url", F.when(moved, F.col("detail")).otherwise(F.col("reason")).alias("reason"), "source", "kind", F.when(moved, "blocked").otherwise(F.col("disposition")).alias("disposition"))


def recheck_tallies(flagged: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: how many broken links are fixed, moved to blocked, still broken."""
    tested = flagged.where(F.col("disposition") == "broken").join(judged(outcomes), "url", "left")
    return tested.agg(F.count_if(F.col("verdict") == "ok").alias("fixed"), F.count_if(F.col("verdict") == "blocked").alias("moved"), F.count_if(F.coalesce(F.col("verdict") == "broken", F.lit(True))).alias("still_broken"))


def to_reprobe(flagged: DataFrame) -> DataFrame:
    """Each url to probe once: broken ones not allowlisted first, then blocked ones. flagged has ``suppressed``."""
    open_ = flagged.where(~(F.col("suppressed") & (F.col("disposition") == "broken")))
    return first_wins(open_.withColumn("_o", F.when(F.col("disposition") == "broken", 0).otherwise(1)), ["url"], ["_o", "reason", "source"]).drop("_o")


def reprobe(flagged: DataFrame, outcomes: DataFrame) -> DataFrame:
    """flagged rebuilt from new outcomes: suppressed errors stay untouched; links without an outcome (a stopped run) keep their old state."""
    joined = to_reprobe(flagged).join(judged(outcomes), "url", "left")
    kept = joined.where(F.coalesce(F.col("verdict") != "ok", F.lit(True)))
    known = F.col("verdict").isNotNull()
    rows = kept.select(
        "url", F.when(known, _reason(F.col("kind"), F.col("verdict"), F.col("detail"))).otherwise(F.col("reason")).alias("reason"), "source", "kind", F.coalesce("verdict", "disposition").alias("disposition")
    )
    untouched = flagged.where(F.col("suppressed") & (F.col("disposition") == "broken")).select(*COLUMNS)
    return untouched.unionByName(rows)


def reprobe_tallies(flagged: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: links ok, blocked and broken now, and links not reached."""
    joined = to_reprobe(flagged).join(judged(outcomes), "url", "left")
    return joined.agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("ok", "blocked", "broken")), F.count_if(F.col("verdict").isNull()).alias("unreached"))


def update_external(external: DataFrame, outcomes: DataFrame) -> DataFrame:
    """External destinations with the status that new outcomes give them."""
    status = F.when(F.col("verdict") == "broken", "err").otherwise(F.col("verdict"))
    return external.join(judged(outcomes), "url", "left").select("url", "host", F.coalesce(status, F.col("status")).alias("status"))


def suspects(given: DataFrame | None, listed: DataFrame | None, flagged: DataFrame | None, which: str = "both") -> DataFrame:
    """(url, kind, was) to render: urls given, then listed, then broken, then blocked ones; http(s) only, each url once."""
    parts = []
    for order, rows in enumerate((given, listed)):
        if rows is not None:
            parts.append(rows.select("url", F.lit(("cli", "list")[order]).alias("kind"), F.lit("").alias("was"), F.lit(order).alias("_o")))
    if flagged is not None:
        wanted = {"both": ["broken", "blocked"], "broken": ["broken"], "blocked": ["blocked"]}[which]
        broken = F.col("disposition") == "broken"
        label = F.concat(F.when(broken, "error:").otherwise("blocked:"), F.coalesce("kind", F.lit("internal")))
        parts.append(flagged.where(F.col("disposition").isin(wanted)).select("url", label.alias("kind"), F.coalesce("reason", F.lit("")).alias("was"), F.when(broken, 2).otherwise(3).alias("_o")))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    valid = rows.where(urls.canonical(F.col("url")).isNotNull() & urls.is_web("url"))
    return first_wins(valid, ["url"], ["_o", "kind", "was"]).drop("_o")


def render_verdicts(suspected: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rendering verdicts (schemas.VERDICT) of suspects from (url, status, error, title, finalUrl) outcomes."""
    s, e, t = F.col("status"), F.col("error"), F.col("title")
    return suspected.join(outcomes, "url").select("url", "kind", "was", "status", http.render_disposition(s, e, t).alias("disposition"), http.render_note(s, e, t).alias("note"), F.coalesce("title", F.lit("")).alias("title"), "finalUrl")


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """One row: ok, broken and blocked."""
    return verdicts.agg(*(F.count_if(F.col("disposition") == d).alias(d) for d in ("ok", "broken", "blocked")))


def apply_verdicts(flagged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """flagged after rendering: ok ones go, broken ones found blocked move, blocked ones never become broken."""
    known = first_wins(verdicts.select("url", F.col("disposition").alias("verdict")), ["url"], ["verdict"])
    joined = flagged.join(known, "url", "left")
    kept = joined.where(F.coalesce(F.col("verdict") != "ok", F.lit(True)))
    moved = (F.col("disposition") == "broken") & F.coalesce(F.col("verdict") == "blocked", F.lit(False))
    why = F.concat(F.lit("blocked in browser ("), F.coalesce("reason", F.lit("")), F.lit(")"))
    return kept.select("url", F.when(moved, why).otherwise(F.col("reason")).alias("reason"), "source", "kind", F.when(moved, "blocked").otherwise(F.col("disposition")).alias("disposition"))
