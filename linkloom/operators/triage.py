"""Verdicts of people on flagged links, fixes by page and link, and the state files that carry them.

State is a table (family, page, url, value): families ``broken``, ``ok`` and ``ts`` of verdicts, and
``fixed``, ``fixed_on``, ``verdict``, ``verdict_ts`` and ``note`` of the fix tracker. Files hold it as
maps from prefixed keys to strings; the application tag they must bear is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import urls
from linkloom.operators.measures import is_external

#: Key prefixes of the two kinds of state.
VERDICT_KEYS = {"broken": "cwbroken:", "ok": "cwok:", "ts": "cwts:"}
FIX_SPACE = "cwfix:"
FIX_APP, VERDICT_APP = "linkloom-fixes", "linkloom-verdicts"


def verdict(broken: Column, ok: Column) -> Column:
    """working, broken or untriaged from two exclusive flags."""
    return F.when(F.coalesce(ok, F.lit(False)), "working").when(F.coalesce(broken, F.lit(False)), "broken").otherwise("untriaged")


def valid_states(files: DataFrame, app: str) -> DataFrame:
    """(pos, file, host, v, status) of state files: merged, other-host or bad. The first valid file sets the host."""
    good = (F.coalesce(F.col("app") == app, F.lit(False))) & F.col("v").isNotNull()
    host = F.coalesce("host", F.lit(""))
    first = files.where(good).agg(F.min_by(host, "pos").alias("_host"))
    status = F.when(~good, "bad").when(host != F.col("_host"), "other-host").otherwise("merged")
    return files.crossJoin(first).select("pos", "file", host.alias("host"), "v", status.alias("status"), "_host")  # one row


def merge_states(files: DataFrame, app: str = FIX_APP) -> DataFrame:
    """(key, value): the union of the valid files' keys in the host's name space; a later file wins."""
    kept = valid_states(files, app).where(F.col("status") == "merged")
    rows = kept.select("pos", "_host", F.explode("v").alias("key", "value")).where(F.col("key").startswith(F.concat(F.lit(FIX_SPACE), F.col("_host"), F.lit(":"))))
    return rows.groupBy("key").agg(F.max_by("value", "pos").alias("value"))


def merge_report(files: DataFrame, app: str = FIX_APP) -> DataFrame:
    """One row: files merged, of another host, bad; keys taken."""
    mine = F.map_filter("v", lambda k, _: k.startswith(F.concat(F.lit(FIX_SPACE), F.col("_host"), F.lit(":"))))
    n = F.when(F.col("status") == "merged", F.size(mine)).otherwise(0)
    return valid_states(files, app).agg(*(F.count_if(F.col("status") == s).alias(a) for s, a in (("merged", "merged"), ("other-host", "skipped_host"), ("bad", "skipped_bad"))), F.coalesce(F.sum(n), F.lit(0)).alias("entries"))


def fix_rows(state: DataFrame, host: str) -> DataFrame:
    """(family, page, url, value) from (key, value) rows of a host's fix tracker; keys outside its name space are left out."""
    space = f"{FIX_SPACE}{host}:"
    tail = F.substring("key", len(space) + 1, 1 << 30)
    rows = state.where(F.col("key").startswith(space)).withColumn("_t", tail)
    family = F.when(F.col("_t").startswith("ft:"), "fixed_on").when(F.col("_t").startswith("vd:"), "verdict").when(F.col("_t").startswith("vt:"), "verdict_ts").when(F.col("_t").startswith("n:"), "note").otherwise("fixed")
    body = F.when(family == "fixed", F.col("_t")).otherwise(F.regexp_replace("_t", r"(?s)^(?:ft|vd|vt|n):", ""))
    rows = rows.select(family.alias("family"), body.alias("_b"), "value")
    pair = F.col("family").isin("fixed", "fixed_on")
    page = F.when(pair, F.substring_index("_b", "\n", 1)).when(F.col("family") == "note", F.col("_b"))
    url = F.when(pair, F.regexp_extract("_b", r"(?s)^[^\n]*\n(.*)$", 1)).when(F.col("family") != "note", F.col("_b"))
    return rows.where(~pair | F.col("_b").contains("\n")).select("family", page.alias("page"), url.alias("url"), "value")


def fix_keys(rows: DataFrame, host: str) -> DataFrame:
    """(key, value) of fix_rows, for export."""
    mark = F.when(F.col("family") == "fixed_on", "ft:").when(F.col("family") == "verdict", "vd:").when(F.col("family") == "verdict_ts", "vt:").when(F.col("family") == "note", "n:").otherwise("")
    body = F.when(F.col("family") == "note", F.col("page")).when(F.col("page").isNull(), F.col("url")).otherwise(F.concat_ws("\n", "page", "url"))
    return rows.select(F.concat(F.lit(f"{FIX_SPACE}{host}:"), mark, body).alias("key"), "value")


def verdict_rows(state: DataFrame, host: str) -> DataFrame:
    """(family, url, value) from (key, value) rows of a host's verdicts."""
    cases, url = F.when(F.lit(False), ""), F.lit("")
    for family, prefix in VERDICT_KEYS.items():
        hit = F.col("key").startswith(f"{prefix}{host}:")
        cases, url = cases.when(hit, family), F.when(hit, F.substring("key", len(prefix) + len(host) + 2, 1 << 30)).otherwise(url)
    return state.select(cases.alias("family"), url.alias("url"), "value").where(F.col("family").isNotNull())


def import_verdicts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored verdict rows after an import: urls the file names lose their old rows and get the file's; others stay."""
    named = incoming.select("url").distinct()
    return stored.join(named, "url", "left_anti").select("family", "url", "value").unionByName(incoming.select("family", "url", "value"))


def verdict_count(rows: DataFrame) -> DataFrame:
    """Distinct urls with a broken or ok row."""
    return rows.where(F.col("family").isin("broken", "ok")).agg(F.count_distinct("url").alias("verdicts"))


def seeded(stored: DataFrame, baked: DataFrame) -> DataFrame:
    """Stored rows, or the baked ones where none are stored."""
    flag = stored.agg((F.count(F.lit(1)) == 0).alias("_empty"))
    return stored.unionByName(baked.crossJoin(flag).where("_empty").drop("_empty"))


def upsert(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """rows with those of new in place of equal keys; new rows of null or empty value delete."""
    kept = rows.join(new.select(*key).distinct(), key, "left_anti")
    return kept.select(*rows.columns).unionByName(new.where(F.coalesce(F.col("value"), F.lit("")) != "").select(*rows.columns))


def set_verdict(rows: DataFrame, links: DataFrame, want: str, at: str) -> DataFrame:
    """Verdict rows after one verdict on all links (url): broken, working, or '' to clear; the time is set or cleared with it."""
    keys = links.select("url").distinct()
    values = {"broken": "1" if want == "broken" else "", "ok": "1" if want == "working" else "", "ts": at if want else ""}
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(v).alias("value")) for f, v in values.items())))
    return upsert(rows.select("family", "url", "value"), keys.select("url", each.alias("x")).select("x.family", "url", "x.value"), ["family", "url"])


def bulk_verdict(rows: DataFrame, links: DataFrame, group: Column, key: str, want: str, at: str) -> DataFrame:
    """set_verdict for every link of one host or folder."""
    return set_verdict(rows, links.where(group == key), want, at)


def bulk_fix(rows: DataFrame, section: DataFrame, fixed: bool, at: str) -> DataFrame:
    """Fix rows after setting or clearing fixed and fixed-on for all (page, url) of a section."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(v if fixed else "").alias("value")) for f, v in (("fixed", "1"), ("fixed_on", at)))))
    return upsert(rows.select("family", "page", "url", "value"), section.select("page", "url", each.alias("x")).select("x.family", "page", "url", "x.value"), ["family", "page", "url"])


def reset_fixes(rows: DataFrame) -> DataFrame:
    """Fix rows without fixed flags and times; verdicts and notes stay."""
    return rows.where(~F.col("family").isin("fixed", "fixed_on"))


def effective(stored: Column, baked: Column) -> Column:
    """The stored value, else the baked default."""
    return F.coalesce(stored, baked)


def with_verdicts(flagged: DataFrame, rows: DataFrame) -> DataFrame:
    """flagged with verdict and verdict_ts."""
    wide = rows.groupBy("url").agg(*(F.max(F.when(F.col("family") == f, F.col("value"))).alias(f"_{f}") for f in VERDICT_KEYS))
    joined = flagged.join(wide, "url", "left")
    return joined.withColumn("verdict", verdict(F.col("_broken").isNotNull(), F.col("_ok").isNotNull())).withColumnRenamed("_ts", "verdict_ts").drop("_broken", "_ok")


def counts_as_broken() -> Column:
    """An error unless working; a blocked link only if a person found it broken."""
    return F.when(F.col("disposition") == "broken", F.col("verdict") != "working").otherwise(F.col("verdict") == "broken")


def triage_stats(flagged: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: broken instances, internal and external destinations and referrer pages after triage; tested and all by kind.

    flagged has verdict; refs are (target, referrer) edges.
    """
    n = refs.groupBy(F.col("target").alias("url")).agg(F.count_distinct("referrer").alias("_refs"))
    rows = flagged.join(n, "url", "left").withColumn("_counts", counts_as_broken())
    inst = F.greatest(F.coalesce("_refs", F.lit(0)), F.lit(1))
    tested, ext, blocked = F.col("verdict") != "untriaged", is_external(), F.col("disposition") == "blocked"
    stats = rows.agg(
        F.coalesce(F.sum(F.when(F.col("_counts"), inst)), F.lit(0)).alias("instances"),
        F.count_if(F.col("_counts") & ~ext).alias("internal"), F.count_if(F.col("_counts") & ext).alias("external"),
        F.count_if(~ext).alias("internal_all"), F.count_if(~ext & tested).alias("internal_tested"),
        F.count_if(ext).alias("external_all"), F.count_if(ext & tested).alias("external_tested"),
        F.count_if(blocked).alias("blocked_all"), F.count_if(blocked & tested).alias("blocked_tested"),
    )
    pages = refs.join(rows.where("_counts").select(F.col("url").alias("target")).distinct(), "target", "left_semi").agg(F.count_distinct("referrer").alias("pages"))
    return stats.crossJoin(pages)  # one row each


def completeness(tested: Column, total: Column) -> Column:
    """green when all are tested, amber before, null without any."""
    return F.when(total > 0, F.when(tested >= total, "green").otherwise("amber"))


def triage_counters(flagged: DataFrame, tab: list[str]) -> DataFrame:
    """Per tab: links, tested, broken, working."""
    return flagged.groupBy(*tab).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") != "untriaged").alias("tested"), F.count_if(F.col("verdict") == "broken").alias("broken"), F.count_if(F.col("verdict") == "working").alias("working"))


def group_headers(flagged: DataFrame, group: Column) -> DataFrame:
    """Per group: n, broken, working, tested and whether all are broken, all working, mixed, all tested."""
    rows = triage_counters(flagged.withColumn("key", group), ["key"])
    b, w, n = F.col("broken"), F.col("working"), F.col("n")
    return rows.withColumns({"all_broken": b == n, "all_working": w == n, "mixture": (b > 0) & (w > 0), "all_tested": F.col("tested") == n})


def references(links: DataFrame, refs: DataFrame, fixed: DataFrame) -> DataFrame:
    """(kind, url, verdict, page, fixed): each (page, link) of links (url, kind, verdict), with the stored fix rows' flag."""
    done = fixed.where(F.col("family") == "fixed").select("page", "url", F.lit(True).alias("_fixed")).distinct()
    pairs = links.join(refs.select(F.col("target").alias("url"), F.col("referrer").alias("page")).distinct(), "url", "left")
    return pairs.join(done, ["page", "url"], "left").select("kind", "url", "verdict", "page", F.coalesce("_fixed", F.lit(False)).alias("fixed"))


def fix_matrix(pairs: DataFrame) -> DataFrame:
    """One row: broken and fixed instances, internal and external destinations, and pages; working links don't count.

    A destination is fixed when it has references and all are fixed; a page when all of its links are.
    """
    open_ = pairs.where(F.col("verdict") != "working")
    has = F.col("page").isNotNull()
    links = open_.groupBy("kind", "url").agg((F.count_if(has) > 0).alias("_any"), F.coalesce(F.bool_and(F.when(has, F.col("fixed"))), F.lit(False)).alias("_all"), F.count_if(has).alias("_n"), F.count_if(has & F.col("fixed")).alias("_f"))
    done = F.col("_any") & F.col("_all")
    by_link = links.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("broken_instances"), F.coalesce(F.sum("_f"), F.lit(0)).alias("fixed_instances"),
        F.count_if(~is_external()).alias("broken_internal"), F.count_if(is_external()).alias("broken_external"),
        F.count_if(~is_external() & done).alias("fixed_internal"), F.count_if(is_external() & done).alias("fixed_external"),
    )
    pages = open_.where(has).groupBy("page").agg(F.bool_and("fixed").alias("_all"))
    return by_link.crossJoin(pages.agg(F.count(F.lit(1)).alias("broken_pages"), F.count_if("_all").alias("fixed_pages")))  # one row each


def fix_progress(pairs: DataFrame) -> DataFrame:
    """One row: (page, link) pairs fixed, and all."""
    return pairs.where(F.col("page").isNotNull()).agg(F.count_if("fixed").alias("fixed"), F.count(F.lit(1)).alias("total"))


def sections(pairs: DataFrame, by: str) -> DataFrame:
    """Per page or per url: rows, fixed, resolved (fixed or working), and whether attention is needed."""
    done = F.col("fixed") | (F.col("verdict") == "working")
    out = pairs.where(F.col("page").isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if("fixed").alias("fixed"), F.count_if(done).alias("resolved"))
    return out.withColumn("needs_attention", F.col("resolved") < F.col("n"))


def export_groups(pairs: DataFrame, mode: str = "page") -> DataFrame:
    """(group, file, pages, links) of bulk exports by page or folder; groups with working links only are left out. Files of equal names get -2, -3 and so on."""
    key = F.col("page") if mode == "page" else urls.tracker_folder("page")
    rows = pairs.where(F.col("page").isNotNull()).withColumn("group", key)
    groups = rows.groupBy("group").agg(F.count_distinct("page").alias("pages"), F.count_distinct("url").alias("links"), F.bool_or(F.col("verdict") != "working").alias("_open")).where("_open")
    named = groups.withColumn("_name", urls.page_file_name("group"))
    n = F.row_number().over(Window.partitionBy("_name").orderBy("group"))
    return named.select("group", F.when(n == 1, F.col("_name")).otherwise(F.concat("_name", F.lit("-"), n.cast("string"))).alias("file"), "pages", "links")


def scoped_state(rows: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """Fix rows that belong to some pages (page) and the links (url) they refer to."""
    by_page = rows.where(F.col("family").isin("fixed", "fixed_on", "note")).join(pages.select("page").distinct(), "page", "left_semi")
    by_link = rows.where(F.col("family").isin("verdict", "verdict_ts")).join(links.select("url").distinct(), "url", "left_semi")
    return by_page.select("family", "page", "url", "value").unionByName(by_link.select("family", "page", "url", "value"))


def tracker_data(flagged: DataFrame, found_on: DataFrame) -> DataFrame:
    """(part, url, reason, refs, v, ts): active errors, then blocked links, by kind; working ones left out, repeats kept.

    flagged has suppressed, verdict and verdict_ts; found_on is (target, found_on). For counts instead of
    lists of referrers see ``tracker_counts``.
    """
    open_ = flagged.where(~(F.col("suppressed") & (F.col("disposition") == "broken")) & (F.col("verdict") != "working"))
    own = F.when(F.coalesce("source", F.lit("")) != "", F.array("source")).otherwise(F.array().cast("array<string>"))
    joined = open_.join(found_on, open_.url == found_on.target, "left")
    return joined.select(F.when(is_external(), "external").otherwise("internal").alias("part"), "url", "reason", F.coalesce("found_on", own).alias("refs"), F.col("verdict").alias("v"), F.col("verdict_ts").alias("ts"))


def tracker_counts(flagged: DataFrame, counts: DataFrame) -> DataFrame:
    """As tracker_data with refs the number of referrers, from (target, n): no list is built, however famous a target is."""
    open_ = flagged.where(~(F.col("suppressed") & (F.col("disposition") == "broken")) & (F.col("verdict") != "working"))
    joined = open_.join(counts, open_.url == counts.target, "left")
    own = (F.coalesce("source", F.lit("")) != "").cast("long")
    return joined.select(F.when(is_external(), "external").otherwise("internal").alias("part"), "url", "reason", F.coalesce("n", own).alias("refs"), F.col("verdict").alias("v"), F.col("verdict_ts").alias("ts"))
