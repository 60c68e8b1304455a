"""Named queries over the bindings, each with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import http, text, urls
from linkloom.operators import allowlist, classify, extract, graph, journal, measures, outcomes, triage
from linkloom.plans import bindings as b
from linkloom.sources import readers, writers
from linkloom.sources.shared import Tables
from linkloom.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_ST = "list_extract([200, 200, 301, 404, 410, 403, 429, 500, 0, 418], CAST(({k}) % 10 + 1 AS BIGINT))"
_ERR = "CASE WHEN ({k}) % 10 = 8 THEN CASE WHEN ({k}) % 20 = 8 THEN 'socket timeout' ELSE 'ENOTFOUND' END END"
_DISP = "CASE WHEN {s} BETWEEN 200 AND 399 THEN 'ok' WHEN {s} IN (401, 403, 405, 406, 408, 409, 429, 451, 999) OR {s} BETWEEN 500 AND 599 THEN 'blocked' WHEN {s} = 0 AND coalesce({e}, '') ILIKE '%timeout%' THEN 'blocked' ELSE 'broken' END"
_DETAIL = "CASE WHEN {s} > 0 THEN 'HTTP ' || {s} ELSE coalesce(nullif({e}, ''), 'no response') END"
_URL = "CASE WHEN {k} % 3 = 0 THEN 'https://ext' || ({k} % 7) || '.example.net/p' || {k} ELSE 'https://site.example/d' || ({k} % 11) || '/p' || {k} END"
_KIND = "CASE WHEN {k} % 3 = 0 THEN 'external' ELSE 'internal' END"
_HOSTRE = "'^https?://([^/?#]+)'"


def _out(name: str, turn: int) -> str:
    k = f"p_partkey + {3 * turn}"
    return f"{name} AS (SELECT {_URL.format(k='p_partkey')} AS url, {_ST.format(k=k)} AS status, {_ERR.format(k=k)} AS error FROM part)"


def _judged(name: str, of: str) -> str:
    return f"{name} AS (SELECT url, {_DISP.format(s='status', e='error')} AS verdict, {_DETAIL.format(s='status', e='error')} AS detail FROM {of})"


_LK = f"lk AS (SELECT 'https://site.example/o' || l_orderkey AS page_url, l_orderkey, l_linenumber AS pos, {_URL.format(k='l_partkey')} AS target, {_KIND.format(k='l_partkey')} AS link_class FROM lineitem)"
_REFS = "refs AS (SELECT target, page_url AS referrer, min(l_orderkey * 1000 + pos) AS seen FROM lk GROUP BY 1, 2)"
_FL = (
    f"o0 AS (SELECT p_partkey, {_URL.format(k='p_partkey')} AS url, {_KIND.format(k='p_partkey')} AS kind, {_ST.format(k='p_partkey')} AS status, {_ERR.format(k='p_partkey')} AS error FROM part), "
    f"fl AS (SELECT url, {_DETAIL.format(s='status', e='error')} AS reason, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'https://site.example/s' END AS source, kind, {_DISP.format(s='status', e='error')} AS disposition FROM o0 WHERE {_DISP.format(s='status', e='error')} <> 'ok')"
)
_VD = (
    "vd AS (SELECT 'https://' || source || '.example/d' || d.doc_id AS url, source, CASE WHEN d.doc_id % 3 = 0 THEN 'external' ELSE 'internal' END AS kind, CASE WHEN d.doc_id % 4 = 1 THEN 'blocked' ELSE 'broken' END AS disposition, "
    "CASE WHEN toxic = 1 THEN 'broken' WHEN quality = 1 THEN 'working' ELSE 'untriaged' END AS verdict FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)
_EV = "ev AS (SELECT event_id AS line, CASE WHEN event_id % 500 = 0 THEN 'r' ELSE CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'p' WHEN 'error' THEN 'e' WHEN 'signup' THEN 'k' WHEN 'purchase' THEN 'b' END END AS t, 'https://site.example/u' || user_id AS u, event_id % 200 AS o, event_id % 3 AS d FROM events)"
_DONE = "done AS (SELECT * FROM ev WHERE t IN ('p', 'k', 'e', 'b') QUALIFY row_number() OVER (PARTITION BY u ORDER BY line) = 1)"
_HREFS = r"""hrefs AS (SELECT url, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS raw FROM (SELECT url, regexp_extract_all(regexp_replace(html, '<!--[\s\S]*?-->', '', 'g'), '(?i)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1) AS l FROM pages)),
lnk AS (SELECT url AS page_url, CAST(pos AS INTEGER) AS pos, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || replace(replace(replace(url_encode(raw), '%2F', '/'), '%2C', ','), '%3A', ':') AS href FROM hrefs)"""
_BFS = (
    "RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem), "
    "r AS (SELECT 'p1' AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src WHERE r.depth < {d}), g AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1)"
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _own_links(spark: SparkSession, d: str) -> DataFrame:
    found = extract.links(b.table(spark, d, "pages"))
    return classify.classify(found, urls.hostname("page_url"))


# pages: extraction, urls, classes, groups


@query(f"WITH {_HREFS} SELECT page_url, pos, href FROM lnk")
def link_occurrences(spark, d):
    return extract.links(b.table(spark, d, "pages")).select("page_url", "pos", "href")


@query(r"SELECT url, substr(trim(regexp_replace(regexp_extract(html, '(?i)<title[^>]*>([\s\S]*?)</title>', 1), '\s+', ' ', 'g')), 1, 300) AS title FROM pages")
def page_titles(spark, d):
    return b.table(spark, d, "pages").select("url", extract.title(F.col("html")).alias("title"))


@query(f"WITH {_HREFS}, c AS (SELECT page_url, count(*) AS n FROM lnk GROUP BY 1) SELECT url, coalesce(n, 0) AS internal, CAST(0 AS BIGINT) AS external FROM (SELECT DISTINCT url FROM pages) LEFT JOIN c ON url = page_url")
def page_link_counts(spark, d):
    return classify.page_counts(b.table(spark, d, "pages").select("url").distinct(), _own_links(spark, d))


@query(r"SELECT url, CASE WHEN s LIKE '%/' AND regexp_extract(s, '^[a-z]+://[^/?#]*([^?#]*)', 1) <> '/' THEN s[:-2] ELSE s END AS normalized FROM (SELECT url, regexp_replace(url, '#.*$', '') AS s FROM pages)")
def normalized_urls(spark, d):
    return b.table(spark, d, "pages").select("url", urls.normalize("url").alias("normalized"))


@query(f"SELECT url, lower(regexp_extract(url, {_HOSTRE}, 1)) = 'example.net' AS same FROM pages")
def same_domain_exact(spark, d):
    return b.table(spark, d, "pages").select("url", urls.same_domain(urls.hostname("url"), F.lit("example.net"), False).alias("same"))


@query(f"SELECT url, h = 'example.net' OR h LIKE '%.example.net' AS same FROM (SELECT url, lower(regexp_extract(url, {_HOSTRE}, 1)) AS h FROM pages)")
def same_domain_subdomains(spark, d):
    return b.table(spark, d, "pages").select("url", urls.same_domain(urls.hostname("url"), F.lit("example.net"), True).alias("same"))


@query("SELECT url, p = '/en' OR p LIKE '/en/%' AS in_scope FROM (SELECT url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)")
def scope_split(spark, d):
    return b.table(spark, d, "pages").select("url", urls.in_scope(urls.pathname("url"), "/en").alias("in_scope"))


@query("SELECT url, CASE WHEN NOT (h = 'example.net' OR h LIKE '%.example.net') THEN 'external' WHEN p = '/en' OR p LIKE '/en/%' THEN 'internal' ELSE 'out_of_scope' END AS link_class FROM (SELECT url, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)")
def link_classes(spark, d):
    return b.table(spark, d, "pages").select("url", classify.link_class(urls.hostname("url"), urls.pathname("url"), F.lit("example.net"), "/en", True).alias("link_class"))


@query(f"SELECT lower(regexp_extract(url, {_HOSTRE}, 1)) AS key, count(*) AS n FROM pages GROUP BY 1")
def pages_by_host(spark, d):
    return classify.grouped(b.table(spark, d, "pages").select("url"), urls.host_group("url")).select("key", "n")


_FOLDER = r"lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || '/' || CASE WHEN regexp_extract(url, '^https?://[^/?#]+/+([^/?#]+)', 1) = '' THEN '' ELSE regexp_extract(url, '^https?://[^/?#]+/+([^/?#]+)', 1) || '/' END"


@query(f"SELECT {_FOLDER} AS key, count(*) AS n FROM pages GROUP BY 1")
def pages_by_folder(spark, d):
    return classify.grouped(b.table(spark, d, "pages").select("url"), urls.folder_group("url")).select("key", "n")


@query(f"SELECT count(DISTINCT {_FOLDER}) AS groups FROM pages")
def group_counts(spark, d):
    return measures.group_count(b.table(spark, d, "pages"), urls.folder_group("url"))


@query(r"SELECT url, coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^.*?://', ''), '[^A-Za-z0-9._-]', '_', 'g'), '__+', '_', 'g'), '^[_.]+', ''), '[_.]+$', ''), 1, 120), ''), 'page') AS file FROM pages")
def page_file_names(spark, d):
    return b.table(spark, d, "pages").select("url", urls.page_file_name("url").alias("file"))


@query(f"WITH {_HREFS}, c AS (SELECT lower(regexp_extract(page_url, {_HOSTRE}, 1)) AS h, count(*) AS links FROM lnk GROUP BY 1), p AS (SELECT lower(regexp_extract(url, {_HOSTRE}, 1)) AS h, count(*) AS pages FROM pages GROUP BY 1) SELECT p.h AS host, pages, coalesce(links, 0) AS links FROM p LEFT JOIN c ON p.h = c.h")
def site_summary(spark, d):
    host = urls.host_group("url").alias("host")
    n = b.table(spark, d, "pages").groupBy(host).agg(F.count(F.lit(1)).alias("pages"))
    found = _own_links(spark, d).groupBy(urls.host_group("page_url").alias("host")).agg(F.count(F.lit(1)).alias("links"))
    return n.join(found, "host", "left").select("host", "pages", F.coalesce("links", F.lit(0)).alias("links"))


# line items: destinations and referrers


@query(f"WITH {_LK} SELECT DISTINCT target AS url, regexp_extract(target, {_HOSTRE}, 1) AS host FROM lk WHERE link_class = 'external'")
def external_destinations(spark, d):
    return classify.external_destinations(b.links(spark, d))


@query(f"WITH {_LK}, {_REFS} SELECT target, count(*) AS n, string_agg(referrer, ' ' ORDER BY seen, referrer) AS found_on FROM refs GROUP BY 1")
def referrers_per_target(spark, d):
    return classify.referrer_lists(b.refs(spark, d)).select("target", F.size("found_on").cast("long").alias("n"), F.array_join("found_on", " ").alias("found_on"))


@query(f"WITH {_LK}, {_REFS} SELECT target, referrer FROM refs QUALIFY row_number() OVER (PARTITION BY target ORDER BY seen, referrer) <= 5")
def referrer_cap(spark, d):
    return classify.capped_referrers(b.refs(spark, d), 5).select("target", "referrer")


@query(f"WITH {_LK}, {_REFS}, l AS (SELECT target, list(referrer ORDER BY seen, referrer) AS r FROM refs GROUP BY 1) SELECT target, array_to_string(r[1:3], chr(10)) || CASE WHEN len(r) > 3 THEN chr(10) || '+' || (len(r) - 3) || ' more' ELSE '' END AS preview FROM l")
def found_on_preview(spark, d):
    return classify.previews(b.refs(spark, d)).select("target", classify.preview_text(F.col("n"), F.col("found_on")).alias("preview"))


@query(f"WITH {_LK}, {_REFS} SELECT target, arg_min(referrer, seen) AS source FROM refs GROUP BY 1")
def first_referrer(spark, d):
    return classify.first_referrer(b.refs(spark, d))


# measures


@query("SELECT count(*) AS link_instances FROM lineitem")
def link_instances(spark, d):
    return measures.link_instances(b.pages(spark, d))


def _active(spark, d):
    return b.flagged(spark, d).where(F.col("disposition") == "broken")


_NREF = "nr AS (SELECT target, count(*) AS n FROM refs GROUP BY 1)"


@query(f"WITH {_LK}, {_REFS}, {_NREF}, {_FL} SELECT CAST(sum(greatest(coalesce(n, 0), 1)) AS BIGINT) AS broken_instances FROM fl LEFT JOIN nr ON url = target WHERE disposition = 'broken'")
def broken_instances(spark, d):
    return measures.broken_instances(_active(spark, d), b.refs(spark, d))


@query(f"WITH {_FL} SELECT count(*) FILTER (kind <> 'external') AS internal, count(*) FILTER (kind = 'external') AS external, count(*) AS total FROM fl WHERE disposition = 'broken'")
def broken_by_kind(spark, d):
    return measures.broken_by_kind(_active(spark, d))


@query(f"WITH {_FL} SELECT count(*) * 2 AS rows, count(DISTINCT url) AS urls FROM fl WHERE disposition = 'blocked'")
def blocked_counts(spark, d):
    rows = b.flagged(spark, d).where(F.col("disposition") == "blocked")
    return measures.blocked_counts(rows.unionByName(rows))


@query(f"WITH {_LK} SELECT count(DISTINCT page_url) AS pages, (SELECT count(DISTINCT target) FROM lk WHERE link_class = 'external') AS external, count(DISTINCT page_url) + (SELECT count(DISTINCT target) FROM lk WHERE link_class = 'external') AS total FROM lk")
def destinations(spark, d):
    return measures.destinations(b.pages(spark, d), classify.external_destinations(b.links(spark, d)))


@query(f"WITH {_LK}, {_FL} SELECT count(DISTINCT page_url) AS referrer_pages FROM lk WHERE target IN (SELECT url FROM fl WHERE disposition = 'broken')")
def referrer_pages(spark, d):
    return measures.referrer_pages(_active(spark, d), b.refs(spark, d))


@query(f"WITH {_FL} SELECT disposition, count(*) AS n, format('{{:.1f}}', 100.0 * count(*) / (SELECT count(*) FROM part)) AS share FROM fl GROUP BY 1")
def percent_share(spark, d):
    total = b.table(spark, d, "part").agg(F.count(F.lit(1)).alias("total"))
    rows = b.flagged(spark, d).groupBy("disposition").agg(F.count(F.lit(1)).alias("n")).crossJoin(total)
    return rows.select("disposition", "n", measures.shares("n", "total").alias("share"))


PATTERNS = ["https://site.example/d1/*", "https://ext*.example.net/p3*", "https://site.example/d2/p13"]
_MATCH = r"(url LIKE 'https://site.example/d1/%' OR regexp_full_match(url, 'https://ext.*\.example\.net/p3.*') OR url = 'https://site.example/d2/p13')"


@query(f"WITH {_FL} SELECT url, {_MATCH} AS suppressed FROM fl WHERE disposition = 'broken'")
def allowlist_split(spark, d):
    return allowlist.split_active(_active(spark, d), PATTERNS).select("url", "suppressed")


@query(f"WITH {_FL} SELECT url, {_MATCH} OR url LIKE '%/p13' OR url LIKE '%/p%7' OR contains(url, '/d4/') OR url = 'https://site.example/d2/p24' AS suppressed FROM fl WHERE disposition = 'broken'")
def allowlist_table_join(spark, d):
    """Patterns by head, by tail, by an inner part, exact ones, and a thousand that match nothing."""
    more = ["*/p13", "*/p*7", "*/d4/*", "https://site.example/d2/p24", *(f"https://none{k}.example/*" for k in range(500)), *(f"*.none{k}" for k in range(500))]
    patterns = spark.createDataFrame([(p,) for p in PATTERNS + more], "pattern string")
    return allowlist.split_by_table(_active(spark, d), patterns).select("url", "suppressed")


@query(f"WITH {_FL} SELECT url || '   # ' || reason || ' — found on: ' || coalesce(nullif(source, ''), '(start)') AS value FROM fl WHERE disposition = 'broken' AND NOT {_MATCH}")
def suggested_allowlist(spark, d):
    return allowlist.export_lines(allowlist.split_active(_active(spark, d), PATTERNS).where(~F.col("suppressed")))


@query(
    f"WITH {_LK}, {_REFS}, {_NREF}, {_FL}, m AS (SELECT *, {_MATCH} AS suppressed FROM fl) SELECT (SELECT count(DISTINCT page_url) FROM lk) AS pagesCrawled, CAST(0 AS BIGINT) AS queued, (SELECT count(DISTINCT target) FROM lk WHERE link_class = 'external') AS externalLinks, "
    "(SELECT count(*) FROM lk) AS linkInstances, (SELECT CAST(sum(greatest(coalesce(n, 0), 1)) AS BIGINT) FROM m LEFT JOIN nr ON url = target WHERE disposition = 'broken' AND NOT suppressed) AS brokenLinkInstances, CAST(0 AS BIGINT) AS outOfScope, "
    "count(*) FILTER (disposition = 'broken' AND NOT suppressed AND kind = 'internal') AS errorsInternal, count(*) FILTER (disposition = 'broken' AND NOT suppressed AND kind = 'external') AS errorsExternal, count(*) FILTER (disposition = 'blocked') AS blocked, "
    "count(*) FILTER (disposition = 'broken' AND suppressed) AS suppressed, CAST(0 AS BIGINT) AS retries, CAST(0 AS BIGINT) AS runtimeMs FROM m"
)
def summary(spark, d):
    links = b.links(spark, d)
    return measures.summary(b.pages(spark, d), classify.external_destinations(links), classify.out_of_scope_destinations(links), allowlist.split_active(b.flagged(spark, d), PATTERNS), b.refs(spark, d))


@query(
    f"WITH {_LK}, {_FL}, p AS (SELECT l_orderkey % 9 AS site, count(DISTINCT page_url) AS pages, count(*) AS instances FROM lk GROUP BY 1), f AS (SELECT CAST(regexp_extract(url, '([0-9]+)$', 1) AS BIGINT) % 9 AS site, count(*) FILTER (disposition = 'broken') AS broken, count(*) FILTER (disposition = 'blocked') AS blocked FROM fl GROUP BY 1) "
    "SELECT coalesce(p.site, f.site) AS site, CAST(sum(coalesce(pages, 0)) AS BIGINT) AS pages, CAST(sum(coalesce(instances, 0)) AS BIGINT) AS instances, CAST(sum(coalesce(broken, 0)) AS BIGINT) AS broken, CAST(sum(coalesce(blocked, 0)) AS BIGINT) AS blocked FROM p FULL JOIN f ON p.site = f.site GROUP BY ROLLUP (1)"
)
def multi_site_totals(spark, d):
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long") % 9
    return measures.by_site(b.pages(spark, d).withColumn("site", number("url")), b.flagged(spark, d).withColumn("site", number("url")))


@query(f"WITH {_LK}, {_REFS}, {_FL} SELECT kind, url, coalesce(referrer, nullif(source, '')) AS referrer FROM fl LEFT JOIN refs ON url = target WHERE disposition = 'broken' AND coalesce(referrer, nullif(source, '')) IS NOT NULL")
def broken_references(spark, d):
    return measures.broken_references(_active(spark, d), b.refs(spark, d))


@query("SELECT p_partkey, CASE WHEN s < 60 THEN s || 's' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS duration FROM (SELECT p_partkey, CAST(floor(p_partkey * 977 / 1000.0 + 0.5) AS BIGINT) AS s FROM part)")
def duration_text(spark, d):
    return b.table(spark, d, "part").select("p_partkey", text.duration(F.col("p_partkey") * 977).alias("duration"))


# outcomes


@query(f"SELECT p_partkey, {_DISP.format(s='s', e='e')} AS disposition FROM (SELECT p_partkey, {_ST.format(k='p_partkey')} AS s, {_ERR.format(k='p_partkey')} AS e FROM part)")
def disposition(spark, d):
    key = F.col("p_partkey")
    return b.table(spark, d, "part").select("p_partkey", http.disposition(b.status(key), b.error(key)).alias("disposition"))


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'blocked' WHEN s BETWEEN 200 AND 399 THEN 'ok' WHEN s IN (401, 403, 405, 406, 408, 409, 429, 451, 999) OR s BETWEEN 500 AND 599 THEN 'blocked' WHEN s = 0 THEN CASE WHEN e ILIKE '%timeout%' THEN 'blocked' WHEN e = 'ENOTFOUND' THEN 'broken' ELSE 'blocked' END ELSE 'broken' END AS disposition "
    f"FROM (SELECT p_partkey, {_ST.format(k='p_partkey')} AS s, {_ERR.format(k='p_partkey')} AS e FROM part)"
)
def render_disposition(spark, d):
    key = F.col("p_partkey")
    return b.table(spark, d, "part").select("p_partkey", http.render_disposition(b.status(key), b.error(key), F.when(key % 6 == 0, "Just a moment...").otherwise("Parts")).alias("disposition"))


@query(
    "SELECT p_partkey, CASE WHEN doubtful AND gs > 0 THEN gs ELSE hs END AS status, CASE WHEN doubtful AND gs > 0 THEN ge WHEN doubtful AND hs = 0 THEN coalesce(nullif(ge, ''), he) ELSE he END AS error FROM "
    f"(SELECT p_partkey, {_ST.format(k='p_partkey')} AS hs, {_ERR.format(k='p_partkey')} AS he, {_ST.format(k='p_partkey + 4')} AS gs, {_ERR.format(k='p_partkey + 4')} AS ge, coalesce(he, '') <> '' OR hs IN (0, 400, 403, 405, 406, 429, 501) OR hs >= 500 AS doubtful FROM part)"
)
def probe_head_get(spark, d):
    key = F.col("p_partkey")
    s, e = http.probe(b.status(key), b.error(key), b.status(key + 4), b.error(key + 4))
    return b.table(spark, d, "part").select("p_partkey", s.alias("status"), e.alias("error"))


@query(f"WITH {_FL}, {_out('o1', 1)}, {_judged('j', 'o1')} SELECT fl.url, CASE WHEN disposition = 'broken' AND verdict = 'blocked' THEN detail ELSE reason END AS reason, source, kind, CASE WHEN disposition = 'broken' AND verdict = 'blocked' THEN 'blocked' ELSE disposition END AS disposition FROM fl JOIN j ON fl.url = j.url WHERE NOT (disposition = 'broken' AND verdict = 'ok')")
def recheck_reconcile(spark, d):
    return outcomes.second_pass(b.flagged(spark, d), b.outcomes(spark, d, 1))


@query(f"WITH {_FL}, {_out('o1', 1)}, {_judged('j', 'o1')} SELECT count(*) FILTER (verdict = 'ok') AS fixed, count(*) FILTER (verdict = 'blocked') AS moved, count(*) FILTER (verdict = 'broken') AS still_broken FROM fl JOIN j ON fl.url = j.url WHERE disposition = 'broken'")
def recheck_tallies(spark, d):
    return outcomes.recheck_tallies(b.flagged(spark, d), b.outcomes(spark, d, 1))


@query(
    f"WITH {_FL}, {_out('o2', 2)}, {_judged('j', 'o2')}, m AS (SELECT *, {_MATCH} AS suppressed FROM fl) SELECT url, reason, source, kind, disposition FROM m WHERE suppressed AND disposition = 'broken' UNION ALL "
    "SELECT m.url, CASE WHEN kind = 'external' AND verdict = 'broken' THEN 'external unreachable (' || detail || ')' ELSE detail END, source, kind, verdict FROM m JOIN j ON m.url = j.url WHERE NOT (suppressed AND disposition = 'broken') AND verdict <> 'ok'"
)
def reprobe_merge(spark, d):
    return outcomes.reprobe(allowlist.split_active(b.flagged(spark, d), PATTERNS), b.outcomes(spark, d, 2))


@query(f"WITH {_LK}, {_out('o1', 1)}, {_judged('j', 'o1')} SELECT DISTINCT target AS url, CASE verdict WHEN 'broken' THEN 'err' ELSE verdict END AS status FROM lk LEFT JOIN j ON target = url WHERE link_class = 'external'")
def external_check(spark, d):
    status, _ = outcomes.check_external(classify.external_destinations(b.links(spark, d)), b.outcomes(spark, d, 1), classify.first_referrer(b.refs(spark, d)))
    return status.select("url", "status")


@query(
    f"WITH {_LK}, {_REFS}, {_out('o1', 1)}, {_judged('j', 'o1')}, s AS (SELECT target, arg_min(referrer, seen) AS source FROM refs WHERE target LIKE 'https://ext%' GROUP BY 1) "
    "SELECT url, CASE WHEN verdict = 'broken' THEN 'external unreachable (' || detail || ')' ELSE detail END AS reason, source, 'external' AS kind, verdict AS disposition FROM s JOIN j ON target = url WHERE verdict <> 'ok'"
)
def external_flagged(spark, d):
    return outcomes.check_external(classify.external_destinations(b.links(spark, d)), b.outcomes(spark, d, 1), classify.first_referrer(b.refs(spark, d)))[1]


def _rendered(spark, d):
    return b.outcomes(spark, d, 1).select("url", http.disposition(F.col("status"), F.col("error")).alias("disposition"))


_APPLIED = f"{_FL}, {_out('o1', 1)}, {_judged('j', 'o1')}, ap AS (SELECT fl.url, CASE WHEN disposition = 'broken' AND verdict = 'blocked' THEN 'blocked in browser (' || reason || ')' ELSE reason END AS reason, source, kind, CASE WHEN disposition = 'broken' AND verdict = 'blocked' THEN 'blocked' ELSE disposition END AS disposition FROM fl LEFT JOIN j ON fl.url = j.url WHERE coalesce(verdict, '') <> 'ok')"


@query(f"WITH {_APPLIED} SELECT * FROM ap")
def render_apply(spark, d):
    return outcomes.apply_verdicts(b.flagged(spark, d), _rendered(spark, d))


@query(f"WITH {_APPLIED} SELECT CAST(7 AS BIGINT) AS \"brokenLinkInstances\", count(*) FILTER (disposition = 'broken' AND kind <> 'external') AS \"errorsInternal\", count(*) FILTER (disposition = 'broken' AND kind = 'external') AS \"errorsExternal\", count(*) FILTER (disposition = 'blocked') AS blocked FROM ap")
def summary_after_render(spark, d):
    saved = spark.range(1).select(*(F.lit(n).cast("long").alias(c) for c, n in (("brokenLinkInstances", 7), ("errorsInternal", 1), ("errorsExternal", 2), ("blocked", 3))))
    return measures.after_render(saved, outcomes.apply_verdicts(b.flagged(spark, d), _rendered(spark, d)))


@query(f"WITH {_out('o1', 1)}, {_judged('j', 'o1')} SELECT count(*) FILTER (verdict = 'ok') AS ok, count(*) FILTER (verdict = 'broken') AS broken, count(*) FILTER (verdict = 'blocked') AS blocked FROM j")
def render_counts(spark, d):
    return outcomes.verdict_counts(_rendered(spark, d))


@query(f"WITH {_FL} SELECT url, CASE disposition WHEN 'broken' THEN 'error:' ELSE 'blocked:' END || kind AS kind, reason AS was FROM fl")
def suspects_dedup(spark, d):
    rows = b.flagged(spark, d)
    return outcomes.suspects(None, None, rows.unionByName(rows.withColumn("disposition", F.lit("blocked"))).unionByName(rows.withColumns({"url": F.lit("ftp://x/"), "kind": F.lit("internal")})))


# graph


def _edges(spark, d):
    e = b.table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _bfs(spark, d, depth, most=None):
    edges = Tables(spark).write(_edges(spark, d), "edges")
    return graph.bfs(edges, spark.createDataFrame([("p1",)], "node string"), depth, most, ordered=False)


@query(f"WITH {_BFS.format(d=3)} SELECT node, depth FROM g")
def bfs_depth(spark, d):
    return _bfs(spark, d, 3).select("node", "depth")


@query(f"WITH {_BFS.format(d=2)} SELECT dst AS node FROM e JOIN g ON src = node EXCEPT SELECT node FROM g")
def bfs_frontier(spark, d):
    """What a crawl of depth 2 has seen as links but never queued; it still counts as referred to."""
    reached = _bfs(spark, d, 2)
    out = _edges(spark, d).join(reached.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
    return out.join(reached.select("node"), "node", "left_anti")


@query(f"WITH {_BFS.format(d=4)} SELECT depth, count(*) AS n FROM g GROUP BY 1")
def bfs_levels(spark, d):
    return _bfs(spark, d, 4).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_BFS.format(d=3)} SELECT least(100, count(*)) AS n, CAST(max(depth) FILTER (rn <= 100) AS INTEGER) AS deepest FROM (SELECT depth, row_number() OVER (ORDER BY depth) AS rn FROM g)")
def url_cap(spark, d):
    return _bfs(spark, d, 3, 100).agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"))


# triage and fixes


@query(
    f"WITH {_VD}, c AS (SELECT *, CASE WHEN disposition = 'broken' THEN verdict <> 'working' ELSE verdict = 'broken' END AS counts FROM vd) SELECT count(*) FILTER (counts) AS instances, count(*) FILTER (counts AND kind <> 'external') AS internal, count(*) FILTER (counts AND kind = 'external') AS external, "
    "count(*) FILTER (kind <> 'external') AS internal_all, count(*) FILTER (kind <> 'external' AND verdict <> 'untriaged') AS internal_tested, count(*) FILTER (kind = 'external') AS external_all, count(*) FILTER (kind = 'external' AND verdict <> 'untriaged') AS external_tested, "
    "count(*) FILTER (disposition = 'blocked') AS blocked_all, count(*) FILTER (disposition = 'blocked' AND verdict <> 'untriaged') AS blocked_tested, count(DISTINCT source) FILTER (counts) AS pages FROM c"
)
def triage_stats(spark, d):
    rows = b.verdicts(spark, d)
    return triage.triage_stats(rows.drop("source"), rows.select(F.col("url").alias("target"), F.col("source").alias("referrer")))


@query(f"WITH {_VD} SELECT source AS key, count(*) AS n, count(*) FILTER (verdict <> 'untriaged') AS tested, count(*) FILTER (verdict = 'broken') AS broken, count(*) FILTER (verdict = 'working') AS working, bool_and(verdict = 'broken') AS all_broken, bool_and(verdict = 'working') AS all_working, bool_or(verdict = 'broken') AND bool_or(verdict = 'working') AS mixture, bool_and(verdict <> 'untriaged') AS all_tested FROM vd GROUP BY 1")
def group_header(spark, d):
    return triage.group_headers(b.verdicts(spark, d), F.col("source"))


@query(f"WITH {_VD} SELECT kind, disposition, count(*) AS n, count(*) FILTER (verdict <> 'untriaged') AS tested, count(*) FILTER (verdict = 'broken') AS broken, count(*) FILTER (verdict = 'working') AS working, CASE WHEN count(*) FILTER (verdict <> 'untriaged') >= count(*) THEN 'green' ELSE 'amber' END AS outline FROM vd GROUP BY 1, 2")
def triage_counters(spark, d):
    rows = triage.triage_counters(b.verdicts(spark, d), ["kind", "disposition"])
    return rows.withColumn("outline", triage.completeness(F.col("tested"), F.col("n")))


def _pairs(spark, d):
    """(page, link) pairs of all line items; a link is working by its part key, a pair fixed by its line."""
    key = F.col("l_partkey")
    rows = b.table(spark, d, "lineitem").select(F.format_string("https://site.example/o%d", "l_orderkey").alias("page"), b.url(key).alias("url"), b.kind(key).alias("kind"), F.when(key % 7 == 0, "working").otherwise("broken").alias("verdict"), (F.col("l_linenumber") % 2 == 0).alias("fixed"))
    return rows.groupBy("kind", "url", "verdict", "page").agg(F.bool_or("fixed").alias("fixed"))


_PAIRS = f"pr AS (SELECT 'https://site.example/o' || l_orderkey AS page, {_URL.format(k='l_partkey')} AS url, {_KIND.format(k='l_partkey')} AS kind, CASE WHEN l_partkey % 7 = 0 THEN 'working' ELSE 'broken' END AS verdict, bool_or(l_linenumber % 2 = 0) AS fixed FROM lineitem GROUP BY 1, 2, 3, 4)"


@query(
    f"WITH {_PAIRS}, op AS (SELECT * FROM pr WHERE verdict <> 'working'), l AS (SELECT kind, url, bool_and(fixed) AS af FROM op GROUP BY 1, 2), p AS (SELECT page, bool_and(fixed) AS af FROM op GROUP BY 1) SELECT (SELECT count(*) FROM op) AS broken_instances, (SELECT count(*) FROM op WHERE fixed) AS fixed_instances, "
    "(SELECT count(*) FROM l WHERE kind = 'internal') AS broken_internal, (SELECT count(*) FROM l WHERE kind = 'external') AS broken_external, (SELECT count(*) FROM l WHERE kind = 'internal' AND af) AS fixed_internal, (SELECT count(*) FROM l WHERE kind = 'external' AND af) AS fixed_external, (SELECT count(*) FROM p) AS broken_pages, (SELECT count(*) FROM p WHERE af) AS fixed_pages"
)
def fix_matrix(spark, d):
    return triage.fix_matrix(_pairs(spark, d))


@query(f"WITH {_PAIRS} SELECT page, count(*) AS n, count(*) FILTER (fixed) AS fixed, count(*) FILTER (fixed OR verdict = 'working') AS resolved, bool_or(NOT fixed AND verdict <> 'working') AS needs_attention FROM pr GROUP BY 1")
def by_page(spark, d):
    return triage.sections(_pairs(spark, d), "page")


@query(f"WITH {_PAIRS} SELECT url, count(*) AS n, count(*) FILTER (fixed) AS fixed, count(*) FILTER (fixed OR verdict = 'working') AS resolved, bool_or(NOT fixed AND verdict <> 'working') AS needs_attention FROM pr GROUP BY 1")
def by_link(spark, d):
    return triage.sections(_pairs(spark, d), "url")


@query(f"WITH {_PAIRS} SELECT count(*) FILTER (fixed) AS fixed, count(*) AS total FROM pr")
def fix_progress(spark, d):
    return triage.fix_progress(_pairs(spark, d))


@query(f"WITH {_PAIRS} SELECT page AS \"group\", regexp_replace(regexp_replace(page, '^.*?://', ''), '[^A-Za-z0-9._-]', '_', 'g') AS file, CAST(1 AS BIGINT) AS pages, count(*) AS links FROM pr GROUP BY 1, 2 HAVING bool_or(verdict <> 'working')")
def bulk_export_groups(spark, d):
    return triage.export_groups(_pairs(spark, d), "page")


@query(
    f"WITH {_FL}, {_LK}, {_REFS}, {_NREF}, t AS (SELECT *, CASE WHEN p % 6 = 0 THEN 'working' WHEN p % 6 = 1 THEN 'broken' ELSE 'untriaged' END AS v FROM (SELECT *, CAST(regexp_extract(url, '([0-9]+)$', 1) AS BIGINT) AS p, {_MATCH} AS suppressed FROM fl)) "
    "SELECT kind AS part, url, reason, CASE WHEN n IS NULL THEN CASE WHEN source = '' THEN 0 ELSE 1 END ELSE n END AS refs, v FROM t LEFT JOIN nr ON url = target WHERE v <> 'working' AND NOT (suppressed AND disposition = 'broken')"
)
def tracker_data(spark, d):
    p = F.regexp_extract("url", r"(\d+)$", 1).cast("long")
    rows = allowlist.split_active(b.flagged(spark, d), PATTERNS).withColumns({"verdict": F.when(p % 6 == 0, "working").when(p % 6 == 1, "broken").otherwise("untriaged"), "verdict_ts": F.lit(None).cast("string")})
    return triage.tracker_counts(rows, classify.referrer_counts(b.refs(spark, d))).select("part", "url", "reason", "refs", "v")


# state


_STATES = "kv AS (SELECT user_id % 20 AS pos, CASE WHEN event_id % 9 = 0 THEN 'other:' ELSE 'cwfix:h0:' END || (event_id % 300) AS key, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY 1, 2), ok AS (SELECT * FROM kv WHERE pos % 7 <> 3 AND pos % 5 <> 4 AND key LIKE 'cwfix:h0:%')"


@query(f"WITH {_STATES} SELECT key, arg_max(value, pos) AS value FROM ok GROUP BY 1")
def state_merge(spark, d):
    return triage.merge_states(b.states(spark, d))


@query(f"WITH {_STATES}, f AS (SELECT DISTINCT pos FROM kv) SELECT count(*) FILTER (pos % 7 <> 3 AND pos % 5 <> 4) AS merged, count(*) FILTER (pos % 7 <> 3 AND pos % 5 = 4) AS skipped_host, count(*) FILTER (pos % 7 = 3) AS skipped_bad, (SELECT count(*) FROM ok) AS entries FROM f")
def merge_report(spark, d):
    return triage.merge_report(b.states(spark, d))


@query(
    "WITH st AS (SELECT doc_id AS u, CASE WHEN toxic = 1 THEN 'broken' ELSE 'ok' END AS family, 'old' AS value FROM labels), inc AS (SELECT DISTINCT user_id AS u, CASE WHEN user_id % 2 = 0 THEN 'broken' ELSE 'ok' END AS family, 'new' AS value FROM events) "
    "SELECT family, 'https://site.example/' || u AS url, value FROM st WHERE u NOT IN (SELECT u FROM inc) UNION ALL SELECT family, 'https://site.example/' || u, value FROM inc"
)
def verdict_import(spark, d):
    at = lambda c: F.format_string("https://site.example/%d", c).alias("url")
    stored = b.table(spark, d, "labels").select(F.when(F.col("toxic") == 1, "broken").otherwise("ok").alias("family"), at("doc_id"), F.lit("old").alias("value"))
    new = b.table(spark, d, "events").select("user_id").distinct().select(F.when(F.col("user_id") % 2 == 0, "broken").otherwise("ok").alias("family"), at("user_id"), F.lit("new").alias("value"))
    return triage.import_verdicts(stored, new)


# journal and log


@query(f"WITH {_EV}, {_DONE} SELECT u AS url, CASE WHEN t = 'p' THEN 'title' ELSE '(non-HTML: image/png)' END AS title, CASE WHEN t = 'p' THEN 200 END AS status, CAST(d AS INTEGER) AS depth, CAST(t = 'p' AS BIGINT) AS internal, CAST(t = 'p' AS BIGINT) AS external FROM done WHERE t IN ('p', 'k')")
def journal_pages(spark, d):
    return journal.pages(journal.completions(b.journal(spark, d)))


@query(
    f"WITH {_EV}, {_DONE}, q AS (SELECT 'https://site.example/u' || o AS url, min(line) AS line FROM done WHERE t = 'p' AND d < 2 GROUP BY 1), f AS (SELECT q.url, CAST(done.d + 1 AS INTEGER) AS depth, done.u AS parent FROM q JOIN done ON q.line = done.line WHERE q.url NOT IN (SELECT u FROM done) AND q.url <> 'https://site.example/'), "
    "s AS (SELECT u, count(DISTINCT n) AS n FROM (SELECT u, (SELECT count(*) FROM ev r WHERE r.t = 'r' AND r.line < ev.line) AS n FROM ev WHERE t = 'v') GROUP BY 1) SELECT 'https://site.example/' AS url, 0 AS depth, '(start)' AS parent UNION ALL SELECT url, depth, parent FROM f LEFT JOIN s ON url = u WHERE coalesce(n, 0) < 2"
)
def journal_fold(spark, d):
    """The frontier to resume from."""
    return journal.fold(b.journal(spark, d), b.START, 2)["frontier"]


@query(f"WITH {_EV}, {_DONE}, s AS (SELECT u, count(DISTINCT n) AS n FROM (SELECT u, (SELECT count(*) FROM ev r WHERE r.t = 'r' AND r.line < ev.line) AS n FROM ev WHERE t = 'v') GROUP BY 1) SELECT u AS url, n AS sessions FROM s WHERE n >= 2 AND u NOT IN (SELECT u FROM ev WHERE t = 'p')")
def quarantine(spark, d):
    """Urls visited in two or more sessions and never completed; here only pages complete, the other completions are left out of the journal."""
    return journal.quarantined(b.journal(spark, d).where(F.col("t").isin("v", "r", "p")))


@query(f"WITH {_EV}, {_DONE} SELECT count(*) AS crawled, count(*) FILTER (t = 'p') AS good, count(*) FILTER (t = 'e') AS broken, count(*) FILTER (t = 'b') AS blocked, count(DISTINCT CASE WHEN t = 'p' THEN o % 50 END) AS external FROM done")
def resume_stats(spark, d):
    return journal.resume_stats(b.journal(spark, d))


@query(f"WITH {_EV}, {_DONE}, f AS (SELECT o % 50 AS x, min(line) AS line FROM done WHERE t = 'p' GROUP BY 1) SELECT line, (SELECT count(*) FROM f WHERE f.line <= done.line) AS total FROM done WHERE t = 'p'")
def running_totals(spark, d):
    return journal.running_external(b.journal(spark, d))


@query(
    "SELECT count(*) FILTER (event_type <> 'view') AS crawled, count(*) FILTER (event_type = 'click') AS good, count(*) FILTER (event_type = 'error') AS broken, count(*) FILTER (event_type = 'purchase' OR event_type = 'view' AND event_id % 4 = 1) AS blocked, max(event_id) FILTER (event_type = 'click') AS external, "
    "max(event_id) FILTER (event_type = 'view') AS ext_checked, CAST(99999 AS BIGINT) AS ext_total, count(*) FILTER (event_type = 'view' AND event_id % 4 = 0) AS ext_bad FROM events"
)
def log_counters(spark, d):
    return progress.counters(progress.parse(b.log_lines(spark, d))).select("crawled", "good", "broken", "blocked", "external", "ext_checked", "ext_total", "ext_bad")


@query(
    "SELECT event_id AS line, CASE event_type WHEN 'click' THEN 'OK  d1 200 https://site.example/u' || user_id || ' int=2 ext=1 extTotal=' || event_id WHEN 'error' THEN 'ERR  https://site.example/u' || user_id || ' :: HTTP 404 :: found on x' WHEN 'purchase' THEN 'BLOCKED  https://site.example/u' || user_id || ' :: HTTP 403 :: found on x' "
    "ELSE 'SKIP  https://site.example/u' || user_id || ' :: image/png' END AS text FROM events WHERE event_type <> 'view' ORDER BY event_id DESC LIMIT 5"
)
def last5(spark, d):
    """The newest five result lines; the limit is the feature."""
    return progress.recent(progress.parse(b.log_lines(spark, d)))


@query("SELECT CAST(event_id // 1000 AS INTEGER) AS part, count(*) AS lines, CAST(sum(length('event ' || event_id) + 1) AS BIGINT) AS bytes FROM events GROUP BY 1")
def log_parts(spark, d):
    rows = b.table(spark, d, "events").select(F.floor(F.col("event_id") / 1000).cast("int").alias("part"), F.format_string("event %d", "event_id").alias("value"))
    return writers.manifest(rows)


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST((row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) + 999) // 1000 AS BIGINT) AS page FROM lineitem")
def page_number(spark, d):
    rows = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return classify.page_numbers(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "page")


# pacing, robots, documents


@query("SELECT p_partkey, least(300000.0, 5000.0 * pow(2, p_partkey % 12)) AS wait FROM part")
def backoff_formula(spark, d):
    return b.table(spark, d, "part").select("p_partkey", http.backoff(F.col("p_partkey") % 12 + 1, F.lit(0), 300_000).alias("wait"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(least(p_partkey % 400 * 1000, 300000) AS DOUBLE) WHEN p_partkey % 3 = 1 THEN CAST(30000 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS wait FROM part")
def retry_after(spark, d):
    key = F.col("p_partkey")
    value = F.when(key % 3 == 0, (key % 400).cast("string")).when(key % 3 == 1, "Wed, 21 Oct 2015 07:28:30 GMT").otherwise("soon")
    return b.table(spark, d, "part").select("p_partkey", http.retry_after(value, F.to_timestamp(F.lit("2015-10-21 07:28:00")), 300_000).alias("wait"))


@query("WITH RECURSIVE r AS (SELECT user_id, event_id, CAST(epoch_us(ts) AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), s AS (SELECT user_id, event_id, i, t AS slot FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.event_id, r.i, greatest(r.t, s.slot + 600000000.0) FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1) SELECT event_id, slot FROM s")
def rate_slots(spark, d):
    """Starts in microseconds with ten minutes between requests of a user."""
    rows = b.table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    return progress.rate_slots(rows, 600_000_000.0, "user_id", "t").select("event_id", "slot")


@query(
    "WITH RECURSIVE r AS (SELECT user_id, event_id, event_type = 'error' AS th, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), s AS (SELECT user_id, event_id, i, CAST(CASE WHEN th THEN 1 ELSE 0 END AS BIGINT) AS streak FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.event_id, r.i, CASE WHEN r.th THEN s.streak + 1 ELSE greatest(s.streak - 1, 0) END FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1) SELECT event_id, streak FROM s"
)
def throttle_streak(spark, d):
    rows = b.table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("throttled"))
    return progress.streak(rows, "user_id", "event_id").select("event_id", "streak")


ROBOTS = "User-agent: *\nCrawl-delay: 9\n\nUser-agent: linkloom # ours\nUser-agent: other\nDisallow: /x\nCrawl-delay: 5s\n\nUser-agent: other\nCrawl-delay: 7\n"


@query("SELECT n_nationkey, CAST(CASE n_nationkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 9 ELSE 0 END AS DOUBLE) AS delay FROM nation")
def robots_delay(spark, d):
    """A robots.txt per nation: with a group for us, with only one for all, and empty."""
    key = F.col("n_nationkey")
    body = F.when(key % 3 == 0, ROBOTS).when(key % 3 == 1, "User-agent: *\nCrawl-delay: 9\nUser-agent: bot\nCrawl-delay: 1").otherwise("# nothing")
    lines = b.table(spark, d, "nation").select("n_nationkey", F.posexplode(F.split(body, "\n")).alias("line", "value"))
    return readers.robots_delay(lines, "linkloom/1.0", ["n_nationkey"])


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'ooxml' WHEN 2 THEN 'ole' WHEN 3 THEN 'pdf' WHEN 4 THEN 'ooxml' WHEN 5 THEN 'ole' END AS doc_type, CASE p_partkey % 7 WHEN 6 THEN 'html' ELSE 'doc' END AS gate FROM part")
def doc_type(spark, d):
    key = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ("application/pdf", "application/vnd.openxmlformats-officedocument", "application/msword", "", "", "", "text/html")))
    paths = F.array(*map(F.lit, ("/a", "/a", "/a", "/a.PDF", "/b.docx", "/c.xls", "/d.html")))
    at = (key % 7).cast("int")
    return b.table(spark, d, "part").select("p_partkey", http.document_type(F.get(kinds, at), F.get(paths, at)).alias("doc_type"), http.content_gate(F.get(kinds, at), F.get(paths, at)).alias("gate"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'ooxml' WHEN 2 THEN 'ole' END AS magic FROM part")
def magic(spark, d):
    heads = F.array(*(F.unhex(F.lit(x)) for x in ("255044462D", "504B0304", "D0CF11E0A1", "00000000", "2550")))
    return b.table(spark, d, "part").select("p_partkey", http.sniff(F.get(heads, (F.col("p_partkey") % 5).cast("int"))).alias("magic"))


@query("SELECT 'https://site.example/' || p_partkey || '.pdf' AS page_url, 'pdf' AS doc_type, CAST(2 AS BIGINT) AS n, unnest(['https://a.example/' || p_partkey || '?x=(1)&y', 'https://site.example/b']) AS href FROM part")
def pdf_links(spark, d):
    """Each part's PDF: a link with escaped brackets, a relative link, a repeated one, a mail address."""
    body = F.concat(F.lit("%PDF-1.4 /URI (https://a.example/"), F.col("p_partkey").cast("string"), F.lit("?x=\\(1\\)&y) /URI(/b) /URI (/b.) /URI (mailto:x@y)"))
    docs = b.table(spark, d, "part").select(F.format_string("https://site.example/%d.pdf", "p_partkey").alias("url"), body.cast("binary").alias("doc"), F.lit(None).cast("string").alias("doc_type"))
    return extract.document_links(docs).select("page_url", "doc_type", "n", "href")
