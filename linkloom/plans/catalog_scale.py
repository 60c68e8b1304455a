"""Queries of what must hold for tables of any size and shape: ranks, several sites, pattern lists, hot keys, options."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import http, schemas, text
from linkloom.operators import allowlist, classify, graph
from linkloom.operators.ranks import ranked
from linkloom.plans import bindings as b
from linkloom.plans.catalog import _LK, _REFS, _URL, query
from linkloom.plans.catalog_more import _ANCHORS, _responses
from linkloom.plans.config import CrawlConfig
from linkloom.sources import readers, writers
from linkloom.sources.shared import Tables, new_path

# ranks and pages


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, CAST(l_shipdate AS VARCHAR)[1:10] AS shipped, "
    "row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem"
)
def occurrence_ranks(spark, d):
    """The rank of every link occurrence, with columns that take no part in the order."""
    rows = b.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "date_format(l_shipdate, 'yyyy-MM-dd') AS shipped")
    return ranked(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query(
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_discount, CAST((row_number() OVER (PARTITION BY CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey END ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) + 99) // 100 AS BIGINT) AS page FROM lineitem"
)
def pages_by_group(spark, d):
    """Page numbers that restart per group, one of which has a third of all rows."""
    rows = b.table(spark, d, "lineitem").selectExpr("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "CASE WHEN l_suppkey % 3 = 0 THEN 0L ELSE l_suppkey END AS grp")
    return classify.page_numbers(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 100, ["grp"]).drop("grp")


# pattern lists


@query(f"SELECT {_URL.format(k='p_partkey')} AS url, p_partkey % 4 = 1 OR (p_partkey % 3 <> 0 AND p_partkey % 11 = 4 AND right(CAST(p_partkey AS VARCHAR), 1) = '6') AS suppressed FROM part")
def allowlist_wild_heads(spark, d):
    """A pattern for every fourth part, all of one head: ``https://*/p1``; each joins by its tail."""
    parts = b.table(spark, d, "part")
    patterns = parts.where("p_partkey % 4 = 1").select(F.format_string("https://*/p%d", "p_partkey").alias("pattern"))
    patterns = patterns.unionByName(spark.createDataFrame([("https://*/d4/*6",), ("https://*/nowhere/*",)], "pattern string"))
    return allowlist.split_by_table(parts.select(b.url(F.col("p_partkey")).alias("url")), patterns).select("url", "suppressed")


# long lists in chunks


@query(
    f"WITH {_LK}, {_REFS}, r AS (SELECT CASE WHEN target LIKE '%/d4/%' THEN 'https://site.example/hot' ELSE target END AS target, referrer, min(seen) AS seen FROM refs GROUP BY 1, 2), "
    "p AS (SELECT *, (row_number() OVER (PARTITION BY target ORDER BY seen, referrer) - 1) // 50 AS chunk FROM r) SELECT target, CAST(chunk AS BIGINT) AS chunk, max(max(chunk)) OVER (PARTITION BY target) + 1 AS chunks, string_agg(referrer, ' ' ORDER BY seen, referrer) AS found_on FROM p GROUP BY target, chunk"
)
def referrer_chunks(spark, d):
    """The referrers of each target in chunks of 50, one target having many."""
    edges = b.refs(spark, d).withColumn("target", F.when(F.col("target").like("%/d4/%"), "https://site.example/hot").otherwise(F.col("target")))
    edges = edges.groupBy("target", "referrer").agg(F.min("first_seen").alias("first_seen"))
    return classify.referrer_chunks(edges, 50).withColumn("found_on", F.array_join("found_on", " "))


@query(f"WITH g AS (SELECT regexp_extract(url, 'https?://[^/]+/(d?)', 0) AS key, url FROM (SELECT {_URL.format(k='p_partkey')} AS url FROM part)), p AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, (row_number() OVER (PARTITION BY key ORDER BY url) - 1) // 40 AS chunk FROM g) SELECT key, n, CAST(chunk AS BIGINT) AS chunk, string_agg(url, ' ' ORDER BY url) AS items FROM p GROUP BY ALL")
def group_chunks(spark, d):
    """Urls by host in chunks of 40; one host has two thirds of them."""
    urls = b.table(spark, d, "part").select(b.url(F.col("p_partkey")).alias("url"))
    return classify.group_chunks(urls, F.regexp_extract("url", "https?://[^/]+/(d?)", 0), size=40).withColumn("items", F.array_join("items", " "))


# several sites


_SITES = (CrawlConfig(start_url="https://s0.example/p1", max_pages=40, max_depth=2, max_urls=0), CrawlConfig(start_url="https://s1.example/p2", max_pages=9, max_depth=1, max_urls=0), CrawlConfig(start_url="https://s2.example/p5", max_pages=None, max_depth=1), CrawlConfig(start_url="https://s0.example/p5", max_pages=3, max_depth=2))
_OF_SITES = (
    f"{_ANCHORS}, ok AS (SELECT src, count(*) AS internal FROM e WHERE CAST(regexp_extract(src, '([0-9]+)$', 1) AS BIGINT) % 10 NOT IN (3, 4, 7) OR src = 'p7' GROUP BY 1), "
    "st AS (SELECT unnest([0, 1, 2, 3]) AS site, unnest(['p1', 'p2', 'p5', 'p5']) AS start, unnest([2, 1, 1, 2]) AS deep, unnest([40, 9, 1000000, 3]) AS most, unnest(['s0', 's1', 's2', 's0']) AS host), "
    "l0 AS (SELECT site, start AS node, 0 AS depth, CAST(1 AS BIGINT) AS rank, deep, most, host FROM st), "
    "f1 AS (SELECT site, dst AS node, min((rank, pos)) AS o, deep, most, host FROM e JOIN l0 ON src = node WHERE src IN (SELECT src FROM ok) AND dst <> node GROUP BY ALL), "
    "l1 AS (SELECT site, node, 1 AS depth, 1 + row_number() OVER (PARTITION BY site ORDER BY o, node) AS rank, deep, most, host FROM f1), s1 AS (FROM l0 UNION ALL FROM l1), n1 AS (SELECT site, count(*) AS n FROM s1 GROUP BY 1), "
    "f2 AS (SELECT site, dst AS node, min((rank, pos)) AS o, deep, most, host FROM e JOIN l1 ON src = node WHERE deep > 1 AND src IN (SELECT src FROM ok) AND (site, dst) NOT IN (SELECT (site, node) FROM s1) GROUP BY ALL), "
    "l2 AS (SELECT f2.site, node, 2 AS depth, n + row_number() OVER (PARTITION BY f2.site ORDER BY o, node) AS rank, deep, most, host FROM f2 JOIN n1 ON f2.site = n1.site), q AS (SELECT * FROM (FROM s1 UNION ALL FROM l2) WHERE rank <= most)"
)


@query(f"WITH {_OF_SITES} SELECT site, 'https://' || host || '.example/' || node AS url, CAST(depth AS INTEGER) AS depth, internal FROM q JOIN ok ON node = src")
def crawl_sites_pages(spark, d):
    """Pages of four sites, two of them on one host, each with its own depth and cap of pages; the caps are the feature."""
    pages = Tables(spark).write(_responses(spark, d), "responses")
    hosts = spark.createDataFrame([("s0",), ("s1",), ("s2",)], "host string")
    responses = pages.join(hosts).withColumn("url", F.concat(F.lit("https://"), F.col("host"), F.lit(".example/"), F.substring_index("url", "/", -1))).drop("host")
    return graph.crawl_sites(spark, responses, list(_SITES)).pages.select("site", "url", "depth", "internal")


# files read back


@query(
    "WITH s AS (SELECT user_id % 4 AS pos, CASE WHEN event_id % 9 = 0 THEN 'other:' ELSE 'cwfix:h0:' END || (event_id % 300) AS key, max(event_id) AS value FROM events GROUP BY 1, 2) "
    "SELECT CAST(pos AS INTEGER) AS pos, 'crawl-state-' || pos || '.json' AS file, 'linkloom-fixes' AS app, 'h' || (pos % 2) AS host, count(*) AS keys, CAST(sum(value) AS BIGINT) AS total FROM s GROUP BY pos"
)
def state_files(spark, d):
    """Four state files of all events, written and read back in the order of their paths."""
    key = F.format_string("%s%d", F.when(F.col("event_id") % 9 == 0, "other:").otherwise("cwfix:h0:"), F.col("event_id") % 300)
    last = b.table(spark, d, "events").groupBy((F.col("user_id") % 4).alias("pos"), key.alias("key")).agg(F.max("event_id").cast("string").alias("value"))
    last, folder = Tables(spark).write(last, "states"), new_path(spark, "state-files")
    paths = [f"{folder}/crawl-state-{k}.json" for k in range(4)]
    for k, path in enumerate(paths):
        writers.write_file(writers.state_json(last.where(F.col("pos") == k), f"h{k % 2}", "linkloom-fixes"), path)
    total = F.aggregate(F.map_values("v"), F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))
    return readers.states(spark, paths).select("pos", "file", "app", "host", F.size("v").cast("long").alias("keys"), total.alias("total"))


@query("SELECT CAST(event_id % 4 AS INTEGER) + 1 AS part, CAST(row_number() OVER (ORDER BY event_id % 4, event_id) AS BIGINT) AS place, 'event ' || event_id || ' ' || event_type AS value FROM events")
def log_parts_read(spark, d):
    """A log's parts with their heads, written and merged again in the order of their numbers."""
    rows = Tables(spark).write(b.table(spark, d, "events").select("event_id", (F.col("event_id") % 4 + 1).alias("part"), F.format_string("event %d %s", "event_id", "event_type").alias("value")), "log-lines")
    folder = new_path(spark, "log")
    for k in range(1, 5):
        head = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(k).cast("long").alias("part"), F.lit('#META {"part":%d}' % k).alias("value"))  # noqa: UP031
        writers.write_file(rows.where(F.col("part") == k).unionByName(head), f"{folder}/crawl-progress.part{k:03d}.log", ["event_id"])
    return ranked(readers.log_parts(spark, folder), ["part", "line"], "place").select("part", "place", "value")


@query(
    f"WITH f AS (SELECT p_partkey % 5 AS site, {_URL.format(k='p_partkey')} AS url FROM part WHERE p_partkey % 5 < 3), n AS (SELECT unnest([0, 1, 2, 3, 4]) AS site) "
    "SELECT 'site-' || n.site || '.json' AS \"jsonFile\", n.site >= 3 AS missing, CAST(count(url) AS BIGINT) AS errors, string_agg(url, ' ' ORDER BY url) AS urls FROM n LEFT JOIN f ON n.site = f.site GROUP BY n.site"
)
def site_reports(spark, d):
    """The reports that a combined report names, of which two are missing."""
    folder, none = new_path(spark, "sites"), F.array().cast("array<struct<url:string,reason:string,kind:string,foundOn:array<string>>>")
    site = F.col("id").cast("int")
    name = F.format_string("site-%d.json", "id")
    index = spark.range(5).select(site.alias("index"), F.format_string("https://s%d.example/", "id").alias("url"), F.format_string("s%d.example", "id").alias("host"), F.lit("done").alias("status"), F.lit("").alias("reportFile"), name.alias("jsonFile"), F.lit(None).cast(schemas.SUMMARY).alias("summary"), none.alias("errors"), none.alias("blocked"))
    writers.write_file(writers.combined_json(index, "2024-01-01T00:00:00Z"), f"{folder}/index.json")
    parts = b.table(spark, d, "part").select((F.col("p_partkey") % 5).alias("site"), b.url(F.col("p_partkey")).alias("url"))
    for k in range(3):
        errors = F.sort_array(F.collect_list(F.struct("url", F.lit("HTTP 404").alias("reason"), F.lit("internal").alias("kind"), F.array().cast("array<string>").alias("foundOn")))).alias("errors")
        writers.write_file(parts.where(F.col("site") == k).agg(errors).select(F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("crawledAt"), "errors")).alias("value")), f"{folder}/site-{k}.json")
    found, missing = readers.site_reports(spark, f"{folder}/index.json")
    there = found.select("jsonFile", F.lit(False).alias("missing"), F.size("errors").cast("long").alias("errors"), F.array_join("errors.url", " ").alias("urls"))
    return there.unionByName(missing.select("jsonFile", F.lit(True).alias("missing"), F.lit(0).cast("long").alias("errors"), F.lit(None).cast("string").alias("urls")))


# texts of the tables


@query("SELECT p_partkey, '<' || p_name || ' & ' || chr(CAST(160 + p_partkey % 8000 AS INTEGER)) || chr(CAST(160 + p_partkey % 999 AS INTEGER)) || '>' AS text FROM part")
def references_decoded(spark, d):
    """Named, decimal and hexadecimal references around each part's name."""
    n = F.col("p_partkey")
    raw = F.concat(F.lit("&lt;"), F.col("p_name"), F.lit(" &amp; &#"), (160 + n % 8000).cast("string"), F.lit(";&#x"), F.hex(160 + n % 999), F.lit(";&gt;"))
    return b.table(spark, d, "part").select("p_partkey", text.decode_entities(raw).alias("text"))


@query(f"WITH u AS (SELECT p_brand, min({_URL.format(k='p_partkey')}) AS first FROM part GROUP BY 1) SELECT regexp_extract(first, '^https?://([^/]+)', 1) AS host, count(*) AS reports FROM u GROUP BY 1")
def report_hosts(spark, d):
    """The start hosts of a saved report per brand, whose pages are the brand's parts in order."""
    page = F.struct(b.url(F.col("p_partkey")).alias("url"))
    saved = b.table(spark, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(page)).alias("internalPages")).withColumn("errors", F.col("internalPages"))
    return readers.start_host(saved).groupBy("host").agg(F.count(F.lit(1)).alias("reports"))


@query(
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '%PDF-1.' || p_size WHEN 1 THEN 'PK' || chr(3) || chr(4) || p_name WHEN 2 THEN '<html>' || p_name WHEN 3 THEN p_name WHEN 4 THEN '%PDX' || p_name ELSE '' END AS head, "
    "CASE p_partkey % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'ooxml' END AS kind FROM part"
)
def magic_of_parts(spark, d):
    """The types that the first bytes of each part's text tell."""
    n = F.col("p_partkey") % 6
    head = F.when(n == 0, F.concat(F.lit("%PDF-1."), F.col("p_size").cast("string"))).when(n == 1, F.concat(F.lit("PK\x03\x04"), "p_name")).when(n == 2, F.concat(F.lit("<html>"), "p_name")).when(n == 3, F.col("p_name")).when(n == 4, F.concat(F.lit("%PDX"), "p_name")).otherwise("")
    return b.table(spark, d, "part").select("p_partkey", head.alias("head"), http.sniff(head.cast("binary")).alias("kind"))
