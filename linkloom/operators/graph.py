"""Breadth-first crawl over recorded responses or over an edge table, one level at a time.

Each level is a join, a deduplication and an anti-join; what is seen is a store bucketed by key (``seen``),
never held on the driver. Each level is a written table in the cluster's shared folder, which cuts its
lineage. Order within a level is (parent's rank, position), the order of a crawl with one worker, so
first discoverers and caps are well defined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from linkloom.functions import http, urls
from linkloom.operators import classify, extract
from linkloom.operators.ranks import ranked
from linkloom.operators.seen import Seen
from linkloom.plans.config import CrawlConfig
from linkloom.sources import live
from linkloom.sources.control import Control
from linkloom.sources.shared import Tables, new_path

START = "(start)"


def bfs(
    edges: DataFrame | Callable[[DataFrame], DataFrame], starts: DataFrame, max_depth: int | None = None, max_nodes: int | None = None, keys: list[str] | None = None,
    keep_going: Callable[[int], bool] = lambda depth: True, ordered: bool = True, limits: DataFrame | None = None,
) -> DataFrame:
    """(keys..., node, depth, parent, rank) of nodes reached over edges (keys..., src, dst[, pos]).

    keys (such as a site) make independent traversals in one plan: ranks start anew for each, caps hold for
    each, a busy one is dealt over many tasks and small ones share them. The rank is the order of discovery,
    parent the first discoverer. Without ``ordered`` there are no ranks (a sort per level less), the parent
    is the least one of the level before. max_nodes cuts by rank and needs the order; limits (keys...,
    max_depth, max_nodes; null: none) sets both for each key. edges may be a function of a level (keys..., src, _rank) that
    gives its edges (keys..., src, dst, pos, _rank). keep_going is asked before each level, for stop and retune files.
    """
    keys, spark = keys or [], starts.sparkSession
    key, tables, root = [*keys, "node"], Tables(spark), new_path(spark, "levels")
    capped = max_nodes is not None or limits is not None
    ordered = ordered or capped
    if not callable(edges):
        listed = edges if "pos" in edges.columns or not ordered else edges.withColumn("pos", F.xxhash64("dst"))
        expand = lambda level: listed.join(level, [*keys, "src"])
    else:
        expand = edges
    first = starts.select(*key).distinct().withColumn("parent", F.lit(START))
    rows = ranked(first, ["node"], by=keys) if ordered else first.withColumn("rank", F.lit(None).cast("long"))
    kinds, seen, depth, total = rows.select(*key, "parent", "rank").schema, Seen(spark, key), 0, 0
    while True:
        rows.select(*key, "parent", "rank").write.parquet(f"{root}/depth={depth}")
        level = spark.read.schema(kinds).parquet(f"{root}/depth={depth}")
        n = level.count()
        total += n
        stop = n == 0 or (max_depth is not None and depth >= max_depth) or (not keys and max_nodes is not None and total >= max_nodes)
        if stop or not keep_going(depth):
            break
        seen.add(level, n)
        alive = tables.write(_alive(level, keys, depth, max_nodes, limits), "alive") if keys and ordered else None
        going = level if alive is None else level.join(alive, keys, "left_semi")
        out = expand(going.select(*keys, F.col("node").alias("src"), F.col("rank").alias("_rank")))
        discoverer = F.min(F.struct("_rank", "pos", "src") if ordered else F.struct("src"))
        new = out.groupBy(*keys, F.col("dst").alias("node")).agg(discoverer.alias("_first"))
        own = [F.col("_first._rank").alias("_r"), F.col("_first.pos").alias("_p")] if ordered else []
        fresh = seen.fresh(new).select(*key, F.col("_first.src").cast("string").alias("parent"), *own)
        if not ordered:
            rows = fresh.withColumn("rank", F.lit(None).cast("long"))
        else:
            placed = ranked(tables.write(fresh, "fresh"), ["_r", "_p", "node"], by=keys)
            placed = placed.join(alive, keys) if keys else placed.withColumns({"_base": F.lit(total), "_most": F.lit(max_nodes).cast("long")})
            rows = placed.withColumn("rank", F.col("rank") + F.col("_base")).where(F.col("_most").isNull() | (F.col("rank") <= F.col("_most")))
        depth += 1
    seen.close()
    return spark.read.schema(StructType([*kinds, StructField("depth", IntegerType())])).parquet(root).select(*key, "depth", "parent", "rank")


def _alive(level: DataFrame, keys: list[str], depth: int, max_nodes: int | None, limits: DataFrame | None) -> DataFrame:
    """(keys..., _base, _most) of the keys whose next level is wanted: the ranks given so far, which the last level ends with, and the cap."""
    at = level.groupBy(*keys).agg(F.max("rank").alias("_base"))
    if limits is None:
        at = at.withColumns({"_deep": F.lit(None).cast("int"), "_most": F.lit(max_nodes).cast("long")})
    else:
        own = limits.select(*keys, F.col("max_depth").cast("int").alias("_deep"), F.least(F.col("max_nodes").cast("long"), F.lit(max_nodes).cast("long")).alias("_most"))
        at = at.join(own, keys, "left")
    return at.where((F.col("_deep").isNull() | (F.col("_deep") > depth)) & (F.col("_most").isNull() | (F.col("_most") > F.col("_base")))).select(*keys, "_base", "_most")


class Crawl:
    """The tables of a crawl: pages, links, external, out_of_scope, flagged (with disposition), frontier."""

    def __init__(self, **tables: DataFrame):
        self.__dict__.update(tables)


def crawl(spark: SparkSession, responses: DataFrame, config: CrawlConfig) -> Crawl:
    """Crawl recorded responses (see schemas.RESPONSE) from the config's start url.

    A url without a response is an error 'not in corpus'; throttled answers (429, 503) are errors after
    the retries a corpus can't give. Links beyond the depth or the caps still count as referrers.
    """
    done = crawl_sites(spark, responses, [config])
    return Crawl(**{name: table.drop("site") for name, table in vars(done).items()})


def _served(responses: DataFrame) -> DataFrame:
    """Responses by normalized key, the first url's of each."""
    normal = responses.withColumn("key", urls.normalize(urls.canonical(F.col("url"))))
    served = classify.first_wins(normal, ["key"], ["url"])
    kind = F.coalesce(F.col("doc_type"), http.document_type(F.col("content_type"), urls.pathname("url")))
    return served.withColumns({"kind": kind, "too_large": extract.body_verdict(F.col("html"), F.col("doc"))})


def _in_docs(served: DataFrame) -> DataFrame:
    """The links of served documents."""
    return extract.document_links(served.where(_usable() & F.col("html").isNull() & F.col("doc").isNotNull()), "key", "doc", "kind")


def _links(served: DataFrame) -> DataFrame:
    """All links of served pages and documents (in_doc: of a document)."""
    # links go out as the page's normalized key; relative hrefs are resolved on it, as on the requested url
    web = extract.links(served.where(_usable() & F.col("html").isNotNull()), "key", "html").withColumn("in_doc", F.lit(False))
    of_docs = _in_docs(served).where(F.col("href").isNotNull()).select("page_url", "pos", F.col("href").alias("raw_href"), "href", urls.protocol("href").alias("protocol"), urls.hostname("href").alias("host"), urls.pathname("href").alias("path"), F.lit(True).alias("in_doc"))
    return web.unionByName(of_docs)


#: Levels whose pages are looked up among all responses, and pages of a level that are; beyond either all pages' links are taken at once.
LOOKUPS, LOOKED_UP = 4, 1 << 16


class _Web:
    """Links of the pages that a crawl reaches, each page's taken once, in written tables.

    Few pages are looked up by a scan without a shuffle of bodies. A walk of more levels than ``LOOKUPS``, or with a level of more than
    ``LOOKED_UP`` pages, takes the links of all pages left in one scan, so that scans stay few however deep or broad it is.
    """

    def __init__(self, tables: Tables, served: DataFrame):
        self.tables, self.served = tables, served
        self.asked: list[DataFrame] = []
        self.found: list[DataFrame] = []
        self.whole = False

    def of(self, pages: DataFrame) -> DataFrame:
        """The links of (page_url) pages, and of all before."""
        if not self.whole:
            known = reduce(DataFrame.unionByName, self.asked) if self.asked else None
            asked = pages.select("page_url").distinct()
            asked = self.tables.write(asked if known is None else asked.join(known, "page_url", "left_anti"), "asked")
            n = asked.count()
            if n == 0 and self.found:
                return reduce(DataFrame.unionByName, self.found)
            if len(self.asked) < LOOKUPS and n <= LOOKED_UP:
                rest = self.served.join(F.broadcast(asked), F.col("key") == F.col("page_url"), "left_semi")
                self.asked.append(asked)
            else:
                rest = self.served if known is None else self.served.join(known, F.col("key") == F.col("page_url"), "left_anti")
                self.whole = True
            self.found.append(self.tables.write(_links(rest), "web"))
        return reduce(DataFrame.unionByName, self.found)


def _usable() -> Column:
    return (F.coalesce("error", F.lit("")) == "") & (F.col("status") < 400) & F.col("too_large").isNull()


_SITE = "site int, start string, start_host string, prefix string, subdomains boolean, scan_docs boolean, max_retries int, max_depth int, max_pages long, max_nodes long"


def crawl_sites(spark: SparkSession, responses: DataFrame, configs: list[CrawlConfig]) -> Crawl:
    """Independent crawls of several start urls over the same responses in one plan, with the depth, caps, scope and patience of each.

    All tables have the site, its number among the configs. Links are extracted and written once, of pages that are
    reached (see _Web); a level of all sites is one join, and a link is classed for the sites that reach its page only.
    """
    tables = Tables(spark)
    served = tables.write(_served(responses), "served")
    web, in_docs = _Web(tables, served), _in_docs(served)
    listed = [(k, c.start_url, urls_host(c.start_url), c.prefix(), c.include_subdomains, c.scan_docs, c.max_retries, c.max_depth, c.max_pages, c.url_cap()) for k, c in enumerate(configs)]
    sites = tables.write(spark.createDataFrame(listed, _SITE).coalesce(1), "sites")  # of known size, so that joins with few sites need no shuffle
    scope = sites.select("site", "start_host", "prefix", "subdomains", "scan_docs")

    def classed(links: DataFrame) -> DataFrame:
        """Links (site, ...) with their class at their site."""
        own = links.join(scope, "site").where(~F.col("in_doc") | F.col("scan_docs"))
        return classify.classify(own, F.col("start_host"), F.col("prefix"), F.col("subdomains")).drop("start_host", "prefix", "subdomains", "scan_docs", "in_doc")

    def expand(level: DataFrame) -> DataFrame:
        going = tables.write(level.withColumnRenamed("src", "page_url"), "going")
        inner = classed(web.of(going).join(going, "page_url")).where(F.col("link_class") == "internal")
        return inner.select("site", F.col("page_url").alias("src"), F.col("target").alias("dst"), F.col("pos").cast("long").alias("pos"), "_rank")

    first = sites.select("site", urls.normalize(urls.canonical(F.col("start"))).alias("node"))
    reached = bfs(expand, first, keys=["site"], limits=sites.select("site", "max_depth", "max_nodes"))
    bounds = sites.select("site", "max_pages", "max_retries", "scan_docs")
    order = reached.join(bounds, "site").where(F.col("max_pages").isNull() | (F.col("rank") <= F.col("max_pages"))).drop("max_pages")
    order = tables.write(order, "order")
    met = served.join(order.select(F.col("node").alias("key")).distinct(), "key", "left_semi")  # a small order drops the other bodies before they are shuffled
    visited = order.join(met, order.node == met.key, "left")
    said = F.coalesce("error", F.lit(""))
    throttled = F.col("status").isin(429, 503)
    state = F.when(F.col("key").isNull(), "broken").when(said != "", http.disposition(F.lit(0), F.col("error"))).when(F.col("too_large").isNotNull(), "broken").when(throttled, "broken").otherwise(http.disposition(F.col("status"), F.lit(None)))
    gave_up = F.format_string("rate limited (HTTP %d, gave up after %d retries)", "status", "max_retries")
    reason = F.when(F.col("key").isNull(), "not in corpus").when(said != "", F.col("error")).when(F.col("too_large").isNotNull(), F.col("too_large")).when(throttled, gave_up).otherwise(F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    judged = visited.withColumns({"disposition": F.when((F.col("status") < 400) & _usable() & F.col("key").isNotNull(), "ok").otherwise(state), "reason": reason})
    doc_n = in_docs.groupBy("page_url").agg(F.first("doc_type").alias("_kind"), F.first("n").alias("_n"))
    skipped = F.concat(F.lit("(non-HTML: "), F.coalesce(F.nullif("content_type", F.lit("")), F.lit("?")), F.lit(")"))
    title = F.when(F.col("html").isNotNull(), extract.title(F.col("html"))).when(F.col("doc").isNotNull() & F.col("scan_docs"), extract.document_title(F.col("_kind"), F.col("_n"))).otherwise(skipped)
    named = judged.join(doc_n, judged.key == doc_n.page_url, "left").select("site", F.col("node").alias("url"), "depth", "parent", "rank", "status", "disposition", "reason", F.when(F.col("disposition") == "ok", title).alias("title"))
    named = tables.write(named, "judged")  # without the bodies, which are read once for links and once here
    ok = named.where(F.col("disposition") == "ok")
    titled = ok.select("site", "url", "title", "status", "depth")
    done = ok.select("site", F.col("url").alias("page_url"), F.col("rank").alias("page_rank"))
    seen_links = tables.write(classed(web.of(done).join(done, "page_url")), "links")
    by = ["site"]
    return Crawl(
        pages=classify.page_counts(titled, seen_links, by),
        links=seen_links,
        refs=classify.referrers(seen_links, ["page_rank", "pos"], by),
        external=classify.external_destinations(seen_links, by).withColumn("status", F.lit(None).cast("string")),
        out_of_scope=classify.out_of_scope_destinations(seen_links, by),
        flagged=named.where(F.col("disposition") != "ok").select("site", "url", "reason", F.col("parent").alias("source"), F.lit("internal").alias("kind"), "disposition"),
        frontier=reached.join(order.select("site", "node"), ["site", "node"], "left_anti"),
    )


def urls_host(url: str) -> str:
    """The host of a start url, without port."""
    from linkloom.functions import whatwg

    return whatwg.parse(url).host or ""


def crawl_live(spark: SparkSession, config: CrawlConfig, control: Control | None = None) -> Crawl:
    """Fetch a site level by level, then crawl what was fetched.

    Each level's urls are fetched by the executors and written; the control files are looked at between
    levels: a stop ends the walk, a pause waits, a tune file sets the pacing of what follows.
    """
    control, tables = control or Control(config), Tables(spark)
    config = replace(config, crawl_delay=live.crawl_delay(spark, config))
    host = F.lit(urls_host(config.start_url))
    ask = spark.createDataFrame([(config.start_url,)], "url string").select(urls.normalize(urls.canonical(F.col("url"))).alias("url"), F.lit(1).cast("long").alias("rank"))
    got, depth, n = None, 0, 0
    while control.wait():
        config = control.tuned(config)
        if config.max_pages is not None:
            ask = ask.where(F.col("rank") <= config.max_pages)
        level = tables.write(live.fetch_table(ask, config), "responses")
        got, n = level if got is None else got.unionByName(level), n + level.count()
        depth += 1
        if (config.max_depth is not None and depth > config.max_depth) or (config.max_pages is not None and n >= config.max_pages):
            break
        read = level.where((F.col("status") < 400) & (F.coalesce("error", F.lit("")) == "") & extract.body_verdict(F.col("html"), F.col("doc")).isNull())
        in_docs = extract.document_links(read.where(F.col("html").isNull() & F.col("doc").isNotNull())).where(F.col("href").isNotNull())
        found = extract.links(read.where(F.col("html").isNotNull())).select("page_url", "pos", "href").unionByName(in_docs.select("page_url", "pos", "href"))
        web = found.select("page_url", "pos", "href", urls.protocol("href").alias("protocol"), urls.hostname("href").alias("host"), urls.pathname("href").alias("path"))
        inner = classify.classify(web, host, config.prefix(), config.include_subdomains).where(F.col("link_class") == "internal")
        # ranked as bfs ranks them, so that a cap fetches the pages that the crawl judges
        placed = inner.join(ask.select(F.col("url").alias("page_url"), F.col("rank").alias("_rank")), "page_url")
        fresh = placed.groupBy(F.col("target").alias("url")).agg(F.min(F.struct("_rank", F.col("pos").cast("long").alias("pos"))).alias("_first")).join(got.select("url"), "url", "left_anti")
        fresh = tables.write(fresh.select("url", F.col("_first._rank").alias("_r"), F.col("_first.pos").alias("_p")), "fresh")
        ask = tables.write(ranked(fresh, ["_r", "_p", "url"]).select("url", (F.col("rank") + n).cast("long").alias("rank")), "ask")
        if ask.isEmpty():
            break
    return crawl(spark, got if got is not None else live.fetch_table(ask.where("false"), config), config)

