"""Link classes, per-page counts, referrers and destinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import urls
from linkloom.operators.ranks import ranked
from linkloom.sources.shared import Tables


def link_class(host: Column, path: Column, start_host: Column, prefix: str | Column = "", include_subdomains: bool | Column = False) -> Column:
    """internal, out_of_scope (same domain, outside the prefix) or external."""
    return F.when(~urls.same_domain(host, start_host, include_subdomains), "external").when(urls.in_scope(path, prefix), "internal").otherwise("out_of_scope")


def classify(links: DataFrame, start_host: Column, prefix: str | Column = "", include_subdomains: bool | Column = False) -> DataFrame:
    """http(s) links with link_class and target: normalized for internal links, else the href with its fragment."""
    kind = link_class(F.col("host"), F.col("path"), start_host, prefix, include_subdomains)
    typed = links.where(F.col("protocol").isin("http:", "https:")).withColumn("link_class", kind)
    return typed.withColumn("target", F.when(F.col("link_class") == "internal", urls.normalize("href")).otherwise(F.col("href")))


def page_counts(pages: DataFrame, links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pages with internal and external occurrence counts; out-of-scope links count in neither, pages without links have 0. Pages are told apart by the columns of ``by`` too."""
    n = links.groupBy(*(by or []), F.col("page_url").alias("url")).agg(*(F.count_if(F.col("link_class") == c).alias(c) for c in ("internal", "external")))
    return pages.join(n, [*(by or []), "url"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("internal", "external")})


def referrers(links: DataFrame, order: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(by..., target, referrer, first_seen): distinct edges; first_seen orders referrers by the page's rank, then position."""
    rank = F.struct(*(order or ["page_url", "pos"]))
    return links.groupBy(*(by or []), "target", F.col("page_url").alias("referrer")).agg(F.min(rank).alias("first_seen"))


def capped_referrers(edges: DataFrame, most: int = 0) -> DataFrame:
    """At most so many first referrers per target; 0 keeps all."""
    if most <= 0:
        return edges
    order = Window.partitionBy("target").orderBy("first_seen", "referrer")
    return edges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def referrer_lists(edges: DataFrame) -> DataFrame:
    """(target, found_on): all referrers in order of first sight, as report files hold them.

    A list is as long as its target has referrers: for display take ``previews``, for files of any size
    ``referrer_chunks``, for work the edges.
    """
    sorted_ = F.sort_array(F.collect_list(F.struct("first_seen", "referrer")))
    return edges.groupBy("target").agg(F.transform(sorted_, lambda x: x["referrer"]).alias("found_on"))


def referrer_chunks(edges: DataFrame, size: int = 1000) -> DataFrame:
    """(target, chunk, chunks, found_on): the referrers in order of first sight, so many to a chunk. A famous target's are ranked and dealt over many tasks, and no aggregate holds more than a chunk; lists of one chunk need no ranks."""
    tables = Tables(edges.sparkSession)
    counts = tables.write(edges.groupBy("target").agg(F.count(F.lit(1)).alias("_of")).where(F.col("_of") > size).select("target"), "famous")
    sorted_ = lambda order: F.transform(F.sort_array(F.collect_list(F.struct(*order, "referrer"))), lambda x: x["referrer"]).alias("found_on")
    zero, one = F.lit(0).cast("long").alias("chunk"), F.lit(1).cast("long").alias("chunks")
    few = edges.join(counts, edges.target.eqNullSafe(counts.target), "left_anti").groupBy("target").agg(sorted_(["first_seen"])).select("target", zero, one, "found_on")
    if counts.isEmpty():
        return few
    chunk = F.floor((F.col("_rank") - 1) / size).cast("long").alias("chunk")
    famous = edges.join(counts, edges.target.eqNullSafe(counts.target), "left_semi")
    placed = tables.write(ranked(famous, ["first_seen", "referrer"], "_rank", ["target"]).select("target", "referrer", "_rank", chunk), "placed-referrers")
    lists = placed.groupBy("target", "chunk").agg(sorted_(["_rank"]))
    many = lists.join(placed.groupBy("target").agg((F.max("chunk") + 1).alias("chunks")), "target").select("target", "chunk", "chunks", "found_on")
    return few.unionByName(many)


def referrer_counts(edges: DataFrame) -> DataFrame:
    """(target, n): how many referrers a target has, by partial counts; for everything that needs no lists."""
    return edges.groupBy("target").agg(F.count_distinct("referrer").alias("n"))


def preview(found_on: Column, shown: int = 3) -> Column:
    """The first referrers and, beyond, '+N more'."""
    more = F.when(F.size(found_on) > shown, F.array(F.format_string("+%d more", F.size(found_on) - shown))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.slice(found_on, 1, shown), more), "\n")


def previews(edges: DataFrame, shown: int = 3) -> DataFrame:
    """(target, n, found_on) with only the first referrers listed; partial ranks keep lists and shuffles short whatever a target's fame."""
    n = edges.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    first = referrer_lists(capped_referrers(edges, shown))
    return n.join(first, "target")


def preview_text(n: Column, found_on: Column) -> Column:
    """The referrers listed and, for those beyond, '+N more'."""
    listed = F.array_join(found_on, "\n")
    return F.when(n > F.size(found_on), F.concat(listed, F.format_string("\n+%d more", n - F.size(found_on)))).otherwise(listed)


def first_referrer(edges: DataFrame) -> DataFrame:
    """(target, source): the referrer seen first."""
    return edges.groupBy("target").agg(F.min_by("referrer", F.struct("first_seen", "referrer")).alias("source"))


def external_destinations(links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., url, host): distinct external hrefs; the host is a function of the url."""
    return links.where(F.col("link_class") == "external").groupBy(*(by or []), F.col("target").alias("url")).agg(F.min("host").alias("host"))


def out_of_scope_destinations(links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., url): distinct out-of-scope hrefs."""
    return links.where(F.col("link_class") == "out_of_scope").select(*(by or []), F.col("target").alias("url")).distinct()


def first_wins(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where(F.col("_n") == 1).drop("_n")


def grouped(rows: DataFrame, key: Column, item: str = "url") -> DataFrame:
    """(key, n, items): rows by host or folder; sort with ``by_size`` for display."""
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(item)).alias("items"))


def group_chunks(rows: DataFrame, key: Column, item: str = "url", size: int = 1000) -> DataFrame:
    """(key, n, chunk, items): as ``grouped``, with the items in order in chunks, so that no aggregate holds a whole host."""
    keyed = rows.select(key.alias("key"), F.col(item).alias("item"))
    placed = Tables(rows.sparkSession).write(ranked(keyed, ["item"], "_rank", ["key"]).withColumn("chunk", F.floor((F.col("_rank") - 1) / size).cast("long")), "placed-items")
    n = placed.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    lists = placed.groupBy("key", "chunk").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return lists.join(n, F.col("key").eqNullSafe(F.col("_key"))).select("key", "n", "chunk", "items")


def by_size(groups: DataFrame) -> DataFrame:
    """Larger groups first, then by key in locale order."""
    return groups.orderBy(F.desc("n"), F.collate("key", "UNICODE"))


def by_depth(pages: DataFrame) -> DataFrame:
    """Pages by depth, then url in locale order."""
    return pages.orderBy("depth", F.collate("url", "UNICODE"))


def by_parent(sections: DataFrame, parent: str = "parent", index: str = "index") -> DataFrame:
    """Sections with the largest parents first, then parent by code unit, then their first order.

    Sizes are partial counts joined to the sections, so that a parent's sections never meet in one task.
    """
    sizes = sections.groupBy(F.col(parent).alias("_parent")).agg(F.count(F.lit(1)).alias("parent_size"))
    return sections.join(sizes, F.col(parent).eqNullSafe(F.col("_parent"))).drop("_parent").orderBy(F.desc("parent_size"), parent, index)


def page_numbers(rows: DataFrame, order: list[str], size: int = 1000, by: list[str] | None = None) -> DataFrame:
    """Rows with their page number, per group of ``by`` if given; a group of any size is dealt over many tasks."""
    return ranked(rows, order, "_rank", by).withColumn("page", F.ceil(F.col("_rank") / size).cast("long")).drop("_rank")
