"""Several sites in one plan, and the store of what has been seen."""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import graph, seen
from linkloom.operators.seen import Seen
from linkloom.plans.config import CrawlConfig
from linkloom.sources import readers
from tests.conftest import rows


def _page(host, name, links):
    return f"https://{host}.example/{name}", f"<title>{name}</title>" + "".join(f'<a href="{x}">x</a>' for x in links)


@pytest.fixture
def web(spark):
    pages = [_page("a", "0", "123"), _page("a", "1", "45"), _page("a", "2", "6"), *(_page("a", str(k), "0") for k in range(3, 7)), _page("b", "0", ["1", "https://a.example/0"]), _page("b", "1", "2"), _page("b", "2", "3"), _page("b", "3", "0")]
    return readers.corpus(spark.createDataFrame(pages, "url string, html string"))


def test_sites_equal_single_crawls(spark, web):
    configs = [CrawlConfig(start_url="https://a.example/0", max_pages=4, max_depth=5), CrawlConfig(start_url="https://b.example/0", max_pages=None, max_depth=2), CrawlConfig(start_url="https://a.example/2", max_pages=2, path_prefix="/"), CrawlConfig(start_url="https://c.example/", max_pages=9)]
    done = graph.crawl_sites(spark, web, configs)
    for k, config in enumerate(configs):
        alone = graph.crawl(spark, web, config)
        for name in ("pages", "refs", "external", "out_of_scope", "flagged", "frontier"):
            own = getattr(done, name).where(F.col("site") == k).drop("site")
            assert rows(own) == rows(getattr(alone, name).select(*own.columns)), (k, name)
    assert rows(done.pages.where("site = 0"), "url") == [(f"https://a.example/{k}",) for k in range(4)]
    assert rows(done.flagged, "site", "url", "reason") == [(3, "https://c.example/", "not in corpus")]


def test_limits_hold_for_each_key(spark):
    edges = spark.createDataFrame([("s", str(a), str(2 * a + b), b) for a in range(1, 40) for b in (0, 1)] + [("t", str(a), str(a + 1), 0) for a in range(1, 9)], "site string, src string, dst string, pos long")
    starts = spark.createDataFrame([("s", "1"), ("t", "1"), ("u", "1")], "site string, node string")
    limits = spark.createDataFrame([("s", None, 10), ("t", 3, None)], "site string, max_depth int, max_nodes long")
    got = graph.bfs(edges, starts, keys=["site"], limits=limits)
    assert rows(got.where("site = 's'"), "rank", "node") == sorted(((k, str(k)) for k in range(1, 11)), key=repr)
    assert rows(got.where("site = 't'"), "node", "depth") == sorted(((str(k + 1), k) for k in range(4)), key=repr)
    assert rows(got.where("site = 'u'"), "node", "rank") == [("1", 1)]


@pytest.mark.parametrize(("least", "few"), [(1, 16), (4, 16), (1 << 20, 1)])
def test_seen_store_gives_the_same_walk(spark, monkeypatch, least, few):
    monkeypatch.setattr(seen, "FEW", few)
    edges = spark.createDataFrame([(str(a), str((a * 7 + b * b) % 97), b) for a in range(97) for b in range(3)], "src string, dst string, pos long")
    start = spark.createDataFrame([("1",)], "node string")
    want = rows(graph.bfs(edges, start))
    monkeypatch.setattr(seen.Seen.__init__, "__defaults__", (least,))
    assert rows(graph.bfs(edges, start)) == want and len(want) > 60


def test_the_store_is_not_shuffled(spark):
    store = Seen(spark, ["site", "node"], least=100)
    level = spark.range(400).select(F.concat(F.lit("s"), F.col("id") % 3).alias("site"), F.col("id").cast("string").alias("node"))
    store.add(level, 400)
    store.add(spark.range(400, 500).select(F.concat(F.lit("s"), F.col("id") % 3).alias("site"), F.col("id").cast("string").alias("node")), 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = store.fresh(spark.range(450, 550).select(F.concat(F.lit("s"), F.col("id") % 3).alias("site"), F.col("id").cast("string").alias("node")))
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert left.count() == 50 and store.stored == 500 and not store.waiting
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        store.close()


@pytest.mark.parametrize(("lookups", "most"), [(4, 1 << 16), (1, 1 << 16), (4, 2), (0, 0)])
def test_links_are_taken_of_reached_pages_once(spark, monkeypatch, lookups, most):
    """However pages are looked up, a deep walk gives the same, and few lookups read the pages that are reached only."""
    monkeypatch.setattr(graph, "LOOKUPS", lookups)
    monkeypatch.setattr(graph, "LOOKED_UP", most)
    taken, links = [], graph._links
    monkeypatch.setattr(graph, "_links", lambda served: taken.append(served.select("key")) or links(served))
    page = lambda k, *to: (f"https://s.example/{k}", "".join(f'<a href="/{x}">x</a>' for x in to))
    pages = [page("a", "c1", "c2"), page("c1", "c3", "a"), page("c2", "c3"), page("c3", "c4"), page("c4", "c5", "x"), page("c5", "c6"), page("c6", "c7"), page("c7", "none"), page("x"), *(page(f"apart{k}", "a") for k in range(20))]
    done = graph.crawl_sites(spark, readers.corpus(spark.createDataFrame(pages, "url string, html string")), [CrawlConfig(start_url="https://s.example/a", max_pages=None, max_depth=None), CrawlConfig(start_url="https://s.example/c2", max_pages=3, max_depth=2)])
    got = {(r.site, r.url.rsplit("/", 1)[1]): (r.depth, r.internal) for r in done.pages.collect()}
    assert got == {(0, "a"): (0, 2), (0, "c1"): (1, 2), (0, "c2"): (1, 1), (0, "c3"): (2, 1), (0, "c4"): (3, 2), (0, "c5"): (4, 1), (0, "x"): (4, 0), (0, "c6"): (5, 1), (0, "c7"): (6, 1), (1, "c2"): (0, 1), (1, "c3"): (1, 1), (1, "c4"): (2, 2)}
    assert rows(done.flagged.select("site", "url")) == [(0, "https://s.example/none")]
    assert done.links.count() == 15
    read = [r.key for keys in taken for r in keys.collect()]
    assert len(read) == len(set(read))
    if lookups == 4 and most > 2:
        assert {r.key for keys in taken[:4] for r in keys.collect()} == {f"https://s.example/{k}" for k in ("a", "c1", "c2", "c3", "c4", "c5", "x")}
