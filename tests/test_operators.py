"""Operators on small inline tables."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from linkloom.operators import allowlist, classify, extract, graph, measures, outcomes, triage
from linkloom.plans.config import CrawlConfig, parse_options
from linkloom.sources import readers
from tests.conftest import rows

PAGE = """<!-- <a href="/no"> --><title> A
 &amp; B </title><base href="/base/"><a href="x">1</a><a class=q href='/y?a=1&amp;b=2#f'>2</a><A HREF=z>3</A>
<a href="#top">4</a><a href="mailto:x@y">5</a><a href="http://h:99999/">6</a><a href="x">7</a><a data-href="/d">8</a><script>"<a href='/s'>"</script><a href="//Other.example/p">9</a>"""


def test_links_and_title(spark):
    pages = spark.createDataFrame([("https://site.example/dir/page", PAGE), ("https://site.example/empty", None)], "url string, html string")
    got = [(r.pos, r.href) for r in extract.links(pages).orderBy("pos").collect()]
    assert got == [
        (0, "https://site.example/base/x"), (1, "https://site.example/y?a=1&b=2#f"), (2, "https://site.example/base/z"), (6, "https://site.example/base/x"),
        (7, "https://site.example/d"), (8, "https://site.example/s"), (9, "https://other.example/p"),
    ]
    assert pages.select(extract.title(F.col("html"))).first()[0] == "A &amp; B"


def _office(method):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("word/_rels/document.xml.rels", '<R Target="https://a.example/?x=1&amp;y=2" TargetMode="External"/><R Target="styles.xml"/><R Target="HTTP://b.example/"/>')
        z.writestr("word/document.xml", 'Target="https://no.example/"')
    return out.getvalue()


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_office_files(method):
    data = _office(method)
    assert extract.office_links(data) == ["https://a.example/?x=1&y=2", "HTTP://b.example/"]
    assert {n for n, _ in extract.zip_entries(data)} == {"word/_rels/document.xml.rels", "word/document.xml"}
    for cut in (0, 10, len(data) // 2, len(data) - 5):
        assert extract.office_links(data[:cut]) == []
    assert extract.office_links(data.replace(zlib.compress(b"x")[:2], b"\0\0")) is not None


def test_document_links(spark):
    ole = b"\xd0\xcf\x11\xe0" + "see https://w.example/a, (https://w.example/b)".encode("utf-16-le") + b"\0\0 http://l.example/x\0"
    docs = spark.createDataFrame([("https://s.example/a.pdf", bytearray(b"%PDF /URI (http://x.example/a\\)b) /URI(/rel.) /URI (mailto:q)"), "pdf"), ("https://s.example/b", bytearray(_office(8)), None), ("https://s.example/c.doc", bytearray(ole), "ole"), ("https://s.example/none", bytearray(b"%PDF"), "sniff"), ("https://s.example/null", None, None)], "url string, doc binary, doc_type string")
    got = {}
    for r in extract.document_links(docs).orderBy("page_url", "pos").collect():
        got.setdefault(r.page_url, (r.doc_type, r.n, []))[2].append(r.href)
    assert got["https://s.example/a.pdf"] == ("pdf", 2, ["http://x.example/a)b", "https://s.example/rel"])
    assert got["https://s.example/b"] == ("ooxml", 2, ["https://a.example/?x=1&y=2", "http://b.example/"])
    assert got["https://s.example/c.doc"] == ("ole", 3, ["http://l.example/x", "https://w.example/a", "https://w.example/b"])
    assert got["https://s.example/none"] == ("pdf", 0, [None])
    assert got["https://s.example/null"] == ("doc", 0, [None])
    title = extract.document_title(F.lit("ooxml"), F.lit(2))
    assert spark.range(1).select(title).first()[0] == "(office-doc, 2 links)"


def _site(spark):
    a, b = '<a href="/b">b</a><a href="/c#x">c</a><a href="/a">self</a><a href="http://out.example/q#f">o</a><a href="/c">c</a>', '<a href="/d">d</a><a href="/gone">g</a><a href="/lim">l</a><a href="/doc.pdf">p</a><a href="ftp://x/">f</a>'
    rows = [
        ("https://s.example/a", 200, "text/html", None, f"<title>A</title>{a}", None, None, None), ("https://s.example/b/", 200, "text/html", None, b, None, None, None), ("https://s.example/c", 404, "text/html", None, "", None, None, None),
        ("https://s.example/d", 403, "text/html", None, "", None, None, None), ("https://s.example/lim", 503, "text/html", "5", "", None, None, None), ("https://s.example/doc.pdf", 200, "application/pdf", None, None, bytearray(b"%PDF /URI (/e)"), "pdf", None),
        ("https://s.example/e", 200, "image/png", None, None, None, None, None),
    ]
    from linkloom.functions.schemas import RESPONSE

    return spark.createDataFrame(rows, RESPONSE)


def test_crawl(spark):
    done = graph.crawl(spark, _site(spark), CrawlConfig(start_url="https://s.example/a", max_depth=5, max_pages=None))
    assert rows(done.pages, "url", "title", "status", "depth", "internal", "external") == sorted(
        [("https://s.example/a", "A", 200, 0, 4, 1), ("https://s.example/b", "", 200, 1, 4, 0), ("https://s.example/doc.pdf", "(pdf, 1 links)", 200, 2, 1, 0), ("https://s.example/e", "(non-HTML: image/png)", 200, 3, 0, 0)], key=repr
    )
    assert rows(done.flagged, "url", "reason", "source", "disposition") == sorted(
        [("https://s.example/c", "HTTP 404", "https://s.example/a", "broken"), ("https://s.example/d", "HTTP 403", "https://s.example/b", "blocked"), ("https://s.example/gone", "not in corpus", "https://s.example/b", "broken"), ("https://s.example/lim", "rate limited (HTTP 503, gave up after 5 retries)", "https://s.example/b", "broken")], key=repr
    )
    assert rows(done.external, "url", "host") == [("http://out.example/q#f", "out.example")]
    assert ("https://s.example/a", "https://s.example/a") in rows(done.refs, "target", "referrer")
    assert done.frontier.count() == 0
    short = graph.crawl(spark, _site(spark), CrawlConfig(start_url="https://s.example/a", max_depth=1, max_pages=2))
    assert rows(short.pages, "url") == [("https://s.example/a",), ("https://s.example/b",)]
    assert rows(short.frontier, "node") == [("https://s.example/c",)]
    assert ("https://s.example/d", "https://s.example/b") in rows(short.refs, "target", "referrer")  # referred to beyond the depth


def test_crawl_scope(spark):
    html = '<a href="/docs/x">1</a><a href="/other#f">2</a><a href="https://sub.s.example/docs">3</a>'
    pages = readers.corpus(spark.createDataFrame([("https://s.example/docs", html)], "url string, html string"))
    done = graph.crawl(spark, pages, CrawlConfig(start_url="https://s.example/docs", path_prefix="/docs/", include_subdomains=True))
    assert rows(done.out_of_scope) == [("https://s.example/other#f",)]
    assert rows(done.pages, "internal", "external") == [(2, 0)]
    assert {r.url for r in done.flagged.collect()} == {"https://s.example/docs/x", "https://sub.s.example/docs"}


def test_bfs_order_caps_and_sites(spark):
    edges = spark.createDataFrame([("s", 1, "a", "c", 1), ("s", 1, "a", "b", 0), ("s", 1, "b", "d", 0), ("s", 1, "c", "d", 0), ("s", 1, "c", "e", 1), ("s", 1, "d", "a", 0), ("t", 1, "a", "z", 0)], "site string, x int, src string, dst string, pos long").drop("x")
    start = spark.createDataFrame([("s", "a"), ("t", "a")], "site string, node string")
    got = graph.bfs(edges, start, keys=["site"]).orderBy("rank").collect()
    assert [(r.site, r.node, r.depth, r.parent) for r in got if r.site == "s"] == [("s", "a", 0, "(start)"), ("s", "b", 1, "a"), ("s", "c", 1, "a"), ("s", "d", 2, "b"), ("s", "e", 2, "c")]
    assert [(r.node, r.depth) for r in got if r.site == "t"] == [("a", 0), ("z", 1)]
    one = edges.where("site = 's'").drop("site")
    first = spark.createDataFrame([("a",)], "node string")
    assert [r.node for r in graph.bfs(one, first, max_nodes=3).orderBy("rank").collect()] == ["a", "b", "c"]
    assert graph.bfs(one, first, keep_going=lambda depth: depth < 1).count() == 3
    assert graph.bfs(one, first, max_depth=0).count() == 1


def test_allowlist(spark):
    lines = spark.createDataFrame([("# c",), (" https://a.example/x*  # why",), ("",), ("https://a.example/y#frag",), ("https://a.example/q?z=1(+)",), (None,)], "value string")
    patterns = [r.pattern for r in allowlist.parse_lines(lines).collect()]
    assert patterns == ["https://a.example/x*", "https://a.example/y#frag", "https://a.example/q?z=1(+)"]
    links = spark.createDataFrame([("https://a.example/x1",), ("https://a.example/y",), ("https://a.example/y#frag",), ("https://a.example/q?z=1(+)",), ("https://A.example/x1",), (None,)], "url string")
    want = {"https://a.example/x1": True, "https://a.example/y": False, "https://a.example/y#frag": True, "https://a.example/q?z=1(+)": True, "https://A.example/x1": False, None: False}
    assert {r.url: r.suppressed for r in allowlist.split_active(links, patterns).collect()} == want
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    assert {r.url: r.suppressed for r in allowlist.split_by_table(links, table).collect()} == want
    many = spark.createDataFrame([(p,) for p in patterns] + [(f"https://b{i}.example/*/z",) for i in range(1005)], "pattern string")
    assert {r.url: r.suppressed for r in allowlist.split_by_table(links, many).collect()} == want
    for patterns in (["*"], ["*#frag"], ["*example/y*", "*nowhere*", "*/q?z=1(+)"], ["**", "h*1"], ["https://a.example/y*g*"], []):
        table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
        assert sorted(map(repr, allowlist.split_by_table(links, table).collect())) == sorted(map(repr, allowlist.split_active(links, patterns).collect()))


def test_wild_heads_join_by_the_rarest_part(spark):
    urls = spark.range(5000).select(F.format_string("https://h%d.example/x%d", F.col("id") % 50, "id").alias("url"))
    patterns = spark.range(10_000).select(F.format_string("https://*/x%d", F.col("id") + 2000).alias("pattern"))
    literals = allowlist._literals(patterns, "pattern")
    rarest = allowlist.rarest_literals(urls, literals)
    pairs, kinds = rarest.agg(F.sum("urls")).first()[0], {r[0] for r in rarest.select("where").distinct().collect()}
    got = allowlist.split_by_table(urls, patterns)
    assert got.where("suppressed").count() == 3000 and pairs == 3000 and kinds == {"tail"}
    assert got.where("suppressed <> (cast(regexp_extract(url, 'x(\\\\d+)$', 1) AS int) >= 2000)").count() == 0


def _flagged(spark):
    return spark.createDataFrame([("u1", "HTTP 404", "s", "internal", "broken"), ("u2", "HTTP 404", "", "external", "broken"), ("u3", "HTTP 403", "s", None, "blocked"), ("u2", "HTTP 403", "s", "external", "blocked")], "url string, reason string, source string, kind string, disposition string")


def test_outcomes(spark):
    new = spark.createDataFrame([("u1", 200, None), ("u2", 429, None), ("u3", 404, None)], "url string, status int, error string")
    assert rows(outcomes.second_pass(_flagged(spark), new), "url", "reason", "disposition") == [("u2", "HTTP 403", "blocked"), ("u2", "HTTP 429", "blocked"), ("u3", "HTTP 403", "blocked")]
    marked = _flagged(spark).withColumn("suppressed", F.col("url") == "u1")
    assert rows(outcomes.reprobe(marked, new), "url", "reason", "disposition") == [("u1", "HTTP 404", "broken"), ("u2", "HTTP 429", "blocked"), ("u3", "HTTP 404", "broken")]
    assert rows(outcomes.reprobe(marked, new.where("url = 'u3'")), "url", "disposition") == [("u1", "broken"), ("u2", "broken"), ("u3", "broken")]
    verdicts = spark.createDataFrame([("u1", "blocked"), ("u2", "ok"), ("u3", "broken")], "url string, disposition string")
    assert rows(outcomes.apply_verdicts(_flagged(spark), verdicts), "url", "reason", "disposition") == [("u1", "blocked in browser (HTTP 404)", "blocked"), ("u3", "HTTP 403", "blocked")]
    given = spark.createDataFrame([("http://a/",), ("ftp://b/",), ("bad",)], "url string")
    flagged = _flagged(spark).withColumn("url", F.concat(F.lit("http://"), "url", F.lit("/")))
    assert rows(outcomes.suspects(given, given, flagged), "url", "kind") == [("http://a/", "cli"), ("http://u1/", "error:internal"), ("http://u2/", "error:external"), ("http://u3/", "blocked:internal")]
    rendered = outcomes.render_verdicts(outcomes.suspects(given, None, None), spark.createDataFrame([("http://a/", 0, None, " Access Denied ", "http://a/")], "url string, status int, error string, title string, finalUrl string"))
    assert rows(rendered, "disposition", "note") == [("blocked", "challenge/interstitial: Access Denied")]


def test_measures_defaults(spark):
    refs = spark.createDataFrame([("u1", "p1", 1), ("u1", "p2", 2)], "target string, referrer string, first_seen int")
    broken = _flagged(spark).where("disposition = 'broken'")
    assert measures.broken_instances(broken, refs).first()[0] == 3
    assert tuple(measures.broken_by_kind(broken).first()) == (1, 1, 2)
    assert tuple(measures.blocked_counts(_flagged(spark).where("disposition = 'blocked'")).first()) == (2, 2)
    assert rows(measures.broken_references(broken, refs)) == [("internal", "u1", "p1"), ("internal", "u1", "p2")]
    empty = broken.limit(0)
    assert measures.broken_instances(empty, refs).first()[0] == 0
    lists = classify.referrer_lists(refs)
    assert lists.select(classify.preview(F.col("found_on"), 1)).first()[0] == "p1\n+1 more"
    assert classify.previews(refs, 1).select(classify.preview_text(F.col("n"), F.col("found_on"))).first()[0] == "p1\n+1 more"
    ordered = classify.by_parent(spark.createDataFrame([("b", 0), ("a", 1), ("c", 2), ("c", 3)], "parent string, index int"))
    assert [r.parent for r in ordered.collect()] == ["c", "c", "a", "b"]
    assert [r.key for r in classify.by_size(spark.createDataFrame([("B", 1), ("a", 1), ("A", 1), ("z", 9)], "key string, n int")).collect()] == ["z", "a", "A", "B"]


def test_triage_state(spark):
    host = "h"
    state = spark.createDataFrame([("cwfix:h:p\nu", "1"), ("cwfix:h:ft:p\nu", "t"), ("cwfix:h:vd:u", "working"), ("cwfix:h:vt:u", "t2"), ("cwfix:h:n:p", "note"), ("cwfix:x:n:p", "no"), ("cwfix:h:odd", "no")], "key string, value string")
    fixes = triage.fix_rows(state, host)
    assert rows(fixes) == sorted([("fixed", "p", "u", "1"), ("fixed_on", "p", "u", "t"), ("verdict", None, "u", "working"), ("verdict_ts", None, "u", "t2"), ("note", "p", None, "note")], key=repr)
    assert {r.key for r in triage.fix_keys(fixes, host).collect()} == {r.key for r in state.collect()} - {"cwfix:x:n:p", "cwfix:h:odd"}
    assert {r.family for r in triage.reset_fixes(fixes).collect()} == {"verdict", "verdict_ts", "note"}
    section = spark.createDataFrame([("p", "u"), ("p", "v")], "page string, url string")
    assert triage.bulk_fix(fixes, section, True, "now").where("family = 'fixed'").count() == 2
    assert triage.bulk_fix(fixes, section, False, "now").where("family like 'fixed%'").count() == 0
    scoped = triage.scoped_state(fixes, section.select("page"), section.select("url"))
    assert scoped.count() == 5
    said = spark.createDataFrame([("cwbroken:h:u", "1"), ("cwts:h:u", "t"), ("cwok:h:v", "1"), ("cwok:x:v", "1")], "key string, value string")
    marks = triage.verdict_rows(said, host)
    assert rows(marks) == [("broken", "u", "1"), ("ok", "v", "1"), ("ts", "u", "t")]
    assert triage.verdict_count(marks).first()[0] == 2
    flagged = _flagged(spark).withColumn("url", F.when(F.col("url") == "u1", "u").otherwise("v"))
    assert {(r.url, r.verdict) for r in triage.with_verdicts(flagged, marks).collect()} == {("u", "broken"), ("v", "working")}
    after = triage.set_verdict(marks, spark.createDataFrame([("u",)], "url string"), "working", "t9")
    assert rows(after) == [("ok", "u", "1"), ("ok", "v", "1"), ("ts", "u", "t9")]
    assert rows(triage.set_verdict(marks, spark.createDataFrame([("u",)], "url string"), "", "t9")) == [("ok", "v", "1")]
    assert triage.seeded(marks, marks).count() == 3 and triage.seeded(marks.limit(0), marks).count() == 3


def test_merge_states(spark):
    files = spark.createDataFrame([(0, "a", None, "h", {"k": "1"}), (1, "b", "linkloom-fixes", "h", {"cwfix:h:n:p": "1", "evil": "x"}), (2, "c", "linkloom-fixes", "g", {"cwfix:g:n:p": "1"}), (3, "d", "linkloom-fixes", "h", {"cwfix:h:n:p": "2"}), (4, "e", "linkloom-fixes", "h", None)], "pos int, file string, app string, host string, v map<string, string>")
    assert rows(triage.merge_states(files)) == [("cwfix:h:n:p", "2")]
    assert tuple(triage.merge_report(files).first()) == (2, 1, 2, 2)
    both = triage.merge_states(files.where("pos in (1, 3)"))
    assert rows(both) == [("cwfix:h:n:p", "2")]


def test_options():
    c = parse_options(["https://a.example", "--max-pages", "none", "--max-depth", "-1", "--concurrency", "99", "--timeout", "5", "--no-recheck", "--page-size", "0", "--path-prefix", "/x/", "--browser", "--resume", "j", "https://b.example"])
    assert len(c) == 2 and c[0].max_pages is None and c[0].max_depth is None and c[0].concurrency == 32 and c[0].timeout == 1000
    assert not c[0].recheck and c[0].paginate and c[0].page_size == 1 and c[0].prefix() == "/x" and "Chrome" in c[0].user_agent and c[0].state == "j"
    assert CrawlConfig().url_cap() == 10_000 and CrawlConfig(max_pages=None).url_cap() is None and CrawlConfig(max_pages=None, seen="disk").url_cap() == 1_000_000
    assert CrawlConfig().tuned('{"rps": 3, "delay": "x", "crawlDelay": -2}').rps == 3 and CrawlConfig().tuned("{").rps == 0
    for bad in (["--nope"], [], ["--scope"], ["x y", "--scope", "world"], ["https://a.example", "--max-urls", "many"], ["nothing"]):
        with pytest.raises(ValueError):
            parse_options(bad)
