import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import http, text, urls, whatwg
from linkloom.functions.text import decode_entity

BASE = "https://Site.Example:443/a/b/c?q=1#f"
VECTORS = [
    ("d", "https://site.example/a/b/d"), ("./d", "https://site.example/a/b/d"), ("../d", "https://site.example/a/d"), ("../../../d", "https://site.example/d"), ("/x", "https://site.example/x"),
    ("//h/x", "https://h/x"), ("?z", "https://site.example/a/b/c?z"), ("#g", "https://site.example/a/b/c?q=1#g"), ("", "https://site.example/a/b/c?q=1"), ("http:y", "http://y/"), ("https:y", "https://site.example/a/b/y"),
    ("HTTP://EX.example:80/", "http://ex.example/"), ("http://ex.example:8080", "http://ex.example:8080/"), ("  /sp ace\n/x ", "https://site.example/sp%20ace/x"), ("/für", "https://site.example/f%C3%BCr"),
    ("/a%2e%2e/..", "https://site.example/"), ("/a/%2E%2e/b", "https://site.example/b"), ("\\x\\y", "https://site.example/x/y"), ("http://bücher.example/", "http://xn--bcher-kva.example/"),
    ("/a?x='<>&y=\"", "https://site.example/a?x=%27%3C%3E&y=%22"), ("/a#b c", "https://site.example/a#b%20c"), ("http://u:p@h/x", "http://u:p@h/x"), ("javascript:void(0)", "javascript:void(0)"), ("mailto:a@b", "mailto:a@b"),
    ("http://1.2.3/", "http://1.2.0.3/"), ("http://0x7f.1/", "http://127.0.0.1/"), ("http://[::1]:81/", "http://[::1]:81/"), ("http://h:99999/", None), ("http://a b/", None), ("http://", None), ("http://[::g]/", None), ("//", None),
    ("http://a%zz/", None), ("file:///c", "file:///c"), ("http:///three", "http://three/"), ("x:y z", "x:y z"),
]


@pytest.mark.parametrize(("raw", "href"), VECTORS)
def test_resolve_vectors(raw, href):
    assert whatwg.resolve(raw, BASE) == href


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=30))
def test_resolving_is_idempotent(raw):
    once = whatwg.resolve(raw, BASE)
    assert once is None or whatwg.resolve(once, BASE) == once


def test_resolve_fast_path_agrees_with_python(spark):
    raws = ["/", "/a", "/a/", "/a//b", "/a/./b", "/a/../b", "/.", "/..", "/a.b/c..d", "/für", "/a b", "x", "//h", "/a?b", "/a#b", "", "/~a_b-c", "/a%20b", "/a,b;c=d@e:f", "/[a]", "/a'b", "/×÷ÀɏÑ/ñ.", "/ß+&é", "/ē!~*"]
    bases = ["https://site.example/x/y", "https://SITE.example/x", "http://site.example", "http://1.2.3.4/x", "http://h/x", "http://site.example:80/x", "nothing"]
    df = spark.createDataFrame([(r, b) for r in raws for b in bases], "raw string, base string")
    for r in df.select("raw", "base", urls.resolve("raw", "base").alias("href")).collect():
        assert r.href == whatwg.resolve(r.raw, r.base), r


def test_normalize(spark):
    cases = {
        "https://a.example/": "https://a.example/", "https://a.example/x/": "https://a.example/x", "https://a.example/x//": "https://a.example/x/", "https://a.example/x#f": "https://a.example/x",
        "https://a.example/a?x=/": "https://a.example/a?x=", "https://a.example/?x=/": "https://a.example/?x=/", "https://a.example/x?y": "https://a.example/x?y",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.n for r in df.select("u", urls.normalize("u").alias("n")).collect()} == cases


def test_hosts_and_folders(spark):
    df = spark.createDataFrame([("https://U:p@Host.example:81/About/x?y/z",), ("http://h",), ("http://h//",), ("mailto:x",), (None,), ("http://h?a/b",)], "u string")
    got = [tuple(r) for r in df.select(urls.host_group("u"), urls.folder_group("u"), urls.tracker_host("u"), urls.tracker_folder("u")).collect()]
    assert got[0] == ("host.example", "host.example/About/", "host.example", "host.example/About/")
    assert got[1] == ("h", "h/", "h", "h/")
    assert got[2] == ("h", "h/", "h", "h/")
    assert got[3] == ("(unknown host)", "(unknown)", "(unknown host)", "(unknown)")
    assert got[5] == ("h", "h/", "h", "h/b/")  # the tracker cuts at the first slash, in a query too


def test_domains_and_scope(spark):
    one = spark.range(1)
    same = lambda a, b, sub: one.select(urls.same_domain(F.lit(a), F.lit(b), sub)).first()[0]
    assert same("a.x", "a.x", False) and not same("b.a.x", "a.x", False)
    assert same("b.a.x", "a.x", True) and same("a.x", "b.a.x", True) and not same("ba.x", "a.x", True)
    scope = lambda p, prefix: one.select(urls.in_scope(F.lit(p), prefix)).first()[0]
    assert scope("/en", "/en") and scope("/en/x", "/en") and not scope("/english", "/en") and scope("/", "")
    assert urls.scope_prefix("https://a.example/docs/", "path") == "/docs" and urls.scope_prefix("https://a.example/docs/", "path", "/x/") == "/x" and urls.scope_prefix("https://a.example/docs/") == ""


def test_file_names(spark):
    cases = {"https://a.example/x?y=1": "a.example_x_y_1", "https://": "page", "http://_.a": "a", "x" * 200: "x" * 120}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.n for r in df.select("u", urls.page_file_name("u").alias("n")).collect()} == cases
    assert spark.range(1).select(urls.site_path("crawl", 2, F.lit("a.b:80"), ".json")).first()[0] == "crawl.2-a.b_80.json"
    assert spark.range(1).select(urls.encode_component(F.lit("a b/ü!'()*~+"))).first()[0] == "a%20b%2F%C3%BC!'()*~%2B"


def test_entities(spark):
    cases = {"a&amp;b": "a&b", "&lt;&gt;&quot;&apos;": "<>\"'", "&nbsp;": " ", "&#65;&#x42;&#X43;": "ABC", "&amp;lt;": "&lt;", "&eacute;": "&eacute;", "&amp": "&amp", "&#xzz;": "&#xzz;", "&#65601;": "A", "&AMP;": "&"}
    assert {k: decode_entity(k) for k in cases} == cases
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.n for r in df.select("u", text.decode_entities(F.col("u")).alias("n")).collect()} == cases


def test_texts(spark):
    one = spark.range(1)
    got = one.select(
        text.escape_html(F.lit('<a href="x">&</a>')), text.collapse(F.lit("  a \n\t b　")), text.thousands(F.lit(1234567)), text.escape_regex(F.lit("a.b*[c]")),
        *(text.percent(F.lit(x)) for x in (0.0, 12.34, 0.03, 0.0004, -1.0)), *(text.duration(F.lit(ms)) for ms in (400, 59_499, 61_000, 3_661_000)),
    ).first()
    assert list(got) == ["&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;", "a b", "1,234,567", r"a\.b\*\[c\]", "0.0", "12.3", "0.03", "0.0004", "0.0", "0s", "59s", "1m 1s", "1h 1m 1s"]


def test_dispositions_for_all_statuses(spark):
    df = spark.range(0, 1000).select(F.col("id").cast("int").alias("s"))
    blocked = {401, 403, 405, 406, 408, 409, 429, 451, 999, *range(500, 600)}
    for r in df.select("s", http.disposition(F.col("s"), F.lit(None)).alias("d"), http.render_disposition(F.col("s"), F.lit(None), F.lit(None)).alias("r")).collect():
        want = "ok" if 200 <= r.s < 400 else "blocked" if r.s in blocked else "broken"
        assert r.d == want
        assert r.r == ("blocked" if r.s == 0 else want)
    errors = {"socket Timeout": ("blocked", "blocked"), "ENOTFOUND x": ("broken", "broken"), "net::ERR_ABORTED": ("broken", "blocked"), "timed out": ("broken", "blocked"), "ERR_CERT": ("broken", "broken")}
    df = spark.createDataFrame([(e,) for e in errors], "e string")
    got = {r.e: (r.d, r.r) for r in df.select("e", http.disposition(F.lit(0), F.col("e")).alias("d"), http.render_disposition(F.lit(0), F.col("e"), F.lit("t")).alias("r")).collect()}
    assert got == errors


def test_probe(spark):
    cases = [((200, None, 404, None), (200, None)), ((405, None, 200, None), (200, None)), ((404, None, 200, None), (404, None)), ((403, None, 0, "reset"), (403, None)), ((0, "a", 0, "b"), (0, "b")), ((0, "a", 0, None), (0, "a")), ((500, None, 404, None), (404, None)), ((0, "a", 301, None), (301, None))]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, hs int, he string, gs int, ge string")
    s, e = http.probe(F.col("hs"), F.col("he"), F.col("gs"), F.col("ge"))
    assert [tuple(r)[1:] for r in sorted(df.select("i", s, e).collect())] == [w for _, w in cases]


def test_gates_and_types(spark):
    cases = [("text/html", "/x", "html"), ("application/vnd.openxmlformats-x+xml", "/x", "doc"), ("image/png", "/x", "skip"), ("application/octet-stream", "/x", "sniff"), ("", "/x", "sniff"), ("application/json", "/x", "skip"), ("image/png", "/a.pdf", "skip"), ("", "/a.XLS?v", "doc"), (None, "/a.docx", "doc")]
    df = spark.createDataFrame([(i, c, p) for i, (c, p, _) in enumerate(cases)], "i int, c string, p string")
    assert [r.g for r in sorted(df.select("i", http.content_gate(F.col("c"), F.col("p")).alias("g")).collect())] == [g for *_, g in cases]
    assert df.where("i = 1").select(http.content_gate(F.col("c"), F.col("p"), False)).first()[0] == "skip"
    assert http.request_headers("ua")["User-Agent"] == "ua" and "Accept-Language" in http.request_headers("ua", True)
    assert http.request_gap_ms(2, 1) == 1000 and http.request_gap_ms(0, 0) == 0


def test_waits(spark):
    now = F.to_timestamp(F.lit("2015-10-21 07:28:00"))
    one = spark.range(1)
    got = one.select(*(http.retry_after(F.lit(v), now, 300_000) for v in ("7", "9999", "-3", "Wed, 21 Oct 2015 07:28:30 GMT", "x", None)), *(http.backoff(F.lit(n), F.lit(0), 300_000) for n in (1, 2, 8)), http.backoff(F.lit(3), F.lit(1234), 300_000)).first()
    assert list(got) == [7000, 300_000, 0, 30_000, 0, 0, 5000, 10_000, 300_000, 1234]
    assert 850 <= one.select(http.jittered(F.lit(1000))).first()[0] <= 1150
