import hashlib
import io
import struct

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import html_text, top_k, warc

SF = "/root/testdata/sf0.001"

PAGES = {
    "": "", "<p>a</p": "a", "<div class='sidebar'>x</div><p>hi &lt;b&gt; &#233;&nbsp; z<br>q</p>": "hi <b> é z q", "<article><header><h1>T</h1></header><p>x<section class=comments><p>no</section><p>y<aside>s</aside></article><p>out": "T\n\nx\n\ny",
    "<main>a<nav>b</nav>c</main>": "a\n\nc", "a < b <!-- x": "a < b", "<script>if(a<b)</script>t<style>": "t", "<form>x<input></form><div>k</div>": "k", "<div role=banner>b</div><table><tr><td>1<td>2</table>": "1\n\n2",
    '<div id="cookie-notice">c</div><p title="a>b">v': "v", "<div hidden>h</div><p style='display:none'>g</p><div style='display: none'>i</div>j": "g\n\nj", "x<b>y</b>z &amp;amp; &bogus; &amp": "xyz &amp; &bogus; &",
    "<article>a<article class=comment>b</article></article>": "a", "<p>one<p>two<li>three</div></section>": "one\n\ntwo\n\nthree", "<title>t</title><h1>a<h2>b": "a\n\nb", "</p>": "", "<a href='x": "", "<footer>f</footer><nav>": "", "<article><p>in<nav>n": "in",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_text.main_text(page) == PAGES[page]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<nav>", "</nav>", "<article>", "</article>", "<!--", "-->", "<script>", "</script>", "word", " ", "&amp;", "<", ">", '"', "<a href='", "<h1>", "</h1>"]), max_size=25))
def test_any_markup_is_read(parts):
    text = html_text.main_text("".join(parts))
    assert text == text.strip() and "  " not in text


def _hosted(k, body, extra=""):
    return f"<html><body><div class=top>Welcome to our site</div>{extra}<div><h1>Title {k}</h1><p>{body}</p></div><div class=bottom>All rights kept<div>Imprint</div></div></body></html>"


def test_templates_are_deduced(spark):
    rows = [(k, f"https://H.example:80/{k}", _hosted(k, f"story number {k * k}", "<div>seen twice</div>" * (k % 2 + 1))) for k in range(12)]
    rows += [(100 + k, "https://few.example/", _hosted(k, "a")) for k in range(2)] + [(200, None, None), (201, "x", "<p>lone</p>"), (None, "https://h.example/", _hosted(99, "no id"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for k in range(12):
        text = got[k]
        assert f"story number {k * k}" in text and f"Title {k}" in text
        assert "Welcome" not in text and "rights" not in text and "Imprint" not in text
    assert "Welcome to our site" in got[100]  # two pages are too few for a template
    assert got[200] == "" and got[201] == "lone" and "no id" in got[None]
    assert html_text.extract(pages.where("false")).count() == 0


def test_copied_articles_stay_whole(spark):
    body = "<html><body><nav>m</nav><article><h1>Copied</h1><p>same text</p></article></body></html>"
    pages = spark.createDataFrame([(k, "https://c.example/", body) for k in range(20)] + [(50, "https://c.example/", body.replace("same", "other"))], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(pages).collect()} == {"Copied\n\nsame text", "Copied\n\nother text"}


def test_hosts_agree(spark):
    urls = ["https://A.example:8/x", "http://u:p@b.example?q", "//c.example/x", "d.example/x", "", None, "HTTP://E.example"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(html_text.host_column("u")).collect()] == [html_text.host_of(u) for u in urls]


def test_articles_of_the_test_pages(spark):
    import html as entities
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<br>", " ", x).replace("<b>", "")).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n\n".join(x for x in blocks if x)


def _archive(n=30):
    out = io.BytesIO()
    payloads = [(f"<html>page {k} " + "text of a page " * 20).encode() for k in range(n)]
    digests = [hashlib.sha256(p).hexdigest() for p in payloads]
    warc.write_archive(out, (warc.record(k, f"https://h/{k}\r\nX: y", p, d, 0, k == 7) for k, (p, d) in enumerate(zip(payloads, digests, strict=True))))
    return out.getvalue(), payloads


def test_archive_round_trip():
    data, payloads = _archive()
    assert struct.unpack_from("<I", data)[0] == warc.DICT_MAGIC
    records = list(warc.read_archive(memoryview(data)))
    assert len(records) == 30
    for k, (headers, block) in enumerate(records):
        page, size, _, kind, _ = warc.page_of(headers, block)
        assert (page, size, kind) == (k, len(payloads[k]), "revisit" if k == 7 else "response")
        assert headers["warc-target-uri"] == f"https://h/{k}%0D%0AX:%20y"


def test_damaged_archives_are_refused():
    data, _ = _archive()
    size = 8 + struct.unpack_from("<I", data, 4)[0]
    for bad in (data[:-1], data[:-20], data[: size - 5], data[:size] + b"junkjunkjunk", data[:size] + data[size + 1 :], data[: size + 40] + bytes([data[size + 40] ^ 255]) + data[size + 41 :]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(memoryview(bad)))
    pack = zstandard.ZstdCompressor().compress
    good = warc.record(1, "u", b"x", hashlib.sha256(b"x").hexdigest(), None, False)
    assert len(list(warc.read_archive(memoryview(pack(good))))) == 1
    for bad in (good[:-2], good + b"x", good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"WARC Date"), good.replace(b"WARC-Record-ID", b"WARC-Other-ID"), good + good):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(memoryview(pack(bad))))
    headers, block = next(warc.read_archive(memoryview(pack(good.replace(b"\r\n\r\nx", b"\r\n\r\ny")))))
    with pytest.raises(warc.WarcError):
        warc.page_of(headers, block)


def test_compressed_dictionary_frame():
    data, _ = _archive()
    size = struct.unpack_from("<I", data, 4)[0]
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    again = struct.pack("<II", warc.DICT_MAGIC, len(packed)) + packed + data[8 + size :]
    assert len(list(warc.read_archive(memoryview(again)))) == 30


def test_archives_of_odd_pages(spark):
    big = "x" * 200
    rows = [(None, None, big), (9, "a\nb", big), (8, "u", big), (8, "u", big), (1, "u", None), (2, "u", "y"), (3, "u", "y"), (4, None, "z" * 99), (5, "u", "z" * 99), (6, "u", "é" * 50), (7, "u", "é" * 50), (None, "u", "q" * 300), (None, "u", "q" * 300)]
    pages = spark.createDataFrame([(*r, "extra", 1, "x", True, b"y") for r in rows], "page_id long, url string, html string, digest string, first int, n string, revisit boolean, payload binary")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_digests(pages).collect()), key=repr)
    assert got == sorted(
        [(None, 200, "revisit", 8), (9, 200, "revisit", 8), (8, 200, "response", None), (8, 200, "response", None), (1, 0, "response", None), (2, 1, "response", None), (3, 1, "response", None), (4, 99, "response", None), (5, 99, "response", None), (6, 100, "response", None), (7, 100, "revisit", 6), (None, 300, "response", None), (None, 300, "response", None)],
        key=repr,
    )
    assert warc.archive_digests(pages.where("false")).count() == 0


def plain_top(ids, matrix, query_ids, k):
    out = {}
    for q in query_ids:
        scores = matrix.astype(object) @ matrix[list(ids).index(q)].astype(object)
        out[q] = sorted(((-int(s), int(i)) for i, s in zip(ids, scores, strict=True) if i != q))[:k]
    return out


@pytest.mark.parametrize(("shard", "block", "scale"), [(1 << 16, 1 << 11, 1.0), (70, 7, 1.0), (100, 50, 0.01)])
def test_top_k_equals_brute_force(spark, monkeypatch, shard, block, scale):
    monkeypatch.setattr(top_k, "SHARD", shard)
    monkeypatch.setattr(top_k, "BLOCK", block)
    rng = np.random.default_rng(7)
    ids = rng.permutation(600)
    x = rng.normal(0, scale, (600, 16)).astype(np.float32)
    x[ids % 6 == 0] = x[0]  # many ties
    vectors = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = {}
    for r in top_k.top_k(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    whole = np.floor(256 * x.astype(float)).astype(np.int64)
    assert got == plain_top(ids.tolist(), whole, [i for i in ids.tolist() if i % 50 == 0], 5)


def test_top_k_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [9.0, 9.0]), (5, [1.0]), (6, [1.0, 1.0, 1.0]), (7, []), (50, [-1.0, 0.5]), (50, [1e12, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k.top_k(vectors, vectors.where("vec_id = 0")).collect()))
    assert got == [(0, 1, 50, 65_536 * 10**12), (0, 2, 5, 65_536), (0, 3, 6, 65_536), (0, 4, 7, 0), (0, 5, 50, -65_536)]
    twice = top_k.top_k(vectors, vectors.where("vec_id = 50")).groupBy("query_id", "rank").count().collect()
    assert {r["count"] for r in twice} == {2}
    assert top_k.top_k(vectors.where("false"), vectors.where("false")).count() == 0
    assert top_k.top_k(vectors.where("vec_id = 0"), vectors.where("vec_id = 0")).count() == 0


def test_search_stops_early_and_is_still_exact():
    rng = np.random.default_rng(1)
    matrix = rng.integers(-5, 6, (5000, 8))
    matrix[:20] *= 40
    shard = top_k.Shard(np.arange(5000), matrix)
    for own in (0, 3, 77):
        ids, scores = shard.search(own, matrix[own], 5)
        want = sorted(((-int(s), i) for i, s in enumerate(matrix @ matrix[own]) if i != own))[:5]
        assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == want
        assert len(shard._possible(matrix[own], 5, own, own + 1)) < 5000


def test_test_vectors_need_under_60_percent_of_postings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    whole = np.floor(256 * np.array([r.embedding for r in rows], float)).astype(np.int64)
    shard, queries = top_k.Shard(ids, whole), np.flatnonzero(ids % 50 == 0)
    for q in queries:
        near, scores = shard.search(int(ids[q]), whole[q], 5)
        exact = whole @ whole[q]
        want = [x for x in np.lexsort((ids, -exact)) if x != q][:5]
        assert near.tolist() == ids[want].tolist() and scores.tolist() == exact[want].tolist()
    assert shard.processed < 0.6 * whole.size * len(queries)


@pytest.mark.parametrize("scale", [1, 40, 9000, 1 << 21])
def test_search_of_coarse_impacts_is_exact(scale):
    rng = np.random.default_rng(scale)
    matrix = rng.integers(-scale, scale + 1, (3000, 12))
    matrix[::3] = matrix[0]
    shard = top_k.Shard(rng.permutation(3000), matrix)
    for query in [*shard.matrix[:5], -shard.matrix[7], np.zeros(12, np.int64), rng.integers(-scale, scale + 1, 12)]:
        ids, scores = shard.search(-1, query, 7)
        want = sorted((-int(s), int(i)) for i, s in zip(shard.ids, shard.matrix @ query, strict=True))[:7]
        assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == want


def test_top_k_of_outside_queries_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1, (500, 6)), rng.normal(0, 9, (9, 6))
    frame = lambda m, first: spark.createDataFrame([(first + i, v.tolist(), 1, 2, 3, 4) for i, v in enumerate(m)], "vec_id long, embedding array<double>, id int, v int, q int, score int")
    got = {}
    for r in top_k.top_k(frame(x, 0), frame(y, 10_000)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    a, b = (np.floor(256 * m).astype(np.int64) for m in (x, y))
    assert got == {10_000 + i: sorted((-int(s), k) for k, s in enumerate(a @ q))[:5] for i, q in enumerate(b)}


def test_shards_are_bounded_by_components(monkeypatch):
    monkeypatch.setattr(top_k, "CELLS", 64)
    dice = np.random.default_rng(3)
    rows = [(k, dice.normal(size=dice.integers(0, 20)).tolist()) for k in range(200)] + [(900, [0.5] * 100), (901, [])]
    batches = [pa.record_batch([pa.array([i for i, _ in part], pa.int64()), pa.array([v for _, v in part], pa.list_(pa.float64()))], ["id", "v"]) for part in (rows[:77], rows[77:])]
    taken = list(top_k._take(iter(batches), 10))
    assert [i for ids, _ in taken for i in ids.tolist()] == [i for i, _ in rows]
    assert all(len(ids) <= 10 and (m.size <= 64 or len(ids) == 1) for ids, m in taken)
    vectors = dict(rows)
    assert all(m[k, : len(vectors[i])].tolist() == np.floor(256 * np.array(vectors[i])).tolist() for ids, m in taken for k, i in enumerate(ids.tolist()))
