"""A live crawl under a cap that cuts a level of several parents."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from linkloom.operators import graph
from linkloom.plans.config import CrawlConfig
from linkloom.sources import live

SITE = {"/": "ba", "/b": "xyw", "/a": "cd", **{f"/{k}": "" for k in "xywcd"}}


class _Site(BaseHTTPRequestHandler):
    def do_GET(self):
        self.send_response(200 if self.path in SITE else 404)
        self.send_header("Content-Type", "text/html")
        self.end_headers()
        self.wfile.write("".join(f'<a href="/{k}">{k}</a>' for k in SITE.get(self.path, "")).encode())

    def log_message(self, *args):
        pass


def test_the_cap_fetches_the_pages_that_are_judged(spark):
    server = HTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        done = graph.crawl_live(spark, CrawlConfig(start_url=f"{at}/", max_pages=6, delay=0, concurrency=2))
        assert {r.url.removeprefix(at) for r in done.pages.collect()} == {"/", "/b", "/a", "/x", "/y", "/w"}
        assert done.flagged.count() == 0
    finally:
        server.shutdown()


def test_patience(monkeypatch):
    answers = iter([(429, "2"), (503, "Wed, 21 Oct 2015 07:28:30 GMT"), (200, None), (429, "NaN"), (429, None), (429, None)])
    monkeypatch.setattr(live, "fetch", lambda url, *a, **k: (url, *(lambda s, r: (s, None, r))(*next(answers)), b"", None))
    slept = []
    config = CrawlConfig(start_url="https://s.example/", max_retries=2, max_backoff=300)
    patience = live.Patience(config, slept.append, lambda: 1445412480.0, lambda: 0.5)
    assert patience.fetch("a")[1] == 200 and slept == [2.0, 30.0]
    assert patience.fetch("b")[1] == 429 and slept[2:] == [10.0, 20.0] and patience.streak == 4


def test_levels_are_fetched_once_over_a_restart(spark, tmp_path):
    server, asked = HTTPServer(("127.0.0.1", 0), _Site), []
    server.RequestHandlerClass = type("_Counted", (_Site,), {"do_GET": lambda self: (asked.append(self.path), _Site.do_GET(self))})
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(live.FetchSource)
    try:
        at, frontier = f"http://127.0.0.1:{server.server_port}", f"file://{tmp_path}/frontier"
        for level, paths in enumerate((["/"], ["/a", "/b", "/none"], [])):
            urls = spark.createDataFrame([(at + p,) for p in paths], "url string")
            live.write_level(urls.coalesce(1), frontier, level, size=2)
            query = spark.readStream.format("linkloom_fetch").option("frontier", frontier).load().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").start(f"{tmp_path}/out")
            query.processAllAvailable()
            query.stop()
        got = {(r.url.removeprefix(at), r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        assert got == {("/", 200), ("/a", 200), ("/b", 200), ("/none", 404)}
        assert sorted(asked) == ["/", "/a", "/b", "/none"]
        parts = live._Frontier({"frontier": frontier}).partitions({"level": 1}, {"level": 2})
        assert len(parts) == 2
    finally:
        server.shutdown()
