"""Readers, writers, journals, logs, streams and the live source."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.operators import journal
from linkloom.plans.config import CrawlConfig
from linkloom.sources import readers, writers
from linkloom.sources.live import FetchSource
from linkloom.streaming import journal as journal_stream
from linkloom.streaming import progress
from tests.conftest import rows

JOURNAL = """{"t":"meta","v":1,"startUrl":"https://s.example/"}
{"t":"v","u":"https://s.example/"}
{"t":"p","u":"https://s.example/","s":200,"d":0,"ti":"Home","in":["https://s.example/a","https://s.example/b","https://s.example/c"],"ex":[["https://o.example/#x","o.example"]],"oo":["https://s.example/out"]}
{"t":"v","u":"https://s.example/a"}
{"t":"e","u":"https://s.example/a","r":"HTTP 404","src":"https://s.example/"}
{"t":"v","u":"https://s.example/b"}
{"t":"r","at":"x"}
{"t":"v","u":"https://s.example/b"}
{"t":"p","u":"https://s.example/a","s":200,"d":1,"ti":"late","in":[]}

{"t":"zz","u":"q"}
{"t":"v","u":"https://s.exam"""


def test_journal_fold(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text(JOURNAL)
    events = readers.journal(spark, str(tmp_path / "j.jsonl"))
    assert events.count() == 10
    state = journal.fold(events, "https://s.example", 3)
    assert rows(state["pages"]) == [("https://s.example/", "Home", 200, 0, 3, 1)]
    assert rows(state["frontier"]) == [("https://s.example/c", 1, "https://s.example/")]
    flagged = rows(state["flagged"], "url", "kind", "disposition")
    assert flagged == [("https://s.example/a", "internal", "broken"), ("https://s.example/b", "internal", "blocked")]
    assert tuple(journal.resume_stats(events).first()) == (2, 1, 1, 0, 1)
    assert journal.head(events).first().startUrl == "https://s.example/"
    (tmp_path / "e.jsonl").write_text("")
    empty = journal.fold(readers.journal(spark, str(tmp_path / "e.jsonl")), "https://s.example/x", None)
    assert rows(empty["frontier"]) == [("https://s.example/x", 0, "(start)")] and empty["pages"].count() == 0


def test_journal_stream_equals_batch(spark, tmp_path):
    lines = [(i, s, t, u) for i, (s, t, u) in enumerate([(0, "v", "a"), (0, "v", "b"), (0, "p", "a"), (1, "v", "b"), (1, "e", "a"), (1, "v", "c"), (2, "b", "c")])]
    schema = "line long, session long, t string, u string"
    for name, cut in (("one", 7), ("many", 2)):
        folder = tmp_path / name
        for k in range(0, len(lines), cut):
            spark.createDataFrame(lines[k : k + cut], schema).coalesce(1).write.mode("append").parquet(str(folder))
            time.sleep(0.05)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        query = journal_stream.fold_urls(stream).writeStream.format("memory").queryName(f"fold_{name}").outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination(120)
        last = spark.sql(f"SELECT u, max_by(status, line * 10 + sessions) AS status FROM fold_{name} GROUP BY u")
        assert rows(last) == [("a", "page"), ("b", "quarantined"), ("c", "blocked")]


LOG = [
    "# crawl start", "2024 OK d0 200 https://a int=1 ext=2 extTotal=7", "2024 ERR https://b :: HTTP 404 :: found on https://a", "2024 SKIP https://c :: image/png", "2024 BLOCKED https://d :: HTTP 403 :: found on https://a\r",
    "# resume-stats crawled=10 good=5 broken=2 blocked=1 external=9", "RECHK ok https://e", "# extcheck 3/8 err HTTP 404 https://f", "# extcheck 4/8 blocked x https://g", "# BACKOFF t HTTP 429 waitMs=5 untilMs=777 attempt=1 url=u", "DONE_130", "# recheck-start total=4 host=h", "# recheck-done ok=1 stopped=1",
]


def test_progress_counters(spark, tmp_path):
    table = spark.createDataFrame(list(enumerate(LOG)), "line long, value string")
    parsed = progress.parse(table)
    got = progress.counters(parsed).first().asDict()
    assert got == {"crawled": 15, "good": 7, "broken": 3, "blocked": 3, "external": 9, "ext_checked": 4, "ext_total": 8, "ext_bad": 1, "recheck_total": 4, "backoff_until": 777, "done_code": 130}
    assert [r.text for r in progress.recent(parsed, 2).collect()] == ["ok  https://e", "BLOCKED  https://d :: HTTP 403 :: found on https://a"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("\n".join(LOG[:3]))
    (tmp_path / "in/b.log").write_text("\n".join(LOG[3:]))
    stream = progress.lines(spark, str(tmp_path / "in")).withColumn("line", F.lit(0))
    query = progress.counters(progress.parse(stream)).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    live = spark.table("live").first()
    assert (live.crawled, live.good, live.broken, live.blocked, live.ext_bad) == (15, 7, 3, 3, 1)
    one = spark.range(1)
    assert one.select(progress.rate_per_minute(F.lit(5), F.lit(40))).first()[0] == 8
    assert one.select(progress.backoff_left(F.lit(10), F.lit(30))).first()[0] == 0


def test_idle_alerts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("x OK u\n")
    stream = progress.parse(spark.readStream.text(str(tmp_path / "in")).withColumn("run", F.lit("r1")))
    query = progress.idle_alerts(stream.select("run", "tag"), idle_ms=500).writeStream.format("memory").queryName("idle").outputMode("update").trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(100):
            if {r.alert for r in spark.table("idle").collect()} >= {"active", "idle"}:
                break
            time.sleep(0.3)
        assert {(r.alert, r.results) for r in spark.table("idle").collect()} == {("active", 1), ("idle", 1)}
    finally:
        query.stop()


@settings(deadline=None, max_examples=8, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 50), st.booleans()), min_size=1, max_size=12))
def test_slots_and_streaks_equal_the_loops(spark, seen):
    seen = sorted(seen)
    df = spark.createDataFrame([("h", float(t) + i / 100, i, th) for i, (t, th) in enumerate(seen)], "host string, t double, i int, throttled boolean")
    slots = [r.slot for r in progress.rate_slots(df, 3.0).orderBy("i").collect()]
    nxt, want = 0.0, []
    for i, (t, _) in enumerate(seen):
        slot = max(t + i / 100, nxt)
        want.append(slot)
        nxt = slot + 3.0
    assert slots == pytest.approx(want)
    n, streaks = 0, []
    for _, th in seen:
        n = n + 1 if th else max(0, n - 1)
        streaks.append(n)
    assert [r.streak for r in progress.streak(df).orderBy("i").collect()] == streaks


def test_report_round_trip(spark, tmp_path):
    tables = {
        "pages": spark.createDataFrame([("https://s.example/", "T", 200, 0, 2, 1)], "url string, title string, status int, depth int, internal long, external long"),
        "external": spark.createDataFrame([("https://o.example/", "o.example", "err")], "url string, host string, status string"),
        "out_of_scope": spark.createDataFrame([("https://s.example/z",)], "url string"),
        "flagged": spark.createDataFrame([("https://o.example/", "gone", "", "external", "broken", False), ("https://s.example/q", "HTTP 404", "https://s.example/", None, "broken", True), ("https://s.example/w", "HTTP 403", "https://s.example/", "internal", "blocked", False)], "url string, reason string, source string, kind string, disposition string, suppressed boolean"),
        "refs": spark.createDataFrame([("https://o.example/", "https://s.example/", 1), ("https://s.example/z", "https://s.example/", 2)], "target string, referrer string, first_seen int"),
    }
    path = str(tmp_path / "r.json")
    writers.write_file(writers.report_json(tables, CrawlConfig(start_url="https://s.example/", max_pages=None), "2024-01-01T00:00:00Z"), path)
    raw = json.loads(open(path).read())
    assert raw["summary"]["brokenLinkInstances"] == 1 and raw["summary"]["suppressed"] == 1 and raw["settings"]["maxPages"] is None and raw["scope"] == "(whole domain)"
    assert raw["errors"][0]["foundOn"] == ["https://s.example/"]
    again = readers.entities(readers.report(spark, path))
    assert rows(again["flagged"], "url", "source", "kind", "disposition") == [("https://o.example/", "https://s.example/", "external", "broken"), ("https://s.example/q", "https://s.example/", "internal", "broken"), ("https://s.example/w", "https://s.example/", "internal", "blocked")]
    assert readers.start_host(readers.report(spark, path)).first()[0] == "s.example"
    writers.backup_once(spark, path)
    assert (tmp_path / "r.json.bak").exists() and writers.sidecar(path).endswith("r.recheck.json")
    sites = spark.createDataFrame([(0, "https://s.example/", "s.example", None, "", "r.json"), (1, "https://t.example/", "t.example", "done", "", "missing.json")], "index int, url string, host string, status string, reportFile string, jsonFile string")
    full = sites.withColumns({"summary": F.lit(None).cast("struct<pagesCrawled: bigint>"), "errors": F.array().cast("array<struct<url: string>>"), "blocked": F.array().cast("array<struct<url: string>>")})
    writers.write_file(writers.combined_json(full, "now"), str(tmp_path / "index.json"))
    found, missing = readers.site_reports(spark, str(tmp_path / "index.json"))
    assert rows(found, "jsonFile") == [("r.json",)] and rows(missing, "host") == [("t.example",)]
    assert json.loads((tmp_path / "index.json").read_text())["sites"][0]["status"] == "queued"
    (tmp_path / "bare.json").write_text('{"errors": [{"url": "https://z.example/x", "reason": "r"}]}')
    bare = readers.entities(readers.report(spark, str(tmp_path / "bare.json")))
    assert rows(bare["flagged"]) == [("https://z.example/x", "r", "", "internal", "broken")] and bare["pages"].count() == 0


def test_logs(spark, tmp_path):
    lines = spark.createDataFrame([(i, f"line {i}") for i in range(10)], "line long, value string")
    parts = writers.split_log(lines, 21)
    assert rows(writers.manifest(parts)) == [(p, 3, 21) for p in (1, 2, 3)] + [(4, 1, 7)]
    for part in (1, 2, 3, 4):
        body = [r.value for r in parts.where(F.col("part") == part).orderBy("line").collect()]
        (tmp_path / f"crawl-progress.part{part:03}.log").write_text("\n".join(['#META {"part": 1}', *body]) + "\n")
    back = readers.log_parts(spark, str(tmp_path))
    assert [r.value for r in back.orderBy("part", "line").collect()] == [f"line {i}" for i in range(10)]
    merged = [r.value for r in writers.merged_log(back, "r", False).orderBy("part", "line").collect()]
    assert merged[0] == "# composite log reconstructed from 4 part(s) (run r, INCOMPLETE)" and len(merged) == 11
    assert readers.part_meta(spark, str(tmp_path)).count() == 4


def test_small_files(spark, tmp_path):
    (tmp_path / "u.txt").write_text("https://a # x\n#c\n\n b#frag\n")
    assert rows(readers.url_list(spark, str(tmp_path / "u.txt"))) == [("b",), ("https://a",)]
    (tmp_path / "c.txt").write_text("a = 1\n# no\nb=x=y\nzz=1\na=YES\n")
    found = readers.settings(spark, str(tmp_path / "c.txt"), ["a", "b"])
    assert rows(found) == [("a", "YES"), ("b", "x=y")]
    assert found.where("key = 'a'").select(readers.flag(F.col("value"))).first()[0]
    (tmp_path / "s0.json").write_text('{"app": "linkloom-fixes", "host": "h", "v": {"cwfix:h:n:p": "1"}}')
    (tmp_path / "s1.json").write_text("broken{")
    states = readers.states(spark, [str(tmp_path / "s0.json"), str(tmp_path / "s1.json")])
    assert rows(states, "pos", "app") == [(0, "linkloom-fixes"), (1, None)]
    flagged = spark.createDataFrame([("u", "HTTP 404", "")], "url string, reason string, source string")
    assert writers.suggested_allowlist(flagged, str(tmp_path / "sug.txt"), "now", "allow.txt")
    assert (tmp_path / "sug.txt").read_text().splitlines()[-1] == "u   # HTTP 404 — found on: (start)"
    assert not writers.suggested_allowlist(flagged.limit(0), str(tmp_path / "none.txt"), "now", "x") and not (tmp_path / "none.txt").exists()
    writers.append_journal(spark.createDataFrame([("v", "u", None)], "t string, u string, r string"), str(tmp_path / "jr"))
    assert rows(readers.events(spark.read.text(str(tmp_path / "jr"))), "t", "u") == [("v", "u")]


@pytest.mark.parametrize(
    ("body", "agent", "delay"),
    [("User-agent: *\nCrawl-delay: 3", "bot", 3.0), ("User-agent: *\nCrawl-delay: 3\nUser-agent: bot\nCrawl-delay: 0", "MyBot", 0.0), ("User-agent: a\nUser-agent: bot\nCrawl-delay: 5s", "bot", 5.0), ("User-agent: bot\nCrawl-delay: 1\nDisallow:\nUser-agent: bot\nCrawl-delay: 2", "bot", 2.0), ("User-agent:\nCrawl-delay: 4", "bot", 4.0), ("Crawl-delay: 4", "bot", 0.0), ("User-agent: x\nCrawl-delay: y", "x", 0.0)],
)
def test_robots(spark, body, agent, delay):
    lines = spark.createDataFrame(list(enumerate(body.split("\n"))), "line int, value string")
    assert readers.robots_delay(lines, agent).first().delay == delay


class _Site(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/page")
        elif self.path == "/loop":
            self.send_response(302)
            self.send_header("Location", "/loop")
        else:
            self.send_response(200 if self.path == "/page" else 404)
            self.send_header("Content-Type", "text/html")
        self.end_headers()
        self.wfile.write(b"<title>hi</title>")

    do_HEAD = do_GET

    def log_message(self, *args):
        pass


def test_live_source(spark):
    server = HTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        spark.dataSource.register(FetchSource)
        asked = [f"{at}/page", f"{at}/moved", f"{at}/loop", f"{at}/gone", "ftp://x/", "nothing", "http://127.0.0.1:1/"]
        got = {r.url: (r.status, r.error is None) for r in spark.read.format("linkloom_fetch").option("urls", " ".join(asked)).load().collect()}
        assert got == {asked[0]: (200, True), asked[1]: (200, True), asked[2]: (302, True), asked[3]: (404, True), asked[4]: (0, False), asked[5]: (0, False), asked[6]: (0, False)}
    finally:
        server.shutdown()


class _Live(BaseHTTPRequestHandler):
    throttled = 0

    def do_GET(self):
        pages = {"/": '<title>Home</title><a href="/a">a</a><a href="/slow">s</a><a href="/missing">m</a><a href="http://out.example/">o</a>', "/a": '<a href="/deep">d</a>', "/deep": "<a href='/too-deep'>x</a>", "/robots.txt": "User-agent: *\nCrawl-delay: 0.01"}
        status, headers = (200, {}) if self.path in pages else (404, {})
        if self.path == "/slow":
            _Live.throttled += 1
            status, headers = (200, {}) if _Live.throttled > 1 else (429, {"Retry-After": "0.01"})
        if self.command == "HEAD" and self.path == "/a":
            status = 405
        self.send_response(status)
        for k, v in {"Content-Type": "text/plain" if self.path == "/robots.txt" else "text/html", **headers}.items():
            self.send_header(k, v)
        self.end_headers()
        if self.command == "GET":
            self.wfile.write(pages.get(self.path, "").encode())

    do_HEAD = do_GET

    def log_message(self, *args):
        pass


def test_live_crawl_and_controls(spark, tmp_path):
    from linkloom.operators import graph
    from linkloom.sources import live
    from linkloom.sources.control import Control

    server = HTTPServer(("127.0.0.1", 0), _Live)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        config = CrawlConfig(start_url=f"{at}/", max_depth=2, delay=0, concurrency=2)
        assert live.crawl_delay(spark, config) == 0.01
        done = graph.crawl_live(spark, config)
        assert {(r.url.removeprefix(at), r.depth) for r in done.pages.collect()} == {("/", 0), ("/a", 1), ("/slow", 1), ("/deep", 2)}
        assert [(r.url.removeprefix(at), r.reason, r.disposition) for r in done.flagged.collect()] == [("/missing", "HTTP 404", "broken")]
        assert rows(done.external, "url") == [("http://out.example/",)]
        asked = spark.createDataFrame([(f"{at}/a",), (f"{at}/missing",), ("http://127.0.0.1:1/",)], "url string")
        got = {r.url: r.status for r in live.probe_table(asked, config).collect()}
        assert got == {f"{at}/a": 200, f"{at}/missing": 404, "http://127.0.0.1:1/": 0}
        (tmp_path / "stop").write_text("")
        stopped = Control(CrawlConfig(start_url=f"{at}/", stop_file=str(tmp_path / "stop")))
        none = graph.crawl_live(spark, config, stopped)
        assert none.pages.count() == 0 and stopped.exit_code() == 130
    finally:
        server.shutdown()
    tune = tmp_path / "tune"
    tune.write_text('{"rps": 1}')
    control = Control(CrawlConfig(tune_file=str(tune), pause_file=str(tmp_path / "pause")), sleep=lambda s: (tmp_path / "pause").unlink())
    assert control.tuned(CrawlConfig()).rps == 0
    tune.write_text('{"rps": 2}')
    assert control.tuned(CrawlConfig()).rps == 2
    (tmp_path / "pause").write_text("")
    assert control.wait() and control.exit_code() == 0


def test_next_values_and_log_parts_over_spans(spark):
    """The next value of a later place, within a span and beyond empty ones, and a log of lines longer than its parts against a loop."""
    from linkloom.operators.running import next_value

    table = spark.createDataFrame([(k, None if k % 7 else k * 10) for k in range(0, 200, 3)], "at long, v long")
    want = [(k, next((j * 10 for j in range(0, 200, 3) if j > k and j % 7 == 0), None)) for k in range(0, 200, 3)]
    assert rows(next_value(table, "v", "next", "at", 10), "at", "next") == sorted(want, key=repr)
    lengths = [(k * 37) % 23 if k % 11 else 150 for k in range(400)]
    part, size, expected = 1, 4, []
    for k, n in enumerate(lengths):
        if size + n + 1 > 40 and size > 4:
            part, size = part + 1, 4
        size += n + 1
        expected.append((part, k))
    lines = spark.createDataFrame([(k, "x" * n) for k, n in enumerate(lengths)], "line long, value string")
    split = writers.split_log(lines, 40, 4)
    assert sorted(tuple(r) for r in split.select("part", "line").collect()) == expected
    framed = writers._first_beyond(lines.withColumns({"end": F.col("line"), "full": F.col("line")}), 40)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in framed.lower()  # a frame that Spark goes through anew for each row
