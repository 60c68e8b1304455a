"""Writers and small operators that no query reaches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators import classify, triage
from linkloom.plans.config import CrawlConfig
from linkloom.sources import readers, report_parts, shared, writers
from linkloom.streaming import journal, progress
from tests.conftest import rows


def test_browser_and_verdict_json(spark):
    pages = spark.createDataFrame([("u", "t", 200, 0, 1, 0)], "url string, title string, status int, depth int, internal long, external long")
    external = spark.createDataFrame([("e", "h")], "url string, host string")
    errors = spark.createDataFrame([("x", "r", "s")], "url string, reason string, source string")
    lists = spark.createDataFrame([("e", ["u"])], "target string, found_on array<string>")
    got = json.loads(writers.browser_json(pages, external, errors, lists).first().value)
    assert got["summary"] == {"pages": 1, "externals": 1, "errors": 1} and got["externals"][0]["foundOn"] == ["u"]
    verdicts = spark.createDataFrame([("u", "cli", "", 200, "ok", "HTTP 200", "t", "u"), ("v", "cli", "", 404, "broken", "HTTP 404", "", "v")], "url string, kind string, was string, status int, disposition string, note string, title string, finalUrl string")
    got = json.loads(writers.verdicts_json(verdicts, "now", "http", "list").first().value)
    assert got["total"] == 2 and got["summary"] == {"ok": 1, "broken": 1, "blocked": 0} and len(got["results"]) == 2
    state = writers.state_json(spark.createDataFrame([("b", "2"), ("a", "1")], "key string, value string"), "h", "app").first().value
    assert json.loads(state) == {"app": "app", "host": "h", "v": {"a": "1", "b": "2"}}


def test_exports(spark, tmp_path):
    flagged = spark.createDataFrame([("u", "HTTP 404", "p"), ("v", "HTTP 410", "p")], "url string, reason string, source string")
    picked = spark.createDataFrame([("v",), ("v",)], "url string")
    assert rows(writers.picked_allowlist(flagged, picked)) == [("v   # HTTP 410 — found on: p",)]
    pairs = spark.createDataFrame([("internal", "u", "broken", "https://h/a b", False), ("internal", "u", "broken", "https://h/a_b", True), ("internal", "w", "working", "https://h/c", False)], "kind string, url string, verdict string, page string, fixed boolean")
    groups = triage.export_groups(pairs)
    assert rows(groups, "group", "file") == [("https://h/a b", "h_a_b"), ("https://h/a_b", "h_a_b-2")]
    assert rows(triage.export_groups(pairs, "folder"), "group", "pages", "links") == [("h/a b/", 1, 1), ("h/a_b/", 1, 1)]
    writers.bulk_export(pairs.withColumnRenamed("page", "group"), groups, str(tmp_path / "bulk"))
    assert {p.name for p in (tmp_path / "bulk").glob("file=*")} == {"file=h_a_b", "file=h_a_b-2"}
    writers.write_tables({"pairs": pairs}, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/pairs")).count() == 3
    sites = writers.site_names(spark.createDataFrame([(1, "a.b")], "index int, host string"), "crawl", ".html")
    assert sites.first().file == "crawl.1-a.b.html"
    line = spark.range(1).select(writers.log_line("OK", F.lit("t"), F.lit(1), F.lit(200), F.lit("u"), F.lit(2), F.lit(3), F.lit(4))).first()[0]
    assert progress.parse(spark.createDataFrame([(line,)], "value string")).first().external == 4
    assert spark.range(1).select(urls.url_key(F.lit("x"))).first()[0] is not None


def test_bulk_verdicts_and_effective_values(spark):
    links = spark.createDataFrame([("https://a/x",), ("https://a/y",), ("https://b/z",)], "url string")
    empty = spark.createDataFrame([], "family string, url string, value string")
    got = triage.bulk_verdict(empty, links, urls.host_group("url"), "a", "broken", "t")
    assert rows(got) == [("broken", "https://a/x", "1"), ("broken", "https://a/y", "1"), ("ts", "https://a/x", "t"), ("ts", "https://a/y", "t")]
    assert spark.range(1).select(triage.effective(F.lit(None), F.lit("baked"))).first()[0] == "baked"


def test_checkpoints_and_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text("2024-01-01T00:00:05Z OK u\n2024-01-01T00:00:45Z ERR v\n2024-01-01T00:01:05Z OK w\n")
    stream = progress.parse(progress.lines(spark, str(tmp_path / "in"))).withColumn("ts", F.to_timestamp(F.substring_index("value", " ", 1)))
    batches = []
    query = journal.checkpoints(stream.select("tag"), lambda df, n: batches.append(df.count()), str(tmp_path / "ckpt"), 1)
    query.processAllAvailable()
    query.stop()
    assert sum(batches) == 3
    table = progress.per_window(progress.parse(spark.read.text(str(tmp_path / "in"))).withColumn("ts", F.to_timestamp(F.substring_index("value", " ", 1))), "ts")
    assert sorted((r.tag, r.n) for r in table.collect()) == [("ERR", 1), ("OK", 1), ("OK", 1)]


def test_scratch_tables_are_deleted_and_clusters_must_name_a_folder(spark, monkeypatch):
    with shared.scratch(spark):
        table = shared.Tables(spark).write(spark.range(5), "t")
        path = next(iter(table.inputFiles()))
        assert table.count() == 5 and os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(ValueError, match="share"):
        shared.shared_dir(Cluster)


def test_report_parts_read_one_after_another_are_the_report(spark, tmp_path):
    some = lambda k: f'https://s.example/"p{k}"'
    tables = {
        "pages": spark.createDataFrame([(some(k), None if k % 5 == 0 else f"T\n{k}", 200, k % 3, k, 1) for k in range(40)], "url string, title string, status int, depth int, internal long, external long"),
        "external": spark.createDataFrame([(f"https://o{k}.example/", f"o{k}.example", None) for k in range(9)], "url string, host string, status string"),
        "out_of_scope": spark.createDataFrame([], "url string"),
        "flagged": spark.createDataFrame([(some(k), "gone", "" if k % 4 else some(99), None if k % 2 else "external", "blocked" if k % 5 == 0 else "broken", k % 3 == 0) for k in range(20)], "url string, reason string, source string, kind string, disposition string, suppressed boolean"),
        "refs": spark.createDataFrame([(f"https://o{k % 7}.example/", some(k), k) for k in range(30)] + [(some(3), f"r{k}", k) for k in range(25)], "target string, referrer string, first_seen int"),
    }
    config = CrawlConfig(start_url="https://s.example/", max_pages=None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        names = report_parts.write_report(tables, config, "2024-01-01T00:00:00Z", str(tmp_path / "parts"), size=4).orderBy("part").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [(tmp_path / "parts" / r["name"]).read_text() for r in names]
    want = writers.report_json(tables, config, "2024-01-01T00:00:00Z").first().value
    assert json.loads("".join(parts)) == json.loads(want) and len(parts) > 1
    assert list(json.loads("".join(parts))) == list(json.loads(want)) and sum(r["bytes"] for r in names) == sum(len(p.encode()) for p in parts)
    plan = report_parts.report_pieces(tables, config, "now", size=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Cartesian" not in plan  # chunks of bounded length are written before


@pytest.mark.parametrize("size", [4, 1000])
def test_report_parts_are_read_back_by_lines(spark, tmp_path, size):
    """The tables of the parts equal those of the document read as one, with lists of referrers over several lines and texts like those between the lines."""
    some = lambda k: f'https://s.example/"p{k}]}}"'
    tables = {
        "pages": spark.createDataFrame([(some(k), None if k % 5 == 0 else f"T\n{{{k}", 200, k % 3, k, 1) for k in range(40)], "url string, title string, status int, depth int, internal long, external long"),
        "external": spark.createDataFrame([(f"https://o{k}.example/", f"o{k}.example", None) for k in range(9)], "url string, host string, status string"),
        "out_of_scope": spark.createDataFrame([("https://s.example/out",)], "url string"),
        "flagged": spark.createDataFrame([(some(k), "gone", "" if k % 4 else some(99), None if k % 2 else "external", "blocked" if k % 5 == 0 else "broken", k % 3 == 0) for k in range(20)], "url string, reason string, source string, kind string, disposition string, suppressed boolean"),
        "refs": spark.createDataFrame([(f"https://o{k % 7}.example/", some(k), k) for k in range(30)] + [(some(3), f'r{k}{{"]}}', k) for k in range(25)] + [(some(6), ',"errors":[', 1)], "target string, referrer string, first_seen int"),
    }
    config = CrawlConfig(start_url="https://s.example/", max_pages=None)
    folder = str(tmp_path / "parts")
    report_parts.write_report(tables, config, "2024-01-01T00:00:00Z", folder, size=size)
    got = report_parts.read_report(spark, folder)
    writers.write_file(writers.report_json(tables, config, "2024-01-01T00:00:00Z"), str(tmp_path / "one.json"))
    one = readers.report(spark, str(tmp_path / "one.json"))
    want = readers.entities(one)
    for name in ("pages", "external", "out_of_scope", "flagged"):
        assert rows(got[name]) == rows(want[name]), name
    assert rows(got["refs"], "target", "referrer") == rows(want["refs"], "target", "referrer")
    assert rows(got["start_host"]) == rows(readers.start_host(one)) == [("s.example",)]
    order = lambda refs: [r.referrer for r in refs.where(F.col("target") == some(3)).orderBy("first_seen").collect()]
    assert order(got["refs"]) == order(want["refs"]) == [f'r{k}{{"]}}' for k in range(25)]


def test_parts_of_the_smaller_document(spark, tmp_path):
    pages = spark.createDataFrame([(f"u{k}", None if k == 2 else "t", 200, 0, 1, 0) for k in range(5)], "url string, title string, status int, depth int, internal long, external long")
    external = spark.createDataFrame([(f"e{k}", "h") for k in range(4)], "url string, host string")
    errors = spark.createDataFrame([("x", "r", "s"), ("y", None, "s")], "url string, reason string, source string")
    refs = spark.createDataFrame([(f"e{k % 3}", f"u{k}", k) for k in range(30) if k % 3 or k < 4], "target string, referrer string, first_seen int")
    folder = tmp_path / "browser"
    report_parts.write_browser(pages, external, errors, refs, str(folder), size=4)
    whole = json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))
    assert whole == json.loads(writers.browser_json(pages, external, errors, classify.referrer_lists(refs)).first().value)
    got = report_parts.read_browser(spark, str(folder))
    assert rows(got["externals"]) == [("e0", "h", 2), ("e1", "h", 10), ("e2", "h", 10), ("e3", "h", 0)]
    assert rows(got["pages"]) == rows(pages) and rows(got["errors"]) == rows(errors) and rows(got["refs"]) == rows(refs, "target", "referrer")
