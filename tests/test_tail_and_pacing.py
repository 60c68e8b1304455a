"""Growing files and shared pacing as streams."""

import json
import time

from linkloom.streaming import journal, pacing, progress

EVENT = "host string, t long, url string, status int, retry_ms long"


def _drain(query):
    query.processAllAvailable()


def test_a_growing_part_is_followed(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    part = folder / "a.log"
    part.write_bytes("one\ntwo é\r\ntor".encode())
    query = progress.tail(spark, str(folder), "*.log").writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        got = lambda: sorted((r.file, r.start, r.value) for r in spark.table("tailed").collect())
        _drain(query)
        assert got() == [("a.log", 0, "one"), ("a.log", 4, "two é")]
        with part.open("ab") as f:
            f.write(b"n\nthree\nlast")
        _drain(query)
        assert [v for *_, v in got()] == ["one", "two é", "torn", "three"]
        (folder / "b.log").write_text("next\n")
        _drain(query)
        assert got() == [("a.log", 0, "one"), ("a.log", 4, "two é"), ("a.log", 12, "torn"), ("a.log", 17, "three"), ("a.log", 23, "last"), ("b.log", 0, "next")]
    finally:
        query.stop()


def test_batches_by_lines_go_on_after_a_restart(spark, tmp_path):
    folder, sizes, seen = tmp_path / "in", [], []
    folder.mkdir()
    (folder / "a").write_text("".join(f"x{k}\n" for k in range(25)))

    def write(df, n):
        values = [r.value for r in df.collect()]
        sizes.append(len(values))
        seen.extend(values)

    for more in (0, 7):
        with (folder / "a").open("a") as f:
            f.write("".join(f"y{k}\n" for k in range(more)))
        stream = progress.tail(spark, str(folder), max_lines=10, positions=str(tmp_path / "at.json"))
        query = journal.checkpoints(stream, write, str(tmp_path / "c"), 0)
        _drain(query)
        query.stop()
    assert [n for n in sizes if n] == [10, 10, 5, 7]
    assert seen == [f"x{k}" for k in range(25)] + [f"y{k}" for k in range(7)]


def test_long_ranges_are_cut_at_lines(tmp_path, monkeypatch):
    from linkloom.sources import tail

    monkeypatch.setattr(tail, "TASK", 50)
    monkeypatch.setattr(tail, "BLOCK", 7)
    (tmp_path / "f").write_text("".join(f"line {k}\n" for k in range(60)) + "torn")
    reader = tail._Tail({"path": str(tmp_path)})
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    rows = [r for p in parts for r in reader.read(p)]
    assert [v for *_, v in rows] == [f"line {k}" for k in range(60)] and len(parts) > 5
    assert all(rows[i][1] == sum(len(f"line {k}\n") for k in range(i)) for i in range(60))
    (tmp_path / "f").write_text("short\n")
    assert [v for p in reader.partitions(end, reader.latestOffset()) for *_, v in reader.read(p)] == ["short"]


def test_all_workers_of_a_host_share_a_backoff(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    now = int(time.time() * 1000)
    put = lambda name, rows: (folder / name).write_text("".join(json.dumps(dict(zip(("host", "t", "url", "status", "retry_ms"), r, strict=True))) + "\n" for r in rows))
    # two workers' files: one was throttled, the other asks
    put("w1.json", [("a", now, "/x", 429, 60_000), ("b", now, "/y", 200, None)])
    put("w2.json", [("a", now + 1, "/1", None, None), ("a", now + 2, "/2", None, None), ("b", now, "/3", None, None), ("b", now, "/4", None, None)])
    stream = spark.readStream.schema(EVENT).json(str(folder))
    query = pacing.paced(stream, 500, 20_000).writeStream.format("memory").queryName("paced").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        def wait(n, most):
            stop = time.time() + most
            while time.time() < stop and spark.table("paced").count() < n:
                time.sleep(1)
            return {(r.host, r.url): r for r in spark.table("paced").collect()}

        first = wait(2, 60)
        assert set(first) == {("b", "/3"), ("b", "/4")} and first["b", "/4"].slot == first["b", "/3"].slot + 500
        both = wait(4, 90)
        assert both["a", "/1"].slot >= now + 20_000 and both["a", "/2"].slot == both["a", "/1"].slot + 500 and both["a", "/1"].streak == 1
    finally:
        query.stop()


def test_backoff_doubles_and_relaxes():
    until, streak = 0, 0
    for t, status, retry, want in ((0, 503, 0, (5000, 1)), (5000, 429, 0, (15_000, 2)), (6000, 200, 0, (15_000, 1)), (7000, 429, 2000, (15_000, 2)), (90_000, 429, 0, (110_000, 3)), (90_001, 404, 0, (110_000, 2))):
        until, streak = pacing._after((t, status, retry), until, streak, 60_000)
        assert (until, streak) == want
