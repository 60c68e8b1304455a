"""Periodic runs against a plain search of every period."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from linkloom.llm import periodic_runs as pr
from linkloom.llm import queries


def plain_runs(w):
    n, found = len(w), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            stretch = w[start : start + length]
            if i > start and length >= max(24, 3 * q) and all(any(stretch[k] != stretch[k + p] for k in range(length - p)) for p in range(1, q)):
                found.add((start, q, length))
            i += i == start
    return sorted(found)


def collapsed(words, runs):
    drop = {i for start, q, length in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def periodic(rng, n, kinds):
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(rng.randrange(3) if n > 30 else 0):
        a, e = sorted(rng.sample(range(n), 2))
        p = rng.randrange(1, (n - a) // 3 + 2)
        for i in range(a + p, e):
            w[i] = w[i - p]
    return w


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    docs = [" ".join(periodic(rng, rng.randrange(300), rng.choice([1, 2, 3, 40]))) for _ in range(150)]
    docs += [" ".join(periodic(rng, 2500, 60)), "x " * 900, "\x0b".join("ab" * 30), "a b\tc\n" * 30 + " d\r\n" * 50, "", None, " \n ", "é\x1c à " * 40]
    return list(enumerate(docs + docs[:5]))


def check(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "rid", "runs", "fragments", "start")})
    got = {r.id: r for r in pr.periodic_runs(df).collect()}
    assert len(got) == len(texts)
    for i, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(words)
        assert [(r.start, r.period, r.length) for r in got[i].runs] == runs, (i, text)
        assert got[i].collapsed == collapsed(words, runs) and got[i].n_words == len(words)


def test_runs_equal_the_plain_search(spark, texts):
    check(spark, texts)


@pytest.mark.parametrize("core", [16, 100])
def test_tiles_are_stitched(spark, texts, monkeypatch, core):
    """Functions that tasks run by value take the module's constants along only where it is pickled, so short tiles are tried in this process."""
    monkeypatch.setattr(pr, "CORE", core)
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in texts]
    rows = [(k, q, a, b) for k, found in enumerate(pr.fragments_of([[w.encode() for w in d] for d in docs])) for q, a, b in found]
    runs = {r.rid: [(x.start, x.period, x.length) for x in r.runs] for r in pr.stitched(spark.createDataFrame(rows, "rid long, period long, start long, stop long")).collect()}
    assert all(runs.get(k, []) == plain_runs(d) for k, d in enumerate(docs))


def test_long_documents_are_dealt_as_tiles(spark, texts):
    df = spark.createDataFrame([(i, (t or "").encode()) for i, t in texts], "rid long, text binary")
    dealt = pr.exploded(df).repartition(5, "rid", "b", "at")
    runs = {r.rid: [(x.start, x.period, x.length) for x in r.runs] for r in pr.stitched(pr.solved_tiles(dealt)).collect()}
    for i, t in texts:
        assert runs.get(i, []) == plain_runs(re.findall(r"[^\x20\x09-\x0D]+", t or "")), i


def test_tiles_cover_and_overlap():
    for n in (24, 4096, 4097, 50_000, 300_001):
        for b, least, most in pr.octaves(n):
            ends = list(pr.tiles(n, b))
            assert ends[0][0] == 0 and ends[-1][1] == n and least <= most <= n // 3
            assert all(x[1] - y[0] == 4 * b for x, y in zip(ends, ends[1:], strict=False))


def test_z_function():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        assert pr.z_function(s, len(s)) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def test_odd_rows(odd, none):
    assert pr.periodic_runs(odd).count() == odd.count() and pr.periodic_runs(none).count() == 0
    assert {len(r.runs) for r in pr.periodic_runs(odd).where("id = 900008").collect()} == {1}
    assert {r.collapsed for r in pr.periodic_runs(odd.where("doc_id = 900001")).collect()} == {""}


def test_query(spark, documents, tmp_path):
    rows = documents.limit(150).union(spark.createDataFrame([(10**9 + i, " ".join(f"w{k * k % 97}" for k in range(80 + i)), "en", "s", 1) for i in range(40)] + [(5 * 10**9, None, None, None, None)], documents.schema))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for r in rows.collect():
        words, h = re.findall(r"[^\x20\x09-\x0D]+", r.text or ""), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = max(runs, key=lambda x: (x[2] / x[1], -x[0], -x[1]), default=(None, None, None))
        x = got[r.doc_id]
        assert (x.n_runs, x.start, x.period, x.length) == (len(runs), *best), r.doc_id
        assert x.exponent_milli == (1000 * best[2] // best[1] if runs else None)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, q, n in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted > 9
