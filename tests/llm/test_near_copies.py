"""Near copies against all pairs compared exactly."""

import random

import pytest

from linkloom.llm import near_copies as nc
from linkloom.llm import stages

SF = "/root/testdata/sf0.01"


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1)))}


def plain_groups(rows):
    return sorted(grouped([(i, plain_set(t)) for i, t in rows]), key=repr)


def grouped(rows):
    sets, least = [s for _, s in rows], list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if (sets[x] or sets[y]) and both / len(sets[x] | sets[y]) >= 0.8 or not sets[x] and not sets[y]:
                a, b = least[x], least[y]
                least = [min(a, b) if v in (a, b) else v for v in least]
    ids = {}
    for (i, _), g in zip(rows, least, strict=True):
        ids[g] = min((v for v in (ids.get(g), i) if v is not None), default=None)
    return [(i, ids[g]) for (i, _), g in zip(rows, least, strict=True)]


def varied(seed, words, copies, changed):
    dice = random.Random(seed)
    base = [f"w{dice.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        own = list(base)
        for at in dice.sample(range(words), changed):
            own[at] = f"x{dice.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def checked(spark, rows):
    got = nc.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_groups(rows)


def test_groups_equal_those_of_all_pairs(spark):
    texts = [t for seed in range(12) for t in varied(seed, 60 + 20 * seed, 5, 1 + seed // 4)] + ["", None, " ", "One two", "one  TWO", "one two three"]
    checked(spark, list(enumerate(texts)) + [(None, texts[0]), (None, "alone here"), (3, texts[3]), (3, texts[40])])


@pytest.mark.parametrize(("bucket", "chunk"), [(2, 3), (8, 256)])
def test_large_buckets_lose_nothing(spark, monkeypatch, bucket, chunk):
    monkeypatch.setattr(nc, "BUCKET", bucket)
    monkeypatch.setattr(nc, "CHUNK", chunk)
    checked(spark, list(enumerate(t for seed in range(3) for changed in (2, 5) for t in varied(seed, 120, 12, changed))))


def test_links_that_no_center_makes_are_found(spark, monkeypatch):
    """A chain of texts, each near its neighbours only, in large buckets."""
    monkeypatch.setattr(nc, "BUCKET", 3)
    monkeypatch.setattr(nc, "CHUNK", 4)
    words = [f"w{k}" for k in range(400)]
    checked(spark, [(k, " ".join(words[6 * k : 6 * k + 120])) for k in range(40)])


def test_empty(spark):
    assert nc.near_copies(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_stage_drops_near_copies_of_the_test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    least = dict(plain_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    kept = {r.doc_id for r in stages.keep_one_of_each_group(spark, docs, SF).select("doc_id").collect()}
    assert kept == {i for i, g in least.items() if i == g}


def test_the_stage_joins_groups_of_fingerprints_and_of_near_copies(spark, monkeypatch):
    """Documents that only SimHash links, and those that it connects with near copies, are one group."""
    text = varied(1, 90, 1, 0)[0]
    other, apart = varied(2, 90, 1, 0)[0], varied(3, 90, 1, 0)[0]
    docs = spark.createDataFrame([(5, text), (7, other), (9, other + " x"), (11, apart), (2, "yet another text of its own kind")], "doc_id long, text string")
    linked = {5: 5, 7: 5, 9: 9, 11: 9, 2: 2}
    monkeypatch.setattr(stages.simhash, "near_duplicates", lambda spark, docs: spark.createDataFrame([(i, 0, g) for i, g in linked.items()], "id long, fp long, component_id long"))
    assert sorted(r.doc_id for r in stages.keep_one_of_each_group(spark, docs, SF).collect()) == [2, 5]
