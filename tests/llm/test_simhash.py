import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.llm import simhash
from linkloom.llm.components import connected_components
from linkloom.llm.store import Tables


def plain_fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def groups(pairs):
    """{id: least id of its group} from (id, fingerprint), by comparing all."""
    prints = sorted({f for _, f in pairs})
    of = {f: f for f in prints}

    def root(f):
        while of[f] != f:
            f = of[f]
        return f

    for i, a in enumerate(prints):
        for c in prints[i + 1 :]:
            if (a ^ c).bit_count() <= 3:
                of[root(c)] = root(a)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return {f: least.get(root(f)) for f in prints}


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_near_duplicates_equal_brute_force(spark, which, request):
    docs = request.getfixturevalue(which)
    want = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    least = groups(want)
    got = simhash.near_duplicates(spark, docs).select("id", simhash.hex_of("fp").alias("h"), "component_id").collect()
    assert sorted(((r.id, r.h, r.component_id) for r in got), key=repr) == sorted(((i, f"{f:016x}", least[f]) for i, f in want), key=repr)


def test_empty_table(spark, none):
    assert simhash.near_duplicates(spark, none).count() == 0


def test_xxhash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("über x y"))).first()[0] == simhash._signed(xxhash.xxh64_intdigest("über x y".encode(), 42))


@settings(deadline=None, max_examples=500)
@given(st.integers(0, (1 << 64) - 1), st.sets(st.integers(0, 63), max_size=3))
def test_masks_cover_every_pair_in_the_radius(x, flips):
    y = x
    for bit in flips:
        y ^= 1 << bit
    assert any(x & m == y & m for m in simhash.covering_masks())
    for mask in simhash.covering_masks():
        if x & mask == y & mask:
            assert any(x & m == y & m for m in simhash.covering_masks(mask))


def test_large_buckets_are_dealt_anew_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(400):
        x = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(20)
        prints.add(x)
    pairs = [(i, f) for i, f in enumerate(sorted(prints))]
    df = spark.createDataFrame([(simhash._signed(f),) for _, f in pairs], "fp long")
    tables = Tables(spark)
    edges = simhash.links(tables, df)
    roots = {r.node: r.root for r in connected_components(tables, edges).collect()}
    want, got = groups(pairs), {}
    for i, f in pairs:
        got.setdefault(roots.get(simhash._signed(f), simhash._signed(f)), []).append(i)
    assert sorted(map(tuple, got.values())) == sorted(map(tuple, [[i for i, f in pairs if want[f] == k] for k in set(want.values())]))


def test_components_of_chains_and_hubs(spark):
    edges = [(i + 1, i) for i in range(60)] + [(200 + i, 100) for i in range(50)] + [(500, 499)]
    tables = Tables(spark)
    table = tables.write(spark.createDataFrame(edges, "a long, b long"), "edges")
    got = {r.node: r.root for r in connected_components(tables, table).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{200 + i: 100 for i in range(50)}, 500: 499}
    assert connected_components(tables, table.where("false")).count() == 0


def test_sliced_fingerprints_of_long_texts(monkeypatch):
    data = " ".join(f"w{i * i % 331}" for i in range(3000)).encode()
    whole = simhash.fingerprint(data)
    monkeypatch.setattr(simhash, "_SLICE", 100)
    assert simhash.fingerprint(data) == whole == plain_fingerprint(data.decode())
    assert np.int64(simhash._signed(1 << 63)) == np.iinfo(np.int64).min
