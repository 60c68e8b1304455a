import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from linkloom.llm import compression_quality as cq
from linkloom.llm import quality_rules as qr
from linkloom.llm import queries

SF = "/root/testdata/sf0.001"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_counts_equal_brute_force(request, which):
    docs = request.getfixturevalue(which)
    for r in qr.with_counts(docs).collect():
        assert tuple(r[c] for c in qr.COUNTS) == plain_counts(r.text), r.doc_id


def test_counts_of_hard_texts(spark):
    texts = ["a b c a b c", "a a a a", "a a a", "x\n\n x\nx\r\nx y\nx", "\n" * 50, " " * 3000 + "\n" + " " * 3000, "a b c d a b c", "\x1c \x85  ", "*#$%&|<> ** ab\nab\n  ab\nab"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in qr.with_counts(df).collect():
        assert tuple(r[c] for c in qr.COUNTS) == plain_counts(r.text), r.text


def test_collisions_fall_back_to_texts(spark, documents):
    words = F.regexp_extract_all("text", F.lit(qr.WORD), F.lit(0))
    df = documents.select("text", words.alias("w")).where(F.size("w") > 3)
    for r in df.select("text", qr._positions_by_text(F.col("w")).alias("p")).collect():
        got, ws = sorted(r.p), re.findall(r"[^\x20\x09-\x0D]+", r.text)
        grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        assert got == [i for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1]


def test_buckets(spark):
    got = {r.id: r.b for r in spark.range(0, 5000).select("id", qr.bucket(F.col("id")).alias("b")).collect()}
    assert all(got[x] == (x >> max(x.bit_length() - 5, 0)) << max(x.bit_length() - 5, 0) for x in got)
    assert all(0 <= x - got[x] <= x / 16 for x in got)


def test_sketches_merge(spark, documents):
    counted = qr.with_counts(documents).withColumn("base_failed", F.lit(False))
    halves = qr.sketches(counted.where("doc_id % 2 = 0")).unionByName(qr.sketches(counted.where("doc_id % 2 = 1")))
    both = halves.groupBy("lang", "source", "ratio", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, qr._mixed(both).collect())) == sorted(map(tuple, qr._mixed(qr.sketches(counted)).collect()))
    assert sorted(map(str, qr.thresholds(both).collect())) == sorted(map(str, qr.thresholds(qr.sketches(counted)).collect()))


def test_rules_on_odd_rows(odd, none):
    got = qr.quality_rules(odd)
    assert got.count() == odd.count() and got.where("kept is null").count() == 0
    assert {r.kept for r in got.where("doc_id >= 900000 and doc_id not in (900004)").collect()} == {False}
    assert qr.quality_rules(none).count() == 0


def test_rules_reject_outliers_by_source(spark):
    clean = [(i, " ".join(f"w{(i * 31 + k * k) % 9973}" for k in range(120)), "en", f"s{i % 2}") for i in range(600)]
    noisy = [(1000 + i, " ".join(f"w{(i * 37 + k * k) % 9973}###" for k in range(120)), "en", "s0") for i in range(5)]
    usual = [(2000 + i, " ".join(f"v{(i * 37 + k * k) % 9973}###" for k in range(120)), "en", "odd") for i in range(300)]
    docs = spark.createDataFrame(clean + noisy + usual, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in qr.quality_rules(docs).collect()}
    assert all(kept[i] for i, *_ in clean + usual) and not any(kept[i] for i, *_ in noisy)


def test_native_plan(spark):
    plan = queries.op3_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, expected = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert sorted(repr(tuple(r)) for r in found.select(*columns).collect()) == sorted(map(repr, expected.project(", ".join(columns)).fetchall()))


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op7_compression_quality(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert len(rows) > 1000 and rows.score.between(0, 1).all()
    assert (rows.predicted == rows.quality).mean() > 0.96
    assert rows.predicted[rows.quality == 1].mean() > 0.98
    assert 1 - rows.predicted[rows.quality == 0].mean() > 0.8
    assert docs.count() == queries.op7_compression_quality(spark, sf).count()
    sure = rows[rows.score > 0.9]
    assert sure.quality.mean() > 0.95  # calibrated


def test_classifier_ignores_held_out_labels(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    spoilt = labels.withColumn("quality", F.when(cq.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert cq.fit(documents, labels) == cq.fit(documents, spoilt)


def test_classifier_edge_cases(spark, odd, none, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = cq.fit(odd.unionByName(documents, allowMissingColumns=True), labels)
    got = cq.with_scores(odd, model)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    same = {r.score for r in got.where("text is null or text = ''").collect()}
    assert len(same) == 1
    assert cq.with_scores(none, model).count() == 0
    alone = cq.fit(documents, labels.where("quality = 1"))
    assert cq.with_scores(documents, alone).select("score").distinct().count() == 1
    assert cq.fit(none, labels.where("false")).score(np.zeros((1, 5)))[0] == 0.5


def test_scores_equal_a_plain_classifier(spark, documents):
    """Dictionaries, features, curve and scores again, by loops over lists."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = cq.fit(documents, labels)
    texts = {r.doc_id: r.text.encode() for r in documents.collect()}
    learnt = [(r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in texts]
    hashes = {i: (lambda h: h - (h >> 63 << 64))(xxhash.xxh64_intdigest(struct.pack("<q", i), 42)) for i, _ in learnt}
    half = {y: [i for _, i in sorted((hashes[i], i) for i, q in learnt if q == y)] for y in (0, 1)}
    cut = lambda t: [t[k : k + 512] for k in range(0, len(t), 512)]
    even = lambda p: [p[k * len(p) // min(16, len(p))] for k in range(min(16, len(p)))]
    raw = []
    for y in (1, 0):
        pieces = [p for i in half[y][::2] for p in even(cut(texts[i]))]
        try:
            raw.append(zstandard.train_dictionary(32 << 10, pieces).as_bytes())
        except zstandard.ZstdError:
            raw.append(b"".join(pieces)[-(32 << 10) :])
    assert (model.good, model.bad) == tuple(raw)

    def size(piece, known):
        return len(zstandard.ZstdCompressor(level=1, dict_data=known and zstandard.ZstdCompressionDict(known), write_content_size=False, write_dict_id=False).compress(piece))

    def plain(text):
        g, b, n = ([size(p, known) for p in cut(text)] for known in (*raw, None))
        worst = max(1, len(g) // 4)
        least = lambda x: sum(sorted(x)[:worst]) / worst
        each = [(y - x) / min(x, y) for x, y in zip(g, b, strict=True)], [(z - x) / z for x, z in zip(g, n, strict=True)]
        return [(sum(b) - sum(g)) / min(sum(g), sum(b)), least(each[0]), (sum(n) - sum(g)) / sum(n), least(each[1]), (sum(n) - sum(b)) / sum(n)]

    held = [(plain(texts[i]), y) for y in (0, 1) for i in half[y][1::2]]
    x = np.array([f for f, _ in held])
    y = np.array([q for _, q in held])
    w = np.array([len(half[q]) / len(half[q][1::2]) for q in y])
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    beta = np.array([model.weights[0] + (np.array(model.weights[1:]) * mean).sum(), *(np.array(model.weights[1:]) * spread)])
    p = 1 / (1 + np.exp(-z @ beta))
    slope = z.T @ (w / w.sum() * len(w) * (y - p)) - np.r_[1e-6, [0.1] * 5] * beta
    assert np.abs(slope).max() < 1e-5  # the curve is the optimum of the penalised likelihood
    for r in cq.with_scores(documents, model).select("doc_id", "score").collect():
        got = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], plain(texts[r.doc_id]), strict=True))
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(got, -30, 30)))) < 1e-9
