"""Ranks over tables of many partitions, with columns that take no part in the order."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linkloom.operators import classify
from linkloom.operators.ranks import ranked

DEFAULTS = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.enabled": "true"}


@pytest.fixture
def defaults(spark):
    before = {k: spark.conf.get(k, None) for k in DEFAULTS}
    for k, v in DEFAULTS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _nodes(spark, n):
    name = F.sha2(F.col("id").cast("string"), 256)
    return spark.range(n).select(F.concat(F.lit("https://site.example/"), name).alias("node"), F.lit(3).alias("depth"), name.alias("parent"), (F.col("id") % 1000).alias("_r"), F.xxhash64("id").alias("_p"))


@pytest.mark.parametrize("wide", [False, True])
def test_a_million_ranks(defaults, wide):
    rows = _nodes(defaults, 1_000_000)
    rows = rows if wide else rows.select("_r", "_p")
    got = ranked(rows, ["_r", "_p"]).agg(F.count("rank"), F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()
    assert tuple(got) == (1_000_000, 1_000_000, 1, 1_000_000)


def test_ranks_follow_the_order(defaults):
    rows = _nodes(defaults, 200_000)
    kept = ranked(rows, ["_r", "_p", "node"]).select("_r", "_p", "rank").orderBy("rank").toPandas()
    assert kept["rank"].tolist() == list(range(1, 200_001))
    assert kept[["_r", "_p"]].apply(tuple, axis=1).is_monotonic_increasing


def test_pages_are_full(defaults):
    sizes = classify.page_numbers(_nodes(defaults, 200_500), ["_r"], 1000).groupBy("page").count().orderBy("page").collect()
    assert [r["count"] for r in sizes] == [1000] * 200 + [500]


def test_ranks_by_group_with_a_hot_one(defaults):
    group = F.when(F.col("_r") < 400, "hot").when(F.col("_r") == 999, None).otherwise(F.col("_r").cast("string"))
    got = ranked(_nodes(defaults, 300_000).withColumn("g", group), ["_p"], by=["g"])
    bad = got.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("most"), F.count_distinct("rank").alias("ranks")).where("n <> most OR n <> ranks")
    assert bad.count() == 0 and got.count() == 300_000


def test_ties_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(None, "x"), (1, "a"), (1, "a"), (1, None), (0, "z")], "k int, v string")
    got = sorted((r.rank, r.k) for r in ranked(rows, ["k"]).collect())
    assert got == [(1, None), (2, 0), (3, 1), (4, 1), (5, 1)]
    assert ranked(rows.where("false"), ["k"]).columns == ["k", "v", "rank"] and ranked(rows.where("false"), ["k"]).count() == 0


def test_columns_that_have_no_hash(spark):
    rows = spark.createDataFrame([(k, {"a": k}, [{"b": k}]) for k in (3, 1, 2)], "k int, m map<string,int>, s array<map<string,int>>")
    assert [(r.rank, r.k, r.m["a"]) for r in ranked(rows, ["k"]).orderBy("rank").collect()] == [(1, 1, 1), (2, 2, 2), (3, 3, 3)]
