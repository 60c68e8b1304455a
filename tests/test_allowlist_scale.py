"""Long allowlists: urls' places meet the pattern parts without a sort, and the counts are whole."""

from pyspark.sql import functions as F

from linkloom.operators import allowlist


def _tables(spark):
    urls = spark.range(3000).select(F.format_string("https://h%d.example/x%d", F.col("id") % 50, "id").alias("url"))
    patterns = spark.range(9000).select(F.format_string("https://*/x%d", F.col("id") + 1000).alias("pattern"))
    return urls, patterns.unionByName(spark.createDataFrame([("https://*",), ("*h7.*x*7",)], "pattern string"))


def test_places_of_urls_are_not_sorted_to_meet_the_parts(spark, monkeypatch):
    monkeypatch.setattr(allowlist, "_FEW", 100, raising=False)
    urls, patterns = _tables(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = allowlist.rarest_literals(urls, allowlist._literals(patterns, "pattern"))._jdf.queryExecution().executedPlan().toString()
        hits = allowlist.split_by_table(urls, patterns.where("pattern <> 'https://*'"))
        joins = [x for x in hits._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "part#" in x]
        assert hits.where("suppressed").count() == 2000 + 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftSemi" in plan and not [x for x in plan.splitlines() if "SortMergeJoin" in x and "LeftSemi" in x]
    assert [x for x in joins if "ShuffledHashJoin" in x and "RLIKE" in x]


def test_counts_of_parts_are_whole_for_long_and_short_lists(spark, monkeypatch):
    urls, patterns = _tables(spark)
    literals = allowlist._literals(patterns, "pattern")
    dealt = sorted(map(tuple, allowlist.rarest_literals(urls, literals).collect()), key=repr)
    monkeypatch.setattr(allowlist, "_FEW", 1_000_000)
    assert sorted(map(tuple, allowlist.rarest_literals(urls, literals).collect()), key=repr) == dealt and len(dealt) == 2000 + 2
    assert allowlist.split_by_table(urls, patterns).where("suppressed").count() == 3000
