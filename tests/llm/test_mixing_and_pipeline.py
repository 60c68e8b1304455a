import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import queries, soft_mixing, stages

SF = "/root/testdata/sf0.001"


def plain_rates(p, n, goal):
    """Projected gradient on one table in memory, in the same metric."""
    m = (p * n[:, None]).T @ p
    inverse, rates = np.linalg.inv(m + np.eye(len(goal)) * 1e-9 * np.trace(m)), np.ones(len(p))
    for _ in range(soft_mixing.PASSES):
        now = (n * rates) @ p
        if np.abs(now - goal).max() <= soft_mixing.CLOSE * goal.sum():
            break
        rates = np.maximum(0, rates - p @ (inverse @ (now - goal)))
    return rates


def test_rates_reach_the_targets_and_equal_the_loop(spark, documents):
    got = soft_mixing.mix(documents, documents, queries.TARGETS, domain_col="lang", carry_text=False).toPandas()
    p, n = np.stack(got.posterior), got.n_tokens.to_numpy(float)
    assert np.allclose(p.sum(1), 1) and (got.rate >= 0).all()
    mixed = (n * got.rate.to_numpy()) @ p
    shares = np.array(list(queries.TARGETS.values()))
    assert np.allclose(mixed / n.sum(), shares, atol=1e-3)
    assert np.allclose(got.rate, plain_rates(p, n, shares * n.sum()), atol=1e-6)
    assert ((got.copies - got.rate).abs() <= 1).all()


def test_targets_that_clip_rates(spark):
    rows = [(i, 100, [1.0, 0.0] if i < 50 else [0.3, 0.7]) for i in range(100)]
    scored = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")
    steps = soft_mixing.fit_rates(scored, np.array([0.3, 0.7]))
    got = soft_mixing.with_rates(scored, 2, steps, ["doc_id"]).toPandas()
    assert (got.rate[:50] < 0.02).all() and np.allclose(((got.n_tokens * got.rate).to_numpy()) @ np.stack(got.posterior), [3000, 7000], rtol=0.02)
    out_of_reach = soft_mixing.fit_rates(scored, np.array([0.0, 1.0]))
    assert (soft_mixing.with_rates(scored, 2, out_of_reach, ["doc_id"]).toPandas().rate >= 0).all()


def test_posteriors_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = soft_mixing.fit_classifier(docs.where("doc_id % 3 <> 1"), list(queries.TARGETS), domain_col="lang")
    rows = soft_mixing.with_posteriors(docs.where("doc_id % 3 = 1 and length(text) > 100"), model).select("lang", "posterior").collect()
    names = list(queries.TARGETS)
    assert np.mean([names[int(np.argmax(r.posterior))] == r.lang for r in rows]) > 0.98
    both = [r.text for r in docs.where("lang = 'en' and length(text) > 600").limit(1).collect()][0][:600] + [r.text for r in docs.where("lang = 'fr' and length(text) > 600").limit(1).collect()][0][:600]
    soft = model.posterior(both.encode())
    assert 0.25 < soft[0] < 0.75 and 0.25 < soft[2] < 0.75


def test_mixing_edge_cases(spark, odd, none, documents):
    got = soft_mixing.mix(odd, documents, queries.TARGETS, domain_col="lang")
    assert got.count() == odd.count() and got.where("rate is null or copies is null").count() == 0
    assert got.where("text is null").select("n_tokens").distinct().collect()[0][0] == 0
    assert soft_mixing.mix(none, none, queries.TARGETS, domain_col="lang").count() == 0
    assert soft_mixing.mix(odd, documents, queries.TARGETS, domain_col="lang", tokens_col="n_chars", carry_text=False).where("doc_id = 900006").first().n_tokens == 7
    with pytest.raises(ValueError):
        soft_mixing.fit_classifier(documents, [], domain_col="lang")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kinds = docs.dtypes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.dtypes == kinds, name
        before, rows = {r.doc_id for r in docs.collect()}, [r.doc_id for r in after.collect()]
        assert set(rows) <= before
        if name != "mixing":
            assert len(rows) == len(set(rows))
        docs = spark.createDataFrame(after.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(map(repr, last.drop("ids").collect())) == sorted(map(repr, corpus_pipeline.run(spark, SF).drop("ids").collect()))


def test_pipeline_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = stages.keep_regular(spark, stages.keep_good(spark, docs, sf), sf).select("doc_id").withColumn("kept", F.lit(1))
    rows = labels.join(docs.where(F.size(F.split("text", r"\s+")) >= 60).select("doc_id"), "doc_id").join(kept, "doc_id", "left").toPandas()
    assert rows.kept[rows.quality == 1].notna().mean() > 0.97
    assert rows.kept[rows.quality == 0].notna().mean() < 0.15


def test_one_of_each_group_stays(spark, documents):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text), (2, text), (2, text), (3, text + " x"), (4, "another text altogether with words"), (4, "another text altogether with words"), (None, text)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], documents.schema)
    got = [r.doc_id for r in stages.keep_one_of_each_group(spark, docs, SF).collect()]
    assert got.count(1) == 1 and got.count(2) == 0 and got.count(4) == 1 and got.count(None) == 1


def test_stages_pass_bounded_batches_to_workers(spark, documents):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    large = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("text "), 10_000).alias("text"))
    stages.encode(spark, documents, "")
    assert max(r.n for r in large.mapInArrow(sizes, "n long").collect()) < 4 << 20
    spark.conf.set(key, "8m")
    stages.encode(spark, documents, "")
    assert spark.conf.get(key) == "8m"
    spark.conf.unset(key)


def test_empty_corpus(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
