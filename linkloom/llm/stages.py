"""The pipeline's stages. Each takes (spark, docs, sf_dir) and returns documents, the last their tokens.

Rows without an id stay in the near-duplicate stage, as no group can name them. Columns of the documents
come through the filtering stages as they are, also where they are named like those that operators add;
the last stage returns its own columns only. All other defined cases are those of the operators.

Rows go to Python workers in batches of about ``BATCH`` bytes, unless the session names a size of its own: by
Spark's default a batch is 10,000 texts or 64 MB, held by the JVM and the worker at once beside its heap and
the workers' stores. The setting stays in the session, as what a stage returns runs later.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import bpe, compression_quality, near_copies, simhash, soft_mixing
from linkloom.llm import quality_rules as rules
from linkloom.llm.components import connected_components
from linkloom.llm.queries import BYTE_RANKS, TARGETS, labelled_domains
from linkloom.llm.store import Tables

BATCH = "2m"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, in a session whose batches for Python are bounded by bytes."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(_BATCH_BYTES, None) is None:
            spark.conf.set(_BATCH_BYTES, BATCH)
        return stage(spark, docs, sf_dir)

    return run


def _free(name: str, docs: DataFrame, others: tuple[str, ...] = ()) -> str:
    """The name, with as many underscores before it as no column or other name has."""
    name = "_" + name
    while name in (*docs.columns, *others):
        name = "_" + name
    return name


@_in_small_batches
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at 0.5 or more."""
    model = compression_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _free("score", docs)
    return compression_quality.with_scores(docs, model, score_col=score).where(F.col(score) >= 0.5).select(*docs.columns)


@_in_small_batches
def keep_regular(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the adaptive rules."""
    own = [c for c in docs.columns if c in rules.ADDED]
    safe = {c: _free(c, docs, rules.ADDED) for c in own}
    return rules.quality_rules(docs.withColumnsRenamed(safe)).where("kept").withColumnsRenamed({v: k for k, v in safe.items()}).select(*docs.columns)


def _groups(spark: SparkSession, docs: DataFrame, tables: Tables) -> DataFrame:
    """(id, component_id) of every row: what SimHash (3 bits or fewer) or near copies (Jaccard 0.8 or more), or both in turns, connect.

    Both name a group by its least id, so pairs of names that a document has join their groups. Rows without an id join none.
    """
    prints = tables.write(simhash.near_duplicates(spark, docs).select("id", F.col("component_id").alias("print_group")), "print-groups")
    near = tables.write(near_copies.near_copies(spark, docs), "near-groups")
    both = near.join(prints, "id").where(F.col("component_id") != F.col("print_group"))
    edges = tables.write(both.select(F.greatest("component_id", "print_group").alias("a"), F.least("component_id", "print_group").alias("b")).distinct(), "joined-groups")
    roots = connected_components(tables, edges)
    return near.join(roots, near.component_id == roots.node, "left").select("id", F.coalesce("root", "component_id").alias("component_id"))


@_in_small_batches
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that fingerprints of 3 differing bits at most or near copies (5-word shingles, Jaccard 0.8 or more) connect, the document of least id, once."""
    tables = Tables(spark)
    groups = tables.write(_groups(spark, docs, tables), "groups")
    copies = tables.write(groups.where("id <> component_id").select(F.col("id").alias("doc_id")).distinct(), "copies")
    repeated = tables.write(groups.where("id = component_id").groupBy(F.col("id").alias("doc_id")).count().where("count > 1").select("doc_id"), "repeated")
    kept = docs.join(copies, "doc_id", "left_anti")
    if not repeated.isEmpty():
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(*docs.columns)


@_in_small_batches
def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say."""
    own = [c for c in docs.columns if c in soft_mixing.ADDED]
    safe = {c: _free(c, docs, soft_mixing.ADDED) for c in own}
    mixed = soft_mixing.mix(docs.withColumnsRenamed(safe), labelled_domains(docs), TARGETS).where("copies > 0").withColumn(copy := _free("copy", docs), F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return mixed.drop(copy, *soft_mixing.ADDED).withColumnsRenamed({v: k for k, v in safe.items()}).select(*docs.columns)


@_in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, packed, with digests of them and of the text they decode to."""
    return bpe.round_trip(docs, BYTE_RANKS, public_tokenizers.PATTERN, with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", keep_good),
    ("quality_rules", keep_regular),
    ("near_duplicates", keep_one_of_each_group),
    ("mixing", mix_languages),
    ("byte_bpe", encode),
]
