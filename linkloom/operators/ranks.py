"""Ranks in a given order, over everything or per group, without a task that holds all rows of either."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.sources.shared import Tables

#: Spark numbers rows by 2^33 times the partition plus the place in it.
_PLACES = 33


def ranked(rows: DataFrame, order: list[str], column: str = "rank", by: list[str] | None = None) -> DataFrame:
    """rows with their rank from 1 in the given order, starting anew in each group of ``by``.

    Rows are dealt once by ranges of (by, order), sorted, numbered and written with that number; counts
    and ranks both come from the written table, so that they name the same ranges whatever a plan prunes
    or coalesces. The counts, a row per range and group, are summed up over the ranges of a group and
    joined back. A group of any size is dealt over many ranges, small groups share one. Rows that are
    equal in the order get ranks in the order of a hash of their columns, which also spreads them over
    ranges; nulls come first; nothing gives nothing. Null groups are groups.
    """
    by = by or []
    kinds = dict(rows.dtypes)
    hashed = [c for c in rows.columns if "map<" not in kinds[c] and "variant" not in kinds[c] and c not in order]
    tied = rows.withColumn("_tie", F.xxhash64(*hashed) if hashed else F.lit(0))
    keys = [*by, *order, "_tie"]
    dealt = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()).drop("_tie")
    written = Tables(rows.sparkSession).write(dealt, "ranges").withColumn("_part", F.shiftright("_id", _PLACES))
    counts = written.groupBy(*by, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")  # a row per range that the group has
    bases = counts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_of"), (before - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = written.join(bases, same).withColumn(column, (F.col("_id") + F.col("_shift") + 1).cast("long"))
    return joined.drop("_id", "_part", "_of", "_shift", *(f"_by_{c}" for c in by))
