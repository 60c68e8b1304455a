"""Running totals and next values over the places of one file, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPAN = 1 << 20


def running_sum(rows: DataFrame, value: Column, out: str, line: str = "line") -> DataFrame:
    """rows with the sum of value over the lines up to and with their own.

    Lines are places in a file, so spans of ``SPAN`` lines hold bounded shares of the rows. A window adds
    up within a span; the sums of the spans before, a row per span, are joined to it.
    """
    rows = rows.withColumns({"_span": F.floor(F.col(line) / SPAN), "_value": value.cast("long")})
    spans = rows.groupBy("_span").agg(F.sum("_value").alias("_sum"))
    bases = spans.select("_span", (F.sum("_sum").over(Window.orderBy("_span")) - F.col("_sum")).alias("_base"))  # one row per span
    own = F.sum("_value").over(Window.partitionBy("_span").orderBy(line).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(bases, "_span").withColumn(out, F.col("_base") + F.col("_own")).drop("_span", "_value", "_own", "_base")


def next_value(rows: DataFrame, value: str, out: str, at: str, span: int = SPAN) -> DataFrame:
    """rows (at: distinct places) with the first value that is not null at a later place.

    As in running_sum a window looks within spans; the first value of a later span is joined to it. Windows run
    from the end, as a frame of all following rows is gone through anew for each row.
    """
    rows = rows.withColumn("_span", F.floor(F.col(at) / span))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("_span").agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(at))).alias("_first"))
    later = spans.select("_span", F.last("_first", ignorenulls=True).over(before(Window.orderBy(F.desc("_span")))).alias("_later"))  # one row per span
    own = F.last(value, ignorenulls=True).over(before(Window.partitionBy("_span").orderBy(F.desc(at))))
    return rows.withColumn("_own", own).join(later, "_span").withColumn(out, F.coalesce("_own", "_later")).drop("_span", "_own", "_later")
