"""What a traversal has met: a store bucketed by key, and the rows of the last levels beside it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from linkloom.sources.shared import Tables, new_path

#: Keys that are kept beside the store before there is one, the share of the store's rows that may wait beside it, and tables that wait at once.
LEAST, SHARE, FEW = 1 << 20, 4, 16


class Seen:
    """Keys of all levels so far.

    The store is a table bucketed by key, so an anti-join with it shuffles the new rows only. A level's
    keys wait beside it until they are a quarter of its rows, then one write appends them: every
    key is written to the store once, in few files, and what is shuffled again each level stays small.
    """

    def __init__(self, spark: SparkSession, key: list[str], least: int = LEAST):
        self.spark, self.key, self.least = spark, key, least
        self.name, self.stored, self.waiting = None, 0, []
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def fresh(self, rows: DataFrame) -> DataFrame:
        """The rows whose keys have not been met; one row of a key at most is given and comes back."""
        if self.name:
            rows = rows.join(self.spark.table(self.name), self.key, "left_anti")
        return rows.join(self._beside(), self.key, "left_anti") if self.waiting else rows

    def _beside(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (level for level, _ in self.waiting))

    def add(self, level: DataFrame, n: int) -> None:
        """Note the keys of a written level of n rows. Many small levels become one table, so that plans stay short however deep a walk goes."""
        self.waiting.append((level.select(*self.key), n))
        total = sum(n for _, n in self.waiting)
        if total >= max(self.least, self.stored // SHARE):
            self._store(total)
        elif len(self.waiting) > FEW:
            self.waiting = [(Tables(self.spark).write(self._beside(), "seen-beside"), total)]

    def _store(self, total: int) -> None:
        name = self.name or f"seen_{uuid.uuid4().hex}"
        writer = self._beside().repartition(self.n, *self.key).write.mode("append" if self.name else "errorifexists").format("parquet").bucketBy(self.n, *self.key)
        if not self.name:
            writer = writer.option("path", new_path(self.spark, "seen"))
        writer.saveAsTable(name)
        self.name, self.stored, self.waiting = name, self.stored + total, []

    def close(self) -> None:
        """Forget the store's name; its files go with the session's other tables."""
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
