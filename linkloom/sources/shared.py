"""Written intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset a folder of our own is made
and set, but only on a local master: on a cluster each machine would write and miss its own files. Tables cut lineage: a lost executor costs the
tasks it ran, never the stages before a written table. Unlike checkpoint() they compute a plan once.
"""

from __future__ import annotations

import atexit
import posixpath
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder, as a URI."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master!r} share")
        root = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        _left.append((spark, root))
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; dropped when the driver ends."""
    path = posixpath.join(shared_dir(spark), "linkloom", f"{label}-{uuid.uuid4().hex}")
    _left.append((spark, path))
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing will read again."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """The intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """Write a DataFrame and return it reread, so that plans on it start from files of known size."""
        path = new_path(self.spark, label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._kept_by = self  # the id stays unique as long as the table is known
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        drop(self.spark, *(self.paths.pop(id(t)) for t in tables))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside is deleted at the end, so use it around a query and the reading of its result, in long sessions."""
    shared_dir(spark)  # made before, not deleted with the tables
    before = len(_left)
    try:
        yield
    finally:
        drop(spark, *(path for _, path in _left[before:]))
        del _left[before:]


@atexit.register
def _clear() -> None:
    for spark, path in _left:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the folder is the cluster's to clear
            return
