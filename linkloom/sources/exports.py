"""Exports of a JSON file for each of many groups, as folders or as those folders in zip archives, written and read by tasks.

Tasks write by themselves, through pyarrow: Spark's own writer moves every group's folder once more on the driver, and on a
local disk forks for the permissions of every file. Archives spare a file and a folder for each group too; unpacked they are the same tree.
"""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a group that one task writes, about; larger groups are dealt to several.
LINES = 100_000
#: Bytes of a JSON file, and of an archive before its last file; what goes beyond begins another. And files of an archive.
BLOCK, MEMBERS = 8 << 20, 10_000
#: What Spark escapes in the folder names of partitions.
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
_NULL = "__HIVE_DEFAULT_PARTITION__"
_FOLDER = "file="


def folder_name(file: str | None) -> str:
    """A group's folder, named as Spark names that of a partition by ``file``."""
    return _FOLDER + (_ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", file) if file else _NULL)


def file_of(name: str) -> str | None:
    """The file of a folder's name."""
    file = name.removeprefix(_FOLDER)
    return None if file == _NULL else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), file)


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def _qualified(spark: SparkSession, folder: str):
    """A folder's file system, path and URI; without a scheme it is in Hadoop's default store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    where = store.makeQualified(where)
    return store, where, where.toUri().toString()


def _put(store: fs.FileSystem, path: str, data: bytes) -> None:
    """A file that has its name only when it is whole; one of an earlier attempt is replaced."""
    beside = posixpath.join(posixpath.dirname(path), f".{uuid.uuid4().hex}")
    with store.open_output_stream(beside, compression=None) as out:
        out.write(data)
    try:
        store.move(beside, path)
    except OSError:  # not every store renames over a file
        with suppress(FileNotFoundError):
            store.delete_file(path)
        store.move(beside, path)


def _members(batches: Iterator[pa.RecordBatch], part: str) -> Iterator[tuple[str, bytes]]:
    """(name, data) of the files of (file, value) rows in order of both, so that each attempt makes the same ones."""
    now, n, lines, held = None, 0, [], 0

    def member() -> tuple[str, bytes]:
        return f"{folder_name(now)}/{part}-{n:05d}.json", ("\n".join(lines) + "\n").encode()

    for batch in batches:
        for file, rows in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), itemgetter(0)):
            if lines and file != now:
                yield member()
                n, lines, held = 0, [], 0
            now = file
            for _, value in rows:
                lines.append(value)
                held += len(value)
                if held > BLOCK:
                    yield member()
                    n, lines, held = n + 1, [], 0
    if lines:
        yield member()


def _writer(uri: str, packed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes (file, value) rows that are in order and gives the number of files."""

    def folders(members: Iterator[tuple[str, bytes]]) -> int:
        (store, root), n = _at(uri), 0
        for n, (name, data) in enumerate(members, 1):  # noqa: B007
            store.create_dir(f"{root}/{posixpath.dirname(name)}", recursive=False)
            _put(store, f"{root}/{name}", data)
        return n

    def archives(members: Iterator[tuple[str, bytes]], part: str) -> int:
        (store, root), n, k, total = _at(uri), 0, 0, 0
        buffer = io.BytesIO()
        archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)
        for name, data in members:
            archive.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)  # dated 1980, so that attempts are equal
            n, total = n + 1, total + 1
            if n == MEMBERS or buffer.tell() > BLOCK:
                archive.close()
                _put(store, f"{root}/{part}-{k:05d}.zip", buffer.getvalue())
                n, k, buffer = 0, k + 1, io.BytesIO()
                archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)
        archive.close()
        if n:
            _put(store, f"{root}/{part}-{k:05d}.zip", buffer.getvalue())
        return total

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = f"part-{TaskContext.get().partitionId():05d}"
        members = _members(batches, part)
        yield pa.record_batch({"files": pa.array([archives(members, part) if packed else folders(members)], pa.int64())})

    return write


def _reader(uri: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(file, value) of the archives of (path) rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _at(uri)
        files, values, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch({"file": pa.array(files, pa.string()), "value": pa.array(values, pa.binary()).cast(pa.string())})

        for path in (p for b in batches for p in b.column(0).to_pylist()):
            with store.open_input_file(f"{root}/{posixpath.basename(path)}") as f, zipfile.ZipFile(io.BytesIO(f.read())) as archive:
                for info in archive.infolist():
                    lines = archive.read(info).split(b"\n")[:-1]
                    values += lines
                    files += [file_of(posixpath.dirname(info.filename))] * len(lines)
                    held += info.file_size
                    if held > BLOCK // 8:
                        yield batch()
                        files, values, held = [], [], 0
        yield batch()

    return read


def write_groups(rows: DataFrame, folder: str, packed: bool = False) -> None:
    """Replace a folder by one of ``file=<file>`` folders with the values of (file, value) rows as lines, or by zip archives of such folders.

    The rows of a file meet in one task, of more than LINES rows in several.
    """
    store, where, uri = _qualified(rows.sparkSession, folder)
    store.delete(where, True)
    store.mkdirs(where)
    parts = rows.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / LINES).alias("_parts")).where("_parts > 1")
    dealt = rows.join(parts, "file", "left").select("file", "value", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("value"), "_parts")).otherwise(0).alias("_part"))
    ordered = dealt.repartition("file", "_part").select("file", "value").sortWithinPartitions("file", "value")
    ordered.mapInArrow(_writer(uri, packed), "files long").agg(F.sum("files")).collect()
    store.create(rows.sparkSession._jvm.org.apache.hadoop.fs.Path(where, "_SUCCESS")).close()


def read_archives(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of an export in archives, with their ``file``."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path")
    lines = paths.mapInArrow(_reader(_qualified(spark, folder)[2]), "file string, value string")
    return lines.select(F.from_json("value", schema).alias("_x"), "file").select("_x.*", "file")
