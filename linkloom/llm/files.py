"""Files that tasks write and read by URI, on whatever store the shared folder is, and batches cut by bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def make_dir(uri: str) -> None:
    store, path = at(uri)
    store.create_dir(path, recursive=True)


@contextmanager
def writer(folder: str, name: str) -> Iterator[tuple[str, pa.NativeFile]]:
    """A new file's URI and stream. The name is the attempt's own, so retried and speculative tasks never share one."""
    uri = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    store, path = at(uri)
    out = store.open_output_stream(path, compression=None)
    try:
        yield uri, out
    except BaseException:
        out.close()
        with suppress(OSError):
            store.delete_file(path)
        raise
    out.close()


def whole(uri: str) -> pa.Buffer:
    """A file's bytes: mapped where the store is local, else read."""
    store, path = at(uri)
    if isinstance(store, fs.LocalFileSystem):
        if store.get_file_info(path).size == 0:
            return pa.py_buffer(b"")
        with pa.memory_map(path) as f:
            return f.read_buffer()
    with store.open_input_file(path) as f:
        return f.read_buffer()


@contextmanager
def reader(uri: str) -> Iterator[pa.NativeFile]:
    """A file to read by ranges: mapped where the store is local."""
    store, path = at(uri)
    local = isinstance(store, fs.LocalFileSystem) and store.get_file_info(path).size
    with pa.memory_map(path) if local else store.open_input_file(path) as f:
        yield f


def range_of(file: pa.NativeFile, begin: int, size: int) -> pa.Buffer:
    """Bytes of a file; no copy where it is mapped."""
    file.seek(begin)
    return file.read_buffer(size)


def bounded(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a column has about so many bytes in each; a value alone may have more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
