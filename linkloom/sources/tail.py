"""Growing line files as a stream: offsets are byte positions, so appended lines come too, each once."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes looked at in one go, and of a task.
BLOCK, TASK = 1 << 16, 1 << 25


def at_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class _Tail(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.pattern = options["path"], options.get("glob", "*")
        self.most, self.memory = int(options.get("max_lines", "0")), options.get("positions")
        self.given: dict[str, int] | None = None  # where the newest batch ends
        if self.most and not self.memory:
            raise ValueError("max_lines needs positions, a file that tells a restarted stream where to count from")

    def initialOffset(self) -> dict:
        return {}

    def _sizes(self) -> dict[str, int]:
        store, folder = at_store(self.folder)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {f.base_name: f.size for f in sorted(found, key=lambda f: f.base_name) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and fnmatch(f.base_name, self.pattern)}

    def _remembered(self) -> dict[str, int] | None:
        if self.given is None and self.memory:
            store, path = at_store(self.memory)
            if store.get_file_info(path).type == fs.FileType.File:
                with store.open_input_file(path) as f:
                    self.given = json.loads(f.read())
        return self.given

    def latestOffset(self) -> dict:
        """Past the last whole line of each file, at most max_lines lines on. The rest of a file that a later one follows is a line, too."""
        store, folder = at_store(self.folder)
        sizes, before, end = self._sizes(), self._remembered(), {}
        left = self.most
        for name, size in sizes.items():
            begin = (before or {}).get(name, 0)
            begin = 0 if begin > size else begin
            with store.open_input_file(posixpath.join(folder, name)) as f:
                if self.most:
                    stop, used = _forward(f, begin, size, left)
                    left -= used
                else:
                    stop = _last_line_end(f, begin, size)
                if stop < size and name != list(sizes)[-1] and (not self.most or left > 0) and _last_line_end(f, stop, size) == stop:
                    stop, left = size, left - 1
            end[name] = stop
        self.given = end
        if self.memory:
            store, path = at_store(self.memory)
            with store.open_output_stream(path + ".new", compression=None) as f:
                f.write(json.dumps(end).encode())
            store.move(path + ".new", path)
        return end

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.given = end
        store, folder = at_store(self.folder)
        out = []
        for name, stop in end.items():
            at = start.get(name, 0)
            at = 0 if at > stop else at  # the file was replaced by a shorter one
            while at < stop:
                cut = stop
                if stop - at > TASK:
                    with store.open_input_file(posixpath.join(folder, name)) as f:
                        cut = min(stop, _forward(f, at + TASK, stop, 1)[0])
                    cut = cut if cut > at else stop
                out.append(InputPartition((self.folder, name, at, cut)))
                at = cut
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        folder, name, at, stop = partition.value
        store, path = at_store(folder)
        with store.open_input_file(posixpath.join(path, name)) as f:
            f.seek(at)
            data = f.read(stop - at)
        for m in re.finditer(rb"([^\n]*)(?:\n|\Z)", data):
            if m.end() > m.start():
                yield name, at + m.start(), m[1].removesuffix(b"\r").decode("utf-8", "replace")


def _forward(f, begin: int, size: int, most: int) -> tuple[int, int]:
    """Past the line end that is most lines on, or past the last one there is; and the number of lines."""
    at, n, end = begin, 0, begin
    while at < size and n < most:
        f.seek(at)
        block = f.read(min(BLOCK, size - at))
        for m in re.finditer(b"\n", block):
            n, end = n + 1, at + m.end()
            if n == most:
                break
        at += len(block)
    return end, n


def _last_line_end(f, begin: int, size: int) -> int:
    """Past the last line end between begin and size, else begin."""
    stop = size
    while stop > begin:
        low = max(begin, stop - BLOCK)
        f.seek(low)
        found = f.read(stop - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        stop = low
    return begin


class TailSource(DataSource):
    """Register with ``spark.dataSource.register(TailSource)``; then ``readStream.format("linkloom_tail")``.

    Options: path (a folder), glob (of file names), max_lines (lines of a batch; 0: all there are), positions (with max_lines: a file of the
    stream's own, which keeps over restarts what has been let in). Rows are (file, start, value): start is the byte the line begins at. A last line
    without its end waits until it has one, or until a later file follows (rolled parts). A file that became shorter is read anew.
    Tasks read ranges of up to 32 MB; a lost executor repeats its ranges only.
    """

    @classmethod
    def name(cls) -> str:
        return "linkloom_tail"

    def schema(self) -> str:
        return "file string, start long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(self.options)
