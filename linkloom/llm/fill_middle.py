"""Fill-in-middle transformation by rotations of blocks in place.

A text is cut at two line ends into prefix, middle and suffix. The three sentinels are inserted into one
bytearray of the text, so that it reads prefix, middle, suffix, each behind its mark; then two neighbouring
blocks are exchanged by three reversals within the same bytes. ``psm`` exchanges the marked middle
and the marked suffix, ``spm`` the first two blocks and the third. The inverse finds the marks,
rotates back and deletes them, which gives the text byte for byte.

Cuts and forms follow from a SHA-256 of seed and id, so they are the same in every run and retry.
Null texts are empty, empty texts are plain, and so are texts that hold a sentinel; a null id hashes as
no digits. Texts are whole whatever their length; repeated rows are transformed alike; columns of docs
named like those added are replaced; nothing gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import worker
from linkloom.llm.files import bounded

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output", "restored")
#: Bytes swapped at once by a reversal, and bytes of texts handed on at once.
_SWAP, _BATCH = 1 << 16, 1 << 24


def checked(sentinels: tuple[str, str, str]) -> list[bytes]:
    """The marks as bytes. None may hold another, begin with another's or its own end, or have a line end, else a mark could be found where none was put."""
    marks = [s.encode() for s in sentinels]
    if len(set(marks)) != 3 or any(not m or b"\n" in m for m in marks) or any(a in b for a, b in permutations(marks, 2)):
        raise ValueError(f"sentinels must be three strings of which none holds another or a line end: {sentinels}")
    if any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)))):
        raise ValueError(f"a sentinel may not begin as another or itself ends: {sentinels}")
    return marks


def reverse(a: np.ndarray, i: int, j: int) -> None:
    """Reverse a[i:j] in place, with a bounded copy at a time."""
    while j - i > 1:
        k = min(_SWAP, (j - i) // 2)
        head = a[i : i + k][::-1].copy()
        a[i : i + k] = a[j - k : j][::-1]
        a[j - k : j] = head
        i, j = i + k, j - k


def exchange(a: np.ndarray, i: int, j: int, k: int) -> None:
    """Exchange the neighbouring blocks a[i:j] and a[j:k] by three reversals."""
    reverse(a, i, j)
    reverse(a, j, k)
    reverse(a, i, k)


def line_ends(data: bytes | bytearray) -> np.ndarray:
    """Where each line ends, past its line feed; a last line without one ends with the text."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if not len(data) or (len(ends) and ends[-1] == len(data)) else np.append(ends, len(data))


def transform(buf: bytearray, p: int, m: int, form: str, marks: list[bytes]) -> None:
    """Mark and reorder a text cut at bytes p and m, within buf."""
    prefix, suffix, middle = marks
    buf[m:m] = suffix
    buf[p:p] = middle
    buf[0:0] = prefix
    i, j = len(prefix) + p, len(prefix) + m + len(middle)
    exchange(np.frombuffer(buf, np.uint8), 0 if form == "spm" else i, j, len(buf))


def restore(buf: bytearray, form: str, marks: list[bytes]) -> None:
    """Undo ``transform``, within buf."""
    prefix, suffix, middle = marks
    if form == "spm":  # suffix, then prefix and middle: rotate the suffix to the end
        exchange(np.frombuffer(buf, np.uint8), 0, buf.index(prefix), len(buf))
        i, j = buf.index(middle), buf.index(suffix)
    else:  # prefix, suffix, middle: exchange the last two
        i = buf.index(suffix)
        exchange(np.frombuffer(buf, np.uint8), i, buf.index(middle), len(buf))
        i, j = buf.index(middle), buf.index(suffix)
    del buf[j : j + len(suffix)]
    del buf[i : i + len(middle)]
    del buf[: len(prefix)]


def _chars(data: memoryview) -> int:
    """Code points of UTF-8 bytes: bytes that continue none."""
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)) if len(data) else 0


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, sentinels: tuple[str, str, str] = SENTINELS, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """docs without its text, with n (lines), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output (UTF-8 bytes).

    percent of the texts are transformed, spm_percent of them in the order suffix, prefix, middle.
    """
    marks = checked(sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"_h{k}") for k in range(4)]
    kept = [c for c in docs.columns if c not in (*ADDED, text_col)]
    rows = docs.select(*kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"), *draws)

    def one(data: memoryview, h: list[int]) -> tuple[int, str, int | None, int | None, bytes | bytearray]:
        buf = bytearray(data)
        ends = line_ends(buf)
        n = len(ends)
        if not n or h[2] % 100 >= percent or any(m in buf for m in marks):
            return n, "plain", None, None, buf
        first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m = (int(ends[k - 1]) if k else 0 for k in (first, last))
        form = "spm" if h[3] % 100 < spm_percent else "psm"
        counts = _chars(data[:p]), _chars(data[p:m])
        transform(buf, p, m, form, marks)
        return n, form, *counts, buf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for part in bounded(batches, "_text", _BATCH):
            draw = zip(*(part.column(f"_h{k}").to_pylist() for k in range(4)), strict=True)
            done = [one(memoryview(x.as_buffer()), h) for x, h in zip(part.column("_text"), draw, strict=True)]
            cols = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
            yield pa.record_batch([*(part.column(c) for c in kept), *cols], [*kept, *ADDED[:5]])

    added = "n long, form string, prefix_chars long, middle_chars long, output binary"
    return rows.mapInArrow(run, _schema(docs, kept, added))


def _schema(df: DataFrame, kept: list[str], added: str) -> str:
    own = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept]
    return ", ".join([*own, added])


def restored(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """made (with output and form) and the texts rebuilt from these two columns alone, as UTF-8 bytes in restored."""
    marks = checked(sentinels)

    def back(data: memoryview, form: str) -> bytearray:
        buf = bytearray(data)
        if form != "plain":
            restore(buf, form, marks)
        return buf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches, "output", _BATCH):
            texts = [back(memoryview(x.as_buffer()), f) for x, f in zip(part.column("output"), part.column("form").to_pylist(), strict=True)]
            yield pa.record_batch([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "restored"])

    kept = [c for c in made.columns if c != "restored"]
    return made.select(*kept).mapInArrow(run, _schema(made, kept, "restored binary"))
