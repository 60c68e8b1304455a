"""Periodic runs of words, found in tiles of each period octave and stitched.

A run is a stretch of consecutive words with smallest period q and a length of at least max(24, 3 q)
that no neighbour extends. For periods of an octave [B, 2 B) (1 to 7 in the first, whose B is 8) a run is an interval of
at least 2 B - 1 places i where word i equals word i + q. So it covers a block [c, c + B) with
c a multiple of B whole, which must equal the block at c + q.

Documents are exploded into tiles per octave, ``CORE`` words or 8 B long, each overlapping the next by 4 B. Within a tile hashes
of blocks name the pairs (c, q) to look at, never too few; Z-functions from the boundary c, forwards
and backwards, give how far each reaches. A tile's intervals of one period are merged and go, if they are long enough
or cut off by the tile, to the rows (document, period), where overlapping ones are stitched. An
interval is at least 2 B long in every tile that it isn't whole within the next one's overlap of, so stitching loses nothing.
Stretches found with several periods keep the smallest.

Tiles of documents up to ``LONG`` words are solved where the document is read, only fragments are shuffled. Those of
longer documents are dealt over the tasks as rows; the tile functions are the same. Work is n log n in the words.

Null and empty texts have no words and no runs; rows are told apart by where they were written, so repeated rows and null
ids are rows like others; other columns are ignored, and nothing gives nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm import worker
from linkloom.llm.files import bounded
from linkloom.llm.store import Tables

#: The least length of a run, and how many periods it has at least.
LEAST, TIMES = 24, 3
#: Words of the shortest tiles without their overlap, and of the longest documents that one task solves.
CORE, LONG = 4096, 1 << 18
_FIRST = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts that are solved in a row.
_BYTES = 1 << 19


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than ASCII white space (0x20, 0x09 to 0x0D)."""
    return text.split()


def ids_of(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    return np.fromiter(map({}.setdefault, words, count()), np.int32, len(words))


def octaves(n: int) -> Iterator[tuple[int, int, int]]:
    """(B, least period, greatest period) of every octave whose runs fit n words."""
    b = _FIRST
    while n >= LEAST and (lo := 1 if b == _FIRST else b) * TIMES <= n:
        if b == _FIRST:
            yield b, 1, b - 1
            lo = b
        if lo * TIMES <= n:
            yield b, lo, min(2 * b - 1, n // TIMES)
        b *= 2


def tiles(n: int, b: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the overlapping tiles of n words for blocks of b."""
    core, at = max(CORE, 8 * b), 0
    while True:
        end = min(at + core + 4 * b, n)
        yield at, end
        if end == n:
            return
        at += core


def z_function(s: list[int], upto: int) -> list[int]:
    """How far s[i:] agrees with s, for i below upto."""
    n, left, right = len(s), 0, 0
    z = [n] + [0] * (upto - 1)
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _candidates(w: np.ndarray, b: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places c (multiples of b) and periods q, in order of c, where the blocks of b words at c and c + q may be equal."""
    h = (w.astype(np.uint64) + np.uint64(1)) * _MIX
    size = 1
    while size < b:
        h ^= h >> np.uint64(29)
        h = h[:-size] * _MIX + h[size:]
        size *= 2
    blocks = len(h)  # places where a whole block begins
    starts = np.arange(0, blocks - least, b)
    if not len(starts):
        return starts, starts
    padded = np.concatenate((h, np.zeros(most + b, np.uint64)))
    view = np.lib.stride_tricks.sliding_window_view(padded, most - least + 1)[starts + least]
    at, off = np.nonzero(view == h[starts][:, None])
    c, q = starts[at], off + least
    inside = c + q < blocks
    return c[inside], q[inside]


def solve(w: np.ndarray, b: int, least: int, most: int, begin: int, n: int) -> list[tuple[int, int, int]]:
    """(period, start, stop) of the intervals of agreement in the tile w, which begins at word ``begin`` of n; those cut off by the tile may be parts."""
    cs, qs = _candidates(w, b, least, most)
    if not len(cs):
        return []
    size, reach = len(w), 8 * b
    seen: dict[int, list[list]] = {}
    bounds = np.flatnonzero(np.diff(cs)) + 1
    for c, periods in zip(cs[np.r_[0, bounds]].tolist(), np.split(qs, bounds), strict=True):
        # what a window cut off goes on from the last block within it
        wanted = [q for q in periods.tolist() if q not in seen or seen[q][-1][1] < c + b * (2 if seen[q][-1][2] else 1)]
        if not wanted:
            continue
        right = w[c : c + reach + most].tolist()
        ahead = z_function(right, max(wanted) + 1)
        left = w[max(0, c - reach) : c + max(wanted)][::-1].tolist()
        top = max(wanted)
        lead = left[top:]  # words before c, backwards
        behind = z_function([*lead, -1, *left], len(lead) + 2 + top - min(wanted)) if lead else None
        for q in wanted:
            back = behind[len(lead) + 1 + top - q] if behind else 0
            start, stop = c - min(back, len(lead)), c + ahead[q]
            if stop == start:
                continue
            cut, known = ahead[q] == len(right) - q and c + len(right) < size, seen.setdefault(q, [])
            if known and known[-1][1] >= start:
                known[-1] = [min(known[-1][0], start), max(known[-1][1], stop), cut]
            else:
                known.append([start, stop, cut])
    out = []
    for q, found in seen.items():
        for start, stop, _ in found:
            whole = (start > 0 or begin == 0) and (stop < size - q or begin + size == n)
            if not whole or stop - start >= enough(q):
                out.append((q, begin + start, begin + stop))
    return out


def enough(q: int) -> int:
    """The places of agreement that a run of period q has at least."""
    return max(LEAST - q, (TIMES - 1) * q)


def fragments(ids: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """The fragments of all tiles of a document, or of several in a row that share no numbers, of which the longest is given."""
    n = len(ids)
    return [f for b, least, most in octaves(n if longest is None else longest) for lo, hi in tiles(n, b) for f in solve(ids[lo:hi], b, least, most, lo, n)]


def fragments_of(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The fragments of each of several documents. They are solved in a row, each with numbers of its own, so that no agreement crosses a border and short ones share tiles."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    ends = np.cumsum([len(w) for w in docs])
    if not len(ends) or not ends[-1]:
        return out
    ids = np.concatenate([ids_of(w) + np.int32(end - len(w)) for w, end in zip(docs, ends.tolist(), strict=True)])
    found = fragments(ids, max(map(len, docs)))
    for k, (q, start, stop) in zip(np.searchsorted(ends, [f[1] for f in found], "right").tolist(), found, strict=True):
        begin = int(ends[k]) - len(docs[k])
        out[k].append((q, start - begin, stop - begin))
    return out


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_FRAGMENTS = "array<struct<period:bigint,start:bigint,stop:bigint>>"
_KIND = pa.list_(pa.struct([("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))


def _solved(docs: DataFrame, id_col: str, text_col: str, texts: bool) -> DataFrame:
    """(id, n_words, text, collapsed, fragments): the text where fragments were found or others must look, else what collapsing leaves of it."""

    def solved(texts_in: list[bytes], docs_in: list[list[bytes]]) -> Iterator[tuple]:
        short = fragments_of([w if len(w) <= LONG else [] for w in docs_in])
        for data, words, found in zip(texts_in, docs_in, short, strict=True):
            if found or len(words) > LONG:
                yield len(words), data, None, None if len(words) > LONG else [dict(zip(("period", "start", "stop"), f, strict=True)) for f in found]
            else:
                yield len(words), None, b" ".join(words) if texts else _digest(words).encode(), []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        kinds = (pa.int64(), pa.binary(), pa.binary(), _KIND)
        for part in bounded(batches, "text", _BYTES):
            data = [memoryview(x.as_buffer()).tobytes() for x in part.column("text")]
            rows = solved(data, [words_of(x) for x in data])
            yield pa.record_batch([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["id", "n_words", "text", "collapsed", "fragments"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id long, n_words long, text binary, collapsed binary, fragments {_FRAGMENTS}")


def exploded(long_docs: DataFrame) -> DataFrame:
    """(rid, n, b, least, most, at, ids): the tiles of documents too long for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "n", "b", "least", "most", "at", "ids"]
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(words_of(memoryview(text.as_buffer()).tobytes()))
                for b, least, most in octaves(len(ids)):
                    for lo, hi in tiles(len(ids), b):
                        row = (rid, len(ids), b, least, most, lo, ids[lo:hi].tobytes())
                        yield pa.record_batch([pa.array([v], pa.binary() if k == "ids" else pa.int64()) for k, v in zip(names, row, strict=True)], names)

    return long_docs.select("rid", "text").mapInArrow(run, "rid long, n long, b long, least long, most long, at long, ids binary")


def solved_tiles(rows: DataFrame) -> DataFrame:
    """(rid, period, start, stop): the fragments of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rid, n, b, least, most, at = (batch.column(c)[k].as_py() for c in range(6))
                found = solve(np.frombuffer(batch.column(6)[k].as_buffer(), np.int32), b, least, most, at, n)
                cols = list(zip(*found, strict=True)) or [[], [], []]
                yield pa.record_batch([pa.array([rid] * len(found), pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], ["rid", "period", "start", "stop"])

    return rows.mapInArrow(run, "rid long, period long, start long, stop long")


def stitched(parts: DataFrame) -> DataFrame:
    """(rid, runs): fragments of one document and period are joined where they overlap or touch; runs (start, period, length) by start, then period."""
    order = Window.partitionBy("rid", "period").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.withColumn("_new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    islands = marked.withColumn("_island", F.sum("_new").over(order)).groupBy("rid", "period", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    q = F.col("period")
    long_enough = islands.where(F.col("stop") - F.col("start") >= F.greatest(LEAST - q, (TIMES - 1) * q)).select("rid", "period", "start", (F.col("stop") - F.col("start") + q).alias("length"))
    smallest = long_enough.groupBy("rid", "start", "length").agg(F.min("period").alias("period"))
    return smallest.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def kept_words(words: list[bytes], runs: list[dict]) -> list[bytes]:
    """Words without those that a run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int32)
    for r in runs:
        drop[r["start"] + r["period"]] += 1
        drop[r["start"] + r["length"]] -= 1
    keep = np.cumsum(drop[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def _collapsed(found: DataFrame, texts: bool) -> DataFrame:
    """Rows with runs: their texts collapsed."""

    def one(text: bytes, runs: list[dict] | None) -> bytes:
        words = kept_words(words_of(text), runs or [])
        return b" ".join(words) if texts else _digest(words).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches, "text", _BYTES):
            done = [one(memoryview(t.as_buffer()).tobytes(), r.as_py()) for t, r in zip(part.column("text"), part.column("runs"), strict=True)]
            yield pa.record_batch([part.column("id"), part.column("n_words"), part.column("runs"), pa.array(done, pa.binary())], ["id", "n_words", "runs", "collapsed"])

    return found.select("id", "n_words", "text", "runs").mapInArrow(run, "id long, n_words long, runs array<struct<start:bigint,period:bigint,length:bigint>>, collapsed binary")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: all runs by start, then period, and the kept words joined by one space; without ``texts`` the SHA-256 of these."""
    tables = Tables(docs.sparkSession)
    solved = tables.write(_solved(docs, id_col, text_col, texts).withColumn("rid", F.monotonically_increasing_id()), "solved")
    none = F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")
    parts = solved.where(F.size("fragments") > 0).select("rid", F.inline("fragments"))
    long_docs = solved.where(F.col("fragments").isNull())
    if not long_docs.isEmpty():
        dealt = exploded(long_docs).repartition("rid", "b", "at")
        parts = parts.unionByName(solved_tiles(dealt))
    runs = stitched(parts).withColumnRenamed("rid", "_rid")
    unlike = solved.where(F.col("text").isNotNull())
    found = unlike.join(runs, unlike.rid == runs._rid, "left").select("id", "n_words", "text", F.coalesce("runs", none).alias("runs"))
    plain = solved.where(F.col("text").isNull()).select("id", "n_words", none.alias("runs"), "collapsed")
    out = plain.unionByName(_collapsed(found, texts))
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period; of equal ones the first."""
    first = F.get(runs, F.lit(0))
    return F.aggregate(runs, first, lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))
