"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components become integers floor(256 * x). A shard of at most ``SHARD`` rows and ``CELLS`` components has one posting list per
component, of impacts: the values in at most ``LEVELS`` steps of equal width, so that a list's largest
impact bounds all of its postings. A query takes the lists in descending order of its weight times
that largest impact, a segment of ``SEGMENT`` lists at a time, and adds weight times impact to the
accumulators of the rows that are left.

What a row can still gain is at most |q_rest| * |x_rest| (Cauchy and Schwarz), the norms of query and
row over the lists not yet processed, plus |q| times the norm of what the steps cut off. After each
segment the rows with the best accumulators are scored exactly; the k-th best of these is a proven
bound. Rows that can't reach it leave, and the accumulators are compacted. Only once few rows are
left, or no segment, does processing stop, and these possible members are scored exactly. Impacts,
sums and squared norms are whole numbers below 2**53 in double precision, so only square roots are
rounded, for which the bound leaves room. So results are exact.

Queries are written in blocks of as many components and ``BLOCK`` rows at most to files in the shared folder. Each task
builds its shards' indexes and streams the blocks; nothing is broadcast and no cross join is made. A
task returns at most k rows per query and shard, and a window limited before the shuffle keeps the k
best. Bounds come from the shard's own rows, so queries need not be rows of the vectors.

Defined cases: vectors null or with null or non-finite components, and rows with a null id, take no
part; shorter vectors count as padded with zeros; rows with the query's own id are not its
candidates; each repeated query row gets its own answer, each repeated candidate its own place; other
columns, whatever their names, are ignored; an empty table gives an empty result. Shards and queries
with components of 2**22 or more in magnitude are scored whole in exact integers of any size; scores
are then held to the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm import files
from linkloom.llm.store import Tables, new_path

SHARD, BLOCK, CELLS, LEVELS, SEGMENT = 1 << 16, 1 << 11, 1 << 23, 256, 8
_SAFE, _FEW, _LOWEST = 1 << 22, 64, -(1 << 63)


def integers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the integer matrix of a batch (id, vector)."""
    lists = batch.column(1)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(256.0 * lists.flatten().to_numpy(zero_copy_only=False))
    width = int(sizes.max(initial=0))
    matrix = np.zeros((len(sizes), width))
    if len(flat):
        row = np.repeat(np.arange(len(sizes)), sizes)
        matrix[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    whole = np.abs(matrix).max(initial=0) < 1 << 62
    return batch.column(0).to_numpy(), matrix.astype(np.int64) if whole else np.array([[int(x) for x in r] for r in matrix], object).reshape(matrix.shape)


def _wider(matrix: np.ndarray, width: int) -> np.ndarray:
    return matrix if matrix.shape[1] >= width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def _exact(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Scores as exact integers, held to the range of a long."""
    if matrix.dtype == query.dtype == np.int64 and max(np.abs(matrix).max(initial=0), np.abs(query).max(initial=0)) < _SAFE:
        return matrix @ query
    return np.array([max(min(int(x), (1 << 63) - 1), -(1 << 63)) for x in matrix.astype(object) @ query.astype(object)], np.int64)


class Shard:
    """The impact-ordered index of some rows."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.matrix = ids[order], matrix[order]
        self.processed = 0  # postings, of all searches
        self.plain = matrix.dtype == np.int64 and np.abs(matrix).max(initial=0) < _SAFE
        if not self.plain or not len(ids):
            return
        values = self.matrix.T
        step = np.maximum(1, -(-2 * np.abs(values).max(1, keepdims=True) // LEVELS))
        impacts = (2 * values + step) // (2 * step) * step
        self.impacts = np.ascontiguousarray(impacts.astype(np.float32))  # whole numbers of at most 23 bits
        self.top = np.abs(impacts).max(1)
        self.energy = (impacts * impacts).sum(0).astype(float)
        self.cut_off = np.sqrt(((values - impacts) ** 2).sum(0).astype(float)) * (1 + 1e-12)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, best first."""
        width = max(self.matrix.shape[1], len(query))
        query = np.pad(query, (0, width - len(query))) if len(query) < width else query
        a, b = np.searchsorted(self.ids, [own, own + 1]) if own < (1 << 63) - 1 else (np.searchsorted(self.ids, own), len(self.ids))
        if not self.plain or query.dtype != np.int64 or np.abs(query).max(initial=0) >= _SAFE or len(self.ids) - (b - a) <= _FEW:
            maybe = np.concatenate([np.arange(a), np.arange(b, len(self.ids))])
        else:
            maybe = self._possible(query[: self.matrix.shape[1]], k, a, b)
        scores = _exact(_wider(self.matrix[maybe], width), query)
        best = np.lexsort((self.ids[maybe], -scores))[:k]
        return self.ids[maybe[best]], scores[best]

    def _possible(self, query: np.ndarray, k: int, a: int, b: int) -> np.ndarray:
        """Rows other than a..b that the proof doesn't rule out."""
        rows = np.r_[0:a, b : len(self.ids)]
        if len(rows) <= k:
            return rows
        impact = np.abs(query) * self.top
        order = np.argsort(-impact, kind="stable")[: np.count_nonzero(impact)]
        weight = query.astype(float)
        sums, left, bound = np.zeros(len(rows)), self.energy[rows], -np.inf
        slack = float(np.sqrt((weight * weight).sum())) * (1 + 1e-12) * self.cut_off[rows]
        for at in range(0, len(order), SEGMENT):
            lists = order[at : at + SEGMENT]
            gains = self.impacts[np.ix_(lists, rows)].astype(float)
            self.processed += gains.size
            sums += weight[lists] @ gains
            left -= np.einsum("ij,ij->j", gains, gains)
            rest = float(np.sqrt((weight[order[at + SEGMENT :]] ** 2).sum()))
            best = np.argpartition(sums, len(rows) - k)[len(rows) - k :]
            bound = max(bound, int((self.matrix[rows[best]] @ query).min()))
            keep = sums + rest * np.sqrt(left) * (1 + 1e-12) + slack + 1 >= bound
            if not keep.all():
                rows, sums, left, slack = rows[keep], sums[keep], left[keep], slack[keep]
            if len(rows) <= max(8 * k, _FEW):
                break
        return rows


def _take(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrices of at most ``size`` rows and ``CELLS`` components; one row may have more."""
    held, n, width = [], 0, 1
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            here = batch.slice(at, max(1, min(size, CELLS // max(1, _widest(batch.slice(at, size))))))
            part, at = integers(here), at + here.num_rows
            wider = max(width, part[1].shape[1])
            if held and (n + len(part[0]) > size or (n + len(part[0])) * wider > CELLS):
                yield _joined(held)
                held, n, wider = [], 0, max(1, part[1].shape[1])
            held.append(part)
            n, width = n + len(part[0]), wider
    if held:
        yield _joined(held)


def _widest(batch: pa.RecordBatch) -> int:
    """The components of a batch's longest vector."""
    return pc.max(pc.list_value_length(batch.column(1))).as_py() or 0


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    width = max(m.shape[1] for _, m in parts)
    return np.concatenate([i for i, _ in parts]), np.concatenate([_wider(m, width) for _, m in parts])


def _block_files(queries: DataFrame, folder: str) -> DataFrame:
    """(uri): files of query blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in _take(batches, BLOCK):
            flat = pa.array([str(x) for x in matrix.ravel()], pa.string()) if matrix.dtype == object else pa.array(matrix.ravel())
            rows = pa.FixedSizeListArray.from_arrays(flat, matrix.shape[1]) if matrix.shape[1] else pa.array([[]] * len(ids), pa.list_(pa.int64(), 0))
            table = pa.record_batch([pa.array(ids), rows], ["id", "vector"])
            with files.writer(folder, "queries") as (uri, out), pa.ipc.new_file(out, table.schema) as to:
                to.write_batch(table)
            yield pa.record_batch([pa.array([uri])], ["uri"])

    return queries.mapInArrow(run, "uri string")


def _load(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block's queries."""
    table = pa.ipc.open_file(files.whole(uri)).read_all().combine_chunks()
    kind, flat = table.schema.field("vector").type, table.column("vector").combine_chunks().flatten()
    values = np.array([int(x) for x in flat.to_pylist()], object) if pa.types.is_string(kind.value_type) else flat.to_numpy()
    return table.column("id").to_numpy(), values.reshape(table.num_rows, kind.list_size)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of vectors for each row of queries."""
    spark = vectors.sparkSession
    tables, folder = Tables(spark), new_path(spark, "query-blocks")
    files.make_dir(folder)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    uris = [r.uri for r in tables.write(_block_files(clean(queries), folder), "blocks").toLocalIterator()]  # names of files, one for 2048 queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in _take(batches, SHARD):
            shard = Shard(ids, matrix)
            for block, uri in enumerate(uris):
                own, wanted = _load(uri)
                found = [shard.search(int(x), query, k) for x, query in zip(own, wanted, strict=True)]
                sizes = [len(near) for near, _ in found]
                rows = np.repeat(np.arange(len(own)), sizes)
                yield pa.record_batch([pa.array(c) for c in (block * BLOCK + rows, own[rows], np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))], ["q", "query_id", "vec_id", "score"])

    pairs = clean(vectors).mapInArrow(run, "q long, query_id long, vec_id long, score long")
    best = Window.partitionBy("q", "query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
