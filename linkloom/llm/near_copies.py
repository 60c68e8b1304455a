"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least a given one.

Words are runs of non-space characters, lower-cased. A text's set holds the 64-bit hashes of its
shingles of ``SHINGLE`` words; fewer words form one shingle, no words an empty set. Two texts link when
|A and B| / |A or B| >= ``SIMILARITY``; empty sets link to each other only. Groups are what links connect.

Candidates come from MinHash: ``BANDS`` bands of ``ROWS`` minima each. A pair at similarity s shares no
band with probability (1 - s^ROWS)^BANDS: 5e-8 at 0.8, less above. Candidates whose sizes allow the
similarity are compared by their whole sets, so every link is right. SimHash can't stand in here: at a
similarity of 0.8 two fingerprints differ in about 15 % of their bits, 10 of 64, with a spread that
asks for a radius of 17 or more, for which covering masks would number 2^18.

Scale: texts of equal sets collapse to one row before anything else. Of a band's bucket with at most
``BUCKET`` rows all pairs are candidates. A larger one first has a center, the row that is in most such
buckets (in a group of near copies the text they stem from), and its pairs with the center are
candidates. Rows that these links connect are never paired again. The others of a center's rows are
compared, among themselves and with the connected ones, in chunks of about ``CHUNK`` rows and ``HASHES``
hashes: by minima in vectors, and where ``ALIKE`` of ``BANDS`` * ``ROWS`` agree (one at 0.8 misses that with
probability 3e-7) by whole sets. Only links leave a task. Chunks keep any number of rows in bounded
memory; work is quadratic, some 10 ns a pair, in those rows only that share a large bucket and aren't
near copies of its center.

Defined cases: null and empty texts have the empty set; repeated rows are returned as often as given;
rows with a null id get the id of their group, or null if nobody in it has one; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import worker
from linkloom.llm.components import connected_components
from linkloom.llm.store import Tables

SIMILARITY, SHINGLE, BANDS, ROWS, BUCKET, CHUNK, HASHES, ALIKE = 0.8, 5, 32, 4, 64, 256, 1 << 19, 80
_SLICE = 1 << 12
_RANDOM = np.random.Generator(np.random.PCG64(42))
_FLIP = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    digest = xxhash.xxh3_64_intdigest
    words = np.array([digest(w) for w in (text or "").lower().split()], np.uint64)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(times)
    return np.unique(out ^ (out >> np.uint64(31)))


def minima(hashes: np.ndarray) -> bytes:
    """The least hashes of a set under BANDS * ROWS permutations, 4 bytes each; the empty set has none."""
    if not len(hashes):
        return b""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), _SLICE):
        np.minimum(least, ((short[at : at + _SLICE] ^ _FLIP) * _TIMES).min(1), out=least)
    return least.astype("<u4").tobytes()


def band_keys(least: str) -> F.Column:
    """The keys of a column of minima, one for each band."""
    return F.array(*(F.xxhash64(F.substring(least, 4 * ROWS * k + 1, 4 * ROWS), F.lit(k)) for k in range(BANDS)))


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sets reach the similarity."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) >= similarity


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """(id, text, digest, n, least) of every row: its set's digest, size and minima."""
    names = ["id", "text", "digest", "n", "least"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            sets = [shingles(x.as_py(), width) for x in batch.column(1)]
            digests = pa.array([xxhash.xxh3_128_digest(s.astype("<u8").tobytes()) for s in sets], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), digests, pa.array([len(s) for s in sets], pa.int64()), pa.array([minima(s) for s in sets], pa.binary())], names)

    return docs.mapInArrow(run, "id long, text string, digest binary, n long, least binary")


def _all_pairs(similarity: float):
    """From buckets of (node, n), the pairs (a, b), a > b, whose sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for bucket in batch.column(0):
                members = bucket.values
                node, n = (members.field(k).to_numpy() for k in (0, 1))
                x, y = np.triu_indices(len(node), 1)
                near = np.minimum(n[x], n[y]) / np.maximum(n[x], n[y]) >= similarity
                a.append(np.maximum(node[x], node[y])[near])
                b.append(np.minimum(node[x], node[y])[near])
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _with_sets(width: int):
    """From (node, text), the nodes with the hashes of their sets and the low bytes of their minima, which are enough to count equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            sets = [shingles(x.as_py(), width) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([minima(s)[::4] for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "least", "hashes"])

    return run


def _alike(similarity: float):
    """From pairs of chunks of (node, n, root, least, hashes), the links (a, b), a > b, between different roots: ALIKE equal minima, then whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                (node, n, root), (other, m, base) = ([x.values.field(k).to_numpy() for k in range(3)] for x in (left, right))
                own, their = (np.frombuffer(b"".join(x.values.field(3).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for x in (left, right))
                sets, others = ([np.frombuffer(s.as_buffer(), "<u8") for s in x.values.field(4)] for x in (left, right))
                for at in range(len(node)):
                    near = (root[at] != base) & (np.minimum(n[at], m) / np.maximum(n[at], m) >= similarity)
                    near[near] = np.count_nonzero(their[near] == own[at], axis=1) >= ALIKE
                    for k in np.flatnonzero(near).tolist():
                        if similar(sets[at], others[k], similarity):
                            found.append((max(node[at], other[k]), min(node[at], other[k])))
            yield pa.record_batch([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _linked(tables: Tables, pairs: DataFrame, rows: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs (a, b) whose texts reach the similarity, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            found = []
            for a, b, x, y in zip(*(batch.column(k) for k in range(4)), strict=True):
                pair = a.as_py(), b.as_py()
                for node, text in zip(pair, (x, y), strict=True):
                    if node not in sets:
                        sets[node] = shingles(text.as_py(), width)
                if similar(sets[pair[0]], sets[pair[1]], similarity):
                    found.append(pair)
            yield pa.record_batch([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    texts = rows.select("row", "text")
    first = pairs.join(texts.toDF("a", "x"), "a")
    return tables.write(first.join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """(id, component_id) for every row; component_id is the smallest id reachable over links."""
    tables = Tables(spark)
    sketches = _sketches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), width)
    rows = tables.write(sketches.withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = tables.write(rows.groupBy("digest").agg(F.min("id").alias("first"), F.min("row").alias("node")), "sets")
    nodes = rows.select(F.col("row").alias("node"), "n", "least").join(classes.select("node"), "node", "left_semi").where("n > 0")
    bands = tables.write(nodes.select(F.explode(band_keys("least")).alias("key"), "node", "n"), "bands")
    large = tables.write(bands.groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > BUCKET).select("key"), "large")
    more = not large.isEmpty()
    small = bands.join(large, "key", "left_anti") if more else bands
    buckets = small.groupBy("key").agg(F.collect_list(F.struct("node", "n")).alias("members")).where(F.size("members") > 1).select("members")
    pairs = buckets.mapInArrow(_all_pairs(similarity), "a long, b long")
    if more:
        crowd = _crowd(tables, bands.join(large, "key", "left_semi"))
        fit = F.least("n", "center_n") / F.greatest("n", "center_n") >= similarity
        pairs = pairs.union(crowd.where((F.col("node") != F.col("center")) & fit).select(F.greatest("node", "center"), F.least("node", "center")))
    pairs = tables.write(pairs.distinct(), "pairs")
    edges = _linked(tables, pairs, rows, similarity, width)
    roots = connected_components(tables, edges)
    if more:
        found = tables.write(_chunk_pairs(tables, crowd, roots, rows, width).mapInArrow(_alike(similarity), "a long, b long").distinct(), "alike")
        if not found.isEmpty():
            edges = tables.write(edges.union(found), "links")
            roots = connected_components(tables, edges)
    tables.drop(bands, large, pairs)
    rooted = tables.write(classes.join(roots, "node", "left").select("digest", "first", F.coalesce("root", "node").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = tables.write(rooted.join(ids, "root").select("digest", "component_id"), "groups")
    out = tables.write(rows.select("id", "digest").join(groups, "digest").select("id", "component_id"), "near-copies")
    tables.drop(rows, classes, rooted, groups)
    return out


def _crowd(tables: Tables, bands: DataFrame) -> DataFrame:
    """(center, center_n, node, n): of large buckets (key, node, n) the rows by center, each once, as a written table."""
    bands = tables.write(bands, "large-buckets")
    often = bands.groupBy("node").agg(F.count(F.lit(1)).alias("times"))
    best = bands.join(often, "node").groupBy("key").agg(F.max(F.struct("times", (-F.col("node")).alias("least"), "n")).alias("best"))
    centers = tables.write(best.select("key", (-F.col("best.least")).alias("center"), F.col("best.n").alias("center_n")), "centers")
    return tables.write(bands.join(centers, "key").select("center", "center_n", "node", "n").distinct(), "crowd")


def _chunk_pairs(tables: Tables, crowd: DataFrame, roots: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(own, their): chunks of each center's rows outside its largest component, with every chunk of its rows they aren't yet paired with."""
    rooted = tables.write(crowd.join(roots, "node", "left").select("center", "node", "n", F.coalesce("root", "node").alias("root")), "rooted-crowd")
    sizes = rooted.groupBy("center", "root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("hashes"))
    major = sizes.groupBy("center").agg(F.max(F.struct("size", "root", "hashes")).alias("most"), F.sum("size").alias("all"), F.sum("hashes").alias("all_hashes"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    parts = lambda n, hashes: F.greatest(F.ceil(n / CHUNK), F.ceil(hashes / HASHES)).cast("int")
    in_minor = parts(F.col("all") - F.col("most.size"), F.col("all_hashes") - F.col("most.hashes"))
    major = tables.write(major.select("center", F.col("most.root").alias("major"), parts(F.col("most.size"), F.col("most.hashes")).alias("in_major"), in_minor.alias("in_minor")), "major")
    both = rooted.join(major, "center").withColumn("is_major", F.col("root") == F.col("major"))
    chunk = F.pmod(F.xxhash64("node"), F.when(F.col("is_major"), F.col("in_major")).otherwise(F.col("in_minor"))).cast("int")
    to = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda own, their, with_major, right: F.struct(own.alias("own"), their.alias("their"), F.lit(with_major).alias("with_major"), F.lit(right).alias("right"))
    minor = F.concat(
        F.transform(to(F.col("in_major")), lambda j: place(F.col("chunk"), j, True, False)),
        F.transform(F.filter(to(F.col("in_minor")), lambda j: j >= F.col("chunk")), lambda j: place(F.col("chunk"), j, False, False)),
        F.transform(F.filter(to(F.col("in_minor")), lambda j: j <= F.col("chunk")), lambda j: place(j, F.col("chunk"), False, True)),
    )
    places = F.when(F.col("is_major"), F.transform(to(F.col("in_minor")), lambda i: place(i, F.col("chunk"), True, True))).otherwise(minor)
    texts = rows.select(F.col("row").alias("node"), "text").join(both.select("node").distinct(), "node", "left_semi")
    sets = tables.write(texts.mapInArrow(_with_sets(width), "node long, least binary, hashes binary"), "sets")
    dealt = both.withColumn("chunk", chunk).join(sets, "node").select("center", F.explode(places).alias("at"), F.struct("node", "n", "root", "least", "hashes").alias("x"))
    side = lambda right: F.collect_list(F.when(F.col("at.right") == right, F.col("x")))
    met = dealt.groupBy("center", "at.own", "at.their", "at.with_major").agg(side(False).alias("left"), side(True).alias("right"))
    return met.where((F.size("left") > 0) & (F.size("right") > 0)).select("left", "right")
