"""Near duplicates by SimHash and covering locality-sensitive hashing.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. Each 3-word shingle
(repeats count) is hashed with XXH64, seed 42; a fingerprint bit is set when over half of the
hashes set it. Fewer than three words form one shingle; no words give fingerprint 0.

Two fingerprints link when at most 3 bits differ. Covering LSH finds all such pairs: bit i gets
a nonzero vector a(i) of 4 bits, and for each of the 15 nonzero vectors v a mask keeps the bits
with a(i).v = 1. Any 3 vectors a(i) have a common orthogonal v, so a pair with at most 3 differing
bits agrees under some mask. No pair is missed, whatever the data.

Scale: copies collapse to one row per fingerprint before anything else. A bucket that holds more
than ``BUCKET`` fingerprints is dealt anew by 15 masks over its free bits (again covering), never
compared by one task; this ends, as the free bits shrink by about half each time and a bucket with
none left holds one fingerprint.
A bucket yields a star per group of linked members, not all pairs. Groups are joined by
alternating large-star and small-star rounds on written edge tables.

Defined cases: null and empty texts have fingerprint 0 and link like any other; repeated rows are
returned as often as given; rows with a null id get the id of their group, or null if nobody in
the group has one; other columns are ignored; an empty table gives an empty result.
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

SEED, WIDTH, RADIUS, SHINGLE, BUCKET = 42, 64, 3, 3, 256
_SLICE = 1 << 18
_BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1


def fingerprint(data: bytes) -> int:
    """The unsigned 64-bit fingerprint of a text's UTF-8 bytes."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n, ones = len(words) - SHINGLE + 1, np.zeros(WIDTH, np.int64)
    for at in range(0, n, _SLICE):
        part = words[at : at + _SLICE + SHINGLE - 1]
        hashes = np.array([digest(join(w), SEED) for w in zip(part, part[1:], part[2:], strict=False)], dtype="<u8")
        lanes = hashes.view(np.uint8).reshape(-1, 8)
        for lane in range(8):
            ones[lane * 8 : lane * 8 + 8] += np.bincount(lanes[:, lane], minlength=256) @ _BITS
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of docs, fp as a signed long."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for batch in batches:
            texts = batch.column(1)
            fps = [_signed(fingerprint(x.as_buffer().to_pybytes())) if x.is_valid else 0 for x in texts.cast(pa.binary())]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def covering_masks(mask: int = 0) -> list[int]:
    """15 masks over the bits free in ``mask``, each joined with it; they cover radius 3."""
    free = [i for i in range(WIDTH) if not mask >> i & 1]
    out = []
    for v in range(1, 1 << RADIUS + 1):
        keep = sum(1 << bit for at, bit in enumerate(free) if ((1 + at % 15) & v).bit_count() & 1)
        out.append(mask | keep)
    return out


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From buckets of fingerprints, (a, b) with a > b: each linked member and the least of its group."""
    for batch in batches:
        lists = batch.column(0)
        values, starts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        x, y = values[two], values[two + 1]
        near = np.bitwise_count((x ^ y).view(np.uint64)) <= RADIUS
        found = [(np.maximum(x, y)[near], np.minimum(x, y)[near])]
        for k in np.flatnonzero(sizes > 2):
            own = np.sort(values[starts[k] : starts[k + 1]])
            linked = np.bitwise_count((own[:, None] ^ own[None, :]).view(np.uint64)) <= RADIUS
            group = np.arange(len(own))
            while True:
                least = np.where(linked, group[None, :], len(own)).min(1)
                if (least == group).all():
                    break
                group = least
            member = group != np.arange(len(own))
            found.append((own[member], own[group[member]]))
        yield pa.record_batch([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], ["a", "b"])


def links(tables: Tables, fps: DataFrame) -> DataFrame:
    """(a, b): stars that connect all of the distinct ``fp`` values within 3 bits of each other."""
    spark = tables.spark
    masks = [_signed(m) for m in covering_masks()]
    rows = fps.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    found, spent = [], []
    while True:
        rows = rows.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        large = tables.write(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("mask", "key"), "large")
        spent.append(large)
        more = not large.isEmpty()
        small = rows.join(large, ["mask", "key"], "left_anti") if more else rows
        buckets = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
        found.append(tables.write(buckets.mapInArrow(_stars, "a long, b long").distinct(), "stars"))
        if not more:
            break
        # at most 15 finer masks for each mask in use; the third time the free bits are 8 or fewer
        deal = [(m, _signed(f)) for m in masks for f in covering_masks(m & (1 << 64) - 1)]
        rows = rows.join(large, ["mask", "key"], "left_semi").join(F.broadcast(spark.createDataFrame(deal, "mask long, finer long")), "mask").select("fp", F.col("finer").alias("mask")).distinct()
        masks = sorted({f for _, f in deal})
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    out = tables.write(out.distinct(), "links")
    tables.drop(*spent, *found)
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id reachable over links."""
    tables = Tables(spark)
    prints = tables.write(fingerprints(docs, id_col, text_col), "prints")
    classes = tables.write(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    edges = links(tables, classes)
    roots = connected_components(tables, edges)
    rooted = tables.write(classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = tables.write(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "ids")
    groups = tables.write(rooted.join(ids, "root").select("fp", "component_id"), "groups")
    tables.drop(classes, edges, rooted, ids)
    return prints.join(groups, "fp").select("id", "fp", "component_id")


def hex_of(fp) -> F.Column:
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
