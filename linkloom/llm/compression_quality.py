"""Quality by compression: how much better a text fits a dictionary of good text than one of bad text.

Two Zstandard dictionaries are trained on labelled texts, cut into pieces of ``PIECE`` bytes. A text
is compressed piece by piece with either and with none, so that the dictionaries count alike in short
and long texts. Its features are normalised compressed-size differences and nothing else: bad against
good dictionary, and none against good, each of the whole text and of its worst quarter of pieces, and
none against bad of the whole text. A logistic curve, fitted on labelled texts that no dictionary saw
and weighted to the true class sizes, turns them into a calibrated score.

Fitting uses about ``SAMPLE`` labelled rows of each class, those of id hashes below a cut, of any length. The
driver gets at most ``DRAWN`` pieces of a text, evenly spaced, and the features of whole texts, which
tasks compute: some ``SAMPLE`` * ``DRAWN`` * ``PIECE`` bytes, 24 MB. Everything is scored, whole. Labels,
lang, source and ids are never inputs.

Defined cases: null texts score like empty ones; a label counts if it is 0 or 1, with a non-null id;
repeated rows are scored each, and of rows that share a labelled id the least text is learnt from;
without labels of both classes every score is the share of label 1 (0.5 without labels); other columns
stay as they are, but one named like the score is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm import worker
from linkloom.llm.store import Tables

SAMPLE, DRAWN, PIECE, DICTIONARY, LEVEL = 3000, 16, 512, 32 << 10, 1
_FEATURES = 5


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: its id's crc32 leaves 1 by 3. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _pieces(data: bytes) -> list[bytes]:
    return [data[at : at + PIECE] for at in range(0, len(data), PIECE)] or [b""]


def _drawn(data: bytes) -> list[bytes]:
    """At most DRAWN pieces of a text, evenly spaced."""
    pieces = _pieces(data)
    n = min(len(pieces), DRAWN)
    return [pieces[k * len(pieces) // n] for k in range(n)]


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(pieces)[-DICTIONARY:]


@dataclass(frozen=True)
class Model:
    """Two dictionaries, and the logistic curve over the features."""

    good: bytes = b""
    bad: bytes = b""
    weights: tuple[float, ...] = (0.0,) * (_FEATURES + 1)

    def packers(self) -> list[zstandard.ZstdCompressor]:
        """Compressors with the good dictionary, with the bad one, and with none."""
        out = []
        for raw in (self.good, self.bad):
            known = zstandard.ZstdCompressionDict(raw)
            known.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False))
        return [*out, zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)]

    def score(self, features: np.ndarray) -> np.ndarray:
        z = features @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(data: bytes, packers: list[zstandard.ZstdCompressor]) -> tuple[float, ...]:
    """The features of a text: normalised differences of compressed sizes."""
    pieces = _pieces(data)
    good, bad, plain = (np.array([len(packer.compress(p)) for p in pieces], float) for packer in packers)
    worst = max(1, len(pieces) // 4)
    least = lambda x: float(np.partition(x, worst - 1)[:worst].mean())
    g, b, n = good.sum(), bad.sum(), plain.sum()
    return (b - g) / min(g, b), least((bad - good) / np.minimum(good, bad)), (n - g) / n, least((plain - good) / plain), (n - b) / n


def _fit_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression with a small ridge, by Newton steps on scaled features."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w, beta = w / w.sum() * len(w), np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        ridge = np.r_[1e-6, np.full(len(beta) - 1, 0.1)]
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (w * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return (float(beta[0] - (beta[1:] * mean / spread).sum()), *map(float, beta[1:] / spread))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from labelled rows that are not held out."""
    tables = Tables(docs.sparkSession)
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    usable = tables.write(marks.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi"), "usable")
    sizes = {r.y: r.n for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    # hashes below a cut leave about SAMPLE rows of a class, however many there are
    cut = F.when(F.col("y") == 1, SAMPLE / max(sizes.get(1, 0), 1)).otherwise(SAMPLE / max(sizes.get(0, 0), 1))
    near = usable.withColumn("h", F.xxhash64("id")).where((F.col("h").cast("double") + 2.0**63) / 2.0**64 <= cut)
    half = F.row_number().over(Window.partitionBy("y").orderBy("h", "id")) % 2  # of ids only, about SAMPLE a class
    picked = tables.write(near.select("id", "y", "h", half.alias("half")), "picked")
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(picked, "id").groupBy("id", "y", "h", "half").agg(F.min("text").alias("text"))
    sample = tables.write(joined.select("y", "h", "half", F.coalesce("text", F.lit("")).cast("binary").alias("data")), "sample")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [_drawn(x.as_buffer().to_pybytes()) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(pieces, pa.list_(pa.binary()))], ["y", "h", "pieces"])

    drawn = sample.where("half = 1").select("y", "h", "data").mapInArrow(draw, "y int, h long, pieces array<binary>")
    seen = sorted(drawn.collect(), key=lambda r: (r.h, r.pieces))  # about SAMPLE rows of DRAWN pieces
    own = {y: [bytes(p) for r in seen if r.y == y for p in r.pieces] for y in (0, 1)}
    model = Model(_dictionary(own[1]), _dictionary(own[0])) if all(own.values()) else None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = model.packers()
        for batch in batches:
            x = [features(x.as_buffer().to_pybytes(), packers) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["y", "h", "x"])

    measured = sample.where("half = 0").select("y", "h", "data").mapInArrow(measure, "y int, h long, x array<double>")
    held = sorted(measured.collect(), key=lambda r: (r.h, r.x)) if model else []  # about SAMPLE rows of five numbers
    tables.drop(usable, picked, sample)
    n = {y: sum(r.y == y for r in held) for y in (0, 1)}
    if not all(n.values()):
        share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
        return Model(weights=(float(np.log(share / (1 - share))), *(0.0,) * _FEATURES))
    y = np.array([float(r.y) for r in held])
    w = np.where(y == 1, sizes[1] / n[1], sizes[0] / n[0])
    return Model(model.good, model.bad, _fit_curve(np.array([r.x for r in held]), y, w))


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score of each text."""
    kept = [c for c in docs.columns if c != score_col]
    schema = docs.select(*kept).schema.add(score_col, "double")
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        packers = model.packers()
        for batch in batches:
            x = [features(t.as_buffer().to_pybytes() if t.is_valid else b"", packers) for t in batch.column(at).cast(pa.binary())]
            yield pa.record_batch([*batch.columns, pa.array(model.score(np.array(x).reshape(-1, _FEATURES)))], [*batch.schema.names, score_col])

    return docs.select(*kept).mapInArrow(run, schema)
