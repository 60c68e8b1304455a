"""Mixing to target weights with soft membership.

A classifier fitted on a table of texts with domains gives each document a posterior over the
domains: its bytes' trigrams are scored in segments of ``SEGMENT`` bytes by naive Bayes at a fitted
temperature, and the segments' posteriors are averaged, so a text with passages of several domains
belongs to each in part. Then nonnegative document rates are fitted so that the expected tokens of
each domain, sum over documents of rate * tokens * posterior, match the targets.

The fit is weighted least squares by projected gradient. With M = sum of tokens * p p', the
objective 1/2 |M^(-1/2) (A r - t)|^2 in the variables sqrt(tokens) * rate has a gradient of Lipschitz
constant 1, so steps of 1 converge: rate <- max(0, rate - p.g) with g = M^-1 (A r - t). A rate is thus
a function of the posterior and of the g so far. A pass replays them per document and returns one
vector of sums per task; nothing but K numbers a pass comes to the driver, no state is kept between
passes, and a lost executor costs its tasks only.

Fitting the classifier takes about ``SAMPLE`` texts per domain, those of hashes below a cut, of any length. Tasks count
their trigrams and weigh the temperatures; only sums come to the driver, ``BINS`` numbers a domain. Posteriors, tokens and
the fit use all of every text. The labelled table is one of its own, whose domains no scored row needs. Tokens are
words ``[^\\x20\\x09-\\x0D]+`` unless a column of counts is named.

Defined cases: labelled rows of other domains or without text teach nothing; null and empty texts have no tokens, the prior as posterior, and weigh nothing in the fit; repeated rows
count each time and share their fate; unreachable targets give the least-squares fit; an empty
table gives an empty result; columns named like those added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm import worker
from linkloom.llm.store import Tables

SAMPLE, SEGMENT, BINS, PASSES, CLOSE, DOMAINS = 1500, 256, 1 << 13, 100, 1e-4, 64
_SLICE = 1 << 17
ADDED = ("n_tokens", "posterior", "rate", "copies")
HEATS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)


def _codes(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.uint32)
    return (x[:-2] * 961 + x[1:-1] * 31 * 131 + x[2:] * 7919 >> 1) % BINS


@dataclass(frozen=True)
class Classifier:
    """Log weights of trigram bins by domain, the prior, and the temperature."""

    domains: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BINS, 1), np.float32))
    heat: float = 1.0

    def segments(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores and bytes of each segment."""
        scores, sizes = [], []
        for at in range(0, len(data), _SLICE):
            part = np.frombuffer(data[at : at + _SLICE + 2], np.uint8)
            if len(part) < 3:
                continue
            gains = self.weights[_codes(part)]
            starts = np.arange(0, len(gains), SEGMENT)
            scores.append(np.add.reduceat(gains, starts, axis=0))
            sizes.append(np.diff(np.r_[starts, len(gains)]))
        if not scores:
            return np.zeros((0, len(self.domains))), np.zeros(0)
        return np.concatenate(scores), np.concatenate(sizes)

    def posterior(self, data: bytes) -> np.ndarray:
        """Shares of the domains in a text; they sum to 1."""
        scores, sizes = self.segments(data)
        if not len(sizes):
            return self.prior
        return (_softmax(scores / self.heat + np.log(self.prior)) * sizes[:, None]).sum(0) / sizes.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_classifier(labelled: DataFrame, domains: list[str], text_col: str = "text", domain_col: str = "domain") -> Classifier:
    """Learn the named domains from labelled texts."""
    if not 0 < len(domains) <= DOMAINS:
        raise ValueError(f"1 to {DOMAINS} domains, not {len(domains)}")
    tables = Tables(labelled.sparkSession)
    usable = labelled.select(F.col(domain_col).cast("string").alias("domain"), F.col(text_col).cast("string").alias("text")).where(F.col("domain").isin(domains) & F.col("text").isNotNull())
    counts = {r.domain: r.n for r in usable.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most DOMAINS rows
    prior = np.array([counts.get(d, 0) + 1.0 for d in domains])
    prior /= prior.sum()
    # hashes below a cut leave about SAMPLE texts of a domain, however many there are, with nothing to rank or join
    cut = F.create_map(*(x for d in domains for x in (F.lit(d), F.lit(SAMPLE / max(counts.get(d, 0), 1)))))
    near = usable.withColumn("h", F.xxhash64("text")).where((F.col("h").cast("double") + 2.0**63) / 2.0**64 <= F.element_at(cut, F.col("domain"))).dropDuplicates(["domain", "h"])
    at = F.element_at(F.create_map(*(x for k, d in enumerate(domains) for x in (F.lit(d), F.lit(k)))), F.col("domain"))
    sample = tables.write(near.select(at.alias("at"), (F.xxhash64("h") % 3 == 0).alias("held"), F.col("text").cast("binary").alias("data")), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros((len(domains), BINS), np.int64)
        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(x.as_buffer(), np.uint8)
                for begin in range(0, max(len(data) - 2, 0), _SLICE):
                    bins[d] += np.bincount(_codes(data[begin : begin + _SLICE + 2]), minlength=BINS)
        d, k = np.nonzero(bins)
        yield pa.record_batch([pa.array(d * BINS + k), pa.array(bins[d, k])], ["bin", "n"])

    sums = sample.where("not held").select("at", "data").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS a domain
    bins = np.ones(len(domains) * BINS)
    bins[[r.bin for r in sums]] += [r.n for r in sums]
    bins = bins.reshape(len(domains), BINS).T
    weights = np.log(bins / bins.sum(0)).astype(np.float32)
    raw = Classifier(tuple(domains), prior, weights)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            loss = np.zeros(len(HEATS))
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                scores = raw.segments(x.as_buffer().to_pybytes())[0]
                if len(scores):
                    loss -= [np.log(_softmax(scores / heat + np.log(prior))[:, d] + 1e-12).sum() for heat in HEATS]
            yield pa.record_batch([pa.array(np.arange(len(HEATS))), pa.array(loss)], ["heat", "loss"])

    losses = sample.where("held").select("at", "data").mapInArrow(weigh, "heat long, loss double").groupBy("heat").agg(F.sum("loss").alias("loss")).collect()  # a row for each of HEATS
    tables.drop(sample)
    best = min(losses, key=lambda r: (r.loss, r.heat), default=None)
    return Classifier(tuple(domains), prior, weights, HEATS[best.heat] if best else 1.0)


def with_posteriors(docs: DataFrame, model: Classifier, text_col: str = "text", tokens_col: str | None = None, carry_text: bool = True) -> DataFrame:
    """docs with ``n_tokens`` and ``posterior`` (an array in the order of the domains)."""
    kept = [c for c in docs.columns if c not in ("n_tokens", "posterior") and (carry_text or c != text_col)]
    passed = [*kept, *({text_col, tokens_col or text_col} - set(kept))]
    schema = docs.select(*kept).schema.add("n_tokens", "long").add("posterior", T.ArrayType(T.DoubleType()))
    text_at = passed.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            texts = batch.column(text_at).cast(pa.binary())
            n, posteriors = [], []
            for x in texts:
                data = x.as_buffer().to_pybytes() if x.is_valid else b""
                n.append(len(data.split()))
                posteriors.append(model.posterior(data))
            counts = batch.column(passed.index(tokens_col)).cast(pa.int64()).fill_null(0) if tokens_col else pa.array(n, pa.int64())
            yield pa.record_batch([*batch.columns[: len(kept)], counts, pa.array(posteriors, pa.list_(pa.float64()))], [*kept, "n_tokens", "posterior"])

    return docs.select(*passed).mapInArrow(run, schema)


def _replay(posteriors: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    rates = np.ones(len(posteriors))
    for g in steps:
        rates = np.maximum(0.0, rates - posteriors @ g)
    return rates


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _sums(scored: DataFrame, width: int, steps: list[np.ndarray], square: bool) -> np.ndarray:
    """Sums over documents of tokens * rate * p, or of tokens * p p' in one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width if square else width)
        for batch in batches:
            n, p = batch.column(0).to_numpy().astype(float), _matrix(batch.column(1), width)
            total += ((p * n[:, None]).T @ p).ravel() if square else (n * _replay(p, steps)) @ p
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["at", "x"])

    parts = scored.select("n_tokens", "posterior").mapInArrow(run, "at long, x double")
    found = {r["at"]: r.x for r in parts.groupBy("at").agg(F.sum("x").alias("x")).collect()}  # one row per number of the sum
    return np.array([found.get(k, 0.0) for k in range(width * width if square else width)])


def fit_rates(scored: DataFrame, shares: np.ndarray, total: float | None = None) -> list[np.ndarray]:
    """The gradient steps whose replay gives each document's rate."""
    width = len(shares)
    m = _sums(scored, width, [], True).reshape(width, width)
    now = m.sum(1)  # posteriors sum to 1, so these are the domains' tokens at rates of 1
    if now.sum() <= 0:
        return []
    goal = shares / shares.sum() * (now.sum() if total is None else total)
    inverse, steps = np.linalg.inv(m + np.eye(width) * 1e-9 * np.trace(m)), []
    while np.abs(now - goal).max() > CLOSE * goal.sum() and len(steps) < PASSES:
        steps.append(inverse @ (now - goal))
        before, now = now, _sums(scored, width, steps, False)
        if np.abs(now - before).max() <= CLOSE * CLOSE * goal.sum():
            break
    return steps


def with_rates(scored: DataFrame, width: int, steps: list[np.ndarray], key: list[str]) -> DataFrame:
    """scored with ``rate``, and ``copies`` drawn by the hash of the key columns, of which rate is the mean."""
    schema = T.StructType([*scored.schema.fields, T.StructField("rate", T.DoubleType())])  # add() would change the frame's own
    at, names = scored.columns.index("posterior"), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(_replay(_matrix(batch.column(at), width), steps))], names)

    rated = scored.mapInArrow(run, schema)
    dice = F.call_function("shiftrightunsigned", F.xxhash64(*key), F.lit(11)) / float(1 << 53)
    return rated.withColumn("copies", F.floor(F.col("rate") + dice).cast("int"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text_col: str = "text", domain_col: str = "domain", id_col: str = "doc_id", tokens_col: str | None = None, total: float | None = None, carry_text: bool = True) -> DataFrame:
    """docs with n_tokens, posterior, rate and copies."""
    tables = Tables(docs.sparkSession)
    docs = docs.drop("rate", "copies")
    model = fit_classifier(labelled, list(targets), text_col, domain_col)
    scored = tables.write(with_posteriors(docs, model, text_col, tokens_col, carry_text), "scored")
    steps = fit_rates(scored, np.array(list(targets.values()), float), total)
    return with_rates(scored, len(targets), steps, [id_col])
