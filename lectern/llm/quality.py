"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics are taken from the bytes of the whole text, never from labels, language, source or id.
cos(Wx + b) with a fixed random W approximates a Gaussian kernel over the standardised statistics; each
partition sums its part of the normal equations, the parts are added in two steps, and
the driver solves one system of FEATURES + 1 unknowns. Scores of labelled rows that the fit didn't see
then give, by pooling adjacent violators over score bins, the probability of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from lectern.llm import hashing as H
from lectern.storage import Scratch, free_name

#: Labelled rows to fit on, at most about so many, chosen by a hash of doc_id.
TRAIN_ROWS = 200_000
FEATURES = 256
RIDGE = 1e-3
#: Parts that sum normal equations; each returns (FEATURES + 2) ** 2 numbers.
PARTS = 12
#: Bins to a unit of score, for calibration.
BINS = 500
MARKS = "!?.,;:|*#$%&@/\\<>{}[]()_=+-\"'"

_CLASS = np.zeros((256, 8 + len(MARKS)), np.uint8)  # kinds of bytes, one column each
_CLASS[65:91, 0] = 1  # A-Z
_CLASS[97:123, 1] = 1  # a-z
_CLASS[48:58, 2] = 1  # digits
_CLASS[128:192, 3] = 1  # continuation bytes
_CLASS[192:, 4] = 1  # first bytes of longer characters
_CLASS[[9, 10, 11, 12, 13, 32], 5] = 1
_CLASS[10, 6] = 1
_CLASS[:9, 7] = _CLASS[14:32, 7] = 1
for _k, _c in enumerate(MARKS):
    _CLASS[ord(_c), 8 + _k] = 1
N_STATS = _CLASS.shape[1] + 12


def statistics(column: pa.Array) -> np.ndarray:
    """N_STATS numbers for each text; all zero for one without words."""
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    return np.vstack([np.zeros((0, N_STATS)), *(_statistics(part.column(0)) for part in H.parts(batch, 0))])


def _statistics(column: pa.Array) -> np.ndarray:
    data, offsets = H.text_buffers(column)
    starts, ends, per = H.word_spans(data, offsets)
    words = H.word_hashes(data, starts, ends)
    size = ends - starts
    out = np.zeros((len(offsets) - 1, N_STATS))
    k = _CLASS.shape[1]
    for i in range(len(out)):
        a, b = per[i], per[i + 1]
        if a == b:
            continue
        lo, hi = offsets[i], offsets[i + 1]
        n, w, s = hi - lo, words[a:b], size[a:b]
        m = len(w)
        out[i, :k] = np.sqrt(np.bincount(data[lo:hi], minlength=256) @ _CLASS / n)
        _, uses = np.unique(w, return_counts=True)
        runs = H.shingles(w, 3)
        share = uses / m
        out[i, k:] = (
            np.log(n),
            np.log(m),
            s.mean() / 8,
            s.std() / 8,
            min(s.max(), 200) / 50,
            (s <= 2).mean(),
            (s >= 12).mean(),
            len(uses) / m,
            share.max(),
            -(share * np.log(share)).sum() / max(1.0, np.log(m)),
            (w[1:] == w[:-1]).mean() if m > 1 else 0.0,
            1 - len(H.distinct(runs)) / len(runs),
        )
    return out


@dataclass
class QualityModel:
    """Everything that scoring needs; its size doesn't depend on the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    at: np.ndarray
    to: np.ndarray

    def lifted(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lifted(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.at, self.to), 0.0, 1.0)


def _summed(rows: DataFrame, part, width: int) -> np.ndarray:
    """The sum over all partitions of the vectors that `part` makes of record batches."""

    def local(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    parts = rows.repartition(PARTS).mapInArrow(local, "v binary").collect()
    return np.sum([np.frombuffer(r.v) for r in parts], axis=0)


def _stats_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array(batch.column(name).values.to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, N_STATS) if batch.num_rows else np.zeros((0, N_STATS))


def pooled(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the means y with weights n: (positions, values) to interpolate between."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n):
        blocks.append([xi * ni, yi * ni, ni])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def with_statistics(docs: DataFrame, name: str = "stats", columns: list[str] = ["doc_id"]) -> DataFrame:
    """columns of docs, and `name`: the statistics of text."""
    rows = docs.select(*columns, F.col("text").cast("string").alias(free_name(docs, "_text")))

    def made(batches):
        for batch in batches:
            last = batch.num_columns - 1
            stats = H.lists(statistics(batch.column(last)).ravel().astype(np.float32), np.full(batch.num_rows, N_STATS), pa.float32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(last)), stats], [*batch.schema.names[:last], name])

    return rows.mapInArrow(made, ST.StructType([rows.schema[c] for c in columns]).add(name, ST.ArrayType(ST.FloatType())))


def fit(stats: DataFrame, labels: DataFrame, *, seed: int = 11) -> QualityModel:
    """Fits on stats(doc_id, stats) joined with labels(doc_id, quality); null labels and ids take no part."""
    labels = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    rows = labels.count()
    if rows > TRAIN_ROWS:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * TRAIN_ROWS / rows))
    scratch = Scratch(stats.sparkSession, "quality")
    train = scratch.save(stats.join(labels, "doc_id").select("stats", "y", (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)) == 0).alias("late")), "train")
    early, late = train.where("not late"), train.where("late")

    def moments(batch):
        x = _stats_of(batch, "stats")
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    total = _summed(early, moments, 1 + 2 * N_STATS)
    n = max(total[0], 1.0)
    mean = total[1 : 1 + N_STATS] / n
    scale = np.sqrt(np.maximum(total[1 + N_STATS :] / n - mean**2, 0.0))
    scale[scale < 1e-6] = 1.0
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, scale, rng.normal(size=(N_STATS, FEATURES)) / np.sqrt(2.0 * N_STATS), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    if total[0] == 0:
        return model
    d = FEATURES + 1

    def normal(batch):
        z = model.lifted(_stats_of(batch, "stats"))
        y = batch.column("y").to_numpy(zero_copy_only=False)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _summed(early, normal, d * d + d)
    penalty = np.eye(d) * RIDGE * n / FEATURES
    penalty[-1, -1] = 1e-9 * n
    model.beta = np.linalg.solve(sums[: d * d].reshape(d, d) + penalty, sums[d * d :])

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(np.clip(model.raw(_stats_of(batch, "stats")), -1, 2) * BINS).astype(np.int64)), batch.column("y")], ["bin", "y"])

    bins = (late if not late.isEmpty() else early).mapInArrow(scored, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    # one success and one failure spread over the bins keep scores off 0 and 1
    x, y, w = (np.array([r[k] for r in bins], float) for k in ("bin", "y", "n"))
    model.at, model.to = pooled(x / BINS, (y * w + 1 / len(w)) / (w + 2 / len(w)), w)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text, ...).

    Labels are learnt from rows whose crc32(doc_id as text) mod 5 is not 0. Null and empty texts
    have all statistics zero and are scored as such. A null doc_id is never learnt from and not held
    out. Repeated rows are scored alike. With no usable label every score is 0.5.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.save(with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "stats")
    model = fit(stats, _to_learn(labels))

    def scored(batches):
        for batch in batches:
            s = model.score(_stats_of(batch, "stats"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.3).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.mapInArrow(scored, "doc_id long, score double, predicted int").select("doc_id", _held_out().alias("held_out"), "score", "predicted")


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _to_learn(labels: DataFrame) -> DataFrame:
    return labels.where(~_held_out())


def accepted(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold.

    Null and empty texts are scored like those of quality_scores(); repeated rows stay or go together; a null doc_id
    is never learnt from; with no usable label every row stays. Columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    name = free_name(docs, "_stats")
    whole = scratch.save(with_statistics(docs, name, docs.columns), "whole")  # statistics are made once
    model = fit(whole.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("stats")), _to_learn(labels))

    def kept(batches):
        for batch in batches:
            last = batch.num_columns - 1
            found = pa.RecordBatch.from_arrays([batch.column(last)], ["stats"])
            yield batch.select(list(range(last))).filter(pa.array(model.score(_stats_of(found, "stats")) >= threshold))

    return whole.mapInArrow(kept, docs.schema)
