"""Quality classifier: random Fourier features approximate a Gaussian kernel over document
statistics; normal equations, summed over partitions, fit ridge scores; isotonic regression over
a second part of the training labels makes them probabilities.

The statistics are ratios of counts over the whole text (no label, language, source or id). All
labelled rows outside the held-out fold take part. What reaches the driver is bounded: sums over
the features (FEATURES squared) and a histogram of BINS scores.

Null or empty texts have statistics of zero and a score like any other. Labels that are null are
left out; if an id is labelled twice the larger label counts. Without labels every score is 0.5.
Rows that repeat an id are scored each, and train each under the id's label; a null id is not held
out. An empty table gives no rows. Only id and text are read, so that other columns and their names
do not matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import crc_fold, map_batches, materialize, text_or_empty
from corpusmill.llm.textstats import Stats, stats

FEATURES = 128
GAMMA = 0.15
RIDGE = 1e-3
BINS = 1000
SEED = 20240229
PARTIALS = 32
FOLDS, HELD = 3, 1


def statistics(s: Stats) -> list[float]:
    n, chars = max(s.n_words, 1), max(s.word_chars, 1)
    return [
        np.log1p(s.n_words),
        s.word_chars / n,
        np.log1p(100 * s.n_symbols / n),
        np.log1p(100 * s.n_pipes / n),
        np.log1p(100 * s.n_bangs / n),
        s.n_upper / max(s.n_letters, 1),
        s.n_letters / chars,
        s.n_digits / chars,
        s.n_repeat_words / n,
        s.n_same_neighbours / n,
        s.n_distinct_words / n**0.8,
        s.n_dup_lines / max(s.n_lines, 1),
        s.n_stops / n,
        s.n_commas / n,
        np.log1p(s.longest_word),
    ]


WIDTH = len(statistics(stats("")))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(stats(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


class Fourier:
    """cos(w x + b) over standardised statistics; the frequencies are drawn once, from SEED."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, np.sqrt(2 * GAMMA), (len(mean), FEATURES - 1))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def _rows(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=float).reshape(len(column), WIDTH)


def isotonic(pos: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over the bins; empty bins take their left neighbour's value."""
    blocks: list[list[float]] = []
    for p, n in zip(pos, all_):
        blocks.append([p, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, n2, k = blocks.pop()
            blocks[-1][0] += p2
            blocks[-1][1] += n2
            blocks[-1][2] += k
    out = np.concatenate([np.full(int(k), (p + 0.5 * (n == 0)) / max(n, 1)) for p, n, k in blocks])
    return np.clip(out, 0.0, 1.0)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    measured = materialize(map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), _measure, "doc_id long, x array<double>"), "classifier-x")
    fold = crc_fold(id_col, FOLDS)
    marks = labels.filter(F.col(label_col).isNotNull() & (fold != HELD)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("double").alias("y"))
    train = measured.join(marks, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(5)))
    train = materialize(train.select("x", "y", "part"), "classifier-train")
    fit, held = train.filter("part > 0"), train.filter("part = 0")
    moments = [f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(WIDTH) for f in (F.avg, F.stddev_pop)]
    m = fit.agg(F.count(F.lit(1)).alias("n"), *moments).first()
    if not m["n"]:
        return measured.select("doc_id", F.coalesce(crc_fold("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out"), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    lift = Fourier(np.array([m[f"avg{i}"] for i in range(WIDTH)]), np.array([m[f"stddev_pop{i}"] or 1.0 for i in range(WIDTH)]))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES, FEATURES + 1))
        for batch in batches:
            z, y = lift(_rows(batch.column(0))), batch.column(1).to_numpy()
            total[:, :FEATURES] += z.T @ z
            total[:, FEATURES] += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES * (FEATURES + 1))
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    # a tree of sums: partitions, PARTIALS of them, the driver
    sums = map_batches(map_batches(fit.select("x", "y"), normal, "sums binary").repartition(PARTIALS), add, "sums binary").collect()
    total = sum(np.frombuffer(r["sums"]) for r in sums).reshape(FEATURES, FEATURES + 1)
    theta = np.linalg.solve(total[:, :FEATURES] + RIDGE * m["n"] / FEATURES * np.eye(FEATURES), total[:, FEATURES])

    def bins(x: np.ndarray) -> np.ndarray:
        return np.clip((lift(x) @ theta + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bins(_rows(batch.column(0)))), batch.column(1)], names=["bin", "y"])

    pos, all_ = np.zeros(BINS), np.zeros(BINS)
    for r in map_batches(held.select("x", "y"), place, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).collect():
        pos[r["bin"]], all_[r["bin"]] = r["p"], r["n"]
    if not all_.any():
        pos, all_ = np.arange(BINS) / BINS, np.ones(BINS)
    curve = isotonic(pos, all_)
    # the slope of the raw score keeps order within a level of the curve
    curve = np.clip(0.995 * curve + 0.005 * np.arange(BINS) / BINS, 0, 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = curve[bins(_rows(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = map_batches(measured, score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", "predicted")
