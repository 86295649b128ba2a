"""Document quality by ordinal cumulative-link regression on graded ratings.

The chance that a document is rated at most ``k`` is the logistic function of a threshold
``t_k`` less one weighted sum of its features: all grades share the weights, and the
thresholds rise. Features are the hashed words a text has, and its hashed byte trigrams by the
logarithm of their counts, scaled to length one; slots that few sample documents fill have no
weight. The model is fitted on at most
``SAMPLE`` rated documents of each grade (those with the smallest hashes of their ids), each
weighted so that the grades keep their shares, by full-batch gradient steps on the driver.

A document gets its expected grade and the chance of each upper range of grades; the chance
of the highest grade serves for selection.

Defined results: a null or empty text has no features and gets the chances of a text without
evidence; documents with several ratings count as their lowest; null ratings do not count;
with fewer than two grades to learn from, every result is null; repeated rows are scored each
by itself; an input column that has the name of the result column is replaced by it. No text
is shortened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text_np import ALNUM_LOWER, Texts, owners, pieces, with_struct

RESULT = "rating"
WORD_BITS, GRAM_BITS = 20, 13
GRAMS = 1 << GRAM_BITS
#: words take the first slots, trigrams the rest
SIZE = (1 << WORD_BITS) + GRAMS
WORD_VALUE = 0.2
#: slots of fewer sample documents than this have no weight
SUPPORT = 50
SAMPLE = 2500
STEPS = 150
PENALTY = 1e-5
_RATE = 0.5
_ROWS = 128


def words(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text and slot of each distinct word."""
    starts, ends, first = t.spans(ALNUM_LOWER)
    slot = (t.hashes(starts, ends, ALNUM_LOWER) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    both = np.unique((owners(first) << WORD_BITS) | slot)
    return both >> WORD_BITS, both & ((1 << WORD_BITS) - 1)


def grams(t: Texts) -> np.ndarray:
    """Byte trigrams, one row for each text."""
    x = np.zeros((t.n, GRAMS), np.float32)
    if len(t.data) > 2:
        v = t.data.astype(np.uint32)
        code = (v[:-2] << np.uint32(16)) | (v[1:-1] << np.uint32(8)) | v[2:]
        own = np.repeat(np.arange(t.n), np.diff(t.bounds))
        inside = own[:-2] == own[2:]
        slot = (code[inside] * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)
        x += np.bincount(own[:-2][inside] * GRAMS + slot, minlength=t.n * GRAMS).reshape(t.n, GRAMS)
    np.log1p(x, out=x)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=x, where=norm > 0)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # rising, one less than there are grades
    grades: np.ndarray  # rising

    def chances(self, t: Texts) -> np.ndarray:
        """The chance of each grade, one row for each text."""
        own, slot = words(t)
        total = np.bincount(own, WORD_VALUE * self.weights[slot], t.n) + grams(t) @ self.weights[-GRAMS:]
        at_most = _logistic(self.thresholds[None, :] - total[:, None])
        edge = np.ones((t.n, 1))
        return np.diff(np.hstack([0 * edge, at_most, edge]), axis=1)


def _sample(docs: DataFrame, grades: DataFrame, key: str, text: str) -> list:
    """(key, grade, weight, slots, values) of at most ``SAMPLE`` documents of each grade."""
    order = Window.partitionBy("_grade").orderBy(F.xxhash64("_key"), "_key")
    rated = grades.select(F.col("_key"), "_grade")
    sizes = rated.groupBy("_grade").agg(F.count("_key").alias("_n"))
    chosen = (
        rated.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= SAMPLE)
        .join(sizes, "_grade")
        .select("_key", "_grade", (F.col("_n") / F.least("_n", F.lit(SAMPLE))).alias("_weight"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in pieces(batches, "_text", rows=_ROWS):
            own, slot = words(t)
            first = np.searchsorted(own, np.arange(t.n + 1))
            x = grams(t)
            rows = [np.flatnonzero(r) for r in x]
            slots = [np.append(slot[first[i] : first[i + 1]], r + (1 << WORD_BITS)).astype(np.int32) for i, r in enumerate(rows)]
            values = [
                np.append(np.full(first[i + 1] - first[i], WORD_VALUE), x[i, r]).astype(np.float32) for i, r in enumerate(rows)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.string()), batch.column(1).cast(pa.float64()), batch.column(2),
                    pa.array([r.tobytes() for r in slots], pa.binary()),
                    pa.array([r.tobytes() for r in values], pa.binary()),
                ],
                ["key", "grade", "weight", "slots", "values"],
            )

    # at most SAMPLE ids of each grade are broadcast
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")
    picked = texts.select("_key", "_grade", F.col("_weight"), "_text")
    return picked.mapInArrow(run, "key STRING, grade DOUBLE, weight DOUBLE, slots BINARY, values BINARY").collect()


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, key: str = "doc_id", text: str = "text") -> Model | None:
    """``grade``: a whole number, from columns of ``ratings``."""
    rated = (
        ratings.select(F.col(key).alias("_key"), grade.cast("int").alias("_g"))
        .where(F.col("_g").isNotNull() & F.col("_key").isNotNull())
        .groupBy("_key").agg(F.min("_g").alias("_grade"))
    )
    rows = sorted(_sample(docs, rated, key, text), key=lambda r: (r.key, r.slots, r.values))
    grades = np.unique([r.grade for r in rows])
    if len(grades) < 2:
        return None
    slots = [np.frombuffer(r.slots, np.int32) for r in rows]
    counts = np.array([len(s) for s in slots])
    slot = np.concatenate(slots)
    value = np.concatenate([np.frombuffer(r.values, np.float32) for r in rows]).astype(float)
    own = np.repeat(np.arange(len(rows)), counts)
    y = np.searchsorted(grades, [r.grade for r in rows])
    weight = np.array([r.weight for r in rows])
    held = np.flatnonzero(np.bincount(slot, minlength=SIZE) >= SUPPORT)
    place = np.full(SIZE, -1)
    place[held] = np.arange(len(held))
    ok = place[slot] >= 0
    w, thresholds = _descend(place[slot[ok]], value[ok], own[ok], y, weight / weight.sum(), len(held), len(grades) - 1)
    weights = np.zeros(SIZE, np.float32)
    weights[held] = w
    return Model(weights, thresholds, grades)


def _descend(
    slot: np.ndarray, value: np.ndarray, own: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights of ``size`` slots and ``k`` thresholds that minimise the weighted loss, by moment-scaled gradient
    steps (Adam). Thresholds are the first one and the logarithms of the steps above it, so that they stay in order."""
    share = np.clip(np.array([weight[y <= i].sum() for i in range(k)]), 1e-6, 1 - 1e-6)
    start = np.log(share / (1 - share))
    state = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    first, second = np.zeros_like(state), np.zeros_like(state)
    rows = np.arange(len(y))
    for step in range(1, STEPS + 1):
        w, steps = state[: size], np.exp(state[size + 1 :])
        thresholds = state[size] + np.concatenate([[0.0], np.cumsum(steps)])
        z = thresholds[None, :] - np.bincount(own, value * w[slot], len(y))[:, None]
        at_most = np.hstack([np.zeros((len(y), 1)), _logistic(z), np.ones((len(y), 1))])
        slope = at_most * (1 - at_most)
        chance = np.maximum(at_most[rows, y + 1] - at_most[rows, y], 1e-12)
        # derivatives of the loss by the upper and the lower threshold of each row's grade
        upper, lower = -weight * slope[rows, y + 1] / chance, weight * slope[rows, y] / chance
        by_threshold = np.bincount(y + 1, upper, k + 2)[1:-1] + np.bincount(y, lower, k + 2)[1:-1]
        by_w = np.bincount(slot, value * -(upper + lower)[own], size) + 2 * PENALTY * w
        tail = np.cumsum(by_threshold[::-1])[::-1]
        gradient = np.concatenate([by_w, tail[:1], tail[1:] * steps])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        rate = _RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        state = state - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    thresholds = state[size] + np.concatenate([[0.0], np.cumsum(np.exp(state[size + 1 :]))])
    return state[:size], thresholds


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct ``rating``: ``expected`` grade, ``tails`` (the
    chance of each grade above the lowest or a higher one) and ``top`` (of the highest)."""
    docs = docs.drop(RESULT)
    schema = with_struct(docs, RESULT, "expected: DOUBLE, top: DOUBLE, tails: ARRAY<DOUBLE>")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in pieces(batches, text, rows=_ROWS):
            m = sent.value
            if m is None:
                columns = [pa.nulls(t.n, pa.float64()), pa.nulls(t.n, pa.float64()), pa.nulls(t.n, pa.list_(pa.float64()))]
            else:
                chance = m.chances(t)
                tails = np.cumsum(chance[:, ::-1], axis=1)[:, ::-1][:, 1:]
                columns = [
                    pa.array(chance @ m.grades), pa.array(chance[:, -1]), pa.array(list(tails), pa.list_(pa.float64())),
                ]
            struct = pa.StructArray.from_arrays(columns, ["expected", "top", "tails"])
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, RESULT])

    return docs.mapInArrow(run, schema)
