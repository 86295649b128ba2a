"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte 1-, 2- and 3-grams (letters lower-cased, everything that
is neither a letter nor a digit beyond ASCII counts as a space), weighted by the logarithm of
the count and by inverse document frequency, and scaled to length one. Document frequencies
come from all training documents. For each language, a sample of at most ``SAMPLE`` training
documents (those with the smallest hashes of their ids) is clustered into ``CENTROIDS``
centroids by spherical k-means. A text gets the language of the centroid with the largest
cosine; where that cosine is below what nearly all sample documents of the language reach,
the prediction is marked as rejected (``accepted`` is false).

Defined results: a null text, or one without any letter, is ``und`` with score 0, not
accepted; so is every text if there is nothing to learn from; ties go to the language that
sorts first; repeated rows are predicted each by itself; an input column that has the name
of the result column is replaced by it. No text is shortened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text_np import Texts, pieces, with_struct

RESULT = "language"
BITS = 13
SIZE = 1 << BITS
SAMPLE = 256
CENTROIDS = 4
ROUNDS = 12
#: share of the sample of a language that may lie beyond the rejection distance
BEYOND = 0.01
_ROWS = 128

_BYTES = np.full(256, 32, np.uint32)
_BYTES[65:91] = np.arange(97, 123)
_BYTES[97:123] = np.arange(97, 123)
_BYTES[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _counts(t: Texts) -> np.ndarray:
    """Gram counts, one row of ``SIZE`` for each text."""
    v = _BYTES[t.data]
    own = np.repeat(np.arange(t.n), np.diff(t.bounds))
    total = np.zeros(t.n * SIZE, np.float32)
    code = np.zeros(len(v), np.uint32)
    for order in (1, 2, 3):
        n = len(v) - order + 1
        if n <= 0:
            break
        code = (code[:n] << np.uint32(8)) | v[order - 1 :]
        ok = own[:n] == own[order - 1 :]
        ok &= v[:n] != 32 if order == 1 else (v[:n] != 32) | (v[1 : n + 1] != 32)
        slot = ((code[ok] + np.uint32(order << 24)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        total += np.bincount(own[:n][ok] * SIZE + slot, minlength=len(total))
    return total.reshape(t.n, SIZE)


def _vectors(t: Texts, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(_counts(t)) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=x, where=norm > 0)


def _has_letter(t: Texts) -> np.ndarray:
    found = t.count_bytes(_ASCII_LETTER[t.data]) > 0
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in t.string(t.bounds[i], t.bounds[i + 1]))
    return found


@dataclass
class Model:
    names: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    language: np.ndarray  # of each centroid, as index of names
    least: np.ndarray  # cosine that a language asks for

    def predict(self, t: Texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        cosine = np.clip(_vectors(t, self.idf) @ self.centroids.T, 0.0, 1.0).astype(float)
        best = cosine.argmax(axis=1)
        score = cosine[np.arange(t.n), best]
        language = self.language[best]
        lettered = _has_letter(t)
        score[~lettered] = 0.0
        names = [self.names[k] if ok else "und" for k, ok in zip(language, lettered, strict=True)]
        return names, score, lettered & (score >= self.least[language])


def _clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from the row nearest to the mean and rows far from it."""
    start = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[start[0]]
    while len(start) < min(k, len(x)):
        start.append(int(near.argmin()))
        near = np.maximum(near, x @ x[start[-1]])
    centres = x[start].copy()
    for _ in range(ROUNDS):
        of = (x @ centres.T).argmax(axis=1)
        for j in range(len(centres)):
            if (of == j).any():
                c = x[of == j].sum(axis=0)
                centres[j] = c / max(float(np.linalg.norm(c)), 1e-12)
    return centres


def _frequencies(train: DataFrame, text: str) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(SIZE, np.int64), 0
        for _, t in pieces(batches, text, rows=_ROWS):
            seen += (_counts(t) > 0).sum(axis=0)
            n += t.n
        yield pa.RecordBatch.from_pydict({"slot": np.arange(-1, SIZE), "n": np.append(n, seen)})

    rows = (
        train.select(text).mapInArrow(run, "slot BIGINT, n BIGINT").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    )  # one row for each slot
    n = {r.slot: r.n for r in rows}
    return np.array([n.get(i, 0) for i in range(SIZE)], float), n.get(-1, 0)


def _sample(train: DataFrame, key: str, text: str, lang: str, idf: np.ndarray) -> list:
    """Vectors of at most ``SAMPLE`` documents for each language."""
    order = Window.partitionBy(lang).orderBy(F.xxhash64(F.col(key)), F.col(key))
    chosen = (
        train.select(key, lang).distinct()
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= SAMPLE)
        .select(key)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in pieces(batches, text, rows=_ROWS):
            x = _vectors(t, idf)
            yield pa.RecordBatch.from_pydict({
                "key": batch.column(0).cast(pa.string()),
                "lang": batch.column(2).cast(pa.string()),
                "vector": pa.array([row.tobytes() for row in x], pa.binary()),
            })

    # at most SAMPLE ids for each language are broadcast
    rows = train.join(F.broadcast(chosen), key, "left_semi").select(key, text, lang)
    return rows.mapInArrow(run, "key STRING, lang STRING, vector BINARY").collect()


def fit(train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Learn from the rows that have a text and a language; None if there are none."""
    train = train.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(key, text, lang)
    seen, n = _frequencies(train, text)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(1)
    rows = sorted(_sample(train, key, text, lang, idf), key=lambda r: (r.lang, r.key, r.vector))
    names = sorted({r.lang for r in rows})
    centroids, language, least = [], [], []
    for i, name in enumerate(names):
        x = np.stack([np.frombuffer(r.vector, np.float32) for r in rows if r.lang == name])
        c = _clustered(x, CENTROIDS)
        centroids.append(c)
        language += [i] * len(c)
        least.append(float(np.quantile((x @ c.T).max(axis=1), BEYOND)))
    return Model(names, idf, np.concatenate(centroids), np.array(language), np.array(least))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct ``language`` (``lang``, ``score``, ``accepted``)."""
    docs = docs.drop(RESULT)
    schema = with_struct(docs, RESULT, "lang: STRING, score: DOUBLE, accepted: BOOLEAN")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in pieces(batches, text, rows=_ROWS):
            if sent.value is None:
                found = ["und"] * t.n, np.zeros(t.n), np.zeros(t.n, bool)
            else:
                found = sent.value.predict(t)
            struct = pa.StructArray.from_arrays(
                [pa.array(found[0], pa.string()), pa.array(found[1]), pa.array(found[2])], ["lang", "score", "accepted"]
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, RESULT])

    return docs.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 4 == 2
