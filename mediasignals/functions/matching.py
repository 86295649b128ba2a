"""Finding dictionary terms inside text.

A dictionary known in code becomes part of the expression: no join, no shuffle. A
dictionary that is a table is matched by an equi-join on character n-grams, which is exact
and never pairs every text with every term.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .text import _col

GRAM = 3
POINT_BITS = 21
#: bits of the table of dictionary grams, as a power of two (512 KB)
TABLE_BITS = 22
#: bytes of text whose grams are held at a time; a longer text stands alone
GRAM_BYTES = 1 << 18


def minimal_terms(terms: Iterable[str]) -> list[str]:
    """Drop terms that contain another one: wherever they occur, the shorter one does too."""
    kept: list[str] = []
    for term in sorted(set(terms), key=len):
        if not any(short in term for short in kept):
            kept.append(term)
    return kept


def word_pattern(terms: Iterable[str]) -> str:
    alternatives = "|".join(re.escape(t) for t in sorted(set(terms), key=len, reverse=True))
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{alternatives})(?![\p{{L}}\p{{N}}_])"


def contains_any(c: str | Column, terms: Iterable[str], match: str = "substring") -> Column:
    """True where any term occurs in the (already folded) text.

    'substring' also hits inside words; 'word' needs word boundaries.
    """
    terms = list(terms)
    if not terms:
        return F.lit(False)
    if match == "word":
        return F.coalesce(_col(c).rlike(word_pattern(terms)), F.lit(False))
    hits = [F.contains(_col(c), F.lit(t)) for t in minimal_terms(terms)]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def any_item_in(items: str | Column, values: Iterable[str]) -> Column:
    """True where an item of the array equals one of the values."""
    wanted = F.array(*[F.lit(v) for v in values])
    return F.coalesce(F.arrays_overlap(_col(items), wanted), F.lit(False))


def _mixed(grams: np.ndarray) -> np.ndarray:
    """The places of packed grams in the bit table."""
    x = grams.astype(np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _packed(texts: list[str], sizes: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, gram): up to three code points of a text in one long. All grams of the sizes;
    without sizes each text's longest ones."""
    length = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), length)
    place = np.arange(len(points)) - np.repeat(np.cumsum(length) - length, length)
    left = np.repeat(length, length) - place
    own = np.repeat(np.minimum(length, GRAM), length)
    rows, places, grams = [], [], []
    for size in sizes or range(1, GRAM + 1):
        at = np.flatnonzero((left >= size) if sizes else (left >= size) & (own == size))
        gram = points[at] << (2 * POINT_BITS)
        for i in range(1, size):
            gram |= points[at + i] << ((2 - i) * POINT_BITS)
        rows.append(row[at]), places.append(place[at]), grams.append(gram)
    return np.concatenate(rows), np.concatenate(places), np.concatenate(grams)


def _listed(batch: pa.RecordBatch, kept: list[str], row, place, gram) -> pa.RecordBatch:
    """One row for each text and gram with the gram's places in it."""
    order = np.lexsort((place, gram, row))
    row, place, gram = row[order], place[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    first = np.flatnonzero(new)
    offsets = pa.array(np.append(first, len(row)), pa.int32())
    columns = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row[first])) for c in kept]
    places = pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32()))
    return pa.RecordBatch.from_arrays([*columns, pa.array(gram[first]), places], [*kept, "gram", "at"])


def _bounded(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of ``GRAM_BYTES`` of text at most, or of one row."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + GRAM_BYTES, "right")))
        yield batch.slice(low, high - low)
        low = high


def _gram_rows(
    frame: DataFrame, column: str, kept: list[str], sizes: list[int] | None = None, table: np.ndarray | None = None
) -> DataFrame:
    """The ``kept`` columns with ``gram`` and its places ``at``: one row for each text and gram of
    it; if there is a bit table, only of grams whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _bounded(whole, column):
                plain = [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
                row, place, gram = _packed(plain, sizes)
                if table is not None:
                    slot = _mixed(gram)
                    held = (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                    row, place, gram = row[held], place[held], gram[held]
                yield _listed(batch, kept, row, place, gram)

    added = T.StructType.fromDDL("gram LONG, at ARRAY<INT>")
    return frame.mapInArrow(run, T.StructType([*[frame.schema[c] for c in kept], *added.fields]))


def _bit_table(grams: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bits of all grams, in a table of a fixed size, and the gram sizes that occur."""
    words = 1 << (TABLE_BITS - 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(0).to_numpy(zero_copy_only=False)
            slot = np.unique(_mixed(gram))
            low = (1 << POINT_BITS) - 1
            sizes = np.where(gram & low, 4, np.where((gram >> POINT_BITS) & low, 2, 1))
            cells = np.append(slot >> 6, words)
            bits = np.append(np.left_shift(np.uint64(1), (slot & 63).astype(np.uint64)), np.uint64(np.bitwise_or.reduce(sizes, initial=0)))
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(bits.view(np.int64))], ["cell", "bits"])

    rows = grams.select("gram").mapInArrow(run, "cell LONG, bits LONG").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    table = np.zeros(words + 1, np.int64)
    for row in rows.collect():  # as many as the table has cells, at most
        table[row.cell] = row.bits
    sizes = [n for n in range(1, GRAM + 1) if table[words] >> (n - 1) & 1]
    return table[:words].view(np.uint8), sizes or [GRAM]


def gram_pairs(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """All (text_id, term_id) where the term occurs in the text; blank terms occur nowhere.

    ``texts``: (text_id, text), ``terms``: (term_id, term). Texts are read once into a positional
    index of their character grams, three code points packed in a long (shorter ones only where
    a term is that short), of which those outside the dictionary are left out by a bit table of a
    fixed size. From the index come the number of texts that hold a gram and then the candidates:
    every term is anchored at the one of its grams that the fewest texts hold (with a gram that
    none holds it is out), and compared with the text at the places of that gram alone. Texts and
    grams meet by id and gram, so neither side is ever copied to every task. Texts, term grams and
    anchors are written, so that no later plan repeats what made them.
    """
    texts = written(texts.select("text_id", "text"), "gram_texts")
    parts = written(_gram_rows(terms.select("term_id", "term"), "term", ["term_id", "term"]), "term_grams")
    table, sizes = _bit_table(parts)
    index = written(_gram_rows(texts, "text", ["text_id"], sizes, table), "gram_index")
    counts = index.groupBy("gram").agg(F.count("text_id").alias("n"))
    anchors = written(
        parts.join(counts, "gram", "left")
        .groupBy("term_id", "term")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", F.get("at", F.lit(0)).alias("inside"))).alias("least"))
        .filter("least.n > 0")
        .select("term_id", "term", "least.gram", "least.inside"),
        "anchors",
    )
    candidates = index.join(anchors, "gram").select("text_id", "at", "term_id", "term", "inside")

    def hit(place: Column) -> Column:
        start = place - F.col("inside")
        return (start >= 0) & (F.substr(F.col("text"), start + 1, F.length("term")) == F.col("term"))

    return candidates.join(texts, "text_id").filter(F.exists("at", hit)).select("text_id", "term_id")


def matching_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_id, term_id) pairs of a dictionary table, whatever its size."""
    return gram_pairs(texts, terms)


def word_list(c: str | Column) -> Column:
    """Runs of word characters, in text order."""
    return F.filter(F.split(_col(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def word_grams(words: str | Column, max_words: int) -> Column:
    """n-grams of a word list with the position of their first word.

    array<struct<gram, pos>>, n from 1 to ``max_words``. Each size extends the one before by
    the shifted list, in linear time. ``words`` is used many times: pass a computed column.
    """
    words = _col(words)
    total = F.size(words)
    grams, parts = words, []
    for n in range(1, max_words + 1):
        if n > 1:
            left = F.greatest(total - n + 1, F.lit(0))
            grams = F.zip_with(
                F.slice(grams, 1, left), F.slice(words, n, left), lambda a, b: F.concat_ws(" ", a, b)
            )
        parts.append(
            F.transform(grams, lambda g, i: F.struct(g.alias("gram"), (i + 1).alias("pos")))
        )
    return F.concat(*parts)
