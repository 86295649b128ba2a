"""Vectorised work on the UTF-8 bytes of a column of texts, for use inside Arrow tasks.

Texts are taken from the Arrow buffers as they are and cut, text by text, into pieces of a
bounded number of bytes, so that the working arrays of a task stay small. Words, lines and
windows are spans of bytes with 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

PIECE_BYTES = 1 << 19
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def byte_table(keep: Callable[[int], bool], lower: bool) -> np.ndarray:
    """The byte each byte stands for: 0 outside words, A-Z lower-cased where asked."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        if keep(b):
            table[b] = b + 32 if lower and 65 <= b <= 90 else b
    return table


# words [^\x20\x09-\x0D]+, as they are and with A-Z lower-cased
SPACED = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D, lower=False)
SPACED_LOWER = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D, lower=True)
# words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of texts whose A-Z were lower-cased
ALNUM_LOWER = byte_table(
    lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128, lower=True
)


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down


_powers = Powers()


class Texts:
    """A piece: bytes of some texts and the bounds of each of them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        self.n = len(bounds) - 1
        self._sums: dict[int, np.ndarray] = {}

    def spans(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the index of each text's first word (one more
        at the end)."""
        inside = table[self.data] != 0
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = self.bounds[(self.bounds > 0) & (self.bounds < len(self.data))]
        starts[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return s, e, np.searchsorted(s, self.bounds)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """A hash of the bytes of each span, mapped by the table."""
        up, down = _powers.to(len(self.data) + 1)
        key = id(table)
        if key not in self._sums:
            values = BYTE_VALUE[self.data if table is None else table[self.data]]
            values *= up[: len(values)]
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values, out=sums[1:])
            self._sums[key] = sums
        sums = self._sums[key]
        return mix((sums[ends] - sums[starts]) * down[starts])

    def count_bytes(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each text has."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def string(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word, from the index of each text's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


_WEIGHTS = mix(np.arange(1001, 1129, dtype=np.uint64)) | np.uint64(1)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first word of every window of ``size`` words that stays in one text,
    and the window hashes."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i in range(size):
        total += hashes[i : i + count] * _WEIGHTS[i]
    own = owners(first)
    at = np.flatnonzero(own[:count] == own[size - 1 :])
    return at, mix(total[at])


def column_texts(column: pa.Array) -> Texts:
    """The texts of an Arrow string column; null counts as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    size = 8 if wide else 4
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * size)
    bounds = bounds.astype(np.int64)
    length = int(bounds[-1] - bounds[0])
    if data is None or length == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    return Texts(np.frombuffer(data, np.uint8, length, int(bounds[0])), bounds - bounds[0])


def pieces(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES, rows: int = 1 << 14
) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Record batches cut so that each holds at most ``limit`` bytes of text, or one row, and
    at most ``rows`` rows."""
    for batch in batches:
        whole = column_texts(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < whole.n:
            room = whole.bounds[at] + limit
            end = max(at + 1, int(np.searchsorted(whole.bounds, room, "right")) - 1)
            end = min(end, whole.n, at + rows)
            low, high = whole.bounds[at], whole.bounds[end]
            yield batch.slice(at, end - at), Texts(whole.data[low:high], whole.bounds[at : end + 1] - low)
            at = end


def add_per_text(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of the word values of each text."""
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def with_struct(docs: DataFrame, name: str, fields: str) -> StructType:
    """The schema of ``docs`` and one more column, a struct of the fields."""
    return StructType([*docs.schema.fields, *StructType.fromDDL(f"{name} STRUCT<{fields}>").fields])
