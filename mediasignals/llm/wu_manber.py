"""Benchmark decontamination by multi-pattern search over words (Wu and Manber).

Patterns are the windows of ``size`` consecutive words of each benchmark item; an item with
fewer words is one pattern. Patterns of equal length share three tables: a shift table over
blocks of two words tells how far the search may move without missing an occurrence, a table
of the blocks that end a pattern gives the candidates where the shift is zero, and a
candidate counts after its words were compared one by one. The search runs over all stretches
of a piece of text at once, each of them moving by its own shifts.

The benchmark is cut into blocks of at most ``block_bytes`` of text (an item is never cut);
each block is one broadcast of that bounded size, and every text is searched for each block.
A worker holds the tables of at most four blocks.

Defined results: null or empty texts, and items without words, have no words and no hits;
repeated rows are searched each by itself; an input column that has the name of the result
column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_np import ALNUM_LOWER, Texts, column_texts, mix, owners, pieces, with_struct

RESULT = "contamination"
SIZE = 10
BLOCK_BYTES = 4 << 20
_STRETCH = 96
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A3564E27F8862D)


class Group:
    """The tables for patterns of ``m`` words."""

    def __init__(self, m: int, hashes: np.ndarray, starts: np.ndarray):
        self.m, self.hashes, self.starts = m, hashes, starts
        self.b = min(2, m)
        n = len(starts)
        blocks = [self.block(hashes, starts + q) for q in range(self.b - 1, m)]
        size = 1 << max(12, int(8 * n * len(blocks)).bit_length())
        self.mask = np.uint64(min(size, 1 << 26) - 1)
        self.shift = np.full(int(self.mask) + 1, min(m - self.b + 1, 255), np.uint8)
        for q, code in enumerate(blocks):  # later blocks allow smaller shifts
            slot = code & self.mask
            self.shift[slot] = np.minimum(self.shift[slot], min(len(blocks) - 1 - q, 255))
        order = np.argsort(blocks[-1], kind="stable")
        self.by_suffix = order
        self.suffix, self.at = np.unique(blocks[-1][order], return_index=True)
        self.count = np.diff(np.append(self.at, n))
        self.prefix = blocks[0]

    def block(self, hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The code of the block of words that ends at ``last``."""
        if self.b == 1:
            return mix(hashes[last])
        return mix(hashes[last - 1] * _A + hashes[last] * _B)

    def search(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions and patterns of all occurrences in texts that begin at ``first``."""
        m = self.m
        low, high = first[:-1] + m - 1, first[1:]  # last words of windows: low .. high - 1
        parts = np.maximum(0, -(-(high - low) // _STRETCH))
        text = np.repeat(np.arange(len(low)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        pos = low[text] + nth * _STRETCH
        end = np.minimum(pos + _STRETCH, high[text])
        found = []
        while len(pos):
            step = self.shift[self.block(hashes, pos) & self.mask].astype(np.int64)
            zero = step == 0
            if zero.any():
                found.append(pos[zero])
            pos = pos + np.maximum(step, 1)
            live = pos < end
            pos, end = pos[live], end[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = np.concatenate(found)
        code = self.block(hashes, last)
        near = np.minimum(np.searchsorted(self.suffix, code), len(self.suffix) - 1)
        ok = self.suffix[near] == code
        last, near = last[ok], near[ok]
        many = self.count[near]
        at = np.repeat(self.at[near] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pattern, start = self.by_suffix[at], np.repeat(last, many) - m + 1
        for i in range(m):  # word by word; the first and the second word go first
            same = hashes[start + i] == self.hashes[self.starts[pattern] + i]
            pattern, start = pattern[same], start[same]
        return start, pattern


class Block:
    """Patterns of some benchmark items."""

    def __init__(self, ids: list[int], texts: list[str | None], size: int):
        self.text = column_texts(pa.array(texts, pa.string()))
        self.ids = np.array(ids, np.int64)
        self.begin, self.end, first = self.text.spans(ALNUM_LOWER)
        hashes = self.text.hashes(self.begin, self.end, ALNUM_LOWER)
        own = owners(first)
        length = np.diff(first)
        self.groups: list[tuple[Group, np.ndarray]] = []
        for m in sorted({min(int(n), size) for n in length if n}):
            if m == size:
                starts = np.flatnonzero(np.arange(len(own)) + m <= first[own + 1])
            else:
                starts = first[:-1][length == m]
            self.groups.append((Group(m, hashes, starts), own[starts]))

    def confirmed(self, t: Texts, begin: np.ndarray, end: np.ndarray, start: int, at: int, m: int) -> bool:
        """Compare the words themselves."""
        return all(
            np.array_equal(
                ALNUM_LOWER[t.data[begin[start + i] : end[start + i]]],
                ALNUM_LOWER[self.text.data[self.begin[at + i] : self.end[at + i]]],
            )
            for i in range(m)
        )


def _blocks(benchmark: DataFrame, key: str, text: str, size: int, block_bytes: int) -> list:
    """One broadcast (item ids, texts) for each block; together they hold every item."""
    items = benchmark.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(
        F.col("id").isNotNull() & F.col("text").isNotNull()
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // (block_bytes // 2)) or 1  # half full, so that uneven blocks fit
    sent = []
    for i in range(parts):
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).collect()
        sent.append(benchmark.sparkSession.sparkContext.broadcast(([r.id for r in rows], [r.text for r in rows])))
    return sent


def search(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
    item_text: str = "text", size: int = SIZE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All columns of ``docs`` and a struct ``contamination``: ``n_words``, ``n_hit`` (words
    inside an occurrence), ``spans`` (merged, in words, end exclusive) and ``items``."""
    docs = docs.drop(RESULT)
    blocks = _blocks(benchmark, item_key, item_text, size, block_bytes)
    fields = "n_words: BIGINT, n_hit: BIGINT, spans: ARRAY<STRUCT<start: INT, end: INT>>, items: ARRAY<BIGINT>"
    schema = with_struct(docs, RESULT, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=4)
        def block(i: int) -> Block:
            return Block(*blocks[i].value, size)

        for batch, t in pieces(batches, text, 1 << 20):
            begin, end, first = t.spans(ALNUM_LOWER)
            hashes = t.hashes(begin, end, ALNUM_LOWER)
            own = owners(first)
            change = np.zeros(len(begin) + 1, np.int64)
            items: list[set[int]] = [set() for _ in range(t.n)]
            for i in range(len(blocks)):
                b = block(i)
                for group, item in b.groups:
                    for start, pattern in zip(*map(np.ndarray.tolist, group.search(hashes, first)), strict=True):
                        if b.confirmed(t, begin, end, start, group.starts[pattern], group.m):
                            change[start] += 1
                            change[start + group.m] -= 1
                            items[own[start]].add(int(b.ids[item[pattern]]))
            hit = (np.cumsum(change[:-1]) > 0).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(hit)])
            n_hit = sums[first[1:]] - sums[first[:-1]]
            spans: list[list[dict[str, int]]] = [[] for _ in range(t.n)]
            for k in np.flatnonzero(n_hit):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[first[k] : first[k + 1]], [0]])))
                spans[k] = [{"start": int(a), "end": int(z)} for a, z in zip(edge[::2], edge[1::2], strict=True)]
            struct = pa.StructArray.from_arrays(
                [
                    pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                ],
                ["n_words", "n_hit", "spans", "items"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, RESULT])

    return docs.mapInArrow(run, schema)
