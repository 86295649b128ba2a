"""SentencePiece encoding to the N best segmentations, and decoding.

Pieces and scores come from a model file. A text, its spaces written as U+2581 and one put in
front, is a lattice of pieces; the best segmentation has the largest sum of scores. No piece
holds a letter before a space, so that every segmentation has a cut before each run of
spaces: the text falls into chunks that are searched apart.

For a chunk, forward Viterbi gives the best score from the start to each place. The N best
come from a backward A-star search that starts at the end and takes those scores as its
estimate of what is left; the estimate is exact, so complete segmentations leave the queue
in order of their scores. Over the text, a second best score follows for each chunk from
forward and backward Viterbi (the best segmentation through an edge that the best one does
not use); the N best of the text can only differ from the best one in the N - 1 chunks whose
second best costs least, so A-star runs on these, and their alternatives are combined.

Forward and backward Viterbi run over all new chunks of a piece of text at once; a worker
remembers a bounded number of chunks.

A character that no piece holds becomes the byte pieces of its UTF-8 form (or the unknown
piece, in a model without byte pieces), at the smallest score less ten. So does a U+2581 in
the text itself, and decoding gives every text back.

Defined results: a null text gives null; an empty text has no pieces and score 0; repeated
rows are encoded each by itself; equal scores are ordered by which was found first; an input
column that has the name of the result column is replaced by it. No text is shortened.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text_np import mix, pieces, with_struct

RESULT = "encoded"
N_BEST = 4
UNKNOWN_COST = 10.0
SPACE = "▁"
#: stands for a U+2581 of the text; no valid text holds half a surrogate pair
_OWN_SPACE = "\udc81"
_REMEMBERED = 1_000_000
_LONG = 48
Path = tuple[float, tuple[int, ...]]


@dataclass
class Vocabulary:
    """What encoding needs of a model; small enough to be broadcast."""

    texts: list[str]  # of all ids
    scores: list[float]
    plain: list[bool]  # an ordinary piece
    byte_ids: dict[int, int]
    unknown: int
    prefix: bool = True
    ids: dict[str, int] = field(init=False)
    longest: int = field(init=False)
    least: float = field(init=False)

    def __post_init__(self) -> None:
        self.ids = {t: i for i, t in enumerate(self.texts) if self.plain[i]}
        self.longest = max(map(len, self.ids), default=1)
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_COST
        self.bytes = [t.replace(SPACE, " ").encode() if self.plain[i] else b"" for i, t in enumerate(self.texts)]
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])
        held = set("".join(self.ids))
        lone = "".join(c for c in "\n\t\r\v\f" if c not in held)
        other = f"[^ {lone}]"
        cut = not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids)
        self.chunks = re.compile(f"[{lone}]| +{other}*|{other}+" if cut and lone else f" +[^ ]*|[^ ]+" if cut else r"(?s:.+)")

    @classmethod
    def load(cls, model_file: str, prefix: bool = True) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = range(model.get_piece_size())
        texts = [model.id_to_piece(i) for i in n]
        aside = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in n]
        return cls(
            texts, [model.get_score(i) for i in n], [not x for x in aside],
            {int(texts[i][3:5], 16): i for i in n if model.is_byte(i)}, model.unk_id(), prefix,
        )

    def decode(self, ids: list[int] | np.ndarray) -> str:
        text = b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def split(self, text: str) -> list[str]:
        """Chunks of the text with the space in front."""
        return self.chunks.findall(f" {text}" if self.prefix and text else text)

    def spelled(self, c: str) -> tuple[int, ...]:
        """The pieces of a character that no piece holds."""
        raw = (SPACE if c == _OWN_SPACE else c).encode("utf-8", "surrogatepass")
        return tuple(self.byte_ids[b] for b in raw) if self.byte_ids else (self.unknown,)

    def edges(self, chunk: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each place, the edges that end there: start, ids, score."""
        chunk = chunk.replace(SPACE, _OWN_SPACE).replace(" ", SPACE)
        ending: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(len(chunk) + 1)]
        for end in range(1, len(chunk) + 1):
            for start in range(max(0, end - self.longest), end):
                i = self.ids.get(chunk[start:end])
                if i is not None:
                    ending[end].append((start, (i,), self.scores[i]))
                elif start == end - 1:
                    ending[end].append((start, self.spelled(chunk[start]), self.least))
        return ending

    def best(self, chunk: str, n: int) -> list[Path]:
        """The n best segmentations, by A-star from the end."""
        ending = self.edges(chunk)
        ahead = [0.0] * len(ending)
        for end in range(1, len(ending)):
            ahead[end] = max(ahead[start] + score for start, _, score in ending[end])
        found: list[Path] = []
        count = 0
        queue: list[tuple] = [(-ahead[-1], 0, len(ending) - 1, 0.0, None)]
        while queue and len(found) < n:
            _, _, place, done, tail = heapq.heappop(queue)
            if place == 0:
                ids: list[int] = []
                while tail:
                    ids += tail[0]
                    tail = tail[1]
                found.append((done, tuple(ids)))
                continue
            for start, ids_of, score in ending[place]:
                count += 1
                heapq.heappush(queue, (-(done + score + ahead[start]), count, start, done + score, (ids_of, tail)))
        return found


class Table:
    """Piece ids by hash, for many look-ups at once."""

    SLOTS = 1 << 19
    BEGINS, NOTHING = -1, -2

    def __init__(self, vocabulary: Vocabulary):
        # pieces by id, and what begins a piece without being one
        begun = {w[:n]: self.BEGINS for w in vocabulary.ids for n in range(1, len(w))}
        words = sorted(begun | vocabulary.ids)
        ids = [vocabulary.ids.get(w, self.BEGINS) for w in words]
        codes = self.codes(words)
        slot = (codes % np.uint64(self.SLOTS)).astype(np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left = np.arange(len(words))
        while len(left):
            _, first = np.unique(slot[left], return_index=True)
            key, value = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, self.NOTHING, np.int32)
            now = left[first]
            key[slot[now]], value[slot[now]] = codes[now], [ids[i] for i in now]
            self.levels.append((key, value))
            left = np.delete(left, first)

    POWER = [pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(512)]

    @classmethod
    def codes(cls, words: list[str]) -> np.ndarray:
        sums = [sum((ord(c) + 1) * cls.POWER[i] for i, c in enumerate(w)) % (1 << 64) for w in words]
        return mix(np.array(sums, np.uint64))

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Ids, ``BEGINS`` for the beginning of a piece, ``NOTHING`` otherwise."""
        slot = (codes % np.uint64(self.SLOTS)).astype(np.int64)
        out = np.full(len(codes), self.NOTHING, np.int32)
        open_ = np.arange(len(codes))
        for key, value in self.levels:
            there = key[slot[open_]]
            hit = there == codes[open_]
            out[open_[hit]] = value[slot[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
            if not len(open_):
                break
        return out


class Encoder:
    """A worker's chunks: best ids, score and cost of the second best."""

    def __init__(self, vocabulary: Vocabulary, n_best: int):
        self.v, self.n, self.table = vocabulary, n_best, Table(vocabulary)
        self.score_of = np.array(vocabulary.scores, float)
        self.n_best = lru_cache(maxsize=50_000)(lambda chunk: vocabulary.best(chunk, n_best))
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.score, self.second = np.zeros(0), np.zeros(0)

    def _learn(self, chunks: list[str]) -> None:
        by_size: dict[int, list[str]] = defaultdict(list)
        for c in chunks:
            by_size[len(c) if len(c) <= _LONG else 0].append(c)
        ids, sizes, score, second = [self.flat], [np.diff(self.start)], [self.score], [self.second]
        odd = by_size.pop(0, [])
        for n, same in by_size.items():
            same, flat, size, best, cost = self._viterbi(same, n, odd)
            self.index.update(zip(same, range(len(self.index), len(self.index) + len(same)), strict=True))
            ids.append(flat), sizes.append(size), score.append(best), second.append(cost)
        for c in odd:
            paths = self.v.best(c, 2)
            self.index[c] = len(self.index)
            ids.append(np.array(paths[0][1], np.int32)), sizes.append(np.array([len(paths[0][1])]))
            score.append(np.array([paths[0][0]]))
            second.append(np.array([paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf]))
        self.flat, self.score, self.second = np.concatenate(ids), np.concatenate(score), np.concatenate(second)
        self.start = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _viterbi(self, chunks: list[str], n: int, odd: list[str]):
        """Best paths of chunks of n characters. Those with a character that no piece holds
        are put with the odd ones."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).reshape(-1, n)
        spaced = np.where(points == 32, ord(SPACE), np.where(points == ord(SPACE), 0xFFFFFFFF, points)).astype(np.uint64)
        power = np.array(Table.POWER[: n + 1], np.uint64)
        back = np.array([pow(x, -1, 1 << 64) for x in Table.POWER[: n + 1]], np.uint64)
        sums = np.zeros((len(chunks), n + 1), np.uint64)
        np.cumsum((spaced + np.uint64(1)) * power[:n], axis=1, out=sums[:, 1:])
        single = self.table.find(mix(((sums[:, 1:] - sums[:, :-1]) * back[:n]).ravel())).reshape(-1, n)
        ok = (single >= 0).all(axis=1)
        odd.extend(c for c, x in zip(chunks, ok, strict=True) if not x)
        if not ok.all():
            chunks, sums, single = [c for c, x in zip(chunks, ok, strict=True) if x], sums[ok], single[ok]
        m = len(chunks)
        score = self.score_of
        # edges (start, end) with the rows that have them; longer ones are sought among the
        # rows whose shorter one begins some piece
        edges: dict[tuple[int, int], tuple[np.ndarray | slice, np.ndarray, np.ndarray]] = {}
        every = np.arange(m)
        for i in range(n):
            edges[i, i + 1] = slice(None), single[:, i], score[single[:, i]]
            rows = every
            for j in range(i + 2, min(n, i + self.v.longest) + 1):
                ids = self.table.find(mix((sums[rows, j] - sums[rows, i]) * back[i]))
                rows, ids = rows[ids > Table.NOTHING], ids[ids > Table.NOTHING]
                if not len(rows):
                    break
                hit = ids >= 0
                edges[i, j] = rows[hit], ids[hit], score[ids[hit]]
        ahead = np.full((n + 1, m), -np.inf)
        ahead[0] = 0
        came = np.zeros((n + 1, m), np.int16)
        best_id = np.zeros((n + 1, m), np.int32)
        for i, j in sorted(edges, key=lambda e: (e[1], e[0])):
            rows, ids, value = edges[i, j]
            total = ahead[i][rows] + value
            better = total > ahead[j][rows]
            at = np.flatnonzero(better) if isinstance(rows, slice) else rows[better]
            ahead[j][at], came[j][at], best_id[j][at] = total[better], i, ids[better]
        behind = np.full((n + 1, m), -np.inf)
        behind[n] = 0
        for i, j in sorted(edges, reverse=True):
            rows, _, value = edges[i, j]
            behind[i][rows] = np.maximum(behind[i][rows], behind[j][rows] + value)
        # walk back along the best path
        used = np.zeros((n + 1, m), bool)  # a piece ends here
        place = np.full(m, n)
        while len(rows := np.flatnonzero(place > 0)):
            used[place[rows], rows] = True
            place[rows] = came[place[rows], rows]
        other = np.full(m, -np.inf)
        for (i, j), (rows, _, value) in edges.items():
            through = ahead[i][rows] + value + behind[j][rows]
            through[used[j][rows] & (came[j][rows] == i)] = -np.inf
            other[rows] = np.maximum(other[rows], through)
        used, best_id = used.T, best_id.T
        return chunks, best_id[used], used.sum(axis=1), ahead[n], ahead[n] - other

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, float, list[tuple[float, list[tuple[int, tuple[int, ...]]]]]]]:
        """Of each text: best ids, score, and the further segmentations as score and changed
        chunks."""
        parts = [self.v.split(t) for t in texts]
        if len(self.index) > _REMEMBERED:
            self._forget()
        chunks = list(chain.from_iterable(parts))
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn(sorted({chunks[i] for i in new}))
            at[new] = [self.index[chunks[i]] for i in new]
        begin, size = self.start[at], self.start[at + 1] - self.start[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        scores, second = self.score[at], self.second[at]
        out = []
        low = 0
        for p in parts:
            high = low + len(p)
            score = float(scores[low:high].sum())
            out.append((ids[ends[low] : ends[high]], score, self._further(p, second[low:high], score)))
            low = high
        return out

    def _further(self, chunks: list[str], second: np.ndarray, score: float):
        """The second to n-th segmentations of a text."""
        most = self.n - 1
        order = np.argpartition(second, most)[:most] if len(second) > most else np.arange(len(second))
        order = order[np.isfinite(second[order])]
        ways: list[tuple[float, list[tuple[int, tuple[int, ...]]]]] = [(0.0, [])]
        for at in sorted(order.tolist()):
            paths = self.n_best(chunks[at])
            more = [
                (cost + paths[0][0] - s, [*changes, (at, ids)] if k else changes)
                for cost, changes in ways for k, (s, ids) in enumerate(paths)
            ]
            ways = heapq.nsmallest(self.n, more, key=lambda w: w[0])
        return [(score - cost, changes) for cost, changes in ways[1:]]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", n_best: int = N_BEST) -> DataFrame:
    """All columns of ``docs`` and a struct ``encoded``: ``ids`` and ``score`` of the best
    segmentation, ``further`` ones (``score`` and the ``changes`` they make: number of the
    chunk and its ids), and whether decoding gives the text back (``exact``)."""
    docs = docs.drop(RESULT)
    change = "STRUCT<chunk: INT, ids: ARRAY<INT>>"
    fields = f"ids: ARRAY<INT>, score: DOUBLE, further: ARRAY<STRUCT<score: DOUBLE, changes: ARRAY<{change}>>>, exact: BOOLEAN"
    schema = with_struct(docs, RESULT, fields)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = pa.struct([
        ("ids", pa.list_(pa.int32())), ("score", pa.float64()),
        ("further", pa.list_(pa.struct([
            ("score", pa.float64()),
            ("changes", pa.list_(pa.struct([("chunk", pa.int32()), ("ids", pa.list_(pa.int32()))]))),
        ]))),
        ("exact", pa.bool_()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value, n_best)
        for batch, t in pieces(batches, text, 1 << 21):
            texts = batch.column(batch.schema.get_field_index(text))
            plain = [x or "" for x in texts.to_pylist()]
            found = encoder.encode(plain)
            sizes = np.array([len(ids) for ids, _, _ in found])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            columns = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([ids for ids, _, _ in found]), pa.int32())),
                pa.array([score for _, score, _ in found], pa.float64()),
                pa.array(
                    [[{"score": s, "changes": [{"chunk": at, "ids": ids} for at, ids in c]} for s, c in more] for _, _, more in found],
                    kind.field("further").type,
                ),
                pa.array([encoder.v.decode(ids.tolist()) == x for (ids, _, _), x in zip(found, plain, strict=True)]),
            ]
            struct = pa.StructArray.from_arrays(columns, fields=list(kind), mask=texts.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, RESULT])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str, result: str = "decoded") -> DataFrame:
    """All columns of ``docs`` and the text of a column of ids; null ids give null."""
    from pyspark.sql.types import StringType, StructField, StructType

    docs = docs.drop(result)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [None if x is None else sent.value.decode(x) for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, result])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(result, StringType())]))
