"""Alignment of two tokenizers over exact-text duplicates.

Tokenizer A is a byte-level BPE file, B a SentencePiece model. A text is encoded by A with a space
in front, by B as it is (B adds the space itself), both without special tokens. The bytes of the
tokens must add up to the same space and text; byte places where tokens of A and B both end cut them
into groups, and tokens that end together are linked.

The corpus is shuffled by full text and equal texts become one row with their number. Each
distinct text is then tokenised and aligned once. Texts are worked on in blocks of a bounded number
of bytes; a block keeps its distinct linked id pairs once, with their counts weighted by
multiplicity, and each text refers to them by their place in the block. So the pair counts are
shuffled once for each block and not for each link, also those of the most common pairs. Counts
over the corpus, and the highest count of each id of B, come back to the blocks that hold the pair;
the measures of each text go to its documents by the SHA-256 of the text.

Neither tokenizer joins what stands before a space to the space, unless a piece of B says otherwise:
the pre-tokens of A end before a space that follows a letter, digit or sign, and so do the pieces of B.
A text is therefore cut there, and a chunk (a word, mostly) that a worker remembers is not
tokenised and aligned again. A text with a chunk whose bytes differ is encoded as a whole.

Defined results: null and empty texts, and texts whose bytes the tokens do not give back (B may
change them), have no tokens: zeros and an empty group column; equal texts have equal measures;
rows that share an id and repeated rows are counted and returned as they stand; an empty table gives
no rows; of the input only id and text are read, so that further columns clash with nothing. Texts
are never shortened; a very long one is a block by itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .text_np import pieces

#: bytes of text in a block
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 1 << 16
#: bytes of text that are tokenised at once
STEP_BYTES = 1 << 19
#: a space that follows a printed sign, and is not the last character
CUT = re.compile("(?s)(?<=[!-~\u00a1-\u024f])(?= .)")
_REMEMBERED = 600_000
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@dataclass
class Tokenizers:
    """The contents of the two files; bounded, and sent to the tasks."""

    a: str
    b: bytes

    @classmethod
    def load(cls, byte_bpe_file: str, piece_model_file: str) -> Tokenizers:
        with open(byte_bpe_file, encoding="utf-8") as f:
            a = f.read()
        with open(piece_model_file, "rb") as f:
            return cls(a, f.read())


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones of Latin-1
    for themselves, the others by the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers in a task, with the bytes of their ids."""

    def __init__(self, files: Tokenizers):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        symbols = byte_symbols()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            plain = all(c in symbols for c in token)
            self.a_bytes[i] = bytes(symbols[c] for c in token) if plain else token.encode()
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        ]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # a piece of B that goes on after a space would join two chunks
        self.chunked = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.sizes, self.start, self.links = np.zeros((0, 3), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        """Remember the groups and links of chunks, each with its space in front."""
        sizes, flat, ends = [], [], []
        found = self.a.encode_batch_fast(chunks, add_special_tokens=False)
        for c, a, b in zip(chunks, found, self.b.encode([c[1:] for c in chunks], num_threads=1), strict=True):
            a, raw = a.ids, c.encode()
            parts_a, parts_b = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
            self.index[c] = len(self.groups)
            if b"".join(parts_a) != raw or b"".join(parts_b) != raw or b"" in parts_a or b"" in parts_b:
                self.groups.append(None)
                sizes.append((0, 0, 0))
            else:
                groups, i, j, p, q = [], 0, 0, 0, 0
                at_a = at_b = 0
                while p < len(a):
                    at_a += len(parts_a[p])
                    p += 1
                    while at_b < at_a:
                        at_b += len(parts_b[q])
                        q += 1
                    if at_a == at_b:
                        groups.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
                        flat.append(b[q - 1] << 32 | a[p - 1])
                        i, j = p, q
                self.groups.append(";".join(groups))
                sizes.append((len(a), len(b), len(groups)))
            ends.append(len(flat))
        self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int64)])
        self.start = np.concatenate([self.start, self.start[-1] + np.array(ends, np.int64)])
        self.links = np.concatenate([self.links, np.array(flat, np.int64)])

    def measure(self, texts: list[str]) -> Iterator[tuple[int, int, int, str | None, np.ndarray]]:
        """Of each text: tokens of A and B, groups, the groups spelled out (none without tokens), and
        the links as ``b << 32 | a``."""
        if not self.chunked:
            yield from map(self.whole, texts)
            return
        if len(self.index) > _REMEMBERED:
            self._forget()
        parts = [CUT.split(f" {t}") if t else [] for t in texts]
        chunks = [c for p in parts for c in p]
        new = list({c for c in chunks if c not in self.index})
        if new:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))
        begin, size = self.start[at], self.start[at + 1] - self.start[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        links = self.links[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(self.sizes[at], axis=0)])
        groups = [self.groups[i] for i in at.tolist()]
        low = 0
        for t, p in zip(texts, parts, strict=True):
            high = low + len(p)
            spelled = groups[low:high]
            if not p or None in spelled:
                yield self.whole(t)
            else:
                n_a, n_b, n = (sums[high] - sums[low]).tolist()
                yield n_a, n_b, n, ";".join(spelled), links[ends[low] : ends[high]]
            low = high

    def whole(self, text: str) -> tuple[int, int, int, str | None, np.ndarray]:
        """The same of one text at once."""
        (a, b), = self.encode([text])
        if not a:
            return 0, 0, 0, None, np.zeros(0, np.int64)
        count, groups, link_a, link_b = self.align(a, b)
        return len(a), len(b), count, groups, link_b << 32 | link_a

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of each text by A and B; no ids where their bytes are not the text's."""
        found = self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)
        for t, a, b in zip(texts, found, self.b.encode(texts, num_threads=1), strict=True):
            whole, a = f" {t}".encode(), a.ids
            same = t != "" and b"".join([self.a_bytes[i] for i in a]) == whole and b"".join([self.b_bytes[i] for i in b]) == whole
            yield (a, b) if same else ([], [])

    def align(self, a: list[int], b: list[int]) -> tuple[int, str, np.ndarray, np.ndarray]:
        """Number of groups, groups spelled out, and the linked ids of A and B."""
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_size[x]), np.cumsum(self.b_size[y])
        cuts = np.intersect1d(ends_a, ends_b)
        # the groups' last tokens; several tokens end at one place only if some have no bytes
        stop_a, stop_b = np.searchsorted(ends_a, cuts, "right"), np.searchsorted(ends_b, cuts, "right")
        many_a, many_b = stop_a - np.searchsorted(ends_a, cuts), stop_b - np.searchsorted(ends_b, cuts)
        if (many_a == 1).all() and (many_b == 1).all():
            link_a, link_b = x[stop_a - 1], y[stop_b - 1]
        else:
            both = [
                (p, q)
                for i, m, j, n in zip(stop_a.tolist(), many_a.tolist(), stop_b.tolist(), many_b.tolist(), strict=True)
                for p in a[i - m : i] for q in b[j - n : j]
            ]
            link_a, link_b = (np.array(c, np.int64) for c in zip(*both, strict=True))
        sa, sb = list(map(str, a)), list(map(str, b))
        groups, i, j = [], 0, 0
        for p, q in zip(stop_a.tolist(), stop_b.tolist(), strict=True):
            if p - i == 1 and q - j == 1:
                groups.append(f"{sa[i]}|{sb[j]}")
            else:
                groups.append(f"{','.join(sa[i:p])}|{','.join(sb[j:q])}")
            i, j = p, q
        return len(cuts), ";".join(groups), link_a, link_b


@lru_cache(maxsize=1)
def _pair(key: str, a: str, b: bytes) -> Pair:
    return Pair(Tokenizers(a, b))


_TEXTS = pa.struct([
    ("id", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups", pa.string()), ("place", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
])
_BLOCK = (
    "block LONG, pairs ARRAY<LONG>, weights ARRAY<LONG>, texts ARRAY<STRUCT<id: BINARY, n_a: LONG, n_b: LONG, "
    "n_groups: LONG, n_links: LONG, groups: STRING, place: ARRAY<INT>, times: ARRAY<INT>>>"
)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def _digest(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(text, 256))


def blocks(texts: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Blocks of aligned texts, of distinct (text, n)."""
    sent = texts.sparkSession.sparkContext.broadcast(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pair = _pair(hashlib.sha256(sent.value.b).hexdigest(), sent.value.a, sent.value.b)
        block = TaskContext.get().partitionId() << 32
        for batch, _ in pieces(batches, "text", BLOCK_BYTES, BLOCK_ROWS):
            plain = batch.column(batch.schema.get_field_index("text")).to_pylist()
            weight = batch.column(batch.schema.get_field_index("n")).to_numpy(zero_copy_only=False)
            rows, codes, times = [], [], []
            for t, (n_a, n_b, count, groups, links) in zip(plain, _steps(pair, plain), strict=True):
                own, n = np.unique(links, return_counts=True)
                codes.append(own), times.append(n)
                spelled = "" if groups is None else hashlib.sha256(groups.encode()).hexdigest()
                rows.append((hashlib.sha256(t.encode()).digest(), n_a, n_b, count, len(links), spelled))
            flat = np.concatenate(codes)
            pairs, place = np.unique(flat, return_inverse=True)
            weights = np.zeros(len(pairs), np.int64)
            np.add.at(weights, place, np.concatenate(times) * np.repeat(weight, [len(c) for c in codes]))
            edges = np.cumsum([len(c) for c in codes])[:-1]
            columns = [pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), list(_TEXTS)[:6], strict=True)]
            columns += [_lists(np.split(place, edges), pa.int32()), _lists(times, pa.int32())]
            whole = pa.StructArray.from_arrays(columns, fields=list(_TEXTS))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), _lists([pairs], pa.int64()), _lists([weights], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)],
                ["block", "pairs", "weights", "texts"],
            )
            block += 1

    return texts.select("text", "n").mapInArrow(run, _BLOCK)


def _steps(pair: Pair, texts: list[str]) -> Iterator[tuple[int, int, int, str | None, np.ndarray]]:
    low = 0
    while low < len(texts):
        size, high = 0, low
        while high < len(texts) and (high == low or size + len(texts[high]) <= STEP_BYTES):
            size += len(texts[high])
            high += 1
        yield from pair.measure(texts[low:high])
        low = high


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair over the corpus, and whether no other pair of
    that id of B has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "weights")).alias("x"))
    counts = written(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.weights").alias("count")), "pair_counts")
    b = F.shiftright("pair", 32)
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def measured(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The measures of each distinct text, by the digest of the text."""
    needed = aligned.select("block", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair")
    back = needed.groupBy("block").agg(F.collect_list(F.struct("at", "count", "best")).alias("known"))  # of one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts = batch.column(0).slice(i, 1).flatten()
                known = batch.column(1).slice(i, 1).flatten()
                at = known.field("at").to_numpy(zero_copy_only=False)
                count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                count[at] = known.field("count").to_numpy(zero_copy_only=False)
                best[at] = known.field("best").to_numpy(zero_copy_only=False)
                place, times = texts.field("place"), texts.field("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = place.flatten().to_numpy(zero_copy_only=False)
                edges = np.concatenate([[0], np.cumsum(place.value_lengths().to_numpy(zero_copy_only=False))])
                columns = [texts.field(name) for name in ("id", "n_a", "n_b", "n_groups", "n_links")]
                for values in (best, count):
                    sums = np.concatenate([[0], np.cumsum(values[flat] * times)]) if len(flat) else np.zeros(1, np.int64)
                    columns.append(pa.array(np.diff(sums[edges])))
                yield pa.RecordBatch.from_arrays([*columns, texts.field("groups")], ["id", *MEASURES, "groups_sha256"])

    met = aligned.select("block", "texts").join(back, "block", "left").select(
        "texts", F.coalesce("known", F.array().cast("array<struct<at:int,count:bigint,best:boolean>>")).alias("known")
    )
    return met.mapInArrow(run, "id BINARY, " + ", ".join(f"{m} LONG" for m in MEASURES) + ", groups_sha256 STRING")


def align(docs: DataFrame, tokenizers: Tokenizers, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the six measures and ``groups_sha256`` of each row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    distinct = rows.where(F.length("text") > 0).groupBy("text").agg(F.count("text").alias("n"))
    aligned = written(blocks(distinct, tokenizers), "aligned_blocks")
    measures = written(measured(aligned, pair_counts(aligned)), "text_measures")
    by_digest = rows.select("key", _digest(F.col("text")).alias("id"))
    return by_digest.join(measures, "id", "left").select(
        F.col("key").alias(key), *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
