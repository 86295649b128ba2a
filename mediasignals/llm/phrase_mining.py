"""Collocation mining: frequent phrases by Misra-Gries summaries, then counted exactly.

Texts, A-Z lower-cased, fall at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
``[^\\x20\\x09]+``; phrases are runs of up to four words of a piece. All is per language.

First pass. Each occurrence of a phrase of one to four words has a 48-bit key, whose upper bits
name a hash partition; there are as many as the bytes of the corpus ask for. A task sends,
for each few megabytes of text, the keys and counts of a hash partition as one row. The keys of a
hash partition meet in one Misra-Gries summary. Its capacity is more than the partition's mass (all
occurrences, sent ahead) divided by the threshold: what it takes from a counter is therefore less
than the threshold, and every phrase that occurs so often survives. What remains is marked
in a bit table of a fixed size, each hash partition in its own part.

Second pass. Occurrences whose key is marked are counted exactly, by the phrase itself: first
in each task, then over all. A key that meets another one, or a bit that does, costs work
and never a result.

Candidates are phrases of two to four words that occur ``LEAST`` times or more. The cut into
two parts with the lowest ``2000000 * f / (f(first) + f(rest))`` gives the score, in integers.
A candidate inside a longer one that occurs at least 0.8 times as often goes. The best of each
language are ranked in two steps, so that no task sorts a whole language.

A summary holds about twice mass / threshold counters: some 25 MB for 32 MB of texts a hash
partition. The bit table has 16 MB whatever the corpus; the fuller it is the less the second pass
skips.

Defined results: a null text has no words, a null language is ``und``, the same as that name; empty
texts, rows that share an id and repeated rows count as they stand; ties go by count, then by the
bytes of the phrase; an empty table gives no rows; only the text and the language are read, so that
further columns clash with nothing. No text is shortened; a very long one is worked on by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .text_np import Texts, byte_table, mix, owners, pieces

WORDS = 4
LEAST = 30
TOP = 2000
SLACK = 2
PIECE = 1 << 19
#: occurrences and phrases that a task combines before it sends them
TOGETHER = 1 << 21
PENDING = 1 << 18
#: bytes of text for one hash partition
PART_BYTES = 32 << 20
#: bytes of the bit table
TABLE_BYTES = 1 << 24
_SPLITTERS = b".,;:!?\n\x0b\x0c\r"
WORD = byte_table(lambda b: b not in b" \t" and b not in _SPLITTERS, lower=True)
BREAK = np.isin(np.arange(256), list(_SPLITTERS))
_WEIGHT = mix(np.arange(2001, 2001 + 2 * (WORDS + 2), dtype=np.uint64)) | np.uint64(1)
_SALTS = 1024


class Summary:
    """A mergeable Misra-Gries summary: a counter is too small by ``lost`` at most."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys = np.concatenate([self.keys, keys])
        counts = np.concatenate([self.counts, counts])
        order = np.argsort(keys, kind="stable")  # sorted runs are merged
        keys, counts = keys[order], counts[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        keys, counts = keys[at], np.add.reduceat(counts, at) if len(at) else counts
        if len(keys) > self.capacity:
            place = len(keys) - self.capacity - 1
            taken = int(np.partition(counts, place)[place])
            self.lost += taken
            left = counts > taken
            keys, counts = keys[left], counts[left] - taken
        self.keys, self.counts = keys, counts

    def merge(self, other: Summary) -> None:
        self.lost += other.lost
        self.add(other.keys, other.counts)

    def frequent(self, least: int) -> np.ndarray:
        """All keys that may have occurred so often; every one that has is among them."""
        return self.keys[self.counts + self.lost >= least]


class Phrases:
    """The words of a piece of texts and the hashes of its phrases."""

    def __init__(self, texts: Texts, langs: np.ndarray):
        self.texts = texts
        self.start, self.end, first = texts.spans(WORD)
        self.own = owners(first)
        passed = np.cumsum(BREAK[texts.data])[self.start] if len(self.start) else self.start
        # the run of words that a phrase must stay in
        self.run = np.zeros(len(self.start), np.int64)
        np.cumsum((passed[1:] != passed[:-1]) | (self.own[1:] != self.own[:-1]), out=self.run[1:])
        self.words = texts.hashes(self.start, self.end, WORD)
        self.lang = langs[self.own]

    def hashes(self, size: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all phrases of so many words; ``second`` gives other hashes."""
        count = len(self.words) - size + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        weight = _WEIGHT[WORDS + 2 :] if second else _WEIGHT
        total = self.lang[:count] * weight[WORDS] + weight[WORDS + 1] * np.uint64(size)
        for i in range(size):
            total += self.words[i : i + count] * weight[i]
        at = np.flatnonzero(self.run[:count] == self.run[size - 1 :])
        return at, mix(total[at])

    def spelled(self, first: np.ndarray, size: np.ndarray) -> pa.Array:
        """The phrases as texts, their words joined by one space."""
        ends = np.cumsum(size)
        word = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(first, size)
        more = np.ones(len(word), np.int64)
        more[ends - 1] = 0
        length = self.end[word] - self.start[word]
        stop = np.cumsum(length + more)
        begin = stop - length - more
        source = np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.start[word] - begin, length + more)
        out = WORD[self.texts.data[np.minimum(source, len(self.texts.data) - 1)]] if len(source) else np.zeros(0, np.uint8)
        out[(stop - 1)[more > 0]] = 32
        offsets = np.concatenate([[0], stop[ends - 1]]) if len(ends) else np.zeros(1)
        return pa.Array.from_buffers(
            pa.string(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)]
        )


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition of 48-bit keys, ascending with them."""
    return ((keys >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)


def _packed(keys: np.ndarray) -> bytes:
    """Keys in six bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _bits(keys: np.ndarray, part: np.ndarray, parts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the table for each key, in the bytes of its hash partition."""
    base = part * np.uint64(size * 8)
    mixed = mix(keys + np.uint64(1))
    return base + mixed % np.uint64(size * 8), base + (mixed >> np.uint64(32)) % np.uint64(size * 8)


def part_bytes(parts: int) -> int:
    """Bytes of the bit table for each hash partition."""
    return max(8, TABLE_BYTES // parts)


def _langs(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("lang_hash")).to_numpy(zero_copy_only=False).view(np.uint64)


def summaries(texts: DataFrame, parts: int, words: int = WORDS) -> DataFrame:
    """(part, kind, mass, ones, many, counts): of each few megabytes of text and hash partition,
    the keys found once, those found more often, and their counts; kind 0 has the mass alone."""

    names = ["part", "kind", "mass", "ones", "many", "counts"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def combined(keys: np.ndarray, mass: np.ndarray) -> pa.RecordBatch:
        keys.sort()
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        keys, counts = keys[at], np.diff(at, append=len(keys))
        edges = np.searchsorted(part_of(keys, parts), np.arange(parts + 1, dtype=np.uint64))
        rows = []
        for p in np.flatnonzero(np.diff(edges)).tolist():
            k, c = keys[edges[p] : edges[p + 1]], counts[edges[p] : edges[p + 1]]
            mass[p] += c.sum()
            rows.append((p, 1, None, _packed(k[c == 1]), _packed(k[c > 1]), c[c > 1].astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(parts, np.int64)
        waiting, held = [], 0
        for batch, t in pieces(batches, "text", PIECE):
            found = Phrases(t, _langs(batch))
            for n in range(1, words + 1):
                waiting.append(found.hashes(n)[1] >> np.uint64(16))
                held += len(waiting[-1])
            if held >= TOGETHER:
                yield combined(np.concatenate(waiting), mass)
                waiting, held = [], 0
        if held:
            yield combined(np.concatenate(waiting), mass)
        at = np.flatnonzero(mass)
        none = pa.nulls(len(at), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(np.zeros(len(at)), pa.int32()), pa.array(mass[at]), none, none, none], names
        )

    schema = "part INT, kind INT, mass LONG, ones BINARY, many BINARY, counts BINARY"
    return texts.select("text", "lang_hash").mapInArrow(run, schema)


def survivors(summed: DataFrame, parts: int, least: int = LEAST) -> DataFrame:
    """(part, table): the part's bytes of the bit table, with the bits of all keys that may occur
    ``least`` times or more."""
    size = part_bytes(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, summary, mass, waiting, held = None, None, 0, [], 0

        def fold() -> None:
            nonlocal waiting, held
            if waiting:
                summary.add(np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting]))
            waiting, held = [], 0

        def done() -> pa.RecordBatch:
            fold()
            keys = summary.frequent(least)
            table = np.zeros(size * 8, bool)
            part = np.full(len(keys), 0, np.uint64)
            for bits in _bits(keys, part, parts, size):
                table[bits] = True
            data = np.packbits(table, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([data], pa.binary())], ["part", "table"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                part, kind, some, ones, many, counts = row
                if part != now:
                    if summary is not None:
                        yield done()
                    now, summary, mass = part, Summary(0), 0
                if kind == 0:
                    mass += some
                    summary.capacity = SLACK * (mass // least + 1)
                    continue
                waiting.append((_unpacked(ones), np.ones(len(ones) // 6, np.int64)))
                waiting.append((_unpacked(many), np.frombuffer(counts, "<u4").astype(np.int64)))
                held += (len(ones) + len(many)) // 6
                if 2 * held >= summary.capacity:
                    fold()
        if summary is not None:
            yield done()

    met = summed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")
    return met.mapInArrow(run, "part INT, table BINARY")


def _same(one: np.ndarray, two: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct pair of hashes and the sum of its counts."""
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    start = np.flatnonzero(new)
    return order[start], np.add.reduceat(n[order], start)


def counted(texts: DataFrame, table: np.ndarray, parts: int, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """(lang, size, phrase, f) of all phrases that occur ``least`` times or more; size 0 has
    the number of words of the language."""
    sent = texts.sparkSession.sparkContext.broadcast(table)
    size = part_bytes(parts)
    names = ["lang", "size", "phrase", "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        waiting, held = [], 0
        for batch, t in pieces(batches, "text", PIECE):
            found = Phrases(t, _langs(batch))
            lang = batch.column(batch.schema.get_field_index("lang")).dictionary_encode()
            code = lang.indices.to_numpy(zero_copy_only=False)[found.own]
            per = np.bincount(code, minlength=len(lang.dictionary))
            some = np.flatnonzero(per)
            yield pa.RecordBatch.from_arrays([
                lang.dictionary.take(pa.array(some)), pa.array(np.zeros(len(some)), pa.int32()),
                pa.array([""] * len(some)), pa.array(per[some], pa.int64()),
            ], names)
            at, one, two, width = [], [], [], []
            for n in range(1, words + 1):
                first, h = found.hashes(n)
                keys = h >> np.uint64(16)
                there = np.ones(len(h), bool)
                for b in _bits(keys, part_of(keys, parts), parts, size):
                    there &= (bits[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1
                at.append(first[there]), one.append(h[there]), two.append(found.hashes(n, second=True)[1][there])
                width.append(np.full(int(there.sum()), n))
            at, one, two, width = (np.concatenate(x) for x in (at, one, two, width))
            if not len(at):
                continue
            chosen, n = _same(one, two, np.ones(len(one), np.int64))
            waiting.append((
                one[chosen], two[chosen], n, width[chosen],
                lang.dictionary.take(pa.array(code[at[chosen]])), found.spelled(at[chosen], width[chosen]),
            ))
            held += len(chosen)
            if held >= PENDING:
                yield together(waiting)
                waiting, held = [], 0
        if held:
            yield together(waiting)

    def together(waiting: list[tuple]) -> pa.RecordBatch:
        one, two, n, width = (np.concatenate([w[i] for w in waiting]) for i in range(4))
        chosen, n = _same(one, two, n)
        at = pa.array(chosen)
        lang, phrase = (pa.concat_arrays([w[i] for w in waiting]).take(at) for i in (4, 5))
        return pa.RecordBatch.from_arrays([lang, pa.array(width[chosen], pa.int32()), phrase, pa.array(n)], names)

    rows = texts.mapInArrow(run, "lang STRING, size INT, phrase STRING, f LONG")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0))


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, words: int = WORDS) -> DataFrame:
    """(lang, size, phrase, f), written: exact counts of all phrases that occur often enough."""
    name = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), name.alias("lang"), F.xxhash64(name).alias("lang_hash"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    size = part_bytes(parts)
    table = np.zeros(parts * size, np.uint8)
    # one row of a fixed size for each hash partition
    for row in survivors(summaries(texts, parts, words), parts, least).collect():
        table[row.part * size : (row.part + 1) * size] = np.frombuffer(row.table, np.uint8)
    return written(counted(texts, table, parts, least, words), "phrase_counts")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, size, phrase, a, l, r, score) of phrases of two or more words, by their weakest cut."""
    words = F.split("phrase", " ")
    cuts = counts.where("size > 1").select(
        "lang", "size", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select(
        "lang", "size", "phrase", "a", "k",
        F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    known = counts.where("size > 0")
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    return (
        cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        .join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        .groupBy("lang", "size", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
        .select("lang", "size", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )


def contained(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the most occurrences of a longer phrase around it."""
    words = F.split("phrase", " ")
    inner = counts.where("size > 2").select(
        "lang", "f", "size", words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n")
    ).select("lang", "f", "w", "n", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)).alias("i"))
    return inner.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("phrase")).agg(F.max("f").alias("longer"))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, words: int = WORDS) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = frequent(docs, text, lang, least, words)
    alone = scored(counts).join(contained(counts), ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(22,0)") * 100 < F.col("a").cast("decimal(22,0)") * 80)
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = alone.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
