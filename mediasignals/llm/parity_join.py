"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct shingles (``SHINGLE`` words; the whole sequence of a
shorter text). Two sets with similarity of at least ``SHARE`` differ in at most
(|A| + |B|) / 7 shingles (for 0.75). A parity sketch toggles one position for each shingle, so
two sketches differ in at most as many positions as the sets differ in shingles.

Common shingles. Those of a line or passage that many documents share say little about a
link. Each task counts the shingles of its documents by slots of a fixed table; a slot that
holds more than ``COMMON`` of a task's documents is common everywhere. This choice decides how
candidates are found, never which links are.

Candidates. Sizes are split into bands [2^k, 2^(k+1)); a set also visits the next band if a
similar one there could be large enough. In a band, the positions of a very long sketch are
dealt to a fixed number of parts, and a part's bits are kept as the exclusive or of a 64-bit
number for each toggled position. Each differing shingle changes one part, so that a set with more
useful parts (with a shingle that is not common) than possible differences shares one of
them, unchanged, with every similar set: these parts are the join keys. A set sends one more of
them than may differ, those with most useful shingles first and otherwise in hash order: what
stands before the first shared part, in the list of either set, has changed, so that both send
that part. If two similar sets share none, both have few useful parts; such sets send all of them
and are also keyed by their first shingles, common ones last and otherwise in hash order, of which
similar sets share at least one. No key stands for an empty part.

Joining. Texts with equal sets form one class, and only classes are joined. Rows are sorted by
key within their partition and read as a stream. Up to ``SMALL`` classes of a key give all their
pairs. For a key with more, all are compared with one of them; components of the links
found so far follow, and only members of different components remain to be compared: in
blocks of bounded size, by sketches of at least four positions a shingle that come with them,
and the pairs within the bound go on. All pairs are then filtered by size, by sketches of 512
positions and by the wider ones, and verified on the full sets. Those are made anew from one text
of each class: the texts whose hash is in a bitmap of fixed size are cut into shingles; a class
that only seems to be in it is dropped by the join that follows. No candidate is capped or dropped.

Defined results: null texts and texts without words have an empty set and are linked with
nothing; repeated rows belong to one class; columns other than id and text are not read.
Sets use 64-bit hashes. Keys hold 48 bits of one: equal keys stay equal, and sets that meet by
chance are told apart like any other pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, written
from .components import connected
from .text_np import SPACED_LOWER, Texts, mix, owners, pieces, windows

SHINGLE = 5
#: similarity as a fraction
SHARE = (3, 4)
#: parts of a band for each shingle of its largest set
PARTS = 0.36
#: share of a task's documents that makes a slot of shingles common, and the bits of a slot
COMMON = 0.002
SLOT_BITS = 22
#: bits of a key: zero bytes compress in shuffle files, and a chance meeting is one more pair to filter
KEY_BITS = 48
SMALL = 16
BLOCK = 1024
WORDS = 8  # of a sketch
_SKETCH = [f"s{i}" for i in range(WORDS)]
_U = np.uint64


def shingles(t: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct shingle, in that order."""
    starts, ends, first = t.spans(SPACED_LOWER)
    words = t.hashes(starts, ends, SPACED_LOWER)
    count = np.diff(first)
    bounds = np.concatenate([[0], np.cumsum(np.where(count < size, count > 0, count - size + 1))])
    text = owners(bounds)
    value = np.empty(len(text), _U)
    value[count[text] >= size] = windows(words, first, size)[1]
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        if len(short):
            at = (first[short][:, None] + np.arange(k)).ravel()
            codes = windows(words[at], np.arange(len(short) + 1) * k, k)[1]
            value[bounds[short]] = mix(codes + _U(k))
    long = np.flatnonzero(count > size)
    for low, high in zip(bounds[long].tolist(), bounds[long + 1].tolist(), strict=True):
        value[low:high].sort()
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def _per_text(text: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(text, np.arange(n + 1))


def _classes(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for each set, whatever the order of its shingles."""
    sums = np.zeros(len(value) + 1, _U)
    np.cumsum(mix(value ^ _U(0x5BF03635)), out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(_U)).view(np.int64)


def _sketches(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    bit = (mix(value ^ _U(0xC2B2AE35)) & _U(64 * WORDS - 1)).astype(np.int64)
    odd = (np.bincount(text * (64 * WORDS) + bit, minlength=n * 64 * WORDS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, WORDS * 64), axis=1).view(np.int64)


def _wide_sketches(text: np.ndarray, value: np.ndarray, n: int) -> pa.ListArray:
    """Sketches of 64 * 2^k positions, at least four for each shingle; the halves of one,
    combined by exclusive or, are the sketch of half the width."""
    size = np.bincount(text, minlength=n)
    width = 64 << np.ceil(np.log2(np.maximum(4 * size, 64) / 64)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(width)])
    code = mix(value ^ _U(0x165667B1))
    place = base[text] + (code & (width[text] - 1).astype(_U)).astype(np.int64)
    odd = (np.bincount(place, minlength=int(base[-1])) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(base // 64, pa.int32()), pa.array(np.packbits(odd).view(np.int64)))


def _in_bitmap(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return ((bitmap[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1)) == 1


def _bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """The slots (column ``slot``) as a bitmap of fixed size."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    rows = (
        slots.select(F.floor(F.col("slot") / 64).cast("int").alias("word"), bit.alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    )  # at most 2^(bits - 6) words
    words = np.zeros(1 << (bits - 6), np.int64)
    for r in rows:
        words[r.word] = r.bits
    return words.view(_U)


def common_slots(measured: DataFrame) -> np.ndarray:
    """The bitmap of common slots, from the rows of ``measure``."""
    return _bitmap(measured.where(F.col("slot").isNotNull()).select("slot"), SLOT_BITS)


def join_keys(text: np.ndarray, value: np.ndarray, n: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) rows of the sets of ``n`` texts."""
    first = _per_text(text, n)
    frequent = _in_bitmap(common, value & _U((1 << SLOT_BITS) - 1))
    size = np.diff(first)
    level = np.frexp(np.maximum(size, 1))[1].astype(np.int64) - 1  # 2^level <= size
    out_text, out_key = [], []
    for visit in (0, 1):
        band = level + visit
        comes = size > 0
        if visit:  # a set of the next band holds at most 4/3 as many
            comes &= SHARE[1] * size >= SHARE[0] * (1 << band)
        rows = comes[text]
        if not rows.any():
            continue
        t, v = text[rows], value[rows]
        high = (1 << (band + 1)) - 1
        parts = np.maximum(1, np.ceil(PARTS * high)).astype(np.int64)
        salt = mix(band.astype(_U) + _U(77))
        part = (mix(v ^ salt[t]) % parts[t].astype(_U)).astype(np.int64)
        order = np.argsort((t << 32) | part)  # parts number less than 2^32
        to, po, word = t[order], part[order], mix(v[order] + _U(0x27D4EB2F))
        begin = np.ones(len(to), bool)
        begin[1:] = (to[1:] != to[:-1]) | (po[1:] != po[:-1])
        at = np.flatnonzero(begin)
        telling = np.add.reduceat((~frequent[rows][order]).astype(np.int64), at)
        codes = mix(np.bitwise_xor.reduceat(word, at) ^ mix(po[at].astype(_U) ^ salt[to[at]]))
        useful = telling > 0
        owner, telling, codes = to[at[useful]], telling[useful], codes[useful]
        filled = np.bincount(owner, minlength=n)
        partner = np.minimum(size * SHARE[1] // SHARE[0], high)
        differ = (size + partner) * (SHARE[1] - SHARE[0]) // (SHARE[0] + SHARE[1])
        # one part more than may change, in an order that only the part's contents decide
        place = (_U(15) - np.minimum(telling, 15).astype(_U)) << _U(28) | codes >> _U(36)
        listed = np.argsort((owner << 32) | place.astype(np.int64), kind="stable")
        until = np.cumsum(filled) - filled
        taken = listed[np.arange(len(owner)) - until[owner] <= differ[owner]]
        out_text.append(owner[taken])
        out_key.append(codes[taken])
        # sets whose useful parts may all change
        few = comes & (filled <= differ)
        if few.any():
            lead = size - -(-size * SHARE[0] // SHARE[1]) + 1
            rows = few[text]
            t, v, late = text[rows], value[rows], frequent[rows]
            # shingles of a text come in hash order; common ones go last
            last = np.lexsort((late, t))
            t, v = t[last], v[last]
            pick = np.arange(len(t)) - np.searchsorted(t, t) < lead[t]
            out_text.append(t[pick])
            out_key.append(mix(v[pick] ^ mix(salt[t[pick]] + _U(5))))
    if not out_text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.concatenate(out_key) & _U((1 << KEY_BITS) - 1)
    return np.concatenate(out_text), keys.view(np.int64)


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, class, sketch words, wide sketch, mark) of every row; class is null for an empty
    set, the mark is a hash of the text. At the end of each task follow its common slots: rows
    with nothing but ``slot``, which is null in the others."""
    columns = ["doc", "mark", "n", "class", *_SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, sent = np.zeros(1 << SLOT_BITS, np.int32), 0, set()
        for batch, t in pieces(batches, text):
            own, value = shingles(t)
            first = _per_text(own, t.n)
            size = np.diff(first)
            sketch = _sketches(own, value, t.n)
            classes = _classes(value, first)
            new = _unsent(classes, sent)
            slots = (value[new[own]] & _U((1 << SLOT_BITS) - 1)).astype(np.int64)
            np.add.at(counts, slots, np.ones(len(slots), np.int32))  # of one type, or it is slow
            n += int(new.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(size, pa.int64()),
                    pa.array(classes, pa.int64(), mask=size == 0),
                    *[pa.array(sketch[:, i], pa.int64()) for i in range(WORDS)],
                    _wide_sketches(own, value, t.n), pa.nulls(t.n, pa.int64()),
                ],
                [*columns, "wide", "slot"],
            )
        common = np.flatnonzero(counts > 10 + COMMON * n)
        none = [pa.nulls(len(common), pa.int64())] * len(columns)
        wide = pa.nulls(len(common), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*none, wide, pa.array(common, pa.int64())], [*columns, "wide", "slot"])

    schema = ", ".join(f"{s} BIGINT" for s in columns) + ", wide ARRAY<BIGINT>, slot BIGINT"
    return docs.select(F.col(key).cast("long").alias("doc"), _mark(text), text).mapInArrow(run, schema)


def _mark(text: str) -> Column:
    return F.xxhash64(text).alias("mark")


def _unsent(classes: np.ndarray, sent: set[int]) -> np.ndarray:
    """Which classes a task has not sent yet, as far as it remembers."""
    new = np.zeros(len(classes), bool)
    if len(sent) > 1_000_000:
        sent.clear()
    for i, c in enumerate(classes.tolist()):
        if c not in sent:
            sent.add(c)
            new[i] = True
    return new


def keyed(docs: DataFrame, common: np.ndarray, text: str = "text") -> DataFrame:
    """(key, class) rows. A task sends each class once, while it remembers it."""
    sent_common = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for _, t in pieces(batches, text):
            own, value = shingles(t)
            first = _per_text(own, t.n)
            classes = _classes(value, first)
            rows = _unsent(classes, sent)[own]
            own, keys = join_keys(own[rows], value[rows], t.n, sent_common.value)
            yield pa.RecordBatch.from_pydict({"key": keys, "class": classes[own]})

    return docs.select(text).mapInArrow(run, "key BIGINT, class BIGINT")


def _pairs_of_runs(c: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = [], []
    for m in np.unique(length):
        i, j = np.triu_indices(int(m), 1)
        at = begin[length == m][:, None]
        a.append(c[at + i].ravel())
        b.append(c[at + j].ravel())
    return (np.concatenate(a), np.concatenate(b)) if a else (c[:0], c[:0])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and class: pairs of classes (a < b), and the members (key, a) of keys
    with more than ``SMALL`` classes, whose pairs are only those with one of them."""
    held_k, held_c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    hot: tuple[int, int] | None = None  # key, the class that all are compared with
    last = None
    ends: list[pa.RecordBatch | None] = [None]

    def rows(a: np.ndarray, b: np.ndarray, key: np.ndarray | None) -> pa.RecordBatch:
        if key is None:
            low, high = np.minimum(a, b), np.maximum(a, b)
            return pa.RecordBatch.from_pydict({"key": pa.nulls(len(a), pa.int64()), "a": low, "b": high})
        return pa.RecordBatch.from_pydict({"key": key, "a": a, "b": pa.nulls(len(a), pa.int64())})

    def crowd(key: int, rep: int, members: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield rows(members, members, np.full(len(members), key))
        others = members[members != rep]
        yield rows(np.full(len(others), rep), others, None)

    for batch in (x for part in (batches, ends) for x in part):
        if batch is not None:
            k, c = (np.asarray(batch.column(i)) for i in (0, 1))
            if not len(k):
                continue
            fresh = np.ones(len(k), bool)
            fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            fresh[0] = last != (k[0], c[0])
            last = (k[-1], c[-1])
            k, c = k[fresh], c[fresh]
            if hot:
                more = int(np.searchsorted(k, hot[0], "right"))
                if more:
                    yield from crowd(hot[0], hot[1], c[:more])
                    k, c = k[more:], c[more:]
                if not len(k):
                    continue
                hot = None
            k, c = np.concatenate([held_k, k]), np.concatenate([held_c, c])
        else:
            k, c = held_k, held_c
        if not len(k):
            continue
        begin = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        length = np.diff(np.append(begin, len(k)))
        if batch is not None:  # the last run may go on
            held_k, held_c = k[begin[-1] :], c[begin[-1] :]
            begin, length = begin[:-1], length[:-1]
        small = (length > 1) & (length <= SMALL)
        a, b = _pairs_of_runs(c, begin[small], length[small])
        if len(a):
            yield rows(a, b, None)
        large = [(k[s], c[s : s + m]) for s, m in zip(begin[length > SMALL], length[length > SMALL], strict=True)]
        if batch is not None and len(held_k) > SMALL:
            large.append((held_k[0], held_c))
        for key, members in large:
            rep = int(members[int(key) % (SMALL + 1)])
            yield from crowd(int(key), rep, members)
        if batch is not None and len(held_k) > SMALL:
            hot = (int(held_k[0]), int(held_c[int(held_k[0]) % (SMALL + 1)]))
            held_k, held_c = held_k[:0], held_c[:0]


def _near(a: str, b: str) -> Column:
    """Size and sketch allow a link."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SKETCH[1:]),
                F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    most = (x + y) * (SHARE[1] - SHARE[0]) >= apart * (SHARE[0] + SHARE[1])
    return (SHARE[1] * F.least(x, y) >= SHARE[0] * F.greatest(x, y)) & most


def _wide_near(x: Column, y: Column, total: Column) -> Column:
    """Wide sketches allow a link; sizes that differ by a third have widths that differ by a
    factor of two at most."""
    width = F.least(F.size(x), F.size(y))
    both = lambda a, b: a.bitwiseXOR(b)

    def folded(v: Column) -> Column:
        halves = F.zip_with(F.slice(v, F.lit(1), width), F.slice(v, width + 1, width), both)
        return F.when(F.size(v) > width, halves).otherwise(v)

    apart = F.aggregate(F.zip_with(folded(x), folded(y), both), F.lit(0), lambda n, w: n + F.bit_count(w))
    return total * (SHARE[1] - SHARE[0]) >= apart * (SHARE[0] + SHARE[1])


#: bits of the bitmap of wanted texts: 1 MB, whatever the number of texts
_BITMAP = 23


def _sets(docs: DataFrame, text: str, needed: DataFrame) -> DataFrame:
    """(class, items) of the needed classes: one text of each, with the mark given for it, is read."""
    slot = F.col("mark").bitwiseAND(F.lit((1 << _BITMAP) - 1))
    sent_bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(needed.select(slot.alias("slot")), _BITMAP))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.asarray(batch.column(0)).view(_U) & _U((1 << _BITMAP) - 1)
            yield batch.filter(pa.array(_in_bitmap(sent_bitmap.value, slots)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for _, t in pieces(wanted(batches), text):
            own, value = shingles(t)
            first = _per_text(own, t.n)
            classes = _classes(value, first)
            new = _unsent(classes, sent)
            bounds = np.concatenate([[0], np.cumsum(np.diff(first)[new])])
            sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(value[new[own]].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(classes[new]), sets], ["class", "items"])

    found = docs.select(_mark(text), text).mapInArrow(run, "class BIGINT, items ARRAY<BIGINT>")
    return found.join(needed, "class", "left_semi").dropDuplicates(["class"])


def verified(pairs: DataFrame, classes: DataFrame, measured: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) that are linked."""
    side = classes.select("class", "n", *_SKETCH)
    x, y = side.alias("x"), side.alias("y")
    near = written(
        pairs.select("a", "b").distinct()
        .join(x, F.col("a") == F.col("x.class")).join(y, F.col("b") == F.col("y.class"))
        .where(_near("x", "y")).select("a", "b", (F.col("x.n") + F.col("y.n")).alias("total")),
        "pairs",
    )
    wide = (
        measured.select("class", "wide").join(_members(near), "class", "left_semi").dropDuplicates(["class"])
    )
    closer = written(
        near.join(wide.select(F.col("class").alias("a"), F.col("wide").alias("x")), "a")
        .join(wide.select(F.col("class").alias("b"), F.col("wide").alias("y")), "b")
        .where(_wide_near(F.col("x"), F.col("y"), F.col("total")))
        .select("a", "b"),
        "closer_pairs",
    )
    needed = classes.select("class", "mark").join(_members(closer), "class", "left_semi")
    sets = written(_sets(docs, text, needed), "sets")
    both = (
        closer.join(sets.select(F.col("class").alias("a"), F.col("items").alias("x")), "a")
        .join(sets.select(F.col("class").alias("b"), F.col("items").alias("y")), "b")
    )
    common = F.size(F.array_intersect("x", "y"))
    joined = F.size("x") + F.size("y") - common
    linked = written(both.where(SHARE[1] * common >= SHARE[0] * joined).select("a", "b"), "linked_pairs")
    discard(near, closer, sets)
    return linked


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()


def _forest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges, nearest first, join two trees of the ``n`` nodes."""
    root = list(range(n))
    keep = np.zeros(len(a), bool)
    for e in np.argsort(apart, kind="stable").tolist():
        x, y = int(a[e]), int(b[e])
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[x] = y
            keep[e] = True
    return keep


def _crowded_pairs(members: DataFrame, roots: DataFrame, measured: DataFrame, forest: bool) -> DataFrame:
    """Near pairs of different components among the members of large keys, written: (key, a, b), key
    null. Where ``forest`` leaves out pairs of a key, a row has that key and no pair."""
    labelled = (
        members.join(roots.select(F.col("node").alias("a"), "root"), "a", "left")
        .select("key", F.col("a").alias("class"), F.coalesce("root", "a").alias("root"))
    )
    # of each key the component with most members, and how many members it and the others have
    most = (
        labelled.groupBy("key", "root").agg(F.count("class").alias("m"))
        .groupBy("key").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("all"))
        .where(F.col("all") > F.col("main.m"))
    )
    marks = labelled.groupBy("key").agg(
        F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y")
    )
    sizes = (
        most.join(marks, "key")
        .groupBy("all", "x", "y").agg(F.min(F.struct("key", "main")).alias("first"))  # keys with the same members
        .select(
            "first.key", F.col("first.main.root").alias("main"),
            F.ceil(F.col("first.main.m") / BLOCK).cast("int").alias("inside"),
            F.ceil((F.col("all") - F.col("first.main.m")) / BLOCK).cast("int").alias("outside"),
        )
    )
    left = written(labelled.join(sizes, "key"), "crowds")
    sketched = measured.select("class", "n", "wide").join(left.select("class").distinct(), "class", "left_semi").dropDuplicates(["class"])
    # members of the main component, in blocks of their own, meet the blocks of the others only;
    # these meet all blocks
    is_main = F.col("root") == F.col("main")
    hashed = F.xxhash64("class")
    own = F.when(is_main, F.pmod(hashed, "inside")).otherwise(F.col("inside") + F.pmod(hashed, "outside")).cast("int")
    low = F.when(is_main, F.col("inside")).otherwise(F.lit(0))
    dealt = (
        left
        .join(sketched, "class")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(low, F.col("inside") + F.col("outside") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    )
    fields = ["key", "i", "j", "own", "class", "root", "n"]

    def compare(group: np.ndarray, wide: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Members of blocks i and j of a key; those of one block are compared where i = j.
        Their sketches (words ``at`` of ``wide``) are folded to the least width among them."""
        size = at[1:] - at[:-1]
        width = int(size.min())
        words = wide[at[0] : at[-1]]
        if (size == width).all():
            sketch = words.reshape(-1, width)
        else:
            sketch = np.stack([np.bitwise_xor.reduce(wide[a:b].reshape(-1, width), axis=0) for a, b in zip(at[:-1], at[1:], strict=True)])
        sketch = sketch.view(_U)
        i, j = group[0, 1], group[0, 2]
        rows = np.flatnonzero(group[:, 3] == i)
        others = rows if i == j else np.flatnonzero(group[:, 3] == j)
        a, b, d = [], [], []
        step = max(1, (1 << 20) // max(1, len(others) * width))
        for low in range(0, len(rows), step):
            part = rows[low : low + step]
            apart = np.bitwise_count(sketch[part][:, None, :] ^ sketch[others][None, :, :]).sum(axis=2, dtype=np.int64)
            x, y = group[part, 6][:, None], group[others, 6][None, :]
            ok = (x + y) * (SHARE[1] - SHARE[0]) >= apart * (SHARE[0] + SHARE[1])
            ok &= SHARE[1] * np.minimum(x, y) >= SHARE[0] * np.maximum(x, y)
            ok &= group[part, 5][:, None] != group[others, 5][None, :]
            if i == j:
                ok &= group[part, 4][:, None] < group[others, 4][None, :]
            p, q = np.nonzero(ok)
            a.append(part[p]), b.append(others[q]), d.append(apart[p, q])
        if not a:
            return group[:0, 4], group[:0, 4], False
        a, b, d = np.concatenate(a), np.concatenate(b), np.concatenate(d)
        if forest:
            # members of one component are one node
            _, node = np.unique(group[:, 5], return_inverse=True)
            keep = _forest(node[a], node[b], d, len(group))
            return group[a[keep], 4], group[b[keep], 4], not keep.all()
        return group[a, 4], group[b, 4], False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # a group that may go on: two blocks at most
        ends: list[pa.RecordBatch | None] = [None]
        for batch in (x for part in (batches, ends) for x in part):
            rows, wide, size = held or (np.zeros((0, len(fields)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            if batch is not None:
                lists = batch.column(len(fields))
                rows = np.concatenate([rows, np.stack([np.asarray(c) for c in batch.columns[:-1]], axis=1)])
                wide = np.concatenate([wide, np.asarray(lists.flatten())])
                size = np.concatenate([size, np.asarray(lists.value_lengths()).astype(np.int64)])
            if not len(rows):
                continue
            at = np.concatenate([[0], np.cumsum(size)])
            cut = np.concatenate([[0], np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1, [len(rows)]])
            if batch is not None:
                held = rows[cut[-2] :], wide[at[cut[-2]] :], size[cut[-2] :]
                cut = cut[:-1]
            found = [
                (rows[a, 0], compare(rows[a:b], wide, at[a : b + 1])) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a + 1
            ]
            if found:
                x, y = (np.concatenate([f[1][side] for f in found]) for side in (0, 1))
                again = np.array([key for key, (_, _, more) in found if more], np.int64)
                key = pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(again)])
                none = pa.nulls(len(again), pa.int64())
                a, b = (pa.concat_arrays([pa.array(f(x, y)), none]) for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([key, a, b], ["key", "a", "b"])

    order = ("key", "i", "j")
    rows = dealt.select(*[F.col(c).cast("long") for c in fields], "wide")
    met = rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "key BIGINT, a BIGINT, b BIGINT")
    crowded = written(met, "crowded")
    discard(left)
    return crowded


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    read = written(measure(docs, key, text), "sets_measured")
    measured = read.where(F.col("slot").isNull()).drop("slot")
    classes = written(
        measured.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(*[F.min(s).alias(s) for s in ("doc", "mark", "n", *_SKETCH)]),
        "classes",
    )
    met = written(
        keyed(docs, common_slots(read), text).repartition("key").sortWithinPartitions("key", "class").mapInArrow(_meet, "key BIGINT, a BIGINT, b BIGINT"),
        "meetings",
    )
    links = verified(met.where(F.col("b").isNotNull()), classes, measured, docs, text)
    roots = connected(links)
    members = met.where(F.col("b").isNull()).select("key", "a")
    spent = [met]
    for forest in (True, False):
        if members.isEmpty():
            break
        crowded = _crowded_pairs(members, roots, measured, forest)
        spent.append(crowded)
        pairs = crowded.where(F.col("key").isNull())
        if not pairs.isEmpty():
            more = verified(pairs, classes, measured, docs, text)
            former, links = links, written(links.union(more), "links")
            discard(former, more)
            roots = connected(links)
        members = members.join(crowded.where(F.col("key").isNotNull()).select("key").distinct(), "key", "left_semi")
    discard(*spent)
    rooted = classes.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select(
        "class", "doc", F.coalesce("root", "class").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = rooted.join(least, "root").select("class", "component_id")
    linked = measured.where(F.col("class").isNotNull()).join(named, "class")
    empty = measured.where(F.col("class").isNull()).withColumn("component_id", F.col("doc"))
    out = [F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id"]
    return linked.select(*out).unionByName(empty.select(*out))
