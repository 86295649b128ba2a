"""Line dedup by a segment-partition edit join.

Lines (split at newlines, compared without white space at their ends) of at least
``MIN_CHARS`` characters are near copies if at most ``EDITS`` single-character edits tell them
apart. A line is cut into ``EDITS + 1`` segments of even length; of two near lines the longer
one contains a segment of the shorter one, unchanged and hardly moved. The index holds each
line's segments with its length; a line probes it, for its own and each slightly smaller
length, with those substrings that may still be the segment (the multi-match-aware
positions). Two lines that meet have the parities of their character counts compared, as 64 bits of
which an edit changes at most two, and are then verified by a banded
bit-parallel edit distance: a column of ``2 * EDITS + 1`` cells is one integer.

A line goes if an equal or near line stands earlier, in order of document id and line number;
the first one stays. Equal lines go whatever their length, near ones only from ``MIN_CHARS``
characters on; blank lines are never compared and always stay.

Only one earlier line has to be found. So under each key a line is first compared with the
earliest one alone, which is linear and settles a family of near copies; only lines that this leaves
open are compared with the other earlier ones of their keys, and of these comparisons only
those that pass the parities become rows.

Only DataFrame functions. Equal lines are one row before the join, so that a line found in a
third of all documents is joined once. Texts of lines are fetched for those that share a key.

Defined results: a null text has no lines, its row stays as it is; an empty text has one empty
line; a null id comes after all others, and rows with null ids count as rows that share an id;
rows that share an id are dropped from each by its own text, and equal lines that stand at the same
place of such rows are one line, so that all of them stay; input columns with the names of result
columns are replaced. No text is shortened.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, written

EDITS = 2
MIN_CHARS = 20
#: an edit replaces one character by another
BITS_PER_EDIT = 2
_DROPS = "_line_drops"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment ``i`` (from 1); the last ones are one longer."""
    size = F.floor(length / parts).cast("int")
    short = F.lit(parts) - (length - size * parts)
    start = size * (i - 1) + F.greatest(i - 1 - short, F.lit(0))
    return start, size + (i > short).cast("int")


def keyed(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(key, tag): the keys under which a line may find a near line of its own or a smaller length. The
    tag is the id, which has 63 bits, and a last bit for the keys of the line's own segments, where
    it is found. A place per row (how much smaller the other line is, segment, how far it has moved)
    keeps the compiled code of a key small."""
    parts = edits + 1
    places = [
        (less, i, move)
        for less in range(edits + 1)
        for i in range(1, parts + 1)
        for move in range(max(-(i - 1), less - (parts - i)), min(i - 1, less + (parts - i)) + 1)
    ]
    where = F.array(*[F.struct(F.lit(n).alias("less"), F.lit(i).alias("i"), F.lit(m).alias("move")) for n, i, m in places])
    dealt = lines.select("id", "line", "size", F.explode(where).alias("p"))
    other = F.col("size") - F.col("p.less")
    start, size = _segment(other, F.col("p.i"), parts)
    at = start + F.col("p.move")
    key = F.xxhash64("p.i", other, F.substring(F.col("line"), at + 1, size))
    own = (F.col("p.less") == 0) & (F.col("p.move") == 0)
    tag = F.shiftleft("id", 1).bitwiseOR(own.cast("long"))
    return dealt.where((other > 0) & (at >= 0) & (at + size <= F.col("size"))).select(key.alias("key"), tag.alias("tag"))


def symbol_parity(line: Column) -> Column:
    """64 bits, each toggled once for every character whose code has its last six bits."""
    one = F.lit(1).cast("long")
    return F.aggregate(
        F.split(line, ""), F.lit(0).cast("long"),
        lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", one, F.ascii(c).bitwiseAND(F.lit(63)))),
    )


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether the edit distance of two texts is at most ``edits``.

    Bit ``i`` of a column stands for row ``column - edits + i`` of the distance table; vertical
    differences of +1 and -1 are kept in two integers, and the distance is followed down the
    band's last row until the end of ``a``, then along it.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1

    def flip(x: Column) -> Column:
        return x.bitwiseXOR(F.lit(full).cast("long"))

    def bit(x: Column, at: Column) -> Column:
        return F.when(at >= 0, F.call_function("shiftright", x, F.greatest(at, F.lit(0))).bitwiseAND(F.lit(1))).otherwise(0).cast("int")

    def distance(rows: Column, size: Column) -> Column:
        zero = F.struct(
            F.lit(0).alias("at"),
            F.lit(full & ~((1 << edits) - 1)).cast("long").alias("up"),
            F.lit(0).cast("long").alias("down"),
            F.least(size, F.lit(edits)).alias("distance"),
        )

        def step(s: Column, c: Column) -> Column:
            equal = sum(
                (F.coalesce(F.get(rows, s["at"] + (i - edits)) == c, F.lit(False)).cast("long") * (1 << i) for i in range(1, width)),
                F.coalesce(F.get(rows, s["at"] - edits) == c, F.lit(False)).cast("long"),
            )

            def diagonal(m: Column) -> Column:
                carried = (m.bitwiseAND(s["up"]) + s["up"]).bitwiseAND(F.lit(full).cast("long"))
                return carried.bitwiseXOR(s["up"]).bitwiseOR(m).bitwiseOR(s["down"])

            def column(d: Column) -> Column:
                right = s["down"].bitwiseOR(flip(d.bitwiseOR(s["up"])))
                left = d.bitwiseAND(s["up"])
                moved = F.call_function("shiftright", d, F.lit(1))
                j = s["at"] + 1
                row = size - j + edits  # where the last row of the table is
                along = s["distance"] + bit(right, row) - bit(left, row)
                down = s["distance"] + 1 - bit(d, F.lit(width - 1))
                return F.struct(
                    j.alias("at"),
                    left.bitwiseOR(flip(moved.bitwiseOR(right))).alias("up"),
                    moved.bitwiseAND(right).alias("down"),
                    F.when(j + edits <= size, down).otherwise(along).alias("distance"),
                )

            return let(equal, lambda m: let(diagonal(m), column))

        return F.aggregate(_characters(b), zero, step, lambda s: s["distance"])

    close = F.abs(F.length(a) - F.length(b)) <= edits
    return F.when(close, let(_characters(a), lambda rows: distance(rows, F.size(rows))) <= edits).otherwise(False)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, row, pos, line) of all lines that are not blank; ``row`` tells the texts of an id apart."""
    line = F.btrim(F.col("raw"), F.lit(" \t\x0b\f\r"))
    return (
        docs.select(
            F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("pos", "raw")
        )
        .select("doc", "row", "pos", line.alias("line"))
        .where(F.length("line") > 0)
    )


def _order() -> Column:
    """Place of a line in the corpus, as one number; without an id after all others."""
    doc = F.coalesce(F.col("doc").cast("decimal(19,0)"), F.lit(str(1 << 63)).cast("decimal(19,0)"))
    return doc * F.lit(10**10).cast("decimal(11,0)") + F.col("pos").cast("decimal(10,0)")


def near_later(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """Ids of the lines with an earlier near line. ``lines``: id (of 63 bits), line, size (in
    characters), first (a number that orders them)."""
    key = Window.partitionBy("key")
    of_tag = F.shiftrightunsigned("tag", 1)
    shared = written(
        keyed(lines, edits)
        .select("key", "tag", F.min(of_tag).over(key).alias("low"), F.max(of_tag).over(key).alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("key", of_tag.alias("id"), (F.col("tag").bitwiseAND(F.lit(1)) == 1).alias("own")),
        "shared_keys",
    )
    # a merge join at every size
    ids = shared.select("id").distinct().hint("merge")
    texts = written(
        lines.join(ids, "id", "left_semi").select("id", "first", "line", symbol_parity(F.col("line")).alias("bits")), "met_texts"
    )
    placed = shared.join(texts.select("id", "first"), "id")
    place = F.struct("first", "id")
    earliest_of = placed.groupBy("key").agg(F.min(F.when(F.col("own"), place)).alias("o"), F.min(place).alias("a")).where("o IS NOT NULL")
    met = written(placed.join(earliest_of, "key").select("key", "own", "id", "first", "o", "a"), "met_lines")

    def alike(x: Column, y: Column) -> Column:
        return F.bit_count(x.bitwiseXOR(y)) <= BITS_PER_EDIT * edits

    def verified(pairs: DataFrame) -> DataFrame:
        one = texts.select("id", F.col("line").alias("b"), F.col("bits").alias("b_bits"))
        other = texts.select(F.col("id").alias("x"), F.col("line").alias("a"), F.col("bits").alias("a_bits"))
        both = pairs.join(one, "id").join(other, "x")
        return both.where(alike(F.col("a_bits"), F.col("b_bits")) & within(F.col("a"), F.col("b"), edits)).select("id").distinct()

    earliest = met.where("o.first < first").select("id", F.col("o.id").alias("x")).union(
        met.where("own AND a.first < first").select("id", F.col("a.id").alias("x"))
    )
    settled = written(verified(earliest.distinct()), "settled_lines")
    parity = texts.select("id", "bits")
    # a line without an earlier one under any key is settled, too
    left = met.where("a.first < first").join(settled, "id", "left_anti").join(parity, "id")
    before = met.join(parity, "id").select(
        "key", F.col("id").alias("x"), F.col("own").alias("x_own"), F.col("first").alias("x_first"), F.col("bits").alias("x_bits")
    )
    compared = (F.col("x") == F.col("o.id")) | (F.col("own") & (F.col("x") == F.col("a.id")))
    further = left.join(before, "key").where(
        (F.col("x_first") < F.col("first")) & (F.col("own") | F.col("x_own")) & ~compared & alike(F.col("bits"), F.col("x_bits"))
    )
    pairs = written(further.select("id", "x").distinct(), "line_pairs")
    later = written(settled.union(verified(pairs)), "near_lines")
    discard(shared, met, texts, settled, pairs)
    return later


def dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """All columns of ``docs`` with the kept lines as text, and ``n_lines``, ``n_equal`` and
    ``n_near`` (lines dropped as equal to or near an earlier one; equal comes first)."""
    identity = [
        F.shiftrightunsigned(F.xxhash64("line"), 1).alias("id"), F.xxhash64(F.lit(1), "line").alias("check"),
    ]
    lines = written(
        _occurrences(docs, key, text)
        .groupBy("line")
        .agg(F.min(_order()).alias("first"), F.count("pos").alias("n"))
        .select(*identity, "line", F.length("line").alias("size"), "first", "n"),
        "lines",
    )
    later = near_later(lines.where(F.col("size") >= min_chars), edits)
    doomed = written(
        lines.select("id", "check", "first", "n").join(later.withColumn("near", F.lit(True)), "id", "left")
        .where((F.col("n") > 1) | F.col("near"))
        .select("id", "check", "first", F.coalesce("near", F.lit(False)).alias("near")),
        "doomed_lines",
    )
    discard(lines, later)
    drops = (
        _occurrences(docs, key, text)
        .select("doc", "row", "pos", *identity)
        .join(doomed, ["id", "check"])
        .withColumn("again", _order() != F.col("first"))
        .where(F.col("again") | F.col("near"))
        .select("doc", "row", "pos", "again")
        .distinct()  # rows may be repeated
        .groupBy("doc", "row")
        .agg(
            F.collect_list("pos").alias("at"),  # of one text
            F.count_if("again").alias("n_equal"),
            F.count_if(~F.col("again")).alias("n_near"),
        )
    )
    rest = [c for c in docs.columns if c not in (text, "n_lines", "n_equal", "n_near")]
    split = F.split(F.col(f"d.{text}"), "\n")

    def kept(all_lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(f"{_DROPS}.at"))
        return F.array_join(F.transform(places, lambda i: F.get(all_lines, i)), "\n")

    same = F.col(f"d.{key}").cast("long").eqNullSafe(F.col(f"{_DROPS}.doc")) & (F.xxhash64(f"d.{text}") == F.col(f"{_DROPS}.row"))
    return docs.alias("d").join(drops.alias(_DROPS), same, "left").select(
        *[F.col(f"d.{c}") for c in rest],
        F.when(F.col(f"{_DROPS}.at").isNull(), F.col(f"d.{text}")).otherwise(let(split, kept)).alias(text),
        F.when(F.col(f"d.{text}").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(f"{_DROPS}.n_equal", F.lit(0)).alias("n_equal"),
        F.coalesce(f"{_DROPS}.n_near", F.lit(0)).alias("n_near"),
    )
