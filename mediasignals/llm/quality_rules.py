"""Quality rules whose cutoffs are chosen under risk control.

``measure`` counts a few plain signals of each text. ``choose_cutoffs`` looks at labelled
documents and walks one combined rule for each stratum (a band of word counts): it begins with
all signals off, each step takes one signal to its next cutoff of a fixed grid, and the step is
certified while the exact binomial (Clopper-Pearson) upper bound on the share of good documents
that the signals together reject stays within the allowed risk. (The sum of the documents over
each cutoff stands for those over any, which it is never below.) The rules are nested and tested
in fixed order, so that the walk has the whole risk and the whole error probability of its
stratum. With probability ``1 - error`` no stratum loses more than ``risk`` of its good documents.

The order of the steps must not depend on the documents it is tested on: one in ``PILOT`` of the
good ones, by a hash of the id, and the bad ones choose it (most bad documents for the fewest good
ones first), and only the other good ones are tested. Of the certified steps the one with the
largest gain (share of bad documents rejected less share of good ones) is used; where nothing is
certified, or nothing gained, the rule is off.

Strata with too few good documents to certify even a rule that rejects none of them, at the error
probability of one of all strata, are merged with the next longer one until there are enough, and
what is left at the end with the one before; only labelled strata count. The guarantee then holds
for the merged stratum. The error probability is divided over the strata that remain.

Defined results: a null text has no words and fails the base rule, as does an empty one;
repeated rows are judged each by itself; a document with several labels counts as its lowest
one, labels that are null do not count; without labels all rules are off; an input column
that has the name of the result column is replaced by it. No text is shortened.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_np import SPACED, Texts, add_per_text, mix, owners, pieces, windows, with_struct

RESULT = "quality_signals"
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_marks", "n_digits",
]
SHARES = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)
#: signal -> cutoffs from lax to strict; a text is rejected above the cutoff
GRIDS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (2.0, 1.5, 1.0, *SHARES),
    "marks_per_word": (2.0, 1.5, 1.0, *SHARES),
    "upper_share": SHARES,
    "dup_line_share": SHARES,
    "repeat_share": SHARES,
    "digit_share": SHARES,
    "words_per_char": (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25),
    "chars_per_word": (60.0, 40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0),
}
#: lower ends of the strata, in words
BANDS = (0, 100, 200, 400, 800, 1600)
RISK, ERROR = 0.02, 0.05
#: one in so many good documents helps to order the steps
PILOT = 4

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_CHAR_START = (np.arange(256) & 0xC0) != 0x80
_REPEAT = 3


def _counts(t: Texts) -> dict[str, np.ndarray]:
    starts, ends, first = t.spans(SPACED)
    inside = SPACED[t.data] != 0
    out = {"n_words": np.diff(first).astype(np.int64)}
    out["word_chars"] = t.count_bytes(inside & _CHAR_START[t.data])
    for name, flags in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_marks", _MARK), ("n_digits", _DIGIT)):
        out[name] = t.count_bytes(flags[t.data])
    # lines: every newline ends one, every text has one more
    breaks = np.flatnonzero(t.data == 10)
    line_start = np.sort(np.concatenate([t.bounds[:-1], breaks + 1]))
    per_text = t.count_bytes(t.data == 10) + 1
    line_first = np.concatenate([[0], np.cumsum(per_text)])
    line_end = np.empty_like(line_start)
    line_end[:-1] = line_start[1:] - 1
    line_end[line_first[1:] - 1] = t.bounds[1:]
    worded = np.concatenate([[0], np.cumsum(inside)])
    filled = worded[line_end] > worded[line_start]
    own = owners(line_first)
    code = mix(t.hashes(line_start, line_end) + (line_end - line_start).astype(np.uint64))
    code = mix(code ^ mix(own.astype(np.uint64) + np.uint64(1)))[filled]
    _, at = np.unique(code, return_index=True)
    again = np.ones(len(code), np.int64)
    again[at] = 0
    full = np.zeros(len(own), np.int64)
    full[np.flatnonzero(filled)] = again
    out["n_dup_lines"] = add_per_text(line_first, full)
    out["n_lines"] = add_per_text(line_first, filled.astype(np.int64))
    # words inside windows that the text has twice or more
    at, code = windows(t.hashes(starts, ends), first, _REPEAT)
    own = owners(first)
    _, inverse, count = np.unique(
        mix(code ^ mix(own[at].astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True
    )
    hit = np.zeros(len(starts), np.int64)
    repeated = at[count[inverse] > 1] if len(at) else at
    for i in range(_REPEAT):
        hit[repeated + i] = 1
    out["n_repeat_words"] = add_per_text(first, hit)
    return out


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct ``quality_signals`` of the counts."""
    docs = docs.drop(RESULT)
    schema = with_struct(docs, RESULT, ", ".join(f"{c}: BIGINT" for c in COUNTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in pieces(batches, text):
            counts = _counts(t)
            struct = pa.StructArray.from_arrays([pa.array(counts[c], pa.int64()) for c in COUNTS], COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, RESULT])

    return docs.mapInArrow(run, schema)


def base_failed(q: str = RESULT) -> Column:
    n = F.col(f"{q}.n_words")
    return (n < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * n)


def signals(q: str = RESULT) -> dict[str, Column]:
    """The signals the rules judge; texts without words have 0 everywhere."""
    c = {name: F.col(f"{q}.{name}").cast("double") for name in COUNTS}

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return {
        "symbols_per_word": share(c["n_symbols"], c["n_words"]),
        "marks_per_word": share(c["n_marks"], c["n_words"]),
        "upper_share": share(c["n_upper"], c["word_chars"]),
        "dup_line_share": share(c["n_dup_lines"], c["n_lines"]),
        "repeat_share": share(c["n_repeat_words"], c["n_words"]),
        "digit_share": share(c["n_digits"], c["word_chars"]),
        "words_per_char": share(c["n_words"], c["word_chars"]),
        "chars_per_word": share(c["word_chars"], c["n_words"]),
    }


def stratum(q: str = RESULT, bands: tuple[int, ...] = BANDS) -> Column:
    n = F.col(f"{q}.n_words")
    return sum(((n >= low).cast("int") for low in bands[1:]), F.lit(0)).cast("int")


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable: the Clopper-Pearson upper bound for k of n stays
    within p exactly where this is at most the error probability."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1, dtype=float)
    steps = np.log(np.maximum(n - i[:-1], 1)) - np.log(i[:-1] + 1) + math.log(p) - math.log1p(-p)
    logs = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)])
    top = logs.max()
    return min(1.0, float(math.exp(top) * np.exp(logs - top).sum()))


def label_counts(measured: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Of labelled documents that pass the base rule, how many of each stratum and signal
    exceed exactly the last ``exceeded`` cutoffs of the grid (``n_good`` to test, ``n_bad``, and
    ``n_pilot`` good ones to order the steps)."""
    judged = (
        labels.where(F.col(quality).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.min(quality).alias("_quality"))
    )
    rows = measured.where(~base_failed()).select(
        F.col(key).alias("_key"),
        stratum().alias("stratum"),
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("signal"),
                    # grids fall, so the cutoffs exceeded are the last ones
                    sum(((value > cut).cast("int") for cut in GRIDS[name]), F.lit(0)).alias("exceeded"),
                )
                for name, value in signals().items()
            ]
        ).alias("_signals"),
    )
    return (
        rows.join(judged, "_key")
        .withColumn("_pilot", F.pmod(F.xxhash64("_key"), F.lit(PILOT)) == 0)
        .select("stratum", "_quality", "_pilot", F.explode("_signals").alias("s"))
        .groupBy("stratum", "s.signal", "s.exceeded")
        .agg(
            F.count(F.when((F.col("_quality") > 0) & ~F.col("_pilot"), 1)).alias("n_good"),
            F.count(F.when(F.col("_quality") <= 0, 1)).alias("n_bad"),
            F.count(F.when((F.col("_quality") > 0) & F.col("_pilot"), 1)).alias("n_pilot"),
        )
    )


def merged(good: dict[int, int], least: int) -> list[list[int]]:
    """Neighbouring strata in groups of at least ``least`` good documents, if there are so many."""
    groups: list[list[int]] = []
    for s in sorted(good):
        if groups and sum(good[x] for x in groups[-1]) < least:
            groups[-1].append(s)
        else:
            groups.append([s])
    if len(groups) > 1 and sum(good[x] for x in groups[-1]) < least:
        rest = groups.pop()
        groups[-1] += rest
    return groups


def walk(bad: dict[str, np.ndarray], pilot: dict[str, np.ndarray]) -> Iterator[tuple[str, int]]:
    """Steps (signal, place of the cutoff) of the combined rule; the counts are of documents over
    each cutoff."""
    at = dict.fromkeys(bad, -1)
    while True:
        found = []
        for place, name in enumerate(bad):
            b, g = bad[name], pilot[name]
            now = at[name]
            had, lost = (b[now], g[now]) if now >= 0 else (0, 0)
            for to in range(now + 1, len(b)):
                if b[to] > had:
                    found.append((-(b[to] - had) / (g[to] - lost + 0.5), to, place, name))
        if not found:
            return
        _, to, _, name = min(found)
        for i in range(at[name] + 1, to + 1):
            yield name, i
        at[name] = to


def choose_cutoffs(
    counts: list[tuple[int, ...]], risk: float = RISK, error: float = ERROR
) -> dict[tuple[int, str], float]:
    """The cutoff of each (stratum, signal) that has one.

    ``counts``: rows of ``label_counts`` (the pilot's may be left out); there are at most strata x
    signals x grid of them, whatever the size of the input.
    """
    table: dict[int, dict[str, np.ndarray]] = defaultdict(lambda: {n: np.zeros((len(c) + 1, 3), int) for n, c in GRIDS.items()})
    for s, name, exceeded, *numbers in counts:
        table[s][name][exceeded, : len(numbers)] += numbers
    totals = {s: np.max([by.sum(axis=0) for by in names.values()], axis=0) for s, names in table.items()}
    least = math.ceil(math.log(error / len(BANDS)) / math.log1p(-risk))
    groups = merged({s: int(n[0]) for s, n in totals.items()}, least)
    chosen = {}
    for group in groups:
        n_good, n_bad, _ = sum(totals[s] for s in group).tolist()
        if not n_good or not n_bad:
            continue
        # a text that exceeds j cutoffs exceeds the last j
        over = {name: np.cumsum(sum(table[s][name] for s in group)[:0:-1], axis=0) for name in GRIDS}
        good, bad, pilot = ({name: n[:, i] for name, n in over.items()} for i in range(3))
        best, used, at = 0.0, {}, {}
        for name, i in walk(bad, pilot):
            at[name] = i
            rejected = sum(int(good[x][j]) for x, j in at.items())
            if tail(rejected, n_good, risk) > error / len(groups):
                break
            gain = sum(int(bad[x][j]) for x, j in at.items()) / n_bad - rejected / n_good
            if gain > best:
                best, used = gain, dict(at)
        chosen |= {(s, name): GRIDS[name][i] for s in group for name, i in used.items()}
    return chosen


def fit(measured: DataFrame, labels: DataFrame, key: str = "doc_id", risk: float = RISK, error: float = ERROR) -> dict[tuple[int, str], float]:
    rows = label_counts(measured, labels, key).collect()  # strata x signals x grid
    return choose_cutoffs([tuple(r) for r in rows], risk, error)


def reasons(cutoffs: dict[tuple[int, str], float]) -> Column:
    """The names of the rules that reject a document."""
    values, band = signals(), stratum()
    broken = [
        F.when((band == s) & (values[name] > cut), F.lit(name))
        for (s, name), cut in sorted(cutoffs.items())
    ]
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(measured: DataFrame, cutoffs: dict[tuple[int, str], float]) -> DataFrame:
    """``measured`` with ``base_failed``, ``reasons`` and ``kept``."""
    return measured.withColumns({"base_failed": base_failed(), "reasons": reasons(cutoffs)}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("reasons") == 0)
    )
