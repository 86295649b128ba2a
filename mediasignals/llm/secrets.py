"""Secret scans: fixed patterns, and a battery of randomness tests for everything else.

The base patterns (``assign``, ``access``, ``hex``) always count. Beyond them, every run of 20
or more characters that an encoded value may hold is a candidate, also one of letters only. Its
encoding is inferred from its characters (digits, hexadecimal, one case with or without digits,
base 62, base 64).

A candidate's p-value is that of being ordinary text of its own length and encoding. Text is a
chain of characters: the pairs of neighbouring characters of all words of the corpus (Laplace's
rule within the alphabet, and ``NOISE`` of uniform symbols) give the probability of the
candidate as text. Under that chain the ratio of the uniform to the text probability exceeds r
at most once in r times; the p-value is its inverse times the number of encodings. A corpus of
any size has pairs of characters, whether or not it has long words. Runs of 20 or more
characters that are not plain words do not count for the chain.

What is unlike text need not be random (rules of dashes, paths of single letters). Three tests
ask whether the symbols could be independent uniform draws from the alphabet: a chi-squared test
of symbol counts, a runs test of lower against upper half, and a test of lag-one serial
correlation. Where three times the smallest p-value is under ``LEVEL``, the candidate has p-value 1
in the first question; about that share of truly random values is lost. Within each band of
lengths the Benjamini-Hochberg rule at ``FALSE_SHARE`` picks the candidates that are reported as
``random``; candidates on base spans are left out of it. P-values are compared in steps of a
quarter of a decade.

Only DataFrame functions; one pass over the texts for the pairs and one for the candidates. The
chosen limits (one number for each band) and the chain (one number for each pair of symbols) are
literals of the last step.

Defined results: a null text counts as empty; repeated rows are scanned each by itself;
in a corpus without words, or an empty table, nothing is added to the base spans; input columns with the names of result columns are replaced. No text is shortened.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

KINDS = ("assign", "access", "hex", "random")
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    # runs of [0-9a-f]+ shorter than the least length fail anyway
    "hex": r"[0-9a-f]{32,}",
}
LEAST = {"assign": 8, "access": 16, "hex": 32}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z0-9+/_=-]+"
LETTERS = "^(?:[A-Za-z][a-z]+|[A-Z]+)$"
#: lower ends of the bands of lengths
BANDS = (20, 24, 32, 48, 64)
FALSE_SHARE = 0.05
#: of the battery; the share of uniform symbols in text
LEVEL, NOISE = 0.001, 0.05
_STEPS = 4 * 30  # of a quarter of a decade each
BASE, FOUND = "_base_spans", "_candidates"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs of start and end (code points, end
    exclusive), the match and its group. The text between the matches gives the places."""

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        parts = F.arrays_zip(
            F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("match"), groups.alias("value")
        )
        none = F.array().cast("array<struct<start:int,end:int,match:string,value:string>>")

        def step(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            end = start + F.length(x["match"])
            one = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), x["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
        walked = F.aggregate(parts, zero, step, lambda s: s["out"])
        return F.when(F.size(found) == 0, none).otherwise(walked)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(text: Column) -> Column:
    """Base spans as structs (start, rank of the kind, kind, end), in that order."""
    def of(rank: int, kind: str) -> Column:
        found = spans(text, PATTERNS[kind], group=2 if kind == "assign" else 0)
        return F.transform(
            F.filter(found, lambda x: F.length(x["value"]) >= LEAST[kind]),
            lambda x: F.struct(
                x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")
            ),
        )

    return F.array_sort(F.concat(*[of(rank, kind) for rank, kind in enumerate(PATTERNS)]))


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of a standard normal variable (a published rational approximation with an
    error below 1e-7, and the leading term of the tail beyond z = 5)."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    density = F.exp(-a * a / 2) * 0.3989422804014327
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.when(a > 5, density / a).otherwise(density * series)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding(token: Column) -> Column:
    """The inferred encoding; trailing padding was removed."""
    return (
        F.when(token.rlike("^[0-9]+$"), "digits")
        .when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike(LETTERS), "letters")
        .when(token.rlike("^(?:[a-z0-9]+|[A-Z0-9]+)$"), "one_case")
        .when(token.rlike("^[A-Za-z0-9]+$"), "base62")
        .otherwise("base64")
    )


ALPHABET = {"digits": 10, "hex": 16, "letters": 26, "one_case": 36, "base62": 62, "base64": 64}
_LOWER, _ALL = string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase + string.ascii_lowercase
#: the symbols in the order of ``_symbols``
_ORDER = {
    "digits": string.digits, "hex": _LOWER[:16], "letters": string.ascii_lowercase, "one_case": _LOWER,
    "base62": _ALL, "base64": _ALL + "+/",
}
FOLDED = ("hex", "letters", "one_case")


def _symbols(token: Column, kind: Column) -> Column:
    """Each character's place in the alphabet, from 0."""
    folded = F.when(kind.isin(*FOLDED), F.lower(token)).otherwise(token)

    def place(c: Column) -> Column:
        code = F.ascii(c)
        return (
            F.when(code.between(97, 122), code - F.when(kind.isin("base62", "base64"), 61).when(kind == "letters", 97).otherwise(87))
            .when(code.between(65, 90), code - 55)
            .when(code.between(48, 57), code - 48)
            .when(c.isin("+", "-"), 62)
            .otherwise(63)
        ).cast("double")

    return F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), place)


def combined_p(symbols: Column, alphabet: Column) -> Column:
    """Three times the least p-value of the battery, at most 1."""
    half = (alphabet - 1) / 2
    zero = F.struct(
        *[F.lit(0.0).alias(c) for c in ("n", "high", "runs", "sum", "squares", "products")],
        F.lit(-1.0).alias("last"), F.lit(0.0).alias("first"),
    )

    def step(s: Column, v: Column) -> Column:
        start = s["n"] == 0
        return F.struct(
            (s["n"] + 1).alias("n"),
            (s["high"] + F.when(v > half, 1.0).otherwise(0.0)).alias("high"),
            (s["runs"] + F.when(start | ((v > half) != (s["last"] > half)), 1.0).otherwise(0.0)).alias("runs"),
            (s["sum"] + v).alias("sum"),
            (s["squares"] + v * v).alias("squares"),
            (s["products"] + F.when(start, 0.0).otherwise(v * s["last"])).alias("products"),
            v.alias("last"),
            F.when(start, v).otherwise(s["first"]).alias("first"),
        )

    counts = F.aggregate(
        F.array_distinct(symbols), F.lit(0.0),
        lambda total, v: total + F.pow(F.size(F.filter(symbols, lambda x: x == v)).cast("double"), 2.0),
    )

    def tests(s: Column) -> Column:
        n = s["n"]
        free = alphabet - 1
        chi = s["squared_counts"] * alphabet / n - n
        # the cube root of chi-squared over its degrees is close to normal
        z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        high, low = s["high"], n - s["high"]
        mean_runs = 2 * high * low / n + 1
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        p_runs = F.when(var_runs > 0, 2 * upper_tail(F.abs(s["runs"] - mean_runs) / F.sqrt(var_runs))).otherwise(0.0)
        # the last symbol is followed by the first one
        spread = s["squares"] - s["sum"] * s["sum"] / n
        r = (s["products"] + s["last"] * s["first"] - s["sum"] * s["sum"] / n) / spread
        p_serial = F.when(spread > 0, 2 * upper_tail(F.abs(r + 1 / (n - 1)) * F.sqrt(n))).otherwise(0.0)
        return F.least(F.lit(1.0), 3 * F.least(upper_tail(z_chi), p_runs, p_serial))

    walked = F.aggregate(symbols, zero, step)
    return let(
        let(walked, lambda s: F.struct(
            *[s[c].alias(c) for c in ("n", "high", "runs", "sum", "squares", "products", "last", "first")],
            counts.alias("squared_counts"),
        )),
        tests,
    )


def candidates(text: Column) -> Column:
    """Candidates with band and whether the battery lets them pass as random."""

    def judged(x: Column) -> Column:
        def of(token: Column) -> Column:
            def with_kind(kind: Column) -> Column:
                size = F.when(kind == "digits", 10.0)
                for name, n in list(ALPHABET.items())[1:]:
                    size = size.when(kind == name, float(n))
                return F.struct(
                    x["start"].alias("start"),
                    (x["start"] + F.length(token)).alias("end"),
                    token.alias("token"),
                    kind.alias("encoding"),
                    sum((F.length(token) >= b).cast("int") for b in BANDS[1:]).alias("band"),
                    (let(_symbols(token, kind), lambda v: combined_p(v, size)) >= LEVEL).alias("uniform"),
                )

            return let(encoding(token), with_kind)

        return let(F.rtrim(x["match"], F.lit("=")), of)

    long_enough = F.filter(spans(text, CANDIDATE), lambda x: F.length(F.rtrim(x["match"], F.lit("="))) >= BANDS[0])
    return F.transform(long_enough, judged)


def pair_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each two characters are neighbours in words (a space stands for the start)."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    words = F.filter(found, lambda w: (F.length(w) < BANDS[0]) | w.rlike(LETTERS))
    padded = F.concat(F.lit(" "), F.col("word"))
    return (
        docs.select(F.explode(words).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: padded.substr(i, F.lit(2)))).alias("pair"))
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
    )


def chain(pairs: list[tuple[str, int]]) -> dict[str, np.ndarray]:
    """For each encoding the logarithm of uniform over text probability of each symbol (column)
    after each symbol, and at the start (last row)."""
    out = {}
    for kind, symbols in _ORDER.items():
        place = {c: i for i, c in enumerate(symbols)} | {" ": len(symbols)}
        if kind == "base64":
            place |= {"-": place["+"], "_": place["/"], "=": place["/"]}
        counts = np.zeros((len(symbols) + 1, len(symbols)))
        for pair, n in pairs:
            a, b = pair.lower() if kind in FOLDED else pair
            if a in place and b in place:
                counts[place[a], place[b]] += n
        size = len(symbols)
        text = (counts + 1) / (counts.sum(axis=1, keepdims=True) + size)
        out[kind] = -np.log(size * (1 - NOISE) * text + NOISE)
    return out


def rate(measured: DataFrame, text_chain: dict[str, np.ndarray]) -> DataFrame:
    """Candidates apart from base spans, with the step of their p-value (0: least like text)."""

    def ratio(symbols: Column, kind: str) -> Column:
        size = float(ALPHABET[kind])
        # one literal for all cells
        cells = F.split(F.lit(",".join(f"{x:.5g}" for x in text_chain[kind].ravel())), ",").cast("array<double>")

        def step(s: Column, v: Column) -> Column:
            at = (s["last"] * size + v + 1).cast("int")
            return F.struct(v.alias("last"), (s["sum"] + F.element_at(cells, at)).alias("sum"))

        return F.aggregate(symbols, F.struct(F.lit(size).alias("last"), F.lit(0.0).alias("sum")), step, lambda s: s["sum"])

    def stepped(c: Column) -> Column:
        def of(symbols: Column) -> Column:
            found = F.when(c["encoding"] == "digits", ratio(symbols, "digits"))
            for name in list(ALPHABET)[1:]:
                found = found.when(c["encoding"] == name, ratio(symbols, name))
            decades = found / math.log(10) - math.log10(len(ALPHABET))
            quarters = F.when(c["uniform"], F.floor(4 * decades)).otherwise(0)
            return (_STEPS - F.least(F.greatest(quarters, F.lit(0)), F.lit(_STEPS))).cast("int")

        return F.struct(*[c[x].alias(x) for x in ("start", "end", "band")], let(_symbols(c["token"], c["encoding"]), of).alias("step"))

    apart = F.filter(FOUND, lambda c: ~F.exists(F.col(BASE), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return measured.withColumn(FOUND, F.transform(apart, stepped))


def chance(step: int) -> float:
    """The largest p-value of a step."""
    return 10 ** ((step - _STEPS) / 4)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base spans and judged candidates in place of the text."""
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({BASE: base_spans(content), FOUND: candidates(content)}).drop(text)


def step_counts(rated: DataFrame) -> DataFrame:
    """Candidates of each band and step: at most bands x steps rows."""
    return (
        rated.select(F.explode(FOUND).alias("c"))
        .groupBy("c.band", "c.step")
        .agg(F.count("*").alias("n"), F.lit(0).alias("words"))
    )


def choose_limits(
    counts: list[tuple[int, int, int, int]], false_share: float = FALSE_SHARE, p_value: Callable[[int], float] | None = None
) -> dict[int, int]:
    """For each band the last step that is reported, by the Benjamini-Hochberg rule.

    ``counts`` has (band, step, candidates, null sample). Without ``p_value`` of a step, the share
    of the null sample up to it is taken, over the band and all shorter ones."""
    limits = {}
    for band in range(len(BANDS)):
        words = [0] * (_STEPS + 1)
        found = [0] * (_STEPS + 1)
        for b, step, n, w in counts:
            if b <= band:
                words[step] += w
            if b == band:
                found[step] += n
        total, all_words = sum(found), sum(words)
        reported = passed = 0
        for step in range(_STEPS + 1):
            reported, passed = reported + found[step], passed + words[step]
            p = p_value(step) if p_value else (1 + passed) / (1 + all_words)
            if reported and p * total <= false_share * reported:
                limits[band] = step
    return limits


def report(rated: DataFrame, limits: dict[int, int]) -> DataFrame:
    """Replace the working columns by ``base`` and ``spans``, arrays of structs (start, rank,
    kind, end) in order; ``spans`` has the random ones too."""
    inside = F.lit(False)

    def wanted(c: Column) -> Column:
        ok = inside
        for band, step in sorted(limits.items()):
            ok = ok | ((c["band"] == band) & (c["step"] <= step))
        return ok

    added = F.transform(
        F.filter(F.col(FOUND), wanted),
        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), F.lit("random").alias("kind"), c["end"].alias("end")),
    )
    return rated.withColumns({"base": F.col(BASE), "spans": F.array_sort(F.concat(F.col(BASE), added))}).drop(BASE, FOUND)


def scan(docs: DataFrame, text: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """All columns of ``docs`` but the text, ``base`` and ``spans``."""
    measured = written(measure(docs, text), "secrets")
    pairs = [tuple(r) for r in pair_counts(docs, text).collect()]  # of 66 x 65 characters
    rated = rate(measured, chain(pairs))
    limits = choose_limits([tuple(r) for r in step_counts(rated).collect()], false_share, chance)
    return report(rated, limits)


def listed(found: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
