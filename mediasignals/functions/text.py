"""Column expressions over text. All of them stay inside the JVM."""

from __future__ import annotations

import html.entities
import json
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon, schemas


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Code points whose decomposition, without its marks, is one other character."""
    source, target = [], []
    for point in range(0x80, 0x110000):
        char = chr(point)
        if unicodedata.category(char) in ("Mn", "Cs"):
            continue
        base = [c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != char:
            source.append(char)
            target.append(base[0])
    return "".join(source), "".join(target)


def is_ascii(c: str | Column) -> Column:
    return F.octet_length(_col(c)) == F.length(_col(c))


def fold(c: str | Column) -> Column:
    """Lower case without accents. Pure ASCII text skips the two costly passes."""
    lowered = F.lower(_col(c))
    stripped = F.regexp_replace(F.translate(lowered, *accent_table()), r"\p{Mn}+", "")
    return F.when(is_ascii(c), lowered).otherwise(stripped)


def blank_punctuation(c: str | Column) -> Column:
    """Everything but word characters and white space (in the Unicode sense) -> blank."""
    return F.regexp_replace(_col(c), r"[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85]", " ")


def normalize_text(c: str | Column) -> Column:
    return F.coalesce(blank_punctuation(fold(c)), F.lit(""))


def normalize_key(c: str | Column) -> Column:
    """Lookup key of a name: folded and trimmed, punctuation kept."""
    return F.coalesce(fold(F.btrim(_col(c), F.lit(_SPACES))), F.lit(""))


def fold_all(names: Iterable[str]) -> Column:
    """An array of the folded names."""
    return F.array(*[fold(F.lit(n)) for n in names])


# white space at either end of a name, in the Unicode sense
_SPACES = "".join(chr(p) for p in range(0x3001) if chr(p).isspace())


def strip_space(c: str | Column) -> Column:
    return F.btrim(_col(c), F.lit(_SPACES))


def _cp1252(byte: int) -> str | None:
    try:
        return bytes([byte]).decode("cp1252")
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=1)
def _entity_tables() -> tuple[str, str, str]:
    """(JSON map of named references, regex of names valid without ';', JSON map of C1 codes)."""
    names = html.entities.html5
    open_names = sorted((n for n in names if not n.endswith(";")), key=len, reverse=True)
    c1 = {str(b): _cp1252(b) for b in range(0x80, 0xA0) if _cp1252(b)}
    return json.dumps(names), "|".join(open_names), json.dumps(c1)


def _code_point(c: Column) -> Column:
    """The character of a code point, by the rules of HTML 5."""
    wide = F.lpad(F.hex(c), 8, "0")
    char = F.decode(F.unhex(wide), "UTF-32")
    _, _, c1 = _entity_tables()
    mapped = F.element_at(F.from_json(F.lit(c1), "map<string,string>"), c.cast("string"))
    unusable = (
        c.between(0x1, 0x8) | (c == 0xB) | c.between(0xE, 0x1F) | c.between(0x7F, 0x9F)
        | c.between(0xFDD0, 0xFDEF) | (c.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    return (
        F.when(c == 0xD, F.lit("\r"))
        .when(mapped.isNotNull(), mapped)
        .when((c == 0) | c.between(0xD800, 0xDFFF) | (c > 0x10FFFF), F.lit("�"))
        .when(unusable, F.lit(""))
        .otherwise(char)
    )


def unescape_html(c: str | Column, raw: str | Column | None = None) -> Column:
    """Named and numeric character references -> characters.

    ``raw`` may name a cheaper column that holds a '&' whenever ``c`` does.
    """
    names, open_names, _ = _entity_tables()
    table = F.from_json(F.lit(names), "map<string,string>")

    def decode(token: Column) -> Column:
        # without leading zeros; what is longer than any code point is beyond the last one
        numeric = F.regexp_extract(token, r"^&#0*([0-9]+)", 1)
        numeric = F.when(F.length(numeric) > 9, F.lit("999999999")).otherwise(numeric)
        hexadecimal = F.regexp_extract(token, r"^&#[xX]0*([0-9a-fA-F]+)", 1)
        hexadecimal = F.when(F.length(hexadecimal) > 8, F.lit("fffffff")).otherwise(hexadecimal)
        body = F.substring(token, 2, 64)
        known = F.element_at(table, body)
        prefix = F.regexp_extract(body, f"^({open_names})", 1)
        return (
            F.when(~token.startswith("&") | (token == "&"), token)
            .when(numeric != "", _code_point(numeric.cast("bigint")))
            .when(hexadecimal != "", _code_point(F.conv(hexadecimal, 16, 10).cast("bigint")))
            .when(known.isNotNull(), known)
            .when(
                prefix != "",
                F.concat(F.element_at(table, prefix), F.substr(body, F.length(prefix) + 1)),
            )
            .otherwise(token)
        )

    tokens = F.regexp_extract_all(
        _col(c),
        F.lit(r"(&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]{0,31};?|[^&]+|&)"),
        F.lit(1),
    )
    return F.when(
        F.contains(_col(c if raw is None else raw), F.lit("&")), F.array_join(F.transform(tokens, decode), "")
    ).otherwise(_col(c))


def strip_html(c: str | Column, limit: int | None = None) -> Column:
    """Tags -> blank, references decoded, white space collapsed. Whole text unless ``limit``."""
    plain = unescape_html(F.regexp_replace(_col(c), r"<[^>]+>", " "), raw=c)
    plain = F.trim(F.regexp_replace(plain, r"[\s\p{Z}\x1c-\x1f\x85]+", " "))
    plain = F.coalesce(plain, F.lit(""))
    return F.substring(plain, 1, limit) if limit else plain


def clean_mention(c: str | Column) -> Column:
    """Remove sub-word markers a tokeniser leaves inside a mention."""
    return strip_space(F.regexp_replace(_col(c), r"\s*##", ""))


def usable_mentions(mentions: Column) -> Column:
    """Cleaned mentions of two characters or more that do not start with '#'."""
    cleaned = F.transform(mentions, clean_mention)
    return F.filter(cleaned, lambda m: (F.length(m) >= 2) & ~m.startswith("#"))


def classification_text(title: str | Column, description: str | Column) -> Column:
    """The description, or the title where the description is blank."""
    blank = F.coalesce(strip_space(description), F.lit("")) == ""
    return F.when(blank, _col(title)).otherwise(_col(description))


def risk_text(title: str | Column, description: str | Column) -> Column:
    return F.concat_ws(" ", _col(title), F.coalesce(_col(description), F.lit("")))


def signal_kind(risk: str | Column = "risk", opportunity: str | Column = "opportunity") -> Column:
    r, o = _col(risk) == 1, _col(opportunity) == 1
    return (
        F.when(r & o, "MIXTO").when(r, "RIESGO").when(o, "OPORTUNIDAD").otherwise("NEUTRO")
    )


def split_list(c: str | Column, separator: str = ",") -> Column:
    """Separated text -> trimmed, non-blank items."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), "[" + separator + "]")
    return F.filter(F.transform(parts, strip_space), lambda part: part != "")


def join_list(c: str | Column, separator: str = ",") -> Column:
    return F.array_join(_col(c), separator)


def shorten(c: str | Column, limit: int) -> Column:
    """Cut at the last word boundary within ``limit`` and mark the cut with an ellipsis."""
    head = F.substring(_col(c), 1, limit)
    word_end = F.regexp_replace(head, r"(?s) [^ ]*$", "")
    return F.when(F.length(_col(c)) <= limit, _col(c)).otherwise(
        F.concat(F.rtrim(word_end, F.lit(",;:")), F.lit("…"))
    )


def topic_label(c: str | Column) -> Column:
    key = F.lower(strip_space(c))
    labels = F.create_map(*[F.lit(v) for pair in lexicon.TOPIC_LABELS.items() for v in pair])
    fallback = title_case(F.replace(_col(c), F.lit("_"), F.lit(" ")))
    return F.coalesce(F.try_element_at(labels, key), fallback)


def source_place(c: str | Column) -> Column:
    """Place part of a search-feed name, folded; null for any other source or a blank part."""
    start = F.instr(_col(c), lexicon.SOURCE_PREFIX) + len(lexicon.SOURCE_PREFIX)
    rest = F.substr(_col(c), start)
    tail = F.btrim(F.regexp_replace(F.lower(strip_space(rest)), r"\s+coahuila$", ""))
    place = F.when(_col(c).contains(lexicon.SOURCE_PREFIX), fold(tail))
    return F.when(place != "", place)


def title_case(c: str | Column) -> Column:
    """Upper case for every letter that follows no letter, lower case for the others."""
    runs = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), ""
    )


def parse_model_answer(c: str | Column) -> Column:
    """Answer of an extraction model: optional code fence around a JSON array."""
    body = strip_space(c)
    body = F.regexp_replace(body, r"^```(?:json)?\s*", "")
    body = F.regexp_replace(body, r"\s*```$", "")
    return F.from_json(body, schemas.MODEL_ANSWER)
