import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from mediasignals.functions import text


def plain_fold(s):
    s = unicodedata.normalize("NFD", s.lower())
    return "".join(c for c in s if unicodedata.category(c) != "Mn")


def plain_normalize(s):
    return re.sub(r"[^\w\s]", " ", plain_fold(s))


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("INVERSIÓN", "inversion"), ("año", "ano"), ("", ""), (None, ""), ("Ñandú-1", "nandu 1")],
)
def test_normalize_examples(value, raw, expected):
    assert value(text.normalize_text("x"), x=raw) == expected


def test_normalize_drops_punctuation(value):
    out = value(text.normalize_text("x"), x="¡Hola, mundo!")
    assert not set(out) & set(",!¡")


def test_normalize_equals_python_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    odd = spark.createDataFrame(
        [("İstanbul ΣΑΣ ﬁn x y",), ("é ạ̈",), ("_a-b.c\x1cd\x85e",), ("ǅ ½ ² ٣",)],
        "text string",
    )
    rows = docs.union(odd).select("text", text.normalize_text("text").alias("n"), text.fold("text").alias("f"))
    for r in rows.collect():
        assert r["n"] == plain_normalize(r["text"])
        assert r["f"] == plain_fold(r["text"])


@pytest.mark.parametrize(
    "raw",
    ["a &amp; b", "&lt;p&gt;", "&#233;&#xE9; &#128;", "&ampx &notit; &unknown; & &#0; &#x110000;", "caf&eacute;",
     "&NotEqualTilde;", "x&am", "&copy 2024", "&#13;&#1;."],
)
def test_unescape_equals_html_rules(value, raw):
    assert value(text.unescape_html("x"), x=raw) == html.unescape(raw)


def test_strip_html_keeps_whole_text(value):
    raw = "<p>uno&nbsp;<b>dos</b></p>\n" + "palabra " * 500
    out = value(text.strip_html("x"), x=raw)
    assert out.startswith("uno dos palabra") and len(out) > 3000
    assert len(value(text.strip_html("x", 1500), x=raw)) == 1500
    assert value(text.strip_html("x"), x=None) == ""


def test_mentions_cleaned(value):
    out = value(text.usable_mentions(F.col("x")), x=["Gru ##po", "##a", "#tag", "GM", " "])
    assert out == ["Grupo", "GM"]


@pytest.mark.parametrize(
    ("r", "o", "kind"), [(1, 0, "RIESGO"), (0, 1, "OPORTUNIDAD"), (1, 1, "MIXTO"), (0, 0, "NEUTRO")]
)
def test_signal_kind(value, r, o, kind):
    assert value(text.signal_kind("r", "o"), r=r, o=o) == kind


def test_classification_text_prefers_description(value):
    pick = text.classification_text("t", "d")
    assert value(pick, t="titulo", d="cuerpo") == "cuerpo"
    assert value(pick, t="titulo", d="  ") == "titulo"
    assert value(pick, t="titulo", d=None) == "titulo"


def test_split_and_join(value):
    assert value(text.split_list("x"), x=" a, ,b ,") == ["a", "b"]
    assert value(text.split_list("x", "|"), x="a|b") == ["a", "b"]
    assert value(text.split_list("x"), x=None) == []


def test_shorten(value):
    assert value(text.shorten("x", 10), x="corto") == "corto"
    assert value(text.shorten("x", 12), x="uno dos, tres cuatro") == "uno dos…"
    assert value(text.shorten("x", 4), x="sinespacios") == "sine…"


def test_topic_label(value):
    assert value(text.topic_label("x"), x="comercio_exterior") == "Comercio Exterior"
    assert value(text.topic_label("x"), x=" Energia") == "Energía"
    assert value(text.topic_label("x"), x="tema_nuevo") == "Tema Nuevo"


@pytest.mark.parametrize(
    ("source", "place"),
    [("Google News - Allende Coahuila", "allende"), ("Google News - Cuatro Ciénegas", "cuatro cienegas"),
     ("Vanguardia", None), ("Google News - ", None), (None, None)],
)
def test_source_place(value, source, place):
    assert value(text.source_place("x"), x=source) == place


def test_model_answer_with_fence(value):
    raw = '```json\n[{"id": 1, "personas": ["Ana"], "organizaciones": [], "lugares": ["Saltillo"]}]\n```'
    out = value(text.parse_model_answer("x"), x=raw)
    assert out[0]["personas"] == ["Ana"] and out[0]["lugares"] == ["Saltillo"]


def test_long_references(value):
    for raw in ("&#0000000000065;x", "&#x000000041;x", "&#99999999999999999999;", "&#xffffffffffff;y"):
        assert value(text.unescape_html("x"), x=raw) == html.unescape(raw)


def test_title_case(value):
    for raw in ("o'neill", "jalisco-norte", "tema_nuevo3x", "ÉL niño de la", "", "a1b"):
        assert value(text.title_case("x"), x=raw) == raw.title()
