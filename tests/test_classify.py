import pytest

from mediasignals import lexicon
from mediasignals.functions.matching import minimal_terms
from mediasignals.operators import classify, dims

ARTICLES = "id long, title string, description string"

TOPIC_CASES = [
    ("Nueva inversión millonaria en la región", "La empresa anunció capital para expansión", "inversion"),
    ("Se generarán 500 nuevos empleos", "La contratación iniciará el próximo mes", "empleo"),
    ("Planta automotriz aumenta producción", "La manufactura crece en el estado", "industria"),
    ("INVERSIÓN MILLONARIA", "", "inversion"),
    ("Nueva inversión anunciada", None, "inversion"),
]

RISKS = ["Anuncian cierre de planta industrial", "Empresa anuncia despidos masivos",
         "Trabajadores inician huelga indefinida", "Crisis económica afecta al sector",
         "CRISIS ECONÓMICA", "Nuevos aranceles impactan comercio"]
CHANCES = ["Nueva inversión millonaria en la región", "INVERSIÓN MILLONARIA", "inversión con tilde",
           "Empresa anuncia expansión de operaciones", "México se beneficia del nearshoring",
           "Construirán nueva planta en Coahuila", "Se crearán 1000 nuevos empleos"]


@pytest.fixture(scope="module")
def topics_of(spark):
    rows = [(i, t, d) for i, (t, d, _) in enumerate(TOPIC_CASES)]
    rows += [(90, "Nuevos aranceles afectan exportación", "El T-MEC establece nuevas reglas"),
             (91, "El clima será soleado mañana", "Temperaturas agradables en la región"),
             (92, "Inversión genera empleos en industria automotriz", "Nueva planta de manufactura")]
    out = classify.classify_topics(spark.createDataFrame(rows, ARTICLES))
    return {r["id"]: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(TOPIC_CASES)))
def test_topic_detected(topics_of, i):
    assert TOPIC_CASES[i][2] in topics_of[i]["topics"]
    assert topics_of[i]["relevant"] == 1


def test_description_alone_decides(topics_of):
    assert topics_of[90]["topics"] == []


def test_irrelevant(topics_of):
    r = topics_of[91]
    assert (r["topics"], r["score"], r["relevant"]) == ([], 0, 0)


def test_several_topics(topics_of):
    assert topics_of[92]["score"] >= 2 and len(topics_of[92]["topics"]) == topics_of[92]["score"]


def test_signals(spark):
    rows = [(i, t, "") for i, t in enumerate(RISKS + CHANCES)]
    rows += [(90, "A pesar de los despidos, la empresa anuncia nueva inversión", ""),
             (91, "El gobernador visitó las instalaciones", "")]
    marked = spark.createDataFrame([(*r, 1) for r in rows], ARTICLES + ", relevant int")
    got = {r["id"]: r for r in classify.classify_signals(marked).collect()}
    assert all(got[i]["risk"] == 1 for i in range(len(RISKS)))
    assert all(got[i + len(RISKS)]["opportunity"] == 1 for i in range(len(CHANCES)))
    assert (got[90]["risk"], got[90]["opportunity"]) == (1, 1)
    assert (got[91]["risk"], got[91]["opportunity"]) == (0, 0)


def test_irrelevant_rows_keep_zero(spark):
    rows = spark.createDataFrame([(1, "crisis y despidos", "", 0)], ARTICLES + ", relevant int")
    assert classify.classify_signals(rows).first()["risk"] == 0


def test_one_pass_equals_two_steps(spark):
    docs = spark.createDataFrame(
        [(1, "Inversión millonaria en nueva planta", "Generará 500 empleos"),
         (2, "Crisis económica afecta al sector", "Anuncian despidos"),
         (3, "El clima será soleado mañana", "Temperaturas agradables"),
         (4, "La nueva", "planta abre"), (5, None, None)], ARTICLES)
    columns = ["id", "topics", "score", "relevant", "risk", "opportunity"]
    both = classify.classify(docs).select(columns).orderBy("id").collect()
    steps = classify.classify_signals(classify.classify_topics(docs)).select(columns)
    assert both == steps.orderBy("id").collect()
    assert (both[0]["relevant"], both[0]["opportunity"]) == (1, 1)
    assert {"inversion", "empleo"} & set(both[0]["topics"])
    assert (both[1]["relevant"], both[1]["risk"]) == (1, 1)
    assert both[2]["relevant"] == 0
    assert both[3]["opportunity"] == 1  # the term spans title and description


def test_word_matching_is_stricter(spark):
    rows = spark.createDataFrame([(1, "el entrenador habló", "")], ARTICLES)
    assert classify.classify_topics(rows).first()["topics"] == ["infraestructura"]
    assert classify.classify_topics(rows, match="word").first()["topics"] == []


def test_later_filters_do_not_repeat_matching(spark):
    rows = spark.createDataFrame([(1, "inversión", "")], ARTICLES)
    plan = classify.classify(rows).filter("relevant = 1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(_topic_text") + plan.count("contains(_topic_text") <= sum(
        len(minimal_terms(t)) for t in lexicon.TOPICS.values()) + 1
    assert plan.count("translate(lower(title") == 1


def test_table_classification_equals_inline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr(
        "doc_id as id", "'' as title", "text as description")
    terms = [("topic", g, t, i) for i, (g, t) in enumerate(
        [("a", "eau"), ("a", "ment"), ("b", "sch"), ("c", "para"), ("c", "de la")])]
    table = spark.createDataFrame(terms, "kind string, group string, term string, ord int")
    topics = {"a": ["eau", "ment"], "b": ["sch"], "c": ["para", "de la"]}
    inline = classify.classify_topics(docs, topics).filter("relevant = 1")
    want = {r["id"]: r["topics"] for r in inline.collect()}
    got = {r["id"]: r["topics"] for r in classify.classify_by_table(docs, table).collect()}
    assert got == want and len(got) > 50


def test_topic_links_skip_unknown_and_repeat(spark):
    done = spark.createDataFrame([(1, ["a", "z", "a"]), (2, ["b"])], "id long, topics array<string>")
    topics = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    links = classify.topic_links(done, topics)
    assert sorted((r["article_id"], r["topic_id"]) for r in links.collect()) == [(1, 1), (2, 2)]


def test_dictionary_sizes(spark):
    sizes = [len(v) for v in lexicon.TOPICS.values()]
    assert sizes == [15, 17, 16, 16, 10, 13, 17, 15]
    table = dims.normalized_geo_terms(dims.keyword_table(spark))
    assert table.filter("kind = 'topic'").count() == sum(sizes)
    assert table.filter("group = 'state'").count() == 34
