import pytest
from pyspark.sql import functions as F

from mediasignals.operators import dims, geo

LEVELS = [
    (["Estados Unidos", "Texas"], "", "internacional"),
    (["China", "Beijing"], "", "internacional"),
    (["Coahuila", "Saltillo"], "", "estatal"),
    (["COAHUILA"], "", "estatal"),
    (["Nuevo Leon", "Monterrey"], "", "nacional"),
    (["Jalisco", "Guadalajara"], "", "nacional"),
    (["Ciudad desconocida"], "", "indeterminado"),
    ([], "", "indeterminado"),
    (["Estados Unidos", "Coahuila"], "", "internacional"),
    (["Mexico"], "", "nacional"),
    ([], "Anuncian obra en Coahuila", "estatal"),
    ([], "La causa del accidente", "internacional"),  # containment: 'usa' inside 'causa'
]
DEEP = [
    ([], ["General Motors", "GM"], 1), ([], ["Tesla"], 1), ([], ["Ford Motor Company"], 1),
    ([], ["TESLA", "AMAZON"], 1), (["Estados Unidos"], [], 1), (["China"], [], 1),
    (["Saltillo"], ["Empresa Local SA"], 0), (["Mexico"], [], 0),
]


def test_geo_level(spark):
    rows = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(LEVELS)],
                                 "id int, places array<string>, title string")
    got = {r["id"]: r["geo_level"] for r in geo.with_geo_level(rows).collect()}
    assert [got[i] for i in range(len(LEVELS))] == [x[2] for x in LEVELS]


def test_deep_analysis(spark):
    rows = spark.createDataFrame([(i, p, o) for i, (p, o, _) in enumerate(DEEP)],
                                 "id int, places array<string>, orgs array<string>")
    got = {r["id"]: r["d"] for r in rows.select("id", geo.deep_analysis("places", "orgs").alias("d")).collect()}
    assert [got[i] for i in range(len(DEEP))] == [x[2] for x in DEEP]


@pytest.fixture(scope="module")
def regions(spark):
    keywords = dims.keyword_table(spark)
    built = dims.build_regions(keywords.filter("group = 'state'"), keywords.filter("group = 'country'"))
    ranked = sorted(built.collect(), key=lambda r: (r["block"], r["ord"]))
    rows = [(i, r["name"], r["name_norm"], r["kind"], r["country"], r["is_target"])
            for i, r in enumerate(ranked, start=1)]
    return spark.createDataFrame(
        rows, "id long, name string, name_norm string, kind string, country string, is_target int")


def test_region_dimension(regions):
    assert regions.count() == 47
    kinds = {r["kind"]: r["count"] for r in regions.groupBy("kind").count().collect()}
    assert kinds == {"estado": 34, "pais": 13}
    assert regions.filter("is_target = 1").first()["name"] == "Coahuila"
    names = {r["id"]: r["name"] for r in regions.collect()}
    assert (names[1], names[10], names[35], names[38]) == (
        "Aguascalientes", "Ciudad De Mexico", "México", "Canadá")


def test_region_of_first_known_place(spark, regions):
    rows = spark.createDataFrame(
        [(1, ["Texas", "COAHUILA", "China"]), (2, ["México"]), (3, ["Nada"]), (4, []), (5, None)],
        "id long, places array<string>")
    got = {r["id"]: r["region_id"] for r in geo.with_region(rows, regions).collect()}
    assert got == {1: 7, 2: 35, 3: None, 4: None, 5: None}


def test_source_municipality(spark):
    names = ["Google News - Allende Coahuila", "Google News - Cuatro Ciénegas", "Google News - Acuña",
             "Google News - Sabinas", "Google News - San Juan de Sabinas", "Vanguardia", "Google News - ", None]
    sources = spark.createDataFrame([(n,) for n in names], "source string")
    found = geo.source_municipality(sources, dims.municipality_table(spark))
    got = {r["source"]: r["municipality"] for r in found.collect()}
    assert got == {
        names[0]: "Allende", names[1]: "Cuatro Ciénegas", names[2]: "Ciudad Acuña",
        names[3]: "Sabinas", names[4]: "San Juan de Sabinas"}


def test_title_municipality(spark):
    rows = spark.createDataFrame(
        [(1, "Choque en Torreón"), (2, "San Pedro y Francisco I. Madero"), (3, "Monclova crece"), (4, None)],
        "id long, title string")
    found = geo.title_municipality(rows, dims.municipality_table(spark))
    assert {r["id"]: r["municipality"] for r in found.collect()} == {1: "Torreón", 2: "Francisco I. Madero"}


def test_subregion(spark):
    rows = spark.createDataFrame(
        [(1, "Obra", ["Saltillo", "Sabinas"], "estatal"), (2, "Mina de carbón", [], "nacional"),
         (3, "Mina de carbón", [], "internacional"), (4, "Feria en Francisco I Madero", None, "estatal"),
         (5, "Nada", ["Lima"], None)],
        "id long, title string, places array<string>, geo_level string")
    found = geo.with_subregion(rows, dims.municipality_table(spark))
    assert {r["id"]: r["subregion"] for r in found.collect()} == {
        1: "Carbonífera", 2: "Carbonífera", 3: None, 4: "Laguna", 5: None}


def test_attribution_prefers_source(spark):
    rows = spark.createDataFrame(
        [(1, "Google News - Parras", "Torreón"), (2, "Vanguardia", "En Torreón"), (3, "Vanguardia", "x")],
        "id long, source string, title string").withColumn("risk", F.lit(0))
    out = geo.attributed_articles(rows, dims.municipality_table(spark))
    assert {r["id"]: (r["municipality"], r["subregion"]) for r in out.collect()} == {
        1: ("Parras", "Sureste"), 2: ("Torreón", "Laguna")}


def test_subregion_plan_reads_each_table_once(spark):
    """What feeds the dictionary join is written, so that the plan the driver holds stays short."""
    articles = spark.createDataFrame([(1, "Saltillo", ["x"], "estatal")], "id long, title string, places array<string>, geo_level string")
    towns = spark.createDataFrame([(1, "Saltillo", "Sureste")], "ord int, municipality string, subregion string")
    df = geo.with_subregion(articles, towns)
    assert df._jdf.queryExecution().executedPlan().toString().count("ExistingRDD") == 1
    assert [r.subregion for r in df.collect()] == ["Sureste"]
