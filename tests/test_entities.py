import pytest

from mediasignals import schemas
from mediasignals.operators import classify, dims, entities, quality


def company_dims(spark):
    return dims.build_key_entities(dims.company_table(spark))


def test_key_companies(spark):
    names, aliases = company_dims(spark)
    assert names.count() == 16 and aliases.count() == 40
    assert aliases.filter("is_primary = 1").count() == 16
    assert aliases.filter("alias = 'g.m.'").first()["entity_id"] == 1


def test_topic_dimension(spark):
    built = dims.build_topics(dims.keyword_table(spark)).orderBy("ord").collect()
    assert [r["name"] for r in built] == [
        "inversion", "empleo", "industria", "comercio_exterior", "nearshoring", "aranceles",
        "energia", "infraestructura"]
    assert built[4]["keywords"].startswith("nearshoring,relocalizacion,deslocalizacion")
    stored = spark.createDataFrame([("empleo",)], "name string")
    assert dims.add_missing(stored, dims.build_topics(dims.keyword_table(spark)), "name").count() == 7


ARTICLES = "id long, persons array<string>, orgs array<string>, places array<string>"


def test_resolution(spark):
    known, aliases = company_dims(spark)
    rows = spark.createDataFrame(
        [(1, ["Ana Díaz"], ["GM", "Altos Hornos"], ["Saltillo"]),
         (2, ["ANA DIAZ", "saltillo"], ["General Motors", "Tesla"], None),
         (3, None, ["ALTOS HORNOS"], ["Saltillo"])], ARTICLES)
    mentions = entities.mentions_of(rows)
    resolved = entities.resolve_keys(mentions, aliases, known)
    by_key = {r["key"]: r for r in resolved.collect()}
    assert by_key["gm"]["entity_id"] == by_key["general motors"]["entity_id"] == 1
    assert by_key["saltillo"]["kind"] == "LOC" and by_key["saltillo"]["name"] == "Saltillo"
    assert by_key["ana diaz"]["name"] == "Ana Díaz" and by_key["ana diaz"]["is_new"] == 1
    links = entities.entity_links(mentions, resolved)
    assert links.filter("entity_id = 1").count() == 2
    assert links.count() == 4 + 4 + 2
    assert entities.new_aliases(resolved).count() == 3
    made = known.select("id", "name", "kind", "is_key", "category").union(entities.new_entities(resolved))
    assert quality.duplicate_ids(made).count() == 0
    # a second run finds everything it created
    again = entities.resolve_keys(
        mentions, aliases.union(entities.new_aliases(resolved).select(aliases.columns)), made)
    assert again.filter("is_new = 1").count() == 0
    ids = {r["key"]: r["entity_id"] for r in again.collect()}
    assert ids == {k: r["entity_id"] for k, r in by_key.items()}


def test_name_conflict_reuses_entity(spark):
    known = spark.createDataFrame([(5, "Acme", "ORG", 0, None)], schemas.ENTITIES)
    none = spark.createDataFrame([], schemas.ENTITY_ALIAS)
    rows = spark.createDataFrame([(1, None, ["Acme"], None)], ARTICLES)
    r = entities.resolve_keys(entities.mentions_of(rows), none, known).first()
    assert (r["entity_id"], r["is_new"]) == (5, 0)


def test_gazetteer_needs_whole_words(spark):
    articles = spark.createDataFrame(
        [(1, "GM anuncia planta", "<p>General Motors, en Saltillo</p>"), (2, "Programas", "Nokia"),
         (3, "saltillo; SALTILLO", None)], "id long, title string, description string")
    gazetteer = spark.createDataFrame(
        [("GM", "ORG"), ("Kia", "ORG"), ("General Motors", "ORG"), ("Saltillo", "LOC")], schemas.GAZETTEER)
    hits = entities.extract_by_gazetteer(articles, gazetteer)
    arrays = {r["article_id"]: r for r in entities.mention_arrays(hits).collect()}
    assert set(arrays) == {1, 3}
    assert arrays[1]["orgs"] == ["GM", "General Motors"] and arrays[1]["places"] == ["Saltillo"]
    assert arrays[3]["places"] == ["Saltillo"] and arrays[3]["persons"] == []


def test_legacy_lists(spark):
    rows = spark.createDataFrame([(1, "Ana, Luis", None, "Lima,, ")],
                                 "id long, persons string, orgs string, places string")
    found = [(r["surface"], r["kind"]) for r in entities.legacy_mentions(rows).orderBy("pos").collect()]
    assert found == [("Ana", "PER"), ("Luis", "PER"), ("Lima", "LOC")]


def test_add_links_ignores_stored(spark):
    links = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "article_id long, topic_id long")
    stored = spark.createDataFrame([(3, 4)], "article_id long, topic_id long")
    assert classify.add_links(stored, links, ["article_id", "topic_id"]).collect() == [(1, 2)]


def test_names_of_several_words_do_not_read_the_texts_again(spark):
    articles = spark.createDataFrame(
        [(1, "Acme Steel Works", "steel of Acme; Acme steel"), (2, "Steel Acme", "works, steel")],
        "id long, title string, description string")
    gazetteer = spark.createDataFrame([("Acme Steel", "ORG"), ("Steel Works", "ORG"), ("Acme", "PER")], "surface string, kind string")
    found = entities.extract_by_gazetteer(articles, gazetteer)
    assert found._jdf.queryExecution().executedPlan().toString().count("title#") == 0
    assert {tuple(r) for r in found.collect()} == {
        (1, "Acme Steel", "ORG", 1), (1, "Steel Works", "ORG", 2), (1, "Acme", "PER", 1),
        (2, "Acme", "PER", 2)}


def _broadcast(frame):
    """The lines of the plan that stand below a broadcast."""
    found, level = [], None
    for line in frame._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if level is not None and depth > level:
            found.append(line)
        elif "BroadcastExchange" in line:
            level = depth
        else:
            level = None
    return found


@pytest.mark.parametrize("most", [entities.ANCHOR_BYTES, 0])
def test_word_places_of_texts_are_never_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(entities, "ANCHOR_BYTES", most)
    articles = spark.createDataFrame(
        [(i, f"Acme Steel {i % 7}", "steel, acme steel works") for i in range(200)],
        "id long, title string, description string")
    gazetteer = spark.createDataFrame(
        [("Acme Steel", "ORG"), ("Steel Works", "ORG"), ("Acme", "PER"), ("3", "LOC"), ("Steel 3", "LOC"), ("none", "LOC")],
        schemas.GAZETTEER)
    found = entities.extract_by_gazetteer(articles, gazetteer)
    assert [line for line in _broadcast(found) if "_place#" in line] == []
    assert any("_name#" in line for line in _broadcast(found)) == (most > 0)
    rows = [tuple(r) for r in found.collect()]
    assert [line for line in _broadcast(found) if "_place#" in line] == []
    every = [(i, *name) for i in range(200) for name in (("Acme Steel", "ORG", 1), ("Steel Works", "ORG", 6), ("Acme", "PER", 1))]
    threes = [(i, *name) for i in range(3, 200, 7) for name in (("3", "LOC", 3), ("Steel 3", "LOC", 2))]
    assert sorted(rows) == sorted([*every, *threes])
