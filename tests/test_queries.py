"""The small star fixture: three articles, two topics, two regions, two entities."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from mediasignals.operators import counts, frames, ingest, listing, quality, rollup, trends
from mediasignals.plans import report

TODAY = dt.date(2024, 5, 10)
BEFORE = TODAY - dt.timedelta(days=1)


@pytest.fixture(scope="module")
def star(spark):
    articles = spark.createDataFrame(
        [(1, "Inversión millonaria en Coahuila", TODAY, "Vanguardia", 1, 0, 1, 1, ["inversion"]),
         (2, "Crisis en sector automotriz", TODAY, "El Economista", 1, 1, 0, 2, ["empleo"]),
         (3, "GM anuncia expansión", BEFORE, "Reforma", 1, 0, 1, 1, ["inversion"])],
        "id long, title string, day date, source string, relevant int, risk int, opportunity int, "
        "region_id long, topics array<string>",
    ).withColumns({"deep_analysis": F.lit(0), "geo_level": F.lit(None).cast("string"),
                   "url": F.lit(""), "score": F.lit(1), "description": F.lit("")})
    return {
        "articles": articles,
        "topics": spark.createDataFrame([(1, "inversion", 1), (2, "empleo", 1)], "id long, name string, active int"),
        "regions": spark.createDataFrame(
            [(1, "Coahuila", "coahuila", "estado"), (2, "Nuevo León", "nuevo leon", "estado")],
            "id long, name string, name_norm string, kind string"),
        "entities": spark.createDataFrame(
            [(1, "General Motors", "ORG", 1, "a"), (2, "Tesla", "ORG", 1, "a")],
            "id long, name string, kind string, is_key int, category string"),
        "article_topic": spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 1, 1)],
                                               "article_id long, topic_id long, score long"),
        "article_entity": spark.createDataFrame([(3, 1, "mencionado", 1)],
                                                "article_id long, entity_id long, role string, freq long"),
    }


def test_topic_counts(star):
    got = counts.count_by_topic(star["articles"], star["article_topic"], star["topics"]).collect()
    assert [(r["topic"], r["total"]) for r in got] == [("inversion", 2), ("empleo", 1)]


def test_daily_count(star):
    got = counts.count_by_day(star["articles"], TODAY, 30).collect()
    assert [(r["day"], r["total"]) for r in got] == [(BEFORE, 1), (TODAY, 2)]


def test_top_entities(star):
    got = counts.top_entities(star["articles"], star["article_entity"], star["entities"]).collect()
    assert [r["entity"] for r in got] == ["General Motors"]


def test_top_entities_hold_no_table_of_links(spark, star):
    links = spark.createDataFrame(
        [(3, 1), (3, 1), (1, 1), (2, 2), (2, 2), (2, 2), (2, 3), (9, 1), (None, 1), (1, None)], "article_id long, entity_id long")
    entities = star["entities"].union(spark.createDataFrame([(3, "Ana", "PER", 0, "b")], star["entities"].schema))
    got = counts.top_entities(star["articles"], links, entities, "ORG", 20, BEFORE, TODAY)
    assert [(r["entity_id"], r["mentions"], r["articles"]) for r in got.collect()] == [(1, 3, 2), (2, 3, 1)]
    every = counts.top_entities(star["articles"], links, entities).collect()
    assert [(r["entity_id"], r["mentions"], r["articles"]) for r in every] == [(1, 3, 2), (2, 3, 1), (3, 1, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Aggregate\(keys=\[([^\]]*)", plan)
    assert keys and not any("article_id" in k for k in keys)


def test_region_counts(star):
    got = counts.count_by_region(star["articles"], star["regions"]).collect()
    assert [(r["region"], r["total"]) for r in got] == [("Coahuila", 2), ("Nuevo León", 1)]


def test_rollups_agree_with_rows(star):
    made = rollup.rollup_all(star["articles"], star["article_topic"], star["article_entity"])
    day = made["daily_global"].filter(F.col("day") == TODAY).first()
    assert (day["n_articles"], day["n_mixed"], day["n_sources"]) == (2, 0, 2)
    gaps = quality.rollup_gaps(star["articles"], made["daily_global"])
    assert gaps.filter("difference <> 0").count() == 0
    assert made["daily_region"].filter("geo_level = 'indeterminado'").count() == 3
    one = rollup.rollup_all(star["articles"], star["article_topic"], star["article_entity"], [BEFORE])
    assert one["daily_entity"].count() == 1 and one["daily_global"].count() == 1
    assert made["daily_topic"].first()["avg_score"] == 1.0


def test_payload(star):
    made = rollup.rollup_all(star["articles"], star["article_topic"], star["article_entity"])
    rows = report.daily_payload(star["articles"], made, star["topics"], star["regions"], star["entities"], [TODAY])
    r = rows.first()
    assert rows.count() == 1
    assert r["metrics"]["n_articles"] == 2 and r["change"]["pct_n_articles"] == 100.0
    assert {t["topic"] for t in r["top_topics"]} == {"inversion", "empleo"}
    assert r["top_entities"] is None
    assert [h["title"] for h in r["highlights"]] == [
        "Inversión millonaria en Coahuila", "Crisis en sector automotriz"]
    assert '"n_articles":2' in r["payload"]
    assert report.daily_payload(
        star["articles"], made, star["topics"], star["regions"], star["entities"],
        [TODAY + dt.timedelta(days=1)]).count() == 0


def test_listing(star):
    rows = listing.page(star["articles"], signal="oportunidad", limit=1).collect()
    assert [(r["id"], r["total"]) for r in rows] == [(1, 2)]
    assert listing.page(star["articles"], source="vangu").first()["id"] == 1
    with pytest.raises(ValueError):
        listing.page(star["articles"], limit=500)
    shown = listing.with_kind(star["articles"])
    assert listing.chosen(shown, ["RIESGO"]).first()["id"] == 2
    assert listing.chosen(shown, [], ["local"]).count() == 0
    assert listing.chosen(shown).count() == 3


def test_pending(star):
    done = star["articles"].filter("id = 1").select("id")
    assert ingest.pending_topics(star["articles"], done).count() == 2
    newest = ingest.pending_entities(star["articles"], done, 1)
    assert newest.first()["id"] == 2


def test_first_url_wins(spark):
    rows = spark.createDataFrame(
        [("Media 1", 1, "Title 1", "http://same-url.com", None, "", "Mon, 15 Jan 2024 10:00:00 GMT"),
         ("Media 2", 2, "Title 2", "http://same-url.com", "", "d", "Tue, 16 Jan 2024 10:00:00 GMT"),
         ("Media 3", 3, " ", "http://x.com", None, None, None), ("Media 3", 4, "t", " ", None, None, None)],
        "source string, seq long, title string, link string, summary string, description string, published string")
    made = ingest.new_articles(ingest.article_rows(rows, TODAY), None)
    assert [(r["title"], r["day"]) for r in made.collect()] == [("Title 1", dt.date(2024, 1, 15))]
    assert ingest.new_articles(ingest.article_rows(rows, TODAY), made.select("url")).count() == 0


def test_first_rows_are_cut_before_the_shuffle(spark):
    rows = spark.createDataFrame([("u", 1)], "url string, seq long")
    plan = ingest.first_per_key(rows, ["url"], ["seq"])._jdf.queryExecution().executedPlan().toString()
    below_shuffle = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in below_shuffle and "Partial" in below_shuffle


def daily(spark, values):
    start = dt.date(2024, 1, 1)
    return spark.createDataFrame(
        [(start + dt.timedelta(days=i), v, v, 0, 0, 0, 1, 0) for i, v in enumerate(values)],
        "day date, n_articles long, n_relevant long, n_risk long, n_opportunity long, n_mixed long, "
        "n_sources long, n_deep long")


def test_anomaly(spark):
    found = trends.anomalies(daily(spark, [10] * 20 + [90]), "2024-01-21", 30, 2.0).collect()
    assert [(r["metric"], r["value"], r["direction"]) for r in found] == [("n_articles", 90, "alto")]
    assert trends.anomalies(daily(spark, [5, 5, 5]), "2024-01-03").count() == 0
    assert trends.anomalies(daily(spark, [5]), "2024-01-01").count() == 0


def test_comparisons(spark):
    series = daily(spark, [1] * 7 + [2] * 7 + [4])
    row = trends.compare_with_previous(series, "2024-01-14", 7).first()
    assert (row["cur_n_articles"], row["prev_n_articles"], row["pct_n_articles"]) == (14, 7, 100.0)
    assert row["pct_n_risk"] is None
    block = trends.kpis(series, "2024-01-01", "2024-01-15", "2024-01-15").first()
    # the current window has 8 days, the previous one 7
    assert block["delta_n_articles"] == round((2 * 7 + 4 - 7) / 7 * 100)
    empty = trends.compare_with_previous(series, "2030-01-01", 7).first()
    assert (empty["cur_n_articles"], empty["pct_n_articles"]) == (0, None)


def test_frame_kpis_floor(spark):
    rows = spark.createDataFrame(
        [(1, dt.date(2024, 1, 2), 0, 0, 0), (2, dt.date(2024, 1, 9), 1, 1, 0), (3, dt.date(2024, 1, 10), 1, 0, 1)],
        "id long, day date, risk int, opportunity int, deep_analysis int")
    got = trends.kpis_from_articles(rows, "2024-01-10").first()
    assert (got["delta_n_articles"], got["delta_n_risk"], got["delta_n_opportunity"]) == (100, 200, 100)
    none = trends.kpis_from_articles(rows, "2025-01-10").first()
    assert none["delta_n_risk"] is None


def test_day_over_day_needs_both_days(spark):
    series = daily(spark, [4, 5, 7]).filter("day <> '2024-01-02'")
    assert trends.day_over_day(series).count() == 0


def test_weekly_report(spark, star):
    from mediasignals.operators import dims

    rows = star["articles"].withColumns(
        {"kind": F.lit("x"), "persons": F.array().cast("array<string>"), "orgs": F.array().cast("array<string>"),
         "places": F.array(F.lit("Saltillo"))})
    made = report.weekly_report(rows, dims.municipality_table(spark))
    assert made["kpis"].first()["n_articles"] == 3
    assert made["conclusions"].first()["top_topic"] == "inversion"
    shares = {r["topic"]: r["share"] for r in made["topic_shares"].collect()}
    assert shares["empleo"] == pytest.approx(1 / 3)
    regions = [(r["subregion"], r["n"]) for r in made["subregions"].collect()]
    assert regions[0] == ("Carbonífera", 0) and ("Sureste", 3) in regions
    assert made["subregion_articles"].count() == 2
    assert made["outlook"].first()["sentence"].startswith("La región Sureste")
    nothing = report.weekly_report(rows.filter("id < 0"), dims.municipality_table(spark))
    assert nothing["conclusions"].first()["top_topic"] == "N/D"


def test_feed_profile(spark):
    at = dt.datetime(2024, 1, 10)
    entries = [("a", i, f"t{i}", "d", at, 1) for i in range(25)] + [("b", i, " ", "", None, 0) for i in range(3)]
    df = spark.createDataFrame(
        entries, "feed string, pos long, title string, description string, published timestamp, dated int")
    feeds = spark.createDataFrame([("a",), ("b",), ("c",)], "feed string")
    got = {r["feed"]: r for r in quality.feed_profile(df, feeds, F.lit("2024-01-12").cast("timestamp")).collect()}
    assert got["a"]["n_entries"] == 25 and got["a"]["n_recent"] == 20 and got["a"]["warnings"] == []
    assert got["a"]["sample_titles"] == ["t0", "t1", "t2"]
    assert len(got["b"]["warnings"]) == 3 and got["c"]["status"] == "empty"
    scores = quality.feed_scores(quality.feed_profile(df, feeds, F.lit("2024-01-12").cast("timestamp")))
    assert {r["feed"]: (r["score"], r["verdict"]) for r in scores.collect()} == {
        "a": (4, "ok"), "b": (0, "warning"), "c": (None, "failed")}
    assert quality.feed_summary(scores).first().asDict() == {"n_ok": 1, "n_warning": 1, "n_failed": 1}


def test_constraints(spark, star):
    odd = spark.createDataFrame([(9, "planeta")], "id long, kind string")
    assert quality.constraint_violations(odd, star["entities"].select("id", "kind")).count() == 1
    assert frames.kind_counts(listing.with_kind(star["articles"])).first()["kind"] == "OPORTUNIDAD"
