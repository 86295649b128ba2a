import datetime as dt

from pyspark.sql import functions as F

from mediasignals import schemas
from mediasignals.operators import frames, ingest
from mediasignals.session import shared_dir
from mediasignals.sources import feeds, reports, tables

FEED = """<?xml version="1.0"?><rss><channel><title>c</title>
<item><title> Uno </title><link>http://a/1</link><description>&lt;b&gt;x&lt;/b&gt;</description>
<pubDate>Mon, 15 Jan 2024 10:30:00 GMT</pubDate></item>
<item><title></title><link>http://a/2</link></item>
<item><title>Dos</title><link>http://a/3</link></item></channel></rss>"""


def test_xml_feed_batch(spark, tmp_path):
    (tmp_path / "vanguardia.xml").write_text(FEED, encoding="utf-8")
    entries = feeds.read_xml_feeds(spark, str(tmp_path))
    rows = ingest.article_rows(entries, "2024-02-01").orderBy("url").collect()
    assert [(r["title"], r["day"], r["source"]) for r in rows] == [
        ("Uno", dt.date(2024, 1, 15), "vanguardia"), ("Dos", dt.date(2024, 2, 1), "vanguardia")]


def test_xml_feed_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.xml").write_text(FEED, encoding="utf-8")
    stream = feeds.stream_xml_feeds(spark, str(tmp_path / "in"), 1)
    rows = ingest.article_rows(stream, "2024-02-01")
    query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_feed_order_is_the_same_however_it_is_read(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for name in "abcdefg":
        items = "".join(f"<item><title>{name}{i}</title><link>http://x/{i % 4}</link></item>" for i in range(6))
        (source / f"{name}.xml").write_text(f"<rss><channel>{items}</channel></rss>", encoding="utf-8")

    def winners(entries):
        rows = ingest.article_rows(entries, "2024-02-01")
        return {r["url"]: (r["title"], r["seq"]) for r in ingest.new_articles(rows, None).collect()}

    files = spark.read.text(str(source), wholetext=True)
    want = winners(feeds.xml_entries(files))
    assert len(want) == 4 and {t[0][1:] for t in want.values()} == {"0", "1", "2", "3"}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("300", "100000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            read = feeds.read_xml_feeds(spark, str(source))
            assert read.rdd.getNumPartitions() in (1, 7) or size == "300"
            assert winners(read) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    stream = feeds.stream_xml_feeds(spark, str(source), 3)
    stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert winners(spark.read.parquet(out)) == want


def test_malformed_records_go_to_the_reject_table(spark, tmp_path):
    (tmp_path / "feeds.json").write_text(
        '{"name":"a","url":"u","kind":"k","region":"r","tags":["x"]}\nnot json\n{"url":"u"}\n{"name":"b","url":"u","tags":"x"}\n')
    assert [r["name"] for r in feeds.read_catalogue(spark, str(tmp_path)).collect()] == ["a"]
    records = [r["record"] for r in feeds.catalogue_rejects(spark, str(tmp_path)).collect()]
    assert sorted(records) == ['not json', '{"name":"b","url":"u","tags":"x"}', '{"url":"u"}']


def test_catalogue_filters(spark, tmp_path):
    (tmp_path / "feeds.json").write_text(
        '{"name":"a","url":"u","kind":"regional","region":"norte","tags":["x"]}\n'
        '{"name":"b","url":"u","kind":"nacional","region":"norte","tags":[]}\n')
    catalogue = feeds.read_catalogue(spark, str(tmp_path))
    assert feeds.feeds_matching(catalogue, region="norte").count() == 2
    assert feeds.feeds_matching(catalogue, kind="regional", region="norte", tag="x").first()["name"] == "a"


def test_dashboard_round_trip(spark, tmp_path):
    exported = spark.createDataFrame(
        [(1, dt.date(2024, 1, 2), "m", 'dijo "hola", y\nsalió', "u", ["Ana"], [], ["Saltillo", "Lima"],
          "estatal", 1, 1, 0, "a|b")],
        "id long, day date, source string, title string, url string, persons array<string>, "
        "orgs array<string>, places array<string>, geo_level string, deep_analysis int, risk int, "
        "opportunity int, topics string")
    reports.write_dashboard_csv(exported, str(tmp_path / "d"))
    back = frames.list_columns(frames.parse_dashboard_csv(reports.read_dashboard_csv(spark, str(tmp_path / "d"))))
    r = back.first()
    assert (r["title"], r["kind"], r["topics"], r["places"], r["orgs"]) == (
        'dijo "hola", y\nsalió', "RIESGO", ["a", "b"], ["Saltillo", "Lima"], [])


def test_signal_csv_starts_with_mark(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, dt.date(2024, 1, 2), "m", "t", ["a", "b"], 1, 0, 2)],
        "id long, day date, source string, title string, topics array<string>, risk int, opportunity int, score int")
    reports.write_signal_csv(rows, str(tmp_path / "s"))
    part = next((tmp_path / "s" / "of_day=2024-01-02").glob("part-*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfday,source,title,topics,kind,score")
    assert b'"a,b",RIESGO,2' in part


def test_text_reports(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-05", "2024-01-06"):
        (tmp_path / f"resumen_{day}.txt").write_text(f"texto {day}\nfin")
    every = reports.read_reports(spark, str(tmp_path))
    assert reports.latest_report(every, "2024-01-08").first()["text"] == "texto 2024-01-06\nfin"
    assert reports.latest_report(every, "2024-01-04").first()["day"] == dt.date(2024, 1, 1)
    assert reports.latest_report(every, "2024-01-20").count() == 0
    assert reports.report_of(every, "2024-01-05").count() == 1


def test_replace_days(spark):
    path = shared_dir(spark, "t")
    first = spark.createDataFrame(
        [(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 2)), (3, dt.date(2024, 1, 3))], "n long, day date")
    tables.replace_days(first, path)
    again = spark.createDataFrame([(20, dt.date(2024, 1, 2))], "n long, day date")
    tables.replace_days(again, path, requested=[dt.date(2024, 1, 2), dt.date(2024, 1, 3)])
    back = tables.read_rollup(spark, path, first.schema)
    assert sorted((r["n"], r["day"].day) for r in back.collect()) == [(1, 1), (20, 2)]


def test_scan_prunes_and_pushes(spark, tmp_path):
    schema = "id long, day date, title string"
    spark.createDataFrame([(1, dt.date(2024, 1, 1), "x")], schema).write.parquet(str(tmp_path / "t"))
    plan = tables.scan(spark, str(tmp_path / "t"), schema, "2024-01-01").select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day" in text and "title" not in text


def test_bound_query(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    got = tables.bound_query(spark, "select n from {t} where s = :s", {"t": rows}, s="b'; drop")
    assert got.count() == 0


def test_warehouse_parses_times(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05", 1), ("bad", 2)], "day string, id int")
    paths = tables.reload_warehouse({"articles": df}, shared_dir(spark, "w"))
    back = spark.read.parquet(paths["articles"])
    assert dict(back.dtypes)["day"] == "timestamp"
    assert back.filter(F.col("day").isNull()).first()["id"] == 2


def test_schemas_have_unique_columns():
    for name in dir(schemas):
        schema = getattr(schemas, name)
        if hasattr(schema, "fieldNames"):
            assert len(set(schema.fieldNames())) == len(schema.fieldNames())
