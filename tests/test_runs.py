"""Streaming against batch, the daily run repeated, late rows, the driver contract."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mediasignals import schemas
from mediasignals.catalog import CHECKS, QUERIES, runnable
from mediasignals.operators import rollup
from mediasignals.plans import daily
from mediasignals.session import shared_dir
from mediasignals.sources import reports, tables
from mediasignals.sources.publish import Conflict, Version, of_version, sweep
from mediasignals.streaming import jobs

ENTRY = schemas.FEED_ENTRIES


def entries(spark, rows):
    return spark.createDataFrame(
        [(s, i, t, u, d, None, p) for i, (s, t, u, d, p) in enumerate(rows)], ENTRY)


@pytest.fixture(scope="module")
def dims(spark):
    topics = spark.createDataFrame([(1, "inversion"), (2, "empleo")], "id long, name string")
    regions = spark.createDataFrame(
        [(7, "Coahuila", "coahuila", "estado")], "id long, name string, name_norm string, kind string")
    gazetteer = spark.createDataFrame([("Tesla", "ORG"), ("Coahuila", "LOC")], schemas.GAZETTEER)
    return {"topics": topics, "regions": regions, "gazetteer": gazetteer}


def run(spark, root, rows, as_of, dims):
    return daily.run_daily(
        spark, entries(spark, rows), root, as_of, dims["gazetteer"], dims["topics"], dims["regions"])


def globals_of(spark, root):
    df = of_version(spark, root, "daily_global", schemas.DAILY_GLOBAL)
    return {r["day"].isoformat(): (r["n_articles"], r["n_relevant"], r["n_risk"]) for r in df.collect()}


MON, TUE = "Mon, 15 Jan 2024 10:30:00 GMT", "Tue, 16 Jan 2024 10:30:00 GMT"


def test_daily_run(spark, dims):
    root = shared_dir(spark, "run")
    day1 = [("A", "Tesla trae inversión a Coahuila", "http://1", "Nueva inversión y empleos", MON),
            ("A", "Tesla trae inversión a Coahuila", "http://1", "otra vez", MON),
            ("B", "Crisis y huelga", "http://2", "Crisis: despidos", MON),
            ("B", "El clima", "http://3", "sol", MON)]
    run(spark, root, day1, "2024-01-15", dims)
    assert globals_of(spark, root) == {"2024-01-15": (3, 2, 1)}
    first = of_version(spark, root, "articles", schemas.ARTICLES).filter("url = 'http://1'").first()
    assert (first["orgs"], first["places"], first["region_id"]) == (["Tesla"], ["Coahuila"], 7)
    assert (first["geo_level"], first["deep_analysis"], first["opportunity"]) == ("estatal", 1, 1)
    # the same run again changes nothing
    run(spark, root, day1, "2024-01-15", dims)
    assert globals_of(spark, root) == {"2024-01-15": (3, 2, 1)}
    assert of_version(spark, root, "article_entity", schemas.ARTICLE_ENTITY).count() == 2
    # the next run brings a new day, a stored url, and a late row for the first day
    day2 = [("C", "Tesla crece", "http://4", "expansión de Tesla", TUE),
            ("C", "repetida", "http://1", "x", TUE), ("C", "tardía", "http://5", "huelga", MON)]
    run(spark, root, day2, "2024-01-16", dims)
    assert globals_of(spark, root) == {"2024-01-15": (4, 3, 2), "2024-01-16": (1, 1, 0)}
    assert of_version(spark, root, "entities", schemas.ENTITIES).filter("name = 'Tesla'").count() == 1
    version = Version.open(spark, root)
    payload = reports.read_payload(spark, *version.paths("payload"))
    assert sorted(r["day"].isoformat() for r in payload.collect()) == ["2024-01-15", "2024-01-16"]
    made = daily.run_backfill(spark, root)
    assert {r["day"].isoformat(): r["n_articles"] for r in made["daily_global"].collect()} == {
        "2024-01-15": 4, "2024-01-16": 1}
    assert reports.read_dashboard_csv(spark, *version.paths("dashboard_csv")).count() == 4
    # each day's export is a folder of its own; the first day was written again for the late row
    assert [p.rsplit("=", 1)[1] for p in version.paths("dashboard_csv")] == ["2024-01-15", "2024-01-16"]
    assert len(sweep(spark, root, keep=1)) > 0
    assert globals_of(spark, root) == {"2024-01-15": (4, 3, 2), "2024-01-16": (1, 1, 0)}


def test_a_run_that_dies_between_two_writes_changes_nothing(spark, dims, monkeypatch):
    root = shared_dir(spark, "run")
    run(spark, root, [("A", "huelga", "http://1", "despidos y huelga", MON)], "2024-01-15", dims)
    before = Version.open(spark, root)
    more = [("A", "crisis", "http://2", "crisis y huelga", MON), ("A", "Tesla", "http://3", "inversión de Tesla", TUE)]
    puts = Version.put_days

    def dies(self, name, write, days):
        if name == "daily_source":
            raise KeyboardInterrupt  # articles, links and three rollups are written by now
        puts(self, name, write, days)

    monkeypatch.setattr(Version, "put_days", dies)
    with pytest.raises(KeyboardInterrupt):
        run(spark, root, more, "2024-01-16", dims)
    after = Version.open(spark, root)
    assert (after.number, after.parts) == (before.number, before.parts)
    assert globals_of(spark, root) == {"2024-01-15": (1, 1, 1)}
    assert of_version(spark, root, "articles", schemas.ARTICLES).count() == 1
    monkeypatch.undo()
    run(spark, root, more, "2024-01-16", dims)
    assert globals_of(spark, root) == {"2024-01-15": (2, 2, 2), "2024-01-16": (1, 1, 0)}
    left = sweep(spark, root, keep=1)
    assert any(f.startswith("articles/run=2024-01-16") for f in left)  # of the run that died
    assert globals_of(spark, root) == {"2024-01-15": (2, 2, 2), "2024-01-16": (1, 1, 0)}


def test_two_runs_cannot_publish_one_version(spark):
    root = shared_dir(spark, "run")
    rows = spark.createDataFrame([(1,)], "id long")
    one, two = Version.open(spark, root, "a"), Version.open(spark, root, "b")
    one.put("t", rows)
    two.put("t", rows)
    assert one.publish() == 1
    with pytest.raises(Conflict):
        two.publish()
    assert set(Version.open(spark, root).parts["t"]) == {"a"}


def test_an_export_that_fails_keeps_its_former_state(spark, dims, monkeypatch):
    root = shared_dir(spark, "run")
    run(spark, root, [("A", "huelga", "http://1", "despidos y huelga", MON)], "2024-01-15", dims)
    monkeypatch.setattr(reports, "write_payload", lambda *_: 1 / 0)
    done = run(spark, root, [("A", "crisis", "http://2", "crisis y huelga", TUE)], "2024-01-16", dims)
    assert set(done.failed) == {"payload"} and len(done["payload"]) == 1 and len(done["signals_csv"]) == 2


def rows_of_day(spark, rows):
    return spark.createDataFrame(
        [(i, dt.date(2024, 1, d), s, 1, r, 0, 0) for i, d, s, r in rows],
        "id long, day date, source string, relevant int, risk int, opportunity int, deep_analysis int")


def test_touched_days_follow_late_rows(spark, tmp_path):
    source, stored, out = (str(tmp_path / n) for n in ("in", "rows", "rollup"))
    for part in ([(1, 1, "a", 1), (2, 2, "b", 0)], [(3, 1, "b", 1)]):
        df = rows_of_day(spark, part)
        df.coalesce(1).write.mode("append").parquet(source)
        stream = jobs.read_files(spark, source, df.schema)
        jobs.run_available(
            stream, str(tmp_path / "cp"), jobs.recompute_touched_days(stored, out, rollup.daily_global)
        ).awaitTermination()
    got = spark.read.schema(schemas.DAILY_GLOBAL).parquet(out)
    want = rollup.daily_global(spark.read.parquet(source))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_exact_stream_dedup(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    read, schema = [], None
    for part in ([(1, "u"), (2, "v")], [(3, "u"), (5, "w"), (4, "w")], [(6, "v"), (7, "w"), (8, "x")]):
        df = spark.createDataFrame(part, "id long, url string")
        schema = df.schema
        df.coalesce(1).write.mode("append").parquet(source)
        query = jobs.run_available(
            jobs.read_files(spark, source, schema), checkpoint, jobs.dedup_keyed(out, ["url"], "id"))
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))

    def rows():
        return sorted((r["id"], r["url"]) for r in jobs.unique_rows(spark, out, schema).collect())

    assert rows() == [(1, "u"), (2, "v"), (4, "w"), (8, "x")]
    assert read == [2, 3, 3]  # never what is stored
    # a repeated batch, its files replaced by others, lets nothing through again
    jobs.dedup_keyed(out, ["url"], "id")(df, 2)
    assert rows() == [(1, "u"), (2, "v"), (4, "w"), (8, "x")]
    state = spark.read.format("statestore").load(f"{out}/keys")
    assert state.count() == 4


def stamped(spark, rows):
    return spark.createDataFrame(
        [(dt.datetime(2024, 1, d, 12), r, 0) for d, r in rows], "ts timestamp, risk int, opportunity int")


def test_windows_take_late_rows_until_the_watermark(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "windows", "cp"))
    kept, dropped = [], []
    # days by arrival; day 3 comes late but within the delay in the third step, day 1 too late in the last
    for days in ([1, 1, 2], [3, 4, 5], [6, 3], [12], [20], [21, 1]):
        df = stamped(spark, [(d, d % 2) for d in days])
        df.coalesce(1).write.mode("append").parquet(source)
        stream = jobs.read_files(spark, source, df.schema)
        query = jobs.run_available(
            jobs.tumbling_days(stream, "ts", "3 days"), checkpoint,
            jobs.upsert(path, ["start_day"], "start_day"), "update")
        query.awaitTermination()
        states = [p["stateOperators"][0] for p in query.recentProgress]
        kept.append(states[-1]["numRowsTotal"])
        dropped.append(sum(s["numRowsDroppedByWatermark"] for s in states))
    got = {r["start_day"].day: (r["n_articles"], r["n_risk"]) for r in spark.read.parquet(path).collect()}
    assert got == {1: (2, 2), 2: (1, 0), 3: (2, 2), 4: (1, 0), 5: (1, 1), 6: (1, 0), 12: (1, 0), 20: (1, 0), 21: (1, 1)}
    assert max(kept) <= 6 and kept[-1] <= 2  # of nine days
    assert dropped == [0, 0, 0, 0, 0, 1]


def test_upsert_replaces_keys_and_survives_a_repeat(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "at date, key string, n long"

    def batch(*rows):
        return spark.createDataFrame([(dt.date(2024, 1, d), k, n) for d, k, n in rows], schema)

    sink = jobs.upsert(path, ["at", "key"], "at")
    sink(batch((1, "a", 1), (1, "b", 1), (2, "a", 5)), 0)
    second = batch((1, "a", 2), (3, "c", 1))
    sink(second, 1)
    sink(second, 1)
    want = [(1, "a", 2), (1, "b", 1), (2, "a", 5), (3, "c", 1)]

    def rows():
        return sorted((r["at"].day, r["key"], r["n"]) for r in spark.read.parquet(path).collect())

    assert rows() == want
    # stopped while it replaced partitions: one is gone, the repeated batch puts it back whole
    tables.remove(spark, f"{path}/day=2024-01-01")
    sink(second, 1)
    assert rows() == want


@pytest.mark.parametrize("name", ["b9_stored_metrics", "b16_stored_source_series", "d29_stored_compare", "d31_stored_kpis"])
def test_serving_reads_only_the_days_it_needs(spark, name):
    from mediasignals.catalog import runnable

    df = runnable(name)(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert filters and all("day#" in line.split("PartitionFilters: ")[1].split("]")[0] for line in filters)
    assert df.count() > 0


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
    assert len(QUERIES) > 150


def test_no_query_reads_only_fixed_rows(spark):
    from mediasignals.catalog.registry import check_sql
    from mediasignals.catalog.views import BASE

    for name in QUERIES:
        assert any(f" {table}" in check_sql(name) for table in BASE), name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 60


def test_rollups_survive_a_hot_key(spark):
    """One source holding most rows is pre-aggregated: one row per task is shuffled."""
    rows = spark.range(200000, numPartitions=4).select(
        "id", F.lit(dt.date(2024, 1, 1)).alias("day"), F.lit("hot").alias("source"),
        *[F.lit(1).alias(c) for c in ("relevant", "risk", "opportunity")])
    df = rollup.daily_source(rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange") < plan.rindex("HashAggregate")
    assert df.first()["n_articles"] == 200000


@pytest.mark.parametrize("table, name", [
    ("documents", "k1_streamed_classification"), ("events", "k2_dedup_within_watermark"), ("events", "k3_touched_days")])
def test_streams_read_a_table_of_several_files(spark, tmp_path, table, name):
    one = "/root/testdata/sf0.001"
    spark.read.parquet(f"{one}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    made, expected = (runnable(name)(spark, folder) for folder in (str(tmp_path), one))
    assert sorted(map(str, made.collect())) == sorted(map(str, expected.collect()))


def test_arrivals_are_files_by_size(spark):
    """Many small splits of a table arrive in few files, so that capped triggers stay few."""
    from types import SimpleNamespace

    from mediasignals.catalog.q_plans import _arriving

    rows = spark.range(0, 4000, numPartitions=16).withColumn("kind", F.col("id") % 4)
    *_, folder = _arriving(SimpleNamespace(spark=spark), rows, F.col("kind"), 4)
    arrived = spark.read.parquet(folder)
    assert len(arrived.inputFiles()) == 4
    assert sorted(r["id"] for r in arrived.collect()) == list(range(4000))
