import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from mediasignals.llm import state_dedup
from mediasignals.llm.queries import EXACT_SQL, op12

from .conftest import SF

SCHEMA = "doc_id long, text string, digest string, n int, normal string, file string"


def table(spark, tmp_path, name, rows, parts=3):
    path = str(tmp_path / name)
    made = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA)
    made.repartition(parts).write.parquet(path)
    return path


def brute(rows):
    groups = {}
    for i, t in rows:
        t = t or ""
        n = re.sub(r"[\x20\x09-\x0D]", "", t)
        groups.setdefault(n, []).append((-len(t), i is None, i if i is not None else 0, i))
    out = []
    for n, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(n.encode()).hexdigest()
        out += [(m[3], best[3], len(members), sha) for m in members]
    return sorted(out, key=repr)


def got(frame):
    return sorted([(r.id, r.keep_id, r.group_size, r.digest) for r in frame.collect()], key=repr)


ROWS = [
    (1, "a b"), (2, "ab"), (3, "a\tb "), (4, " a b"), (5, None), (6, ""), (7, " \n"), (8, "ab c"), (None, "ab"),
    (9, "é x"), (10, "éx"), (-5, "éx "), (11, "long " * 50_000), (12, "long" * 50_000), (13, " "), (14, "only"),
]


def test_groups_match_brute_force(spark, tmp_path):
    path = table(spark, tmp_path, "t", ROWS)
    found = state_dedup.dedup(spark, path)
    assert got(found) == brute(ROWS)
    kept = found.where("kept").collect()
    assert len(kept) == len({r.digest for r in found.collect()})
    assert {r.id for r in kept} == {r.keep_id for r in kept}


def test_repeated_rows_keep_one(spark, tmp_path):
    path = table(spark, tmp_path, "t", [(1, "same")] * 5 + [(2, "same")])
    found = state_dedup.dedup(spark, path).collect()
    assert [r.group_size for r in found] == [6] * 6 and sum(r.kept for r in found) == 1
    assert [r.id for r in found if r.kept] == [1]


def test_colliding_digests_are_told_apart_by_bytes(spark, tmp_path):
    path = table(spark, tmp_path, "t", ROWS)
    found = state_dedup.dedup(spark, path, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1))
    want = brute(ROWS)
    assert sorted([(r.id, r.keep_id, r.group_size, r.digest) for r in found.collect()], key=repr) == sorted(
        [(i, k, n, s[:1]) for i, k, n, s in want], key=repr
    )
    assert found.where("kept").count() == len({s for *_, s in want})


def test_state_outlives_batches_and_runs(spark, tmp_path):
    folder = str(tmp_path / "state")
    one = table(spark, tmp_path, "one", ROWS[:9])
    two = table(spark, tmp_path, "two", ROWS[9:] + [(20, "ab"), (21, "a  b  "), (22, "only ")])
    state_dedup.arrive(spark, one, folder)
    state_dedup.absorb(spark, folder, files_per_batch=1)
    first = {r.digest: r.n for r in state_dedup.held(spark, folder).collect()}
    state_dedup.arrive(spark, two, folder)
    state_dedup.absorb(spark, folder, files_per_batch=1)
    state_dedup.absorb(spark, folder, files_per_batch=1)  # nothing new
    ab = hashlib.sha256(b"ab").hexdigest()
    assert first[ab] == 5
    rows = ROWS + [(20, "ab"), (21, "a  b  "), (22, "only ")]
    found = state_dedup.resolve(spark, [one, two], folder)
    assert got(found) == brute(rows)
    assert {r.keep_id for r in found.where(F.col("digest") == ab).collect()} == {21}
    batches = {r.batch for r in spark.read.parquet(f"{folder}/changes").select("batch").distinct().collect()}
    assert len(batches) > 3
    # a repeated batch replaces its own output
    last = spark.read.parquet(f"{folder}/changes").where(F.col("batch") == max(batches)).drop("batch").collect()
    spark.createDataFrame(last, spark.read.parquet(f"{folder}/changes").drop("batch").schema).write.mode("overwrite").parquet(
        f"{folder}/changes/batch={max(batches)}"
    )
    assert got(state_dedup.resolve(spark, [one, two], folder)) == brute(rows)


def test_state_is_on_disk_without_expiry(spark, tmp_path):
    path = table(spark, tmp_path, "t", ROWS)
    folder = str(tmp_path / "state")
    state_dedup.arrive(spark, path, folder)
    state_dedup.absorb(spark, folder)
    state = spark.read.format("statestore").load(f"{folder}/checkpoint")
    assert state.count() == len({s for *_, s in brute(ROWS)})
    assert len(state.select("value.*").columns) == 2  # how many, and the row that stays
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_empty_table(spark, tmp_path):
    assert state_dedup.dedup(spark, table(spark, tmp_path, "t", [], 1)).count() == 0


def test_query_matches_sql(spark):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(db.sql(f"select {', '.join(columns)} from ({EXACT_SQL})").fetchall())
    assert sorted(tuple(r) for r in op12(spark, SF).select(columns).collect()) == want
