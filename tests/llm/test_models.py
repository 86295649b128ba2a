"""Language identification and ordinal quality: held-out accuracy and edge cases."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from mediasignals.llm import centroid_lang as C
from mediasignals.llm import ordinal_quality as O
from mediasignals.llm.queries import op4, op7

from .conftest import SF


def test_language_of_held_out_documents(spark):
    source = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op7(spark, SF).collect()
    assert len(rows) == len(source)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and source[r.doc_id].lang]
    right = sum(r.lang_pred == source[r.doc_id].lang for r in held)
    assert right >= 0.97 * len(held)


def language_rows(rng, n=40):
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ße"]}
    return [(i, " ".join("".join(rng.choices(syllables[c], k=3)) for _ in range(30)), c)
            for i, c in enumerate(["aa", "bb"] * n)]


def test_language_edge_cases(spark):
    schema = "doc_id long, text string, lang string"
    model = C.fit(spark.createDataFrame(language_rows(random.Random(1)) + [(900, None, "aa"), (901, "ka", None)], schema))
    like = language_rows(random.Random(2))[0][1]
    texts = [None, "", "12 34 !!", like, "schungße ungsch", "日本", "a", "ka" * 50_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("language", F.lit(1))
    got = {r.doc_id: r.language for r in C.predict(frame, model).collect()}
    assert [got[i].lang for i in range(3)] == ["und"] * 3 and all(got[i].score == 0 for i in range(3))
    assert got[3].lang == "aa" and got[3].accepted and got[4].lang == "bb"
    assert got[5].lang in ("aa", "bb") and not got[5].accepted and got[7].lang == "aa"
    assert {r.language.lang for r in C.predict(frame, None).collect()} == {"und"}
    assert C.fit(frame.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))) is None
    assert C.predict(frame.limit(0), model).count() == 0


def rated(rng, n=300):
    """Grade 0 is noise, 1 has rude words, 2 is plain."""
    rows = []
    for i in range(n):
        g = i % 3
        words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(rng.randint(20, 80))]
        if g == 0:
            words = [w + "###" for w in words]
        elif g == 1:
            words[rng.randrange(len(words))] = rng.choice(["rude", "mean"])
        rows.append((i, " ".join(words), g))
    return rows


def test_grades_of_held_out_documents(spark):
    schema = "doc_id long, text string, g int"
    train = spark.createDataFrame(rated(random.Random(1), 900), schema)
    test = spark.createDataFrame(rated(random.Random(2)), schema).withColumn("rating", F.lit("x"))
    model = O.fit(train.select("doc_id", "text"), train.select("doc_id", "g"), F.col("g"))
    assert model.thresholds[0] < model.thresholds[1]
    rows = O.score(test, model).collect()
    mean = [np.mean([r.rating.expected for r in rows if r.g == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    right = np.mean([(r.rating.top >= 0.5) == (r.g == 2) for r in rows])
    assert right >= 0.9
    for r in rows:
        assert abs(r.rating.tails[1] - r.rating.top) < 1e-9 and r.rating.tails[0] >= r.rating.tails[1]
        assert abs(sum(r.rating.tails) - r.rating.expected) < 1e-6  # grades are 0, 1, 2


def test_rating_edge_cases(spark):
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "a b"), (2, "a b"), (3, "x " * 50_000)], "doc_id long, text string")
    ratings = spark.createDataFrame([(2, 1), (2, 0), (3, None), (None, 1)], "doc_id long, g int")
    assert O.fit(docs, ratings, F.col("g")) is None
    assert {r.rating.top for r in O.score(docs, None).collect()} == {None}
    both = spark.createDataFrame([(2, 1), (3, 0), (0, 0)], "doc_id long, g int")
    rows = O.score(docs, O.fit(docs, both, F.col("g"))).collect()
    assert len(rows) == 5 and all(0 <= r.rating.top <= 1 for r in rows)
    assert O.score(docs.limit(0), None).count() == 0


def test_rating_query(spark):
    rows = op4(spark, SF).collect()
    labels = {r.doc_id: r.quality + (r.quality and 1 - r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    mean = [np.mean([r.expected_grade for r in rows if labels.get(r.doc_id) == g]) for g in (0, 2)]
    assert mean[0] < mean[1]
