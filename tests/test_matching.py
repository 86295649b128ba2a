import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mediasignals.functions import matching

words = st.text(alphabet="abñ \n", min_size=1, max_size=6)


def frames(spark, texts, terms):
    left = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    right = spark.createDataFrame([(t, t) for t in terms], "term_id string, term string")
    return left, right


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(alphabet="abñ \n", max_size=20), min_size=1, max_size=6),
       terms=st.sets(words, min_size=1, max_size=6))
def test_gram_pairs_match_brute_force(spark, texts, terms):
    left, right = frames(spark, texts, terms)
    want = {(i, t) for i, x in enumerate(texts) for t in terms if t in x}
    pairs = matching.matching_terms(left, right).collect()
    assert len(pairs) == len(want)
    assert {(r["text_id"], r["term_id"]) for r in pairs} == want


def test_gram_join_is_an_equi_join(spark):
    left, right = frames(spark, ["abcd"], ["bc"])
    plan = matching.gram_pairs(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_minimal_terms_keep_meaning():
    terms = ["empleo", "empleos", "desempleo", "jornada laboral", "laboral"]
    assert set(matching.minimal_terms(terms)) == {"empleo", "laboral"}


def test_word_grams(spark):
    row = spark.createDataFrame([("uno, dos-tres",)], "x string").select(
        matching.word_grams(matching.word_list("x"), 3).alias("g")).first()["g"]
    assert {(g["gram"], g["pos"]) for g in row} == {
        ("uno", 1), ("dos", 2), ("tres", 3), ("uno dos", 1), ("dos tres", 2), ("uno dos tres", 1)}
    empty = spark.createDataFrame([("",)], "x string").select(
        matching.word_grams(matching.word_list("x"), 2).alias("g"))
    assert empty.first()["g"] == []


def test_grams_are_made_of_bounded_slices():
    """A slice holds a bounded number of bytes of text, however long the texts of a batch are."""
    texts = ["é" * 60_000] * 9 + [None, "", "x" * (1 << 20), "y"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    slices = [s.column(0).to_pylist() for s in matching._bounded(batch, "text")]
    assert [t for s in slices for t in s] == texts
    assert all(len(s) == 1 or sum(len((t or "").encode()) for t in s) <= matching.GRAM_BYTES for s in slices)


def test_the_joined_plan_does_not_repeat_its_inputs(spark):
    left = spark.createDataFrame([(1, "abcd")], "text_id long, text string")
    right = spark.createDataFrame([(1, "bc")], "term_id long, term string")
    plan = matching.gram_pairs(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" not in plan and "ArrowEvalPython" not in plan
