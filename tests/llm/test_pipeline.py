import pytest

import corpus_pipeline as C
from mediasignals.llm.piece_lattice import Vocabulary
from mediasignals.llm.queries import TOKENIZER
from mediasignals.session import written

from .conftest import SF
from .test_line_join import brute as kept_lines
from .test_parity_join import brute as groups
from .test_quality_rules import brute as counts
from .test_wu_manber import brute as hits


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage written once: name -> frame."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = {"documents": docs}
    for name, stage in C.STAGES:
        docs = made[name] = written(stage(spark, docs, SF), "tested")
    return made


def texts_of(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_quality(stages):
    before, good = texts_of(stages["documents"]), texts_of(stages["quality rules"])
    # too few labels here to certify a cutoff: the base rule decides
    n = {i: counts(t) for i, t in before.items()}
    assert good == {i: t for i, t in before.items() if n[i][0] >= 50 and 100 * n[i][4] <= 50 * n[i][0]}
    assert stages["quality rules"].columns == stages["documents"].columns


def test_lines(stages):
    before, rows = texts_of(stages["quality rules"]), {r.doc_id: r for r in stages["line dedup"].collect()}
    want = {i: t for i, t in kept_lines(sorted(before.items())).items() if t.strip()}
    assert {i: r.text for i, r in rows.items()} == want
    assert all(r.n_chars == len(r.text) for r in rows.values() if r.text != before[r.doc_id])
    assert stages["line dedup"].columns == stages["documents"].columns


def test_near_duplicates(stages):
    before = texts_of(stages["line dedup"])
    want = {i: before[i] for i, _, least in groups(sorted(before.items())) if i == least}
    assert texts_of(stages["n-gram Jaccard join"]) == want
    assert stages["n-gram Jaccard join"].columns == stages["documents"].columns


def test_decontamination(spark, stages):
    before = texts_of(stages["n-gram Jaccard join"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i: t for (i, t), (_, hit, _) in zip(before.items(), hits(before.values(), items), strict=True) if not hit}
    assert texts_of(stages["benchmark decontamination"]) == want
    assert stages["benchmark decontamination"].columns == stages["documents"].columns


def test_tokens(stages):
    before, vocabulary = texts_of(stages["benchmark decontamination"]), Vocabulary.load(TOKENIZER)
    out = {r.doc_id: r for r in stages["SentencePiece encoding"].collect()}
    assert set(out) == set(before)
    assert all(r.exact and vocabulary.decode(r.ids) == before[i] for i, r in out.items())


def test_run_chains_the_stages(spark, stages):
    got = {r.doc_id: r.ids for r in C.run(spark, SF).select("doc_id", "ids").collect()}
    assert got == {r.doc_id: r.ids for r in stages["SentencePiece encoding"].select("doc_id", "ids").collect()}


@pytest.mark.parametrize("name, stage", C.STAGES, ids=[n for n, _ in C.STAGES])
def test_stage_takes_odd_rows(spark, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x " * 60, "en", "s", 1), (3, "long line " * 9, None, "s", 5)]
    odd = spark.createDataFrame(rows + rows[3:], schema)
    assert stage(spark, odd.limit(0), SF).count() == 0
    kept = stage(spark, odd, SF).select("doc_id").collect()
    if name == "n-gram Jaccard join":
        assert {r.doc_id for r in kept} == {1, 2, 3, None} and len(kept) == 4
