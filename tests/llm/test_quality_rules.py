import math
from collections import Counter

from mediasignals.llm import quality_rules as Q
from mediasignals.llm.queries import op10

from .conftest import SF, SPACED


def brute(text):
    text = text or ""
    w = SPACED.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(hit)


CASES = [
    None, "", " \n\t ", "a", "a b c a b c", "x\nx\n x\nx", "##|| <é> ñ\r\nß", "ab " * 3000, "\n\n", "日本 日本 日本 日本",
    "one two three\none two three\nfour",
]


def test_counts_match_brute_force(docs):
    rows = Q.measure(docs(*CASES)).collect()
    assert len(rows) == len(CASES)
    for r in rows:
        assert tuple(r[Q.RESULT])[:5] == brute(CASES[r.doc_id]), CASES[r.doc_id]


def test_repeated_rows_and_empty_table(docs):
    twice = docs("a b", "a b", ids=[1, 1])
    assert [r[Q.RESULT].n_words for r in Q.measure(twice).collect()] == [2, 2]
    assert Q.measure(twice.limit(0)).count() == 0


def test_tail_is_the_binomial_distribution():
    for k, n, p in ((0, 10, 0.1), (3, 40, 0.05), (7, 7, 0.5), (20, 500, 0.03)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(Q.tail(k, n, p) - want) < 1e-9


def test_cutoffs_need_enough_good_documents_and_a_gain():
    top = len(Q.GRIDS["symbols_per_word"])

    def rows(good, bad):
        return [(0, "symbols_per_word", 0, good, 0), (0, "symbols_per_word", top, 0, bad)]

    assert Q.choose_cutoffs(rows(20_000, 50)) == {(0, "symbols_per_word"): Q.GRIDS["symbols_per_word"][0]}
    assert Q.choose_cutoffs(rows(100, 50)) == {}
    assert Q.choose_cutoffs(rows(20_000, 0)) == {}
    # a cutoff that rejects many good documents is never certified
    assert Q.choose_cutoffs([(0, "symbols_per_word", top, 20_000, 50)]) == {}


def test_labels_with_nulls_and_repeats(spark, docs):
    measured = Q.measure(docs(" ".join(f"w{i}" for i in range(60)), None))
    labels = spark.createDataFrame([(0, 1), (0, 0), (0, None), (1, 1), (None, 1)], "doc_id long, quality int")
    rows = Q.label_counts(measured, labels).collect()
    assert {(r.n_good, r.n_bad) for r in rows} == {(0, 1)}
    assert Q.fit(measured, labels.limit(0)) == {}
    judged = {r.doc_id: r.kept for r in Q.judge(measured, {(0, "digit_share"): 0.1}).collect()}
    assert judged == {0: False, 1: False}


def test_query(spark):
    rows = op10(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, again, hit = brute(texts[r.doc_id])
        failed = n < 50 or 100 * hit > 50 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, again, hit)
        assert r.base_failed == failed and not (failed and r.kept)


def counted(stratum, good, bad, **over):
    """Rows of all signals: none over any cutoff, but (good, bad) over all cutoffs of those named."""
    rows = []
    for name, cuts in Q.GRIDS.items():
        g, b = over.get(name, (0, 0))
        rows += [(stratum, name, 0, good - g, bad - b), (stratum, name, len(cuts), g, b)]
    return rows


def test_few_hundred_labels_certify_a_combined_rule():
    rows = counted(1, 300, 50, symbols_per_word=(0, 30), marks_per_word=(0, 20))
    assert Q.choose_cutoffs(rows) == {(1, "symbols_per_word"): 2.0, (1, "marks_per_word"): 2.0}
    # signals that together reject too many good documents are not certified together
    over = {name: (6, 20) for name in Q.GRIDS}
    assert 0 < len(Q.choose_cutoffs(counted(1, 1000, 50, **over))) < 3


def test_thin_strata_are_merged():
    assert Q.merged({0: 83, 1: 847, 2: 988, 4: 301, 5: 104}, 237) == [[0, 1], [2], [4, 5]]
    assert Q.merged({0: 500, 3: 20}, 237) == [[0, 3]] and Q.merged({2: 5}, 237) == [[2]] and Q.merged({}, 237) == []
    rows = [r for s in range(3) for r in counted(s, 90, 9, symbols_per_word=(0, 9))]
    assert Q.choose_cutoffs(rows) == {(s, "symbols_per_word"): 2.0 for s in range(3)}
    assert Q.choose_cutoffs(rows[:16]) == {}


def test_walk_takes_cheap_steps_first():
    bad, pilot = {"a": Q.np.array([5, 9]), "b": Q.np.array([0, 20])}, {"a": Q.np.array([0, 3]), "b": Q.np.array([0, 0])}
    assert list(Q.walk(bad, pilot)) == [("b", 0), ("b", 1), ("a", 0), ("a", 1)]


def test_guarantee_holds_in_simulation():
    rng = Q.np.random.default_rng(5)
    failed = 0
    for _ in range(200):
        # each of three signals is over its cutoff in 1.1 % of good documents, apart from each other
        over = {n: (int(g), 20) for n, g in zip(list(Q.GRIDS)[:3], rng.multinomial(600, [0.011] * 3 + [0.967])[:3], strict=True)}
        failed += len(Q.choose_cutoffs(counted(0, 600, 30, **over))) > 1
    assert failed <= 200 * (Q.ERROR + 0.03)
