import random
from collections import Counter

from pyspark.sql import functions as F

from mediasignals.llm import line_join as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, n, letters="abñ 1"):
    out = list(text)
    for _ in range(n):
        at = rng.randint(0, len(out))
        kind = rng.randrange(3)
        if kind == 0 or at == len(out):
            out.insert(at, rng.choice(letters))
        elif kind == 1:
            out.pop(at)
        else:
            out[at] = rng.choice(letters)
    return "".join(out)


def test_banded_distance(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        a = "".join(rng.choices("abñ ", k=rng.randint(0, 14)))
        rows.append((a, edited(rng, a, rng.randint(0, 4))))
    frame = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2, 3):
        for r in frame.select("a", "b", L.within(F.col("a"), F.col("b"), k).alias("w")).collect():
            assert r.w == (distance(r.a, r.b) <= k), (r.a, r.b, k)


def test_later_near_lines_match_brute_force(spark):
    rng = random.Random(4)
    found = set()
    for _ in range(12):
        base = "".join(rng.choices("abcd 12ñ", k=rng.randint(6, 30)))
        found |= {edited(rng, base, rng.randint(0, 3), "abcd 12ñ") for _ in range(8)}
    rows = list(enumerate(sorted(x for x in found if len(x) > 3)))
    rng.shuffle(rows)  # the order is not that of the ids
    frame = [(100 - i, line, at) for at, (i, line) in enumerate(rows)]
    lines = spark.createDataFrame(frame, "id long, line string, first int").withColumn("size", F.length("line"))
    for k in (1, 2):
        got = sorted(r.id for r in L.near_later(lines, k).collect())
        assert got == sorted(i for i, b, y in frame if any(x < y and distance(a, b) <= k for _, a, x in frame))


def test_family_without_its_earliest_as_centre(spark):
    """Copies two edits from a centre that comes last: most are far from the earliest one."""
    rng = random.Random(5)
    base = "the quick brown fox jumps over the lazy dog"
    rows = [edited(rng, base, 2) for _ in range(150)] + [base]
    frame = [(i, line, i) for i, line in enumerate(dict.fromkeys(rows))]
    lines = spark.createDataFrame(frame, "id long, line string, first int").withColumn("size", F.length("line"))
    got = sorted(r.id for r in L.near_later(lines).collect())
    assert got == [i for i, b, y in frame if any(x < y and distance(a, b) <= 2 for _, a, x in frame)]


def brute(rows, edits=2, least=20):
    order = sorted(
        ((doc, pos), line.strip(" \t\x0b\f\r"))
        for doc, text in rows if text is not None for pos, line in enumerate(text.split("\n"))
    )
    first = {}
    for place, line in order:
        if line:
            first.setdefault(line, place)
    sized = {}
    for line, place in first.items():
        if len(line) >= least:
            sized.setdefault(len(line), []).append((line, Counter(line), place))
    near = {
        line for n, same in sized.items() for line, letters, place in same if any(
            f < place and sum((letters - other).values()) <= edits and distance(line, m) <= edits
            for k in range(n - edits, n + edits + 1) for m, other, f in sized.get(k, ()))
    }
    drop = {place for place, line in order if line and (first[line] != place or line in near)}
    return {
        doc: None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (doc, i) not in drop)
        for doc, text in rows
    }


def test_dedup_matches_brute_force(docs):
    rng = random.Random(9)
    pool = ["".join(rng.choices("abcdefg hij", k=rng.randint(15, 40))) for _ in range(12)] + ["", "short", "   "]
    texts = [None, "", "\n", "only this line stands here once"]
    for _ in range(25):
        texts.append("\n".join(edited(rng, rng.choice(pool), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 8))))
    texts.append("\n".join([pool[0]] * 500))
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in L.dedup(docs(*texts)).collect()}
    want = brute(rows)
    assert {i: r.text for i, r in got.items()} == want
    for i, t in rows:
        lines = 0 if t is None else t.count("\n") + 1
        kept = 0 if t is None else lines - got[i].n_equal - got[i].n_near
        assert got[i].n_lines == lines and (kept == 0 or want[i].count("\n") + 1 == kept)


def test_repeated_rows_and_empty_table(docs):
    line = "a line of more than twenty characters"
    rows = L.dedup(docs(line, line, f"x\n{line}.", ids=[1, 1, 2])).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, line), (1, line), (2, "x")]
    assert L.dedup(docs("a").limit(0)).count() == 0


def test_short_equal_lines_go(docs):
    rows = L.dedup(docs("short\nA.\n\n ", "A.\nshort\nshore\n\n")).collect()
    assert {r.doc_id: (r.text, r.n_equal, r.n_near) for r in rows} == {
        0: ("short\nA.\n\n ", 0, 0), 1: ("shore\n\n", 2, 0)}


def test_null_and_shared_ids(docs):
    line, other = "a line of more than twenty characters", "another line of some thirty characters"
    rows = L.dedup(docs(line, f"{line}\n{other}", f"{other}\nx", None, ids=[None, 7, None, None])).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted(
        [("None", ""), ("7", f"{line}\n{other}"), ("None", "x"), ("None", "None")])
    # texts of one id are told apart: what goes from one stays in the other
    rows = L.dedup(docs(f"{line}\nalpha", "beta\ngamma", f"delta\n{line}", ids=[1, 2, 2])).collect()
    assert sorted(r.text for r in rows) == sorted([f"{line}\nalpha", "beta\ngamma", "delta"])


def test_clashing_names_and_long_lines(spark):
    long = "word " * 30_000
    rows = [(1, long, 5, "a", "b", "c"), (2, f"{long[:70_000]}x{long[70_000:]}\nend", 6, "a", "b", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_equal string, n_near string, line string")
    got = {r.doc_id: r for r in L.dedup(frame).collect()}
    assert got[1].text == long and got[2].text == "end" and got[2].line == "c"
    assert (got[2].n_lines, got[2].n_equal, got[2].n_near) == (2, 0, 1)
