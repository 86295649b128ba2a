import hashlib
import random
from collections import defaultdict

from mediasignals.llm import wu_manber as W
from mediasignals.llm.queries import op6

from .conftest import ALNUM, SF, low


def brute(texts, items, size=10):
    known = defaultdict(set)
    for i, text in items:
        w = ALNUM.findall(low(text or ""))
        m = min(size, len(w))
        for at in range(len(w) - m + 1 if w else 0):
            known[tuple(w[at : at + m])].add(i)
    out = []
    for text in texts:
        w, hit, found = ALNUM.findall(low(text or "")), set(), set()
        for m in {len(k) for k in known}:
            for at in range(len(w) - m + 1):
                k = tuple(w[at : at + m])
                if k in known:
                    hit |= set(range(at, at + m))
                    found |= known[k]
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_random_texts_match_brute_force(spark, docs):
    rng = random.Random(5)
    words = ["a", "B", "c1", "é", "Ñu"]
    items = [(i, rng.choice([" ", ", "]).join(rng.choices(words, k=rng.randint(1, 14)))) for i in range(30)]
    items += [(40, None), (41, ""), (42, " . "), (3, "a a a")]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)] + [None, "", "...", "a " * 500]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (1 << 20, 200):  # one block, several blocks
        got = {r.doc_id: r[W.RESULT] for r in W.search(docs(*texts), bench, size=4, block_bytes=block_bytes).collect()}
        for i, want in enumerate(brute(texts, items, 4)):
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == want
            assert sum(s.end - s.start for s in got[i].spans) == want[1]


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r[W.RESULT].n_hit for r in W.search(docs("a b", None), bench).collect()] == [0, 0]
    assert W.search(docs("a").limit(0), bench).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = dict(zip(texts, brute(texts.values(), items), strict=True))
    rows = op6(spark, SF).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, found = want[r.doc_id]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), digest, hit > 0)
