import random

import numpy as np
import pyarrow as pa

from mediasignals.llm import parity_join as P
from mediasignals.llm.components import connected
from mediasignals.llm.queries import op8
from mediasignals.llm.text_np import column_texts

from .conftest import SF, SPACED, low


def shingles(text, size=5):
    w = SPACED.findall(low(text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def changed(rng, words, share):
    return [f"n{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_groups_match_brute_force(docs):
    rng = random.Random(3)
    texts = [None, "", " \n ", "a", "A", "a b", "a b c d", "a b c d e", "A b c d e", "x " * 400]
    for n, copies in ((3, 4), (6, 6), (12, 8), (40, 60), (150, 45)):  # crowded keys too
        base = [f"w{rng.randrange(500)}" for _ in range(n)]
        texts += [" ".join(changed(rng, base, rng.choice([0, 0, 0.01, 0.02, 0.04, 0.1]))) for _ in range(copies)]
    common = " ".join(f"k{i}" for i in range(30))
    texts += [common + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(5, 60))) for _ in range(60)]
    rng.shuffle(texts)
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    got = P.components(docs(*texts, ids=[i for i, _ in rows])).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_repeated_rows_and_empty_table(docs):
    text = "one two three four five six"
    got = P.components(docs(text, text, None, ids=[4, 4, 2])).collect()
    assert sorted(map(tuple, got)) == [(2, 0, 2), (4, 2, 4), (4, 2, 4)]
    assert P.components(docs("a").limit(0)).count() == 0


def test_keys_are_complete():
    """Similar sets share a key, whatever counts as common."""
    rng = random.Random(11)
    for n in (1, 2, 3, 5, 8, 13, 31, 64, 100, 257):
        for _ in range(8):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
            other = base[rng.randint(0, n // 5) :] if rng.random() < 0.5 else changed(rng, base, 0.02)
            a, b = " ".join(base), " ".join(other)
            x, y = shingles(a), shingles(b)
            if 4 * len(x & y) < 3 * len(x | y):
                continue
            own, value = P.shingles(column_texts(pa.array([a, b])))
            for common in (np.zeros(1 << 16, np.uint64), np.full(1 << 16, 2**64 - 1, np.uint64),
                           np.full(1 << 16, 0x5555555555555555, np.uint64)):
                text, keys = P.join_keys(own, value, 2, common)
                assert set(keys[text == 0]) & set(keys[text == 1])


def sets_of(*sets):
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return own, np.concatenate([np.sort(np.array(list(s), np.uint64)) for s in sets])


def test_keys_are_no_more_than_needed():
    """A set sends one part more than may differ in each band it visits."""
    rng = random.Random(4)
    for n in (64, 95, 200, 1024, 1500, 2000):
        own, value = sets_of({rng.getrandbits(64) for _ in range(n)})
        _, keys = P.join_keys(own, value, 1, np.zeros(1 << 16, np.uint64))
        band = 1 << (n.bit_length() - 1)
        most = (n + min(n * 4 // 3, 2 * band - 1)) // 7 + 1
        if 4 * n >= 3 * 2 * band:  # the next band
            most += (n + n * 4 // 3) // 7 + 1
        assert len(keys) <= most
        assert keys.min() >= 0 and keys.max() < 1 << 48  # zero bytes compress


def test_sets_that_just_link_share_a_key():
    """With as many differences as a link allows, on either side of a band's border."""
    rng = random.Random(5)
    sets = []
    for n in [*range(1, 40), 63, 64, 65, 96, 127, 128, 129, 170, 255, 256, 500, 512, 700, 1023]:
        for _ in range(12):
            base = [rng.getrandbits(64) for _ in range(n)]
            out = rng.randint(0, n // 4)
            put = (4 * (n - out) - 3 * n) // 3  # of shingles in one set only, with those left out
            sets += [set(base), set(base[out:]) | {rng.getrandbits(64) for _ in range(rng.choice([0, put]))}]
    own, value = sets_of(*sets)
    for word in (0, 2**64 - 1, 0x5555555555555555, 0xFFFF0000FFFF0000, 0x7FFFFFFFFFFFFFFF):
        text, keys = P.join_keys(own, value, len(sets), np.full(1 << 16, word, np.uint64))
        of = [set() for _ in sets]
        for t, k in zip(text.tolist(), keys.tolist(), strict=True):
            of[t].add(k)
        for i in range(0, len(sets), 2):
            assert 4 * len(sets[i] & sets[i + 1]) >= 3 * len(sets[i] | sets[i + 1])
            assert of[i] & of[i + 1]


def test_texts_are_cut_twice_and_those_of_pairs_once_more(docs, tmp_path, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(200)]
    texts += [texts[0] + " more", texts[0].upper(), texts[0]]  # near, of equal set, equal
    cut, log = P.shingles, tmp_path / "cut"

    def counted(t, size=P.SHINGLE):
        with open(log, "a") as out:
            out.write(f"{t.n}\n")
        return cut(t, size)

    monkeypatch.setattr(P, "shingles", counted)
    got = P.components(docs(*texts)).collect()
    assert sorted(map(tuple, got)) == brute(list(enumerate(texts)))
    # one text, or its copy too, of each of the two classes that are compared
    assert 2 * len(texts) + 2 <= sum(map(int, log.read_text().split())) <= 2 * len(texts) + 3


def test_common_shingles_are_found_while_measuring(docs):
    common = "a line that many documents share"
    texts = [f"{common} u{i} v{i} w{i} x{i} y{i}" for i in range(60)]
    measured = P.measure(docs(*texts, None).coalesce(1))
    _, value = P.shingles(column_texts(pa.array([common])))
    slots = {r.slot for r in measured.where("slot IS NOT NULL").collect()}
    assert slots == {int(v) & (1 << P.SLOT_BITS) - 1 for v in value}
    assert sorted(r.doc for r in measured.where("slot IS NULL").collect()) == list(range(61))
    assert P._in_bitmap(P.common_slots(measured), value & np.uint64((1 << P.SLOT_BITS) - 1)).all()


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (8, 7), (7, 7), (20, 21), (21, 22), (22, 20)], "a long, b long")
    got = {tuple(r) for r in connected(links).collect()}
    assert got == {(3, 3), (4, 3), (5, 3), (9, 3), (7, 7), (8, 7), (20, 20), (21, 20), (22, 20)}
    assert connected(links.limit(0)).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op8(spark, SF).collect()) == brute(rows)
