import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mediasignals.llm import phrase_mining as M
from mediasignals.llm.queries import PHRASES_SQL, op11

from .conftest import SF, low


def brute(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, found in counts.items():
        often = {p: n for p, n in found.items() if n >= least}
        chosen = []
        for p, a in often.items():
            if len(p) == 1:
                continue
            score, k = min((2000000 * a // (often[p[:k]] + often[p[k:]]), k) for k in range(1, len(p)))
            inside = any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in often.items()
            )
            if not inside:
                phrase = " ".join(p)
                chosen.append((-score, -a, phrase.encode(), phrase, often[p[:k]], often[p[k:]]))
        for rank, (score, a, _, phrase, left, right) in enumerate(sorted(chosen)[:top], 1):
            out.append((lang, rank, phrase, -a, left, right, totals[lang], -score))
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture
def frame(spark):
    def make(rows):
        schema = "text string, lang string, size int, phrase string, f string, n int, part int"
        return spark.createDataFrame([(t, g, 1, "x", "y", 2, 3) for t, g in rows], schema)

    return make


WORDS = ["the", "New", "york", "é", "ß", "of", "naïve", "x y", "日本", "a-b"]


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(1, 30)):
            parts.append(WORDS[min(int(rng.exponential(2)), 9)])
            parts.append([" ", "  ", "\t", ", ", "\n", " . ", " "][rng.integers(7)])
        rows.append(("".join(parts), [None, "en", "und", "de"][rng.integers(4)]))
    return rows + [(None, "en"), ("", None), (" ,. \n", "fr"), ("one", "fr"), ("\x0b\x0cA\x00b \rB", "fr")]


def test_matches_brute_force(frame):
    rows = corpus(1) * 2
    for least, top in ((3, 2000), (8, 5)):
        assert got(M.mine(frame(rows), least=least, top=top)) == brute(rows, least, top)


def test_many_hash_partitions_and_pieces(frame, monkeypatch):
    """Small pieces, a small bit table and many hash partitions change nothing."""
    rows = corpus(2)
    monkeypatch.setattr(M, "PIECE", 64)
    monkeypatch.setattr(M, "PART_BYTES", 300)
    monkeypatch.setattr(M, "TOGETHER", 200)
    monkeypatch.setattr(M, "PENDING", 30)
    monkeypatch.setattr(M, "TABLE_BYTES", 16)
    assert got(M.mine(frame(rows).repartition(5), least=4)) == brute(rows, 4, 2000)


def test_hot_phrase_and_long_text(frame):
    rows = [("to be or not to be", "en")] * 300 + [("word " * 100_000 + "end", "en")] + corpus(3, 20)
    assert got(M.mine(frame(rows))) == brute(rows, 30, 2000)


def test_no_rows(frame):
    assert M.mine(frame([])).count() == 0
    assert M.mine(frame([(None, None), ("", "en")])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=60), max_size=8), st.integers(1, 6))
def test_summaries_keep_every_frequent_key(streams, least):
    mass = sum(map(len, streams))
    capacity = mass // least + 1
    whole = Counter(x for s in streams for x in s)
    merged = M.Summary(capacity)
    for s in streams:
        one = M.Summary(capacity)
        for x in s:
            one.add(np.array([x], np.uint64), np.array([1]))
        assert len(one.keys) <= capacity
        merged.merge(one)
    assert merged.lost < least and len(merged.keys) <= capacity
    kept = dict(zip(merged.keys.tolist(), merged.counts.tolist(), strict=True))
    assert {x for x, n in whole.items() if n >= least} <= set(merged.frequent(least).tolist())
    assert all(whole[x] - merged.lost <= n <= whole[x] for x, n in kept.items())


def test_query_matches_sql(spark):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    columns = "lang, rank, phrase, a, l, r, n, score"
    want = sorted(db.sql(f"select {columns} from ({PHRASES_SQL})").fetchall())
    assert want and got(op11(spark, SF)) == want
