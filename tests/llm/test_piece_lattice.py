import random

import pytest
import sentencepiece

from mediasignals.llm import piece_lattice as P
from mediasignals.llm.queries import TOKENIZER, op1

from .conftest import SF


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary.load(TOKENIZER)


def brute(v, text, n=4):
    t = (" " + text if text else "").replace("▁", P._OWN_SPACE).replace(" ", "▁")
    scores = []

    def go(at, total):
        if at == len(t):
            scores.append(total)
        for size in range(1, min(v.longest, len(t) - at) + 1):
            i = v.ids.get(t[at : at + size])
            if i is not None:
                go(at + size, total + v.scores[i])
            elif size == 1:
                go(at + 1, total + v.least)

    go(0, 0.0)
    return sorted(scores, reverse=True)[:n]


CASES = ["", "a", "ab c", "the cats", "  x ", "a\nb\tc", "▁a", "日ab", "😀 b", "aaaa aa", "Tht!! ##a", "ß é\r\n", "\x00<s>"]


def test_best_paths_match_brute_force(vocabulary):
    encoder = P.Encoder(vocabulary, 4)
    rng = random.Random(1)
    texts = CASES + ["".join(rng.choices("the an ", k=rng.randint(1, 11))) for _ in range(40)]
    for text, (ids, score, further) in zip(texts, encoder.encode(texts), strict=True):
        assert [score] + [s for s, _ in further] == brute(vocabulary, text), text
        chunks = vocabulary.split(text)
        for total, changes in further:
            changed = dict(changes)
            parts = [changed.get(i, encoder.n_best(c)[0][1]) for i, c in enumerate(chunks)]
            flat = [x for part in parts for x in part]
            assert vocabulary.decode(flat) == text and flat != ids.tolist()
            assert abs(sum(vocabulary.scores[i] for i in flat) - total) < 1e-6 or vocabulary.least in (total,) or any(
                i in vocabulary.byte_ids.values() for i in flat)


def test_single_chunk_search(vocabulary):
    for text in ("international", "aaaaaaaa", "x" * 3000):
        paths = vocabulary.best(text, 5)
        scores = [s for s, _ in paths]
        assert scores == sorted(scores, reverse=True) and len({p for _, p in paths}) == 5
        for s, p in paths:
            assert s == sum(vocabulary.scores[i] for i in p) and vocabulary.decode(list(p)) == text


def test_round_trip_and_library_decoder(docs, vocabulary):
    model = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    texts = [*CASES, None, "word " * 4000, "x" * 5000]
    rows = {r.doc_id: r[P.RESULT] for r in P.encode(docs(*texts), vocabulary).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert rows[i] is None
        else:
            assert rows[i].exact
            if "▁" not in text:
                assert model.decode(list(rows[i].ids)) == text
    back = P.decode(P.encode(docs(*texts), vocabulary).select("doc_id", "encoded.ids"), vocabulary, "ids")
    assert {r.doc_id: r.decoded for r in back.collect()} == dict(enumerate(texts))


def test_repeated_rows_and_empty_table(docs, vocabulary):
    assert len({tuple(r[P.RESULT].ids) for r in P.encode(docs("ab c", "ab c", ids=[1, 1]), vocabulary).collect()}) == 1
    assert P.encode(docs("a").limit(0), vocabulary).count() == 0


def test_query(spark):
    rows = op1(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.exact and r.n_tokens == len(r.ids) for r in rows)
    assert all(a.score >= b.score for r in rows for a, b in zip(r.further, r.further[1:]))
