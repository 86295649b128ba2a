import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer, decoders

from mediasignals.llm import token_align
from mediasignals.llm.queries import BYTE_BPE, TOKENIZER, op13

from .conftest import SF

COLUMNS = ["doc_id", *token_align.MEASURES, "groups_sha256"]


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)


def token_bytes(model, ids, first):
    if first:
        shown = {c: b for b, c in enumerate_bytes()}
        return [bytes(shown[c] for c in model.id_to_token(i)) for i in ids]
    out = []
    for i in ids:
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


def enumerate_bytes():
    """(byte, its character in a byte-level vocabulary)."""
    extra = 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            yield b, chr(b)
        else:
            yield b, chr(extra)
            extra += 1


def brute(models, rows):
    linked, out = Counter(), []
    for _, text in rows:
        a = b = []
        if text:
            a, b = models[0].encode(" " + text, add_special_tokens=False).ids, models[1].encode(text)
            x, y = token_bytes(models[0], a, True), token_bytes(models[1], b, False)
            if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
                a = b = []
        links, groups = [], []
        if a:
            ends_a, ends_b = running(x), running(y)
            at = {}
            for q, end in zip(b, ends_b, strict=True):
                at.setdefault(end, []).append(q)
            links = [(p, q) for p, end in zip(a, ends_a, strict=True) for q in at.get(end, ())]
            groups = spelled(a, ends_a, b, ends_b)
        linked.update(links)
        out.append((a, b, groups, links))
    most = {}
    for (_, q), n in linked.items():
        most[q] = max(most.get(q, 0), n)
    return [
        (i, len(a), len(b), len(g), len(k), sum(linked[x] == most[x[1]] for x in k), sum(linked[x] for x in k),
         hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for (i, _), (a, b, g, k) in zip(rows, out, strict=True)
    ]


def running(parts):
    out, n = [], 0
    for p in parts:
        n += len(p)
        out.append(n)
    return out


def spelled(a, ends_a, b, ends_b):
    both, left, right = set(ends_a) & set(ends_b), {}, {}
    for ids, ends, side in ((a, ends_a, left), (b, ends_b, right)):
        k = 0
        for p, end in zip(ids, ends, strict=True):
            side.setdefault(k, []).append(str(p))
            k += end in both
    return [",".join(left[k]) + "|" + ",".join(right[k]) for k in range(len(both))]


def got(frame):
    return sorted([tuple(r) for r in frame.select(COLUMNS).collect()], key=repr)


ODD = [
    None, "", " ", "a", "a b", "a▁b", "<|endoftext|> <s> x</s> <0x41>", "café naïve", "日本語 \U0001f642\U0001f642", "\n\n\ttab",
    "\x00nul", "x" * 3000, "word " * 5000, "é", "ﬁ 　 ", "  two  spaces  ", "12345 3.14,15", "it's we'll I'm", "﻿mark", "​‍",
]


def test_odd_texts_match_brute_force(spark, models):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50 + i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, "a"), (3, "a")]
    schema = "doc_id long, text string, n int, id string, block int, pairs string, n_a string"
    frame = spark.createDataFrame([(i, t, 1, "x", 2, "y", "z") for i, t in rows], schema)
    files = token_align.Tokenizers.load(BYTE_BPE, TOKENIZER)
    assert got(token_align.align(frame, files)) == sorted(brute(models, rows), key=repr)
    assert token_align.align(frame.limit(0), files).count() == 0


def test_chunks_give_what_whole_texts_give():
    pair = token_align.Pair(token_align.Tokenizers.load(BYTE_BPE, TOKENIZER))
    assert pair.chunked
    rng = random.Random(3)
    signs = [" ", "  ", "a", "é", "ß", "\n", "\t", "\u00a0", "\u3000", "\u2581", "x's", ".", "12", "\u00ad", "\u0301", "日", "\U0001f642", "\x85", "'ll", "\u2009"]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(3000)] + [t for t in ODD if t]
    for t, (n_a, n_b, n, groups, links) in zip(texts, pair.measure(texts), strict=True):
        whole = pair.whole(t)
        assert (n_a, n_b, n, groups, links.tolist()) == (*whole[:4], whole[4].tolist()), repr(t)
    pair._forget()
    pair.chunked = False
    assert [x[:4] for x in pair.measure(texts[:50])] == [pair.whole(t)[:4] for t in texts[:50]]


def test_small_blocks_change_nothing(spark, models, monkeypatch):
    monkeypatch.setattr(token_align, "BLOCK_BYTES", 300)
    monkeypatch.setattr(token_align, "STEP_BYTES", 50)
    rows = [(i, f"the number {i % 7} of the {'very ' * (i % 5)}same {t}") for i, t in enumerate(ODD * 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    files = token_align.Tokenizers.load(BYTE_BPE, TOKENIZER)
    assert got(token_align.align(frame, files)) == sorted(brute(models, rows), key=repr)


def test_tokens_without_bytes_end_where_the_one_before_does():
    pair = object.__new__(token_align.Pair)
    import numpy as np

    pair.a_size, pair.b_size = np.array([0, 1, 2]), np.array([0, 1, 2])
    count, groups, a, b = pair.align([1, 2, 0], [2, 1, 0])
    assert (count, groups, sorted(zip(a.tolist(), b.tolist()))) == (1, "1,2,0|2,1,0", [(0, 0), (0, 1), (2, 0), (2, 1)])


def test_query_matches_brute_force(spark, models):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(op13(spark, SF)) == sorted(brute(models, rows), key=repr)


def test_byte_symbols_are_those_of_the_library(models):
    # each byte alone, through the library's decoder
    decode = decoders.ByteLevel()
    for c, b in token_align.byte_symbols().items():
        assert decode.decode([c]) == bytes([b]).decode("utf-8", "replace")
