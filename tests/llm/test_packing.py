import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import packing


def check(histogram, runs, capacity):
    filled, seen = defaultdict(list), defaultdict(list)
    for s, r, n, first, o in runs:
        seen[s] += range(r, r + n)
        for k in range(n):
            filled[first + k].append((o, s))
    assert {s: sorted(x) for s, x in seen.items()} == {s: list(range(n)) for s, n in histogram.items() if n}
    for slots in filled.values():
        at = 0
        for o, s in sorted(slots):
            assert o == at
            at += s
        assert at <= capacity
    return len(filled)


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_everything_and_nearly_full(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([1, 3, 700, 64, rnd.randint(1, 128)]) if rnd.random() < 0.4 else rnd.randint(1, 2048) for _ in range(3000)]
    histogram = Counter(lengths)
    used = check(histogram, packing.plan(histogram), 2048)
    assert used <= 1.04 * -(-sum(lengths) // 2048) + 2


def test_plan_small_cases():
    assert packing.plan({}) == []
    assert check({2048: 3}, packing.plan({2048: 3}), 2048) == 3
    assert check({1: 5}, packing.plan({1: 5}), 2048) == 1
    assert check({1025: 4, 1023: 4}, packing.plan({1025: 4, 1023: 4}), 2048) == 4
    assert check({700: 100000}, packing.plan({700: 100000}), 2048) == 50000


def test_word_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok, encode = Tokenizer.from_file(path), packing.WordEncoder(path)
    texts = ["", " ", "Hello, World's 12 É!!", "a\x1cb\x85c\xa0d", "ΑΣ final Σ", "<|endoftext|> x", "it'S we'LL 'd", "x" * 500 + " ²¼", "ªº µ ß ÿ", "é \U0001f600", "don't''s!'s", "ſs 'ſ"]
    for t, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_query_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "abc"), (5, "word " * 5000), (6, "tie"), (7, "tie")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, length string")
    out = packing.best_fit_packing(docs).collect()
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for slots in bins.values():
        at = 0
        for o, n in sorted(slots):
            assert o == at
            at += n
        assert at <= 2048
    ids = tok.encode("word " * 5000, add_special_tokens=False).ids + [0]
    long = sorted((r for r in out if r.doc_id == 5), key=lambda r: r.piece)
    assert [(r.start, r.length) for r in long] == [(0, 2048), (2048, 2048), (4096, 905)]
    assert [r.ids_crc32 for r in long] == [zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()) for s in (0, 2048, 4096)]
    assert len(out) == len(rows) + 2
    assert packing.best_fit_packing(docs.limit(0)).count() == 0


def test_words_are_encoded_once_in_a_worker(monkeypatch):
    path = packing.default_tokenizer()
    first = packing.encoder(path)
    texts = ["some words, twice some words", "été 12 " + "w" * 100, "naïve <|endoftext|> text", "漢字 and words", ""]
    want = [first.whole(t) for t in texts]
    assert first(texts) == want
    asked = []
    monkeypatch.setattr(first, "_words", lambda words: asked.extend(words) or {w: first.whole(w) for w in words})
    assert packing.encoder(path) is first and packing.encoder(path)(texts) == want
    assert all(len(w) > 64 for w in asked)
