import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import suffix_dedup as sd


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array_brute(text):
    t = [*text, 0]
    assert sd.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_array_periodic_and_random():
    rnd = random.Random(0)
    for t in ([1] * 200, [1, 2] * 100, [2, 1] * 100, [1, 2, 1, 1, 2] * 50, [rnd.randint(1, 255) for _ in range(3000)], [rnd.randint(1, 2) for _ in range(2000)]):
        t = [*t, 0]
        assert sd.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def brute(rows):
    docs = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in docs:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            least[w] = min(least.get(w, i), i)
    out = []
    for (real, _), (i, b) in zip(rows, docs):
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\x01" * 50
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((real, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = [prose(rnd.randint(8, 40)) for _ in range(6)]
    rows = []
    for k in range(70):
        parts = [rnd.choice(shared) if rnd.random() < 0.4 else prose(rnd.randint(1, 40)) for _ in range(rnd.randint(1, 5))]
        rows.append((k, " ".join(parts)))
    rows += [(200, "a" * 300), (201, "a" * 120 + "b" + "a" * 70), (202, "ab" * 100), (203, "ab" * 60), (204, None), (205, ""), (206, "x" * 49), (207, "x" * 50), (208, "x" * 51)]
    rows += [(5, rows[9][1]), (5, rows[5][1]), (300, rows[3][1]), (2, rows[3][1]), (None, rows[4][1]), (None, shared[0] + "!"), (301, rows[8][1][:150] + "#" + rows[8][1][150:])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h1 string")
    got = sd.dedup(docs, block_bytes=3000).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_later_copy_with_a_smaller_id_in_one_task(spark):
    rows = list(reversed([(k, t) for k, (_, t) in enumerate(corpus(3)) if t]))
    rows = [*rows, (1000, rows[0][1]), (-1, rows[5][1]), (-2, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, sd.dedup(docs).collect())) == sorted(brute(rows))


def test_empty(spark):
    assert sd.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r)[:4] for r in sd.dedup(spark.createDataFrame([(1, "short")], "doc_id long, text string")).collect()] == [(1, 5, 0, 0)]
