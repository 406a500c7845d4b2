import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import common, ngram_lm


def counts(lines, order):
    """N-gram counts over texts that begin with start marks; a history counts what follows it."""
    out = [Counter() for _ in range(order + 1)]
    for words in lines:
        line = ["<s>"] * (order - 1) + words + ["</s>"]
        for k in range(order - 1, len(line)):
            for n in range(1, order + 1):
                out[n][tuple(line[k - n + 1 : k + 1])] += 1
    return out


class Backoff:
    """Discounted counts with Katz's back-off weights, over dictionaries."""

    def __init__(self, lines, order, discount):
        self.c, self.order, self.d = counts(lines, order), order, discount
        self.total, self.kinds = sum(self.c[1].values()), len(self.c[1])

    def p(self, word, history):
        if not history:
            return (self.c[1][(word,)] + 1) / (self.total + self.kinds + 1)
        n = len(history) + 1
        after = {g[-1]: k for g, k in self.c[n].items() if g[:-1] == history}
        if not after:
            return self.p(word, history[1:])
        c = sum(after.values())
        if word in after:
            return (after[word] - self.d) / c
        free = self.d * len(after) / c / (1 - sum(self.p(w, history[1:]) for w in after))
        return free * self.p(word, history[1:])


def brute(rows, order, discount):
    split = [(i, [w.decode() for w in (t or "").encode().lower().split()]) for i, t in rows]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in rows]
    model = Backoff([w for ok, (_, w) in zip(train, split) if ok], order, discount)
    out = []
    for ok, (i, words) in zip(train, split):
        line = ["<s>"] * (order - 1) + words + ["</s>"]
        at = range(order - 1, len(line))
        base = sum(math.log10(model.p(line[k], ())) for k in at)
        known = sum(model.c[1][(line[k],)] > 0 for k in at)
        score = sum(math.log10(model.p(line[k], tuple(line[k - order + 1 : k]))) for k in at)
        out.append((i, not ok, len(words) + 1, known, model.total, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[6])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)


@pytest.mark.parametrize(("order", "fan"), [(1, 10), (2, 10), (3, 10), (2, 2), (3, 2)])
def test_against_brute_force(spark, order, fan):
    """With a fan of 2 bits the messages take the way of two levels."""
    rnd = random.Random(order)
    rows = [(i, " ".join(rnd.choice(["A", "a", "b", "c", "é", "dd"]) for _ in range(rnd.randint(0, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (None, "a b"), (7, rows[7][1]), (9, "zz yy zz")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, block int")
    same(ngram_lm.score(docs, order=order, discount=0.4, block_bytes=200, fan=fan).collect(), brute(rows, order, 0.4))


def test_long_text_is_read_in_segments(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(n))) for i, n in enumerate((3 * ngram_lm.SEGMENT + 17, ngram_lm.SEGMENT - 1, 5, 0))]
    same(ngram_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), order=3).collect(), brute(rows, 3, ngram_lm.DISCOUNT))


def machine(lines, order, discount=0.5, extra=()):
    """The automaton of a few texts in one block; ``extra`` are read but not trained on."""
    names, ids, lens = {"<s>": 0, "</s>": 1}, [], []
    for words in [*lines, *extra]:
        line = ["<s>"] * (order - 1) + list(words) + ["</s>"]
        ids += [names.setdefault(w, len(names)) for w in line]
        lens.append(len(line))
    hashed = np.arange(1, len(names) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    grams = ngram_lm.Grams(np.array(ids, dtype=np.int32), np.array(lens), hashed, order)
    train = np.repeat(np.arange(len(lens)) < len(lines), grams.lens)
    c = grams.counts(train)
    n, v = int(c[0].sum()) - (len(lines) if order > 1 else 0), int((c[0] > 0).sum()) - (order > 1)
    w = ngram_lm.Weights(grams, c, n, v, discount)
    spare = []
    for m in range(1, order):
        t, s = w.following(m, np.ones(len(c[m]), dtype=bool))
        spare.append(t / (1 - s))
    return ngram_lm.Automaton(w, spare), names, c


@pytest.mark.parametrize("order", [1, 2, 3])
def test_next_words_of_every_state_sum_to_one(order):
    rnd = random.Random(order)
    lines = [[rnd.choice("abcd") for _ in range(rnd.randint(0, 8))] for _ in range(12)]
    auto, names, c = machine(lines, order, extra=[["unseen"]])
    words = np.array([k for w, k in names.items() if w != "<s>" and (c[0][k] > 0 or w == "unseen")])
    assert len(auto.failure) > (0, 0, 4, 10)[order]
    for state in range(len(auto.failure)):
        _, logp = auto.step(np.full(len(words), state), words)
        assert math.isclose(float((10.0**logp).sum()), 1.0, rel_tol=1e-9)


def test_arcs_and_failure_arcs():
    """The machine fails over to shorter histories and carries its state on."""
    lines = [list("abab"), list("abc"), list("cb")]
    auto, names, _ = machine(lines, 3)
    model = Backoff(lines, 3, 0.5)
    state = np.zeros(1, dtype=np.int64)
    for mark in ("<s>", "<s>"):
        state, _ = auto.step(state, np.array([names[mark]]))
    history = ("<s>", "<s>")
    for word in "abcbbac":
        state, logp = auto.step(state, np.array([names[word]]))
        assert math.isclose(10 ** logp[0], model.p(word, history), rel_tol=1e-12)
        history = (*history, word)[-2:]
    # "ac" was not seen: the state is that of "c", whose failure arc leads to the empty history
    assert auto.failure[state[0]] == 0 and state[0] != 0


def test_empty_table(spark):
    assert ngram_lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_block_needs_little_memory_and_wide_codes(spark):
    rng = np.random.default_rng(0)
    width, n = 100_000, 600_000  # states times words exceed 32 bits
    names = common.mix(np.arange(1, width + 1, dtype=np.uint64))
    ids = rng.integers(2, width, n).astype(np.int32)
    ids[::1000], ids[999::1000] = 0, 1
    lens = np.full(n // 1000, 1000)
    tracemalloc.start()
    grams = ngram_lm.Grams(ids, lens, names, 2)
    peak = tracemalloc.get_traced_memory()[1] / n
    tracemalloc.stop()
    assert peak < 75, peak
    counts = grams.counts(np.ones(n, dtype=bool))
    weights = ngram_lm.Weights(grams, counts, n, width, 0.5)
    t, s = weights.following(1, np.ones(len(counts[1]), dtype=bool))
    machine = ngram_lm.Automaton(weights, [t / (1 - s)])
    got = machine.read(ids, lens, 2)
    pair = dict(zip(zip(grams.history[1].tolist(), grams.last[1].tolist()), weights.arc[1].tolist()))
    want = [sum(np.log10(pair[int(a), int(b)]) for a, b in zip(x[:-1], x[1:])) for x in ids.reshape(-1, 1000)[:5]]
    assert np.allclose(got[:5], want)
