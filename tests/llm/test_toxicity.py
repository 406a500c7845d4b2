import random
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np

from quillon.llm import toxicity


def features(w):
    out = Counter()
    for t in combinations(range(len(w)), 3):
        if t[2] - t[0] < toxicity.SPAN:
            out[w[t[0]], w[t[1]], w[t[2]]] += toxicity.DECAY ** (t[2] - t[0] + 1)
    return out


def norm(f):
    return sum(v * v for v in f.values()) ** 0.5


def brute(window, mark):
    x, y = features(window), features(mark)
    return sum(v * y[k] for k, v in x.items()) / (max(norm(x), toxicity.FULL) * norm(y)) if x and y else 0.0


WORDS = ["idiot", "you idi0t", "i-d-i-o-t", "aaaaaaaaaaaaaaaa", "banana band and a", "abc", "ab", "stupid one, you", "stuupid", "hexagonality"]


def test_kernel_brute():
    marks = [w for w in WORDS if len(w) > 2]
    got = toxicity.gram(WORDS, marks)
    want = np.array([[brute(a[: toxicity.WINDOW], b[: toxicity.WINDOW]) for b in marks] for a in WORDS])
    assert np.allclose(got, want, atol=1e-5)


def test_worst_window_brute():
    """The table of weights and the bound give the greatest kernel of all windows of all sentences."""
    table = np.zeros(toxicity.SYMBOLS**3)
    mark = toxicity.rows(["worthless"])
    code, weight = toxicity._codes(mark)
    np.add.at(table, code, weight / toxicity.norms(mark, 1e-12)[:, None])
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("worthles   .\n") for _ in range(rnd.randint(0, 120))) for _ in range(30)]
    texts += ["you are worth-less. Truly", "worth. Less", "", "x" * 200 + " worthles " + "y" * 200]
    value, name = toxicity.worst(texts, table, 0.05)
    for text, v, n in zip(texts, value, name):
        windows = [s[max(0, k) : k + toxicity.WINDOW] for s in toxicity.plain(text).split("\0") for k in range(1 - toxicity.WINDOW, len(s))]
        want = max([0.05, *(brute(w, "worthless") for w in windows)])
        assert abs(v - want) < 1e-5 and (n is None) == (v == 0.05)
    assert value[30] > 0.5 > value[31]


def test_sentences():
    assert [s.strip() for s in toxicity.plain("You i d i o t!! Go (now)\n\nA  fool, e.g. idi.ot\t.").split("\0") if s.strip()] == ["you idiot", "go (now)", "a fool, e.g", "idi.ot"]


def sample(rnd, n, insults, often=5):
    syll = ["an", "re", "on", "ti", "sh", "le", "ou", "ed"]
    out = []
    for k in range(n):
        words = ["".join(rnd.choice(syll) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "", "", "."]) for _ in range(rnd.randint(20, 80))]
        if k % often == 0:
            words.insert(rnd.randrange(len(words)), rnd.choice(insults))
        out.append((k, " ".join(words), int(k % often == 0)))
    return out


INSULTS = ["idiot", "moron", "scumbag", "zorgling", "zorgfix", "zorgum"]


def test_fit_score_and_edges(spark):
    rnd = random.Random(0)
    rows = sample(rnd, 1000, INSULTS)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    new = sample(rnd, 200, INSULTS) + [(1000, "an re on idi.ot ti sh", 1), (1001, "an re i d i o t on", 1), (1002, "", 0), (1003, None, 0), (1004, "x" * 700_000 + " idiot", 1), (None, "an", 0), (5, "an", 0), (5, "an", 0)]
    got = toxicity.score(spark.createDataFrame(new, "doc_id long, text string, toxic int"), model).collect()
    assert len(got) == len(new) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score >= 0.5 for r in got}
    right = sum(by[i] == bool(y) for i, _, y in new[:200])
    assert right >= 194
    assert by[1000] and by[1001] and by[1004] and not by[1002] and not by[1003]
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_insult_of_two_words_that_are_clean_apart():
    """Sentences are judged whole: no word of the insult is toxic by itself."""
    rnd = random.Random(3)
    plain = lambda rows: [(i, t + rnd.choice([" grey rat", " a rat.", " old grey ", " brain", " rat, old brain", ""]) + " on", y) for i, t, y in rows]
    rows, new = (plain(sample(rnd, n, ["rat brain"], often=3)) for n in (500, 300))
    model = toxicity.train([t for _, t, _ in rows], [y for *_, y in rows])
    value, _ = toxicity.worst([t for _, t, _ in new], model.table, model.floor)
    said = model.probability(value) >= 0.5
    y = np.array([y for *_, y in new]) > 0
    assert said[y].mean() > 0.9 and said[~y].mean() < 0.1


def test_fit_takes_each_class_from_the_documents_at_hand(spark, monkeypatch):
    rows = [(i, f"clean text {i}") for i in range(8)] + [(100 + i, f"toxic text {i}") for i in range(8)]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows] + [(i, i % 2) for i in range(1000, 1400)], "doc_id long, toxic int")
    docs = spark.createDataFrame([rows[0]] * 50 + rows * 3, "doc_id long, text string")
    monkeypatch.setattr(toxicity, "train", lambda texts, y: (texts, y))
    texts, y = toxicity.fit(docs, labels, max_rows=6)
    assert y == [0] * 6 + [1] * 6 and len(set(texts)) == 12
    texts, y = toxicity.fit(docs, labels, max_bytes=40)
    assert Counter(y) == {0: 3, 1: 3}


def test_repeated_rows_leave_the_model_as_it_is(spark):
    rnd = random.Random(4)
    rows = sample(rnd, 120, INSULTS, often=2)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    once = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    a, b = (toxicity.fit(d, labels, max_rows=40) for d in (once, once.unionByName(once).unionByName(once.where("doc_id % 2 = 1"))))
    assert np.allclose(a.table, b.table) and a.slope > 0


def test_first_table_and_kernel_need_little_memory():
    flat = np.random.default_rng(0).integers(0, 30, 4_000_000).astype(np.int32)
    peaks = []
    for step in (lambda: toxicity.odds(flat, (flat % 2).astype(np.int8)), lambda: toxicity.symbols("ab c" * 1_000_000), lambda: toxicity.gram(["some plain words of a text here"] * 200, ["other words of text"] * 256)):
        tracemalloc.start()
        step()
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert max(peaks) < 50, peaks
