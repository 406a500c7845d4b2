import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing


def tables(spark, n=300):
    rnd = random.Random(0)
    vocab = {"a": [f"apple{i}" for i in range(40)], "b": [f"boat{i}" for i in range(40)], "c": [f"cloud{i}" for i in range(40)]}
    rows, labels = [], []
    for k in range(n):
        d = "a" if k % 10 < 7 else "b" if k % 10 < 9 else "c"
        rows.append((k, " ".join(rnd.choice(vocab[d] + ["the", "of"]) for _ in range(rnd.randint(5, 80)))))
        if k % 2:
            labels.append((k, d))
    rows += [(1000, None), (1001, ""), (None, "the of"), (5, rows[5][1]), (5, "the other text")]
    labels += [(7, None), (None, "a")]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, domain string"), spark.createDataFrame(labels, "doc_id long, domain string")


def test_rates_meet_targets_and_match_numpy(spark):
    docs, labels = tables(spark)
    mix = mixing.mixture(docs, labels, {"a": 1, "b": 1, "c": 1}, iterations=60)
    got = mix.rates().collect()
    assert sum(r.copies for r in got) == 305
    n = np.array([r.copies * r.n_tokens for r in got], dtype=float)
    p = np.array([[r[f"p_{k}"] for k in range(3)] for r in got])
    rate = np.array([r.rate for r in got])
    assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all()
    assert np.abs(rate * n @ p / n.sum() - 1 / 3).max() < 5e-3
    # the same descent in numpy
    base = n @ p / n.sum()
    x = np.ones(len(n))
    for _ in mix.history:
        gap = (x * n) @ p / n.sum() - 1 / 3
        x = np.clip(x - mix.step * (p @ (gap / base) + mix.ridge * (x - 1)), mix.low, mix.high)
    assert np.allclose(x, rate, atol=1e-9)
    right = [r for r in got if r.doc_id is not None and r.doc_id < 300 and r.n_tokens and r.doc_id != 5]
    assert np.mean([np.argmax([r.p_0, r.p_1, r.p_2]) == (0 if r.doc_id % 10 < 7 else 1 if r.doc_id % 10 < 9 else 2) for r in right]) > 0.95


def test_bounds_and_edges(spark):
    docs, labels = tables(spark, 60)
    rates = [r.rate for r in mixing.mixture(docs, labels, {"a": 1, "c": 5, "zz": 1}, low=1.0, high=2.0, iterations=10).rates().collect()]
    assert min(rates) >= 1 and max(rates) <= 2
    assert {r.rate for r in mixing.mixture(docs, labels.limit(0), {"a": 1}).rates().collect()} == {1.0}
    assert mixing.mixture(docs.limit(0), labels, {"a": 1}).rates().count() == 0
    with pytest.raises(ValueError):
        mixing.mixture(docs, labels, {"a": -1})


def test_copies_have_the_rate_as_mean(spark):
    got = spark.range(20000).select(mixing.copies(F.lit(1.25), "id").alias("c")).agg(F.avg("c"), F.min("c"), F.max("c")).first()
    assert abs(got[0] - 1.25) < 0.02 and (got[1], got[2]) == (1, 2)


def test_fit_ends_at_the_least_with_soft_posteriors(spark):
    rnd = random.Random(4)
    shared = [f"word{i}" for i in range(60)]
    own = {"a": ["apple", "ant"], "b": ["boat", "bee"], "c": ["cloud", "cat"]}
    rows = []
    for k in range(400):
        d = "a" if k % 10 < 7 else "b" if k % 10 < 9 else "c"
        rows.append((k, " ".join(rnd.choice(own[d] if rnd.random() < 0.04 else shared) for _ in range(rnd.randint(20, 80))), d))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, d) for i, _, d in rows if i % 2], "doc_id long, domain string")
    want = np.array([0.5, 0.1, 0.4])
    mix = mixing.mixture(docs, labels, dict(zip("abc", want.tolist(), strict=True)))
    got = mix.rates().collect()
    n = np.array([r.copies * r.n_tokens for r in got], dtype=float)
    p = np.array([[r[f"p_{k}"] for k in range(3)] for r in got])
    base = n @ p / n.sum()

    def value(x):
        return ((((x * n) @ p / n.sum() - want) ** 2) / base).sum() + mix.ridge * (n * (x - 1) ** 2).sum() / n.sum()

    x = np.ones(len(n))
    for k in range(60_000):
        if k == 40:
            early = value(x)
        x = np.clip(x - mix.step * (p @ (((x * n) @ p / n.sum() - want) / base) + mix.ridge * (x - 1)), mix.low, mix.high)
    rate = np.array([r.rate for r in got])
    assert mix.finished and value(x) < early - 1e-5
    assert value(rate) <= value(x) + 1e-7
    assert np.allclose([mix.gap[d] for d in "abc"], (rate * n) @ p / n.sum() - want, atol=1e-6)
