import random
from collections import Counter

import numpy as np

from quillon.llm import quality


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    times = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    cover = set()
    for i in range(n - 2):
        if times[tuple(words[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover), n < 50 or 100 * len(cover) > 50 * n


def test_base_statistics_brute():
    rnd = random.Random(0)
    cases = ["", " \n\t", "a", "é#| x \x1c y", "a b c a b c", "l\nl\n\n\nl \n l", "x\r\ny\r\nx\r\n"]
    cases += ["".join(rnd.choice(["ab", "é", " ", " ", "\n", "c#"]) for _ in range(rnd.randint(0, 120))) for _ in range(200)]
    for t in cases:
        assert quality.text_statistics(t.encode())[:6] == brute(t), t


def test_chi2():
    assert abs(quality.chi2_quantile(0.5, 6) - 5.348121) < 1e-5
    assert abs(quality.chi2_quantile(0.975, 2) - 7.377759) < 1e-5


def test_outliers_and_edges(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    clean = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(60, 500))) + "."
    rows = [(i, clean(), "en", "a") for i in range(150)] + [(200 + i, clean(), None, "b") for i in range(5)]
    rows += [(1000 + i, " ".join(w.upper() + "!!" for w in clean().split()), "en", "a") for i in range(6)]
    rows += [(2000, None, "en", "a"), (2001, "", None, None), (2002, "x " * 100, "en", "a"), (5, rows[5][1], "en", "a")]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, lang string, source string, kept double, n_words int")
    got = quality.quality_verdicts(docs).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(150)) and all(kept[200 + i] for i in range(5))
    assert not any(kept[1000 + i] for i in range(6)) and not kept[2000] and not kept[2001] and not kept[2002]
    assert quality.quality_verdicts(docs.limit(0)).count() == 0


def test_fit_matches_numpy():
    x = np.random.default_rng(0).normal(size=(500, quality.P))
    q = np.array([(x[:, i] * x[:, j]).sum() for i, j in quality._PAIRS])
    mean, inv, det = quality._fit(500, x.sum(axis=0), q)
    cov = np.cov(x.T, bias=True) + np.diag(quality.FLOOR**2)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(np.linalg.inv(inv), cov) and np.isclose(det, np.linalg.slogdet(cov)[1])


def test_support_takes_h_rows():
    """Bins of one row each give the moments of the h nearest; wider bins share the last."""
    x = np.random.default_rng(1).normal(size=(101, quality.P))
    x = x[np.argsort((x**2).sum(axis=1))]
    q = np.array([x[:, i] * x[:, j] for i, j in quality._PAIRS]).T
    h = int(np.ceil(quality.SUPPORT * 101))
    mean, inv, det = quality._support(np.ones(101), x, q)
    want = np.cov(x[:h].T, bias=True) + np.diag(quality.FLOOR**2)
    assert np.allclose(mean, x[:h].mean(axis=0)) and np.allclose(inv, np.linalg.inv(want)) and np.isclose(det, np.linalg.slogdet(want)[1])
    at = np.array([0, 40, h - 6, h + 4])
    n = np.diff(np.append(at, 101))
    mean, _, _ = quality._support(n, np.add.reduceat(x, at), np.add.reduceat(q, at))
    assert np.allclose(mean, (x[: h - 6].sum(axis=0) + 0.6 * x[h - 6 : h + 4].sum(axis=0)) / h)
