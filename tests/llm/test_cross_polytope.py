import numpy as np
from pyspark.sql import functions as F

from quillon.llm import cross_polytope


def brute(x, ids, q, k):
    near = np.array([(x[q] * v).sum() for v in x])
    return [(int(ids[j]), float(near[j])) for j in sorted((j for j in range(len(x)) if ids[j] != ids[q]), key=lambda j: (-near[j], ids[j]))[:k]]


def run(spark, x, ids, **more):
    rows = spark.createDataFrame([(int(i), [float(c) for c in v], 1.0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, score double")
    got = {}
    for r in sorted(cross_polytope.nearest(rows, F.col("id") % 20 == 0, k=20, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_hadamard_is_orthogonal():
    h = cross_polytope.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    for scale in (1.0, None):
        x = rng.normal(size=(1500, 48))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if scale is None:
            x *= rng.uniform(0.5, 2, size=(1500, 1))
        ids = np.arange(1500)
        got = run(spark, x, ids)
        assert len(got) == 75
        hits = 0
        for q, found in got.items():
            want = dict(brute(x, ids, q, 20))
            hits += len(want.keys() & {i for i, _ in found})
            assert all(abs(s - float((x[q] * x[i]).sum())) < 1e-12 for i, s in found)
        assert hits / (75 * 20) >= 0.9


def test_hot_vector_ties_and_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    x[::2] = x[0]
    ids = np.arange(400)
    got = run(spark, x, ids, block_rows=16, probes=16)
    for q in (0, 100):
        assert got[q] == [(i, s) for i, s in brute(x, ids, q, 20)]


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (20, [1.0, 0.5]), (20, [1.0, 0.5]), (7, [0.5, 0.5]), (8, [1.0]), (None, [1.0, 1.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in cross_polytope.nearest(df, F.col("id") % 20 == 0, k=20).collect())
    assert [r[:3] for r in got] == [(0, 1, 20), (0, 2, 7), (20, 1, 0), (20, 2, 7)]
    assert cross_polytope.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def recall(got, x, ids):
    return np.mean([len({i for i, _ in brute(x, ids, q, 20)} & {i for i, _ in got.get(q, [])}) / 20 for q in map(int, ids) if q % 20 == 0])


def test_recall_on_uneven_norms(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(1500)
    one = x.copy()
    one[7] *= 20
    spread = x * rng.lognormal(size=(1500, 1))
    for y, rows in ((one, 8192), (one, 100), (spread, 8192), (spread, 100)):
        got = run(spark, y, ids, exact_rows=rows)
        assert len(got) == 75 and all(len(v) == 20 for v in got.values())
        assert recall(got, y, ids) >= 0.9


def test_queries_with_few_candidates_are_searched_exactly(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(60)
    for n in (15, 60):
        for rows in (8192, 0):
            got = run(spark, x[:n], ids[:n], exact_rows=rows, tables=1, probes=1)
            assert got == {q: brute(x[:n], ids[:n], q, 20) for q in range(0, n, 20)}


def test_small_and_large_tables_take_the_same_path(spark):
    rng = np.random.default_rng(4)
    x = np.zeros((300, 32))
    x[:, :16] = rng.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(300)
    far = np.tile(np.eye(32)[20], (9000, 1))  # at right angles to all others
    few = {"tables": 2, "probes": 6, "k": 5}
    small = nearest_ids(spark, x, ids, **few)
    large = nearest_ids(spark, np.concatenate([x, far]), np.concatenate([ids, 20 * np.arange(9000) + 1001]), **few)
    assert small == {q: large[q] for q in small}
    assert any(small[q] != [i for i, _ in brute(x, ids, q, 5)] for q in small)  # by hash, not by brute force


def nearest_ids(spark, x, ids, **more):
    rows = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(cross_polytope.nearest(rows, F.col("id") % 20 == 0, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_recall_of_hashing_alone_on_a_small_table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(500)
    for y in (x, x * rng.lognormal(size=(500, 1))):
        assert recall(run(spark, y, ids), y, ids) >= 0.9
