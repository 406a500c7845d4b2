import random

import numpy as np
import xxhash

from quillon.llm import simhash


def brute(text, shingle):
    words = text.lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def near(rnd, base, most):
    for _ in range(rnd.randint(0, most)):
        base ^= 1 << rnd.randrange(64)
    return base


def test_fingerprint_brute():
    for t in (b"", b"  \t\n", b"One", b"a b c d", "É a b C\x0bd e f\xa0g".encode(), b"x y " * 300, b"a b c d e f g"):
        for n in (4, 5):
            assert simhash.fingerprint(t, n) == brute(t, n)


def test_spark_xxhash_is_the_same(spark):
    got = spark.sql("select xxhash64('a b c d') h").first().h % 2**64
    assert got == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_manhattan_is_a_lower_bound():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 2**63, (2, 500), dtype=np.uint64)
    gap = np.abs(simhash.popcounts(a).astype(int) - simhash.popcounts(b).astype(int)).sum(axis=1)
    assert (gap <= np.bitwise_count(a ^ b)).all()


def test_components_against_brute_force(spark):
    rnd = random.Random(3)
    fps = []
    for _ in range(25):
        base = rnd.getrandbits(64)
        fps += [near(rnd, base, 6) for _ in range(rnd.randint(1, 14))]
    fps = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    want = groups([f % 2**64 for f in fps], 4)
    for limit in (20_000, 10):
        nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
        found = simhash.links(nodes, 4, limit)
        got = {r.node: r.component for r in simhash.components(found.select(found.fp_a.alias("a"), found.fp_b.alias("b"))).collect()}
        assert {f: got.get(f, f) for f in fps} == {f: fps[w] for f, w in zip(fps, want, strict=True)}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(9, base), (3, base), (5, base.upper()), (7, "other words entirely here now"), (8, None), (2, ""), (None, base), (11, " \n")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = simhash.simhash_components(docs, shingle=4, radius=4)
    assert sorted((r.doc_id or -1, r.component_id) for r in got.collect()) == [(-1, 3), (2, 2), (3, 3), (5, 3), (7, 7), (8, 2), (9, 3), (11, 2)]
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_unary_counts_the_manhattan_distance():
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(0, 1 << 63, size=(2, 500), dtype=np.uint64)
    for segments in (8, 32):
        want = np.abs(simhash.popcounts(a, segments).astype(int) - simhash.popcounts(b, segments).astype(int)).sum(axis=1)
        assert (np.bitwise_count(simhash.unary(a, segments) ^ simhash.unary(b, segments)) == want).all()
        assert (want <= np.bitwise_count(a ^ b)).all()
    assert len(simhash.unary(a[:0])) == 0
