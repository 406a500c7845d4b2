import random
from itertools import combinations
from pathlib import Path

import corpus_pipeline as cp
from quillon.llm import near_copies


def copies(rnd, n, words, edits):
    """Texts of one base, each with some words replaced."""
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for at in rnd.sample(range(words), rnd.randint(0, edits)):
            text[at] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def alike(a, b):
    x, y = (set(near_copies.shingle_set(t.encode()).tolist()) for t in (a, b))
    return len(x & y) >= 0.8 * len(x | y)


def groups(texts):
    least = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if alike(texts[i], texts[j]) and least[i] != least[j]:
            low, high = sorted((least[i], least[j]))
            least = [low if x == high else x for x in least]
    return least


def test_components_against_brute_force(spark):
    rnd = random.Random(5)
    texts = [t for _ in range(30) for t in copies(rnd, rnd.randint(1, 8), rnd.randint(60, 400), 6)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, ""), (1001, None)], "doc_id long, text string")
    got = {r.doc_id: r.component for r in near_copies.near_copies(docs).collect()}
    assert got.pop(1000) is None and got.pop(1001) is None
    least = {}
    for i in sorted(got):
        least.setdefault(got[i], i)
    assert [least[got[i]] for i in range(len(texts))] == groups(texts)


def test_cells_cut_into_blocks_lose_no_link(spark):
    rnd = random.Random(7)
    texts = [t for _ in range(8) for t in copies(rnd, 12, 120, 14)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_copies.common.materialise(near_copies.sketches(docs), "sketches")
    whole, cut = ({tuple(r) for r in near_copies.components(rows, docs, cell_hashes=n).collect()} for n in (10**6, 300))
    assert whole == cut and whole


def test_sets_of_single_texts_are_not_written(spark, monkeypatch):
    rnd = random.Random(8)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(3000)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    written, write = [], near_copies.common.materialise

    def noted(df, name):
        out = write(df, name)
        written.append(sum(p.stat().st_size for p in Path(out._quillon_path.removeprefix("file://")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(near_copies.common, "materialise", noted)
    assert near_copies.near_copies(docs).count() == 60
    assert max(written) < 0.2 * sum(map(len, texts))


def test_stage_drops_copies_from_similarity_08(spark):
    rnd = random.Random(6)
    rows = []
    for k in range(40):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        edited = list(base)
        for at in (20, 80, 140, 200, 260):  # 25 of 296 shingles change: similarity 0.84
            edited[at] = "changed"
        far = list(base)
        for at in range(10, 290, 20):  # 70 of 296: 0.62
            far[at] = "other"
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(edited)), (3 * k + 2, " ".join(far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in cp.near_duplicates_out(spark, docs, "").collect()}
    assert left == {i for i in range(120) if i % 3 != 1}


def test_stage_judges_each_row_by_its_own_text(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(50))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (2, text("b")), (3, text("c")), (3, text("d")), (None, text("a")), (None, text("e")), (None, text("e")), (None, ""), (None, ""), (4, ""), (4, ""), (5, None)]
    left = [tuple(r) for r in cp.near_duplicates_out(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    want = [(1, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (None, text("e")), (None, ""), (None, ""), (4, ""), (5, None)]
    assert sorted(left, key=str) == sorted(want, key=str)
