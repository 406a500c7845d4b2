import weakref
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quillon.llm import packing


@pytest.fixture(scope="module")
def source(spark):
    return "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark, source):
    docs = spark.read.parquet(f"{source}/documents.parquet")
    base = " ".join(f"word{i}" for i in range(120))
    more = spark.createDataFrame(
        [(900001, base, "en", "a", 1), (900002, base, "en", "a", 1), (None, None, None, None, None), (900003, "", "en", "a", 0), (900004, "key password=abcdef123 end", "en", "a", 26), (900005, None, "en", None, 0)], docs.schema
    )
    docs = docs.unionByName(more)
    for name, stage in cp.STAGES[1:4]:
        out = cp.common.materialise(stage(spark, docs, source), "test")
        assert out.columns == docs.columns
        ids = Counter(r.doc_id for r in out.select("doc_id").collect())
        assert {900001, None, 900003, 900004, 900005} <= ids.keys(), name
        if name == "near_duplicates":
            assert 900002 not in ids and max(ids.values()) == 1
        if name == "secrets":
            assert out.where("doc_id = 900004").first().text == "key [SECRET] end"
        if name == "mixing":
            assert len(ids) == docs.count()


def test_toxic_stage_and_packing(spark, source):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = cp.toxic_out(spark, docs, "/root/testdata/sf0.01")
    assert out.columns == docs.columns
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    n = lambda df, y: df.join(labels.where(f"toxic = {y}"), "doc_id").count()
    assert n(out, 0) > 0.9 * n(docs, 0) and n(out, 1) < 0.5 * n(docs, 1)
    assert cp.packed(spark, docs.limit(0), source).count() == 0
    assert cp.toxic_out(spark, docs.limit(0), source).count() == 0


CLASHING = ["rate", "spans", "_base", "keep", "cands", "_id", "_hash", "own", "row", "copy", "text_hash", "node", "component", "doc_id_", "key_id", "_t"]


@pytest.mark.parametrize(("name", "stage"), cp.STAGES)
def test_extra_columns_of_clashing_names(spark, source, name, stage):
    docs = spark.read.parquet(f"{source}/documents.parquet").where("doc_id < 120 or doc_id % 7 = 0")
    more = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])
    out = stage(spark, more, source)
    if name == "packing":
        assert out.where("piece = 0").count() == docs.count()
        return
    assert out.columns == more.columns
    rows = out.collect()
    assert len(rows) > 50 and all(r[c] == k for r in rows for k, c in enumerate(CLASHING))


@pytest.mark.parametrize(("name", "stage"), cp.STAGES)
def test_empty_table_and_odd_rows(spark, source, name, stage):
    docs = spark.read.parquet(f"{source}/documents.parquet")
    assert stage(spark, docs.limit(0), source).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, "en", "a", 1), (1, "same id, other text", "en", "a", 1), (2, None, "en", "a", None), (2, None, "en", "a", None), (3, "", None, None, 0), (None, "no id here", "en", "a", 1), (None, None, None, None, None), (4, " \n ", "en", "a", 3)]
    out = cp.common.materialise(stage(spark, spark.createDataFrame(rows, docs.schema), source), "test")
    if name == "packing":
        assert out.where("piece = 0").count() == len(rows)
        return
    got = Counter((r.doc_id, r.text) for r in out.collect())
    want = Counter((i, t) for i, t, *_ in rows)
    if name == "near_duplicates":
        want[2, None] = 1
    if name == "mixing":
        assert got.keys() == want.keys() and all(got[k] >= want[k] for k in want)
    else:
        assert got == want


def test_run_is_its_stages(spark, source):
    """``run`` is the stages one after another; clean rows come through, planted copies,
    secrets and toxic rows do not."""
    packed = cp.run(spark, source)
    docs = spark.read.parquet(f"{source}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        docs = cp.common.materialise(stage(spark, docs, source), f"test-{name}")
    want = Counter()
    for r in docs.select("doc_id").collect():
        want[r.doc_id] += 1
    got = Counter(r.doc_id for r in packed.where("piece = 0").select("doc_id").collect())
    assert got == want
    size = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert size.where("n > 2048 or n <> end").count() == 0


def test_a_worker_lets_go_of_encoded_words_when_packing_is_over(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"some words of text {k % 3} " * 9) for k in range(12)], "doc_id long, text string")
    ran, run = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a: ran.append(f) or run(self, f, *a))
    near = cp.near_duplicates_out(spark, docs, "")
    ran.append(cp.toxicity.score_batches(None, 0, None))
    assert near.count() == 3 and len(ran) >= 6
    for f in ran:
        held = weakref.ref(packing.encoder(packing.default_tokenizer()))
        assert packing.encoder(packing.default_tokenizer()) is held()
        list(f(iter([])))
        assert held() is None, f


def test_registered():
    import __spark_entry__ as e

    assert "pipeline" in e.queries() and [k for k, _ in cp.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
