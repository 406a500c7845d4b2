import json
import time

import pytest
from pyspark.sql import functions as F

from quillon.functions import instruments, text
from quillon.operators import ordered_map, timeline
from quillon.sources import artifact, manifest, prepared

RESULTS = "record_index long, skipped int, samples array<struct<mode:string,input_ids:array<int>,labels:array<int>>>"


def results(spark, first, last):
    rows = [(k, int(k % 10 == 0), [] if k % 10 == 0 else [("scratch", [k] * 3, [-100, k, k])]) for k in range(first, last)]
    return spark.createDataFrame(rows, RESULTS)


def test_prepared_run(spark, tmp_path):
    run = str(tmp_path / "run")
    with pytest.raises(FileNotFoundError):
        prepared.resume(spark, run)
    with pytest.raises(FileNotFoundError):
        prepared.check(spark, run)
    prepared.write_flush(results(spark, 0, 100), run, 0, 0.8)
    assert prepared.resume(spark, run) == {"processed": 100, "skipped": 10, "num_train": 72, "num_val": 18, "flushes": 1}
    prepared.write_flush(results(spark, 0, 100), run, 0, 0.8)  # repeated after a failure
    prepared.write_flush(results(spark, 100, 121), run, 1, 0.8)
    with pytest.raises(ValueError):
        prepared.read_split(spark, run, "train")
    totals = {r.split: r for r in prepared.count_splits(spark, run).collect()}
    assert (totals["train"].samples, totals["val"].samples, totals["total"].target_tokens) == (72 + 14, 18 + 4, 2 * 108)
    done = prepared.finish(spark, run, "abc", "m.jsonl")
    assert (done["processed"], done["num_samples"], done["completed"]) == (121, 108, True)
    with pytest.raises(ValueError):
        prepared.resume(spark, run)
    seen = [r.record_index for s in ("train", "val") for r in prepared.read_split(spark, run, s).collect()]
    assert sorted(seen) == [k for k in range(121) if k % 10]
    files = prepared.shards(spark, run).groupBy("split").agg(F.sum("num_samples").alias("n")).collect()
    assert {(r.split, r.n) for r in files} == {("train", 86), ("val", 22)}
    spark.createDataFrame([(prepared.FORMAT, 99, True, 0, 0, 0, 0, 0, 0, "", "")], prepared.META).write.mode("overwrite").parquet(f"{run}/meta")
    with pytest.raises(ValueError):
        prepared.check(spark, run)


def test_flush_without_samples(spark, tmp_path):
    run = str(tmp_path / "run")
    prepared.write_flush(results(spark, 0, 1), run, 0)
    assert prepared.state(spark, run) == {"processed": 1, "skipped": 1, "num_train": 0, "num_val": 0, "flushes": 1}
    prepared.finish(spark, run)
    assert prepared.read_split(spark, run, "train").count() == 0


def test_artifact(spark, tmp_path):
    words = spark.createDataFrame([(0, "a"), (1, "é")], "token_id long, piece string")
    content, path = artifact.payload(words), str(tmp_path / "tok")
    artifact.save(spark, path, content)
    back, vocabulary = artifact.load(spark, path)
    assert back == content and sorted(map(tuple, vocabulary.collect())) == [(0, "a"), (1, "é")]
    for wrong in ({"version": 0}, {"vocab_size": 3}, {"offsets": {"text": 1, "midi": 2}}):
        artifact.save(spark, path, content | wrong)
        with pytest.raises(ValueError):
            artifact.load(spark, path)
    with pytest.raises(ValueError):
        artifact.payload(words.where("token_id = 1"))


def test_map_records(spark):
    def f(v):
        if v == 7:
            time.sleep(5)
        if v % 5 == 0:
            raise KeyError(v)
        return v * 2

    rows = ordered_map.map_records(spark.range(20).repartition(2), "id", "id", f, "long", seconds=1.0)
    got = {r.id: (r.result, r.error) for r in rows.collect()}
    assert len(got) == 20 and got[5] == (None, "KeyError: 5") and got[6] == (12, None) and got[7][0] is None and "Timeout" in got[7][1]


def test_record_index(spark, tmp_path):
    (tmp_path / "b é+.jsonl").write_text("".join(json.dumps({"k": k}) + "\n\n" for k in range(50)), encoding="utf-8")
    (tmp_path / "a.json").write_text('[{"k": -2}, {"k": -1}]')
    (tmp_path / "c.jsonl").write_text('{"k": 50}\n')
    got = [(r.record_index, json.loads(r.item)["k"]) for r in manifest.indexed(spark, str(tmp_path)).orderBy("record_index").collect()]
    assert got == [(k, k - 2) for k in range(53)]
    assert manifest.indexed(spark, str(tmp_path), most=3).count() == 3


def test_byte_text(spark):
    import random

    rnd = random.Random(1)
    rows = [[rnd.choice([65, 0, 10, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xFF, 300, -4]) for _ in range(rnd.randint(0, 30))] for _ in range(300)]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k long, ids array<int>").select("k", text.byte_text(F.col("ids")).alias("t"))
    for r in df.collect():
        assert r.t == bytes(max(0, min(255, x)) for x in rows[r.k]).decode("utf-8", errors="ignore")


def test_encoder(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "A text, é"), (2, ""), (3, None)], "k long, t string")
    got = {r.k: r.ids for r in df.select("k", text.encoder(path)(F.col("t")).alias("ids")).collect()}
    assert got == {1: Tokenizer.from_file(path).encode("A text, é", add_special_tokens=False).ids, 2: [], 3: None}
    with pytest.warns(UserWarning):
        assert df.where("k = 1").select(text.encoder(None)(F.col("t")).alias("ids")).first().ids == list("A text, é".encode())


def test_wrong_track_index(spark):
    tracks = spark.createDataFrame([(1, 0), (1, 1)], "score_id long, track_idx long")
    with pytest.raises(Exception, match="no track 2"):
        timeline.split_at(tracks, spark.createDataFrame([(1, 2)], "score_id long, index long")).collect()


def test_names():
    assert len(instruments.NAMES) == 128 and instruments.NAMES[0] == "acoustic_grand_piano" and instruments.NAMES[127] == "gunshot"
