import io
import json

import pytest

from quillon.sources import manifest, midi


def values(text, chunk=3):
    return list(manifest.json_values(io.StringIO(text).read, chunk))


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": "x"}]', '{"a": 1}{"a": "x"}', ' {"a": 1}\n\n{"a": "x"} ', '[{"a": 1}, {"a": "x"},]'])
def test_json_values(text):
    assert values(text) == [{"a": 1}, {"a": "x"}]


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": 1} {"a": 2}]', "[1]", '[{"a": 1}] x', '{"a": ', '{"a": 1} 5'])
def test_json_errors(text):
    with pytest.raises(ValueError):
        values(text)


def test_empty():
    assert values("") == [] and values("[]") == []


def test_read_manifest(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"caption": "é", "location": "x.mid"}{"caption": "two", "midi_path": "/abs/y.mid"}', encoding="utf-8")
    (tmp_path / "a.jsonl").write_text('{"caption": "one"}\n\n  \n{"caption": null, "midi_path": "z"}\n')
    (tmp_path / "skip.txt").write_text("x")
    rows = manifest.read_manifest(spark, str(tmp_path))
    got = {(r.caption, r.midi_path, r.error) for r in manifest.resolve(rows).collect()}
    assert got == {("é", f"{tmp_path}/x.mid", None), ("two", "/abs/y.mid", None), (None, None, "no path"), (None, None, "no caption")}
    with pytest.raises(FileNotFoundError):
        manifest.expand(str(tmp_path / "none"))


def test_midi_round_trip(spark, tmp_path):
    track = [("program", 0, 0, 0, 24), ("tempo", 0, 0, 0, 500000), ("note", 0, 480, 60, 100), ("note", 480, 240, 64, 90), ("control", 10, 0, 7, 99), ("pedal", 20, 100, 0, 0), ("pitch_bend", 30, 0, 0, -100)]
    data = midi.write_bytes(480, [track, []])
    tpq, rows = midi.parse(data)
    assert tpq == 480
    assert {r[2:7] for r in rows if r[2] == "note"} == {("note", 0, 480, 60, 100), ("note", 480, 240, 64, 90)}
    assert [(r[3], r[5], r[6]) for r in rows if r[2] == "control"] == [(10, 7, 99), (20, 64, 127), (120, 64, 0)]
    assert [r[6] for r in rows if r[2] == "pitch_bend"] == [-100]
    (tmp_path / "a.mid").write_bytes(data)
    (tmp_path / "b.mid").write_bytes(b"nothing")
    got = midi.read_midi(spark, str(tmp_path)).collect()
    assert sum(r.kind == "note" for r in got) == 2 and sum(r.error is not None for r in got) == 1


def test_resume_equals_one_shot(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillon.streaming import ingest

    docs = spark.range(40).select("id", F.when(F.col("id") % 10 == 0, "val").otherwise("train").alias("split"))
    for k in range(2):
        docs.where(F.col("id") % 2 == k).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        ingest.ingest(spark, str(tmp_path / "in"), "id long, split string", str(tmp_path / "out"), str(tmp_path / "ck"), lambda b: b)
    assert {r.split: r.samples for r in ingest.totals(spark, str(tmp_path / "out")).collect()} == {"val": 4, "train": 36}


def test_payload_hash():
    import hashlib

    from quillon.operators.statistics import payload_hash

    assert payload_hash({"b": 1, "a": "x"}) == hashlib.sha256(json.dumps({"a": "x", "b": 1}, sort_keys=True).encode()).hexdigest()
