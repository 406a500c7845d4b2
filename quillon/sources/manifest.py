"""Manifest sources: JSON lines, arrays, and concatenated values; resolution of entries.

``ManifestDataSource`` (format "manifest") reads ``.json`` files that hold one array or
concatenated objects, which Spark's own reader does not; a file is one partition and is
decoded from a bounded buffer.  Malformed files raise an error.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.operators.excerpts import ranked

CHUNK = 1 << 20


def json_values(read, chunk: int = CHUNK) -> Iterator[dict]:
    """Objects of one array or of concatenated JSON text; ``read(n)`` gives more text."""
    decoder, text, at, ended, array, comma = json.JSONDecoder(), "", 0, False, None, False

    def fill() -> bool:
        nonlocal text, at, ended
        more = read(chunk)
        if not more:
            ended = True
            return False
        text, at = text[at:] + more, 0
        return True

    def skip() -> str:
        nonlocal at
        while True:
            while at < len(text) and text[at] in " \t\r\n﻿":
                at += 1
            if at < len(text):
                return text[at]
            if ended or not fill():
                return ""

    while True:
        c = skip()
        if array is None and c == "[":
            array, at = True, at + 1
            continue
        array = bool(array)
        if not c:
            if array:
                raise ValueError("the array does not end")
            return
        if array and c == "]":
            at += 1
            if skip():
                raise ValueError("content after the array")
            return
        if array and comma:
            if c != ",":
                raise ValueError("a comma is missing")
            at, comma = at + 1, False
            continue
        while True:
            try:
                value, end = decoder.raw_decode(text, at)
                break
            except json.JSONDecodeError:
                if ended or not fill():
                    raise
        if not isinstance(value, dict):
            raise ValueError("a manifest value is not an object")
        at, comma = end, True
        yield value


def opened(path: str):
    """A text file by path or address (any scheme that pyarrow's file systems know)."""
    if "://" not in path:
        return open(path, encoding="utf-8")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return io.TextIOWrapper(system.open_input_stream(inner), encoding="utf-8")


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        path = partition.value
        with opened(path) as f:
            for k, item in enumerate(json_values(f.read)):
                yield path, k, json.dumps(item, ensure_ascii=False)


class ManifestDataSource(DataSource):
    """``spark.read.format("manifest").load(path)``: manifest_path, line, item (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "manifest"

    def schema(self) -> str:
        return "manifest_path string, line long, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["paths"]) if "paths" in self.options else expand(self.options["path"]))


def expand(*inputs: str) -> list[str]:
    """A file is kept; a directory gives its own .jsonl and .json files, sorted."""
    out = []
    for p in inputs:
        if os.path.isdir(p):
            found = sorted(os.path.join(p, x) for x in os.listdir(p) if x.lower().endswith((".jsonl", ".json")))
            if not found:
                raise FileNotFoundError(f"no manifest in {p}")
            out += found
        elif os.path.exists(p):
            out.append(p)
        else:
            raise FileNotFoundError(p)
    return out


def read_manifest(spark: SparkSession, *inputs: str) -> DataFrame:
    """manifest_path, place, item for all files; blank lines of .jsonl are skipped.  One scan
    for all files of a kind.  ``place`` (block, row) grows within a file but has gaps;
    :func:`indexed` numbers the records."""
    paths = expand(*inputs)
    lines = [p for p in paths if p.lower().endswith(".jsonl")]
    others = [p for p in paths if not p.lower().endswith(".jsonl")]
    out = None
    if lines:
        place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        by_name = F.create_map(*[F.lit(x) for p in lines for x in (_name(p), p)])
        name = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
        rows = spark.read.text(lines).select(F.element_at(by_name, F.url_decode(F.regexp_replace(name, "[+]", "%2B"))).alias("manifest_path"), place.alias("place"), F.col("value").alias("item"))
        out = rows.where("trim(item) <> ''")
    if others:
        spark.dataSource.register(ManifestDataSource)
        rows = spark.read.format("manifest").option("paths", json.dumps(others)).load()
        rows = rows.select("manifest_path", F.struct(F.lit(0).cast("long").alias("block"), F.col("line").alias("row")).alias("place"), "item")
        out = rows if out is None else out.unionByName(rows)
    return out


def _name(path: str) -> str:
    return path if "://" in path else os.path.abspath(path)


def indexed(spark: SparkSession, *inputs: str, most: int = 0) -> DataFrame:
    """``read_manifest`` with record_index: from 0 over all files in their order, without
    gaps; only the first ``most`` records (0: all).  Records are numbered block by block
    after the blocks have been counted, so a task sorts one block."""
    paths = expand(*inputs)
    order = spark.createDataFrame(list(enumerate(paths)), "file long, manifest_path string")
    rows = read_manifest(spark, *inputs).join(F.broadcast(order), "manifest_path")
    placed = ranked(rows, F.struct("file", "place.block"), [F.col("place.row")]).withColumnRenamed("place", "record_index")
    placed = placed.select("record_index", "manifest_path", "item")
    return placed.where(F.col("record_index") < most) if most else placed


def resolve(records: DataFrame, root: str | None = None) -> DataFrame:
    """caption, midi_path or an error for each record (record_index, item, manifest_path).
    ``midi_path`` wins over ``location`` even if blank; a JSON null counts as missing."""
    get = lambda k: F.get_json_object("item", f"$.{k}")
    caption = F.trim(get("caption"))
    has = F.array_contains(F.coalesce(F.json_object_keys("item"), F.array().cast("array<string>")), "midi_path")
    raw = F.trim(F.when(has, get("midi_path")).otherwise(get("location")))
    base = F.lit(root) if root else F.regexp_replace("manifest_path", "/[^/]*$", "")
    error = F.when(F.coalesce(caption, F.lit("")) == "", "no caption").when(F.coalesce(raw, F.lit("")) == "", "no path")
    path = F.when(raw.startswith("/"), raw).otherwise(F.concat(base, F.lit("/"), raw))
    return records.withColumn("caption", F.when(error.isNull(), caption)).withColumn("midi_path", F.when(error.isNull(), path)).withColumn("error", error)
