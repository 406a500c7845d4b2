"""What the operators of this subpackage share: tables, materialised steps, row keys.

A *materialised* step is a Parquet table in the shared folder that the session
names in ``spark.checkpoint.dir``: it cuts lineage, survives lost executors and
is read back by every executor.  Nothing is kept in a machine-local folder when
that setting exists.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Words are maximal runs of characters other than ASCII white space; ``bytes.split()``
#: cuts at exactly these six bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Make this package importable in Python workers and keep Arrow batches small."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, through Spark's own reader only."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Where the session names none, a local master gets a
    temporary one, and a cluster an error: its executors share no local folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_quillon_dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        where = spark.sparkContext._quillon_dir = tempfile.mkdtemp(prefix="quillon-")
    return where


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Write ``df`` as a table bucketed by ``column``: later groupings by it move no row."""
    spark = df.sparkSession
    if buckets > int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")):
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", str(buckets))
    name = f"quillon_{uuid.uuid4().hex}"
    df.repartition(buckets, column).write.bucketBy(buckets, column).format("parquet").option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out._quillon_table = name
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialise` or :func:`bucketed` that no later step reads."""
    if name := getattr(df, "_quillon_table", None):
        df.sparkSession.sql(f"drop table if exists {name}")
    path = getattr(df, "_quillon_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What a Python worker keeps from task to task, by operator.
_KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What this Python worker keeps from task to task of the operator.  A worker outlives a
    stage, so what it kept for other operators is let go and its memory given back."""
    if others := _KEPT.keys() - {operator}:
        for other in others:
            del _KEPT[other]
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)
    return _KEPT.setdefault(operator, {})


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two multiply-xorshift rounds) over an unsigned array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))
