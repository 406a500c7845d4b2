"""Prepared splits: flushes of samples, their manifest, state and checks.

A run is a folder::

    samples/flush=N/split=train|val/*.parquet   samples of one flush
    state/flush=N                               counters of one flush (one row)
    meta/                                       one row, written when the run is complete

A flush is written whole before its counters; both are overwritten if the flush is
repeated after a failure, so each record counts once.  Nothing is written to local folders:
all paths go through Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quillon.operators import excerpts, statistics

FORMAT = "prepared-splits"
VERSION = 1
META = "format string, version int, completed boolean, processed long, skipped long, num_train long, num_val long, num_samples long, flushes long, tokenizer_hash string, manifest string"


def _maybe(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def state(spark: SparkSession, run: str) -> dict | None:
    """Counters of the flushes that are durable; None if there is no run."""
    rows = _maybe(spark, f"{run}/state")
    if rows is None:
        return None
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("processed", "skipped", "num_train", "num_val")], F.count("*").alias("flushes")).first().asDict()


def meta(spark: SparkSession, run: str) -> dict | None:
    rows = _maybe(spark, f"{run}/meta")
    return rows.first().asDict() if rows is not None else None


def check(spark: SparkSession, run: str, need_complete: bool = True) -> dict:
    """The run's meta row; an error for a wrong format or version or, where asked, for a run
    that is not complete."""
    found = meta(spark, run)
    if found is None:
        if state(spark, run) is None:
            raise FileNotFoundError(f"no prepared splits in {run}")
        if need_complete:
            raise ValueError(f"the prepared splits in {run} are incomplete")
        return {"format": FORMAT, "version": VERSION, "completed": False, **state(spark, run)}
    if found["format"] != FORMAT:
        raise ValueError(f"{run} has the format {found['format']!r}, not {FORMAT!r}")
    if found["version"] != VERSION:
        raise ValueError(f"{run} has version {found['version']}, not {VERSION}: prepare it again")
    if need_complete and not found["completed"]:
        raise ValueError(f"the prepared splits in {run} are incomplete")
    return found


def resume(spark: SparkSession, run: str) -> dict:
    """Counters to go on from; an error if there is no run or it is complete."""
    if (meta(spark, run) or {}).get("completed"):
        raise ValueError(f"{run} is complete: nothing to resume")
    found = state(spark, run)
    if found is None:
        raise FileNotFoundError(f"no run to resume in {run}")
    return found


def split_flush(samples: DataFrame, ratio: float, seed: int, flush: int) -> DataFrame:
    """Samples of one flush in an order drawn by a hash of (seed, flush, record_index, mode):
    the first floor(n * ratio) are train, the rest val."""
    digits = excerpts.drawn(seed, F.lit(flush), F.col("record_index"), F.col("mode"))
    rows = excerpts.ranked(samples.withColumn("_d", digits), F.substring("_d", 1, 3), [F.col("_d")])
    n = samples.agg(F.floor(F.count("*") * ratio).alias("_cut"))
    return rows.join(F.broadcast(n)).withColumn("split", F.when(F.col("place") < F.col("_cut"), "train").otherwise("val")).drop("_d", "_cut", "place")


def write_flush(results: DataFrame, run: str, flush: int, ratio: float = 0.95, seed: int = 42, rows_per_file: int = 0) -> None:
    """One flush from results (record_index, skipped, samples): ``samples`` is an array of
    (mode, input_ids, labels); records without samples only count."""
    spark = results.sparkSession
    samples = results.select("record_index", F.inline("samples"))
    out = split_flush(samples, ratio, seed, flush)
    out.write.mode("overwrite").partitionBy("split").option("maxRecordsPerFile", rows_per_file).parquet(f"{run}/samples/flush={flush}")
    done = _maybe(spark, f"{run}/samples/flush={flush}")
    counted = results.agg(F.count("*").alias("processed"), F.coalesce(F.sum(F.col("skipped").cast("long")), F.lit(0)).alias("skipped"))
    of = lambda s: F.count_if(F.col("split") == s)
    kept = done.agg(of("train").alias("num_train"), of("val").alias("num_val")) if done is not None else spark.sql("select 0L as num_train, 0L as num_val")
    counted.join(F.broadcast(kept)).coalesce(1).write.mode("overwrite").parquet(f"{run}/state/flush={flush}")


def finish(spark: SparkSession, run: str, tokenizer_hash: str = "", manifest: str = "") -> dict:
    """Write the meta row that makes the run complete."""
    s = state(spark, run)
    if s is None:
        raise FileNotFoundError(f"no flush in {run}")
    row = (FORMAT, VERSION, True, s["processed"], s["skipped"], s["num_train"], s["num_val"], s["num_train"] + s["num_val"], s["flushes"], tokenizer_hash, manifest)
    spark.createDataFrame([row], META).coalesce(1).write.mode("overwrite").parquet(f"{run}/meta")
    return meta(spark, run)


def read_split(spark: SparkSession, run: str, split: str, need_complete: bool = True) -> DataFrame:
    """Samples of a split (a partition, so the other is not read)."""
    check(spark, run, need_complete)
    rows = _maybe(spark, f"{run}/samples")
    if rows is None:
        return spark.createDataFrame([], "record_index long, mode string, input_ids array<int>, labels array<int>")
    return rows.where(F.col("split") == split).drop("split", "flush")


def shards(spark: SparkSession, run: str) -> DataFrame:
    """The manifest: (split, path, num_samples) of every file."""
    return spark.read.parquet(f"{run}/samples").groupBy("split", F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("num_samples"))


def count_splits(spark: SparkSession, run: str) -> DataFrame:
    """Totals of train, val and both; format and version are checked, completion is not."""
    rows = [read_split(spark, run, s, need_complete=False).withColumn("split", F.lit(s)) for s in ("train", "val")]
    both = rows[0].unionByName(rows[1])
    return statistics.token_totals(both.select("split", "mode", F.size("input_ids").alias("length"), F.size(F.filter("labels", lambda x: x != -100)).alias("n_targets")))
