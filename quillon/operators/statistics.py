"""Aggregates of samples, batches and scores."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_totals(samples: DataFrame) -> DataFrame:
    """Totals by split and of both: (split, mode, length, n_targets) to one row for train,
    val and total each; a split without samples has zeros."""
    scratch = F.col("mode") == "scratch"
    sums = [
        F.count("*").alias("samples"),
        F.sum("length").alias("input_tokens"),
        F.sum("n_targets").alias("target_tokens"),
        F.count_if(scratch).alias("scratch_samples"),
        F.count_if(~scratch).alias("add_track_samples"),
        F.sum(F.when(scratch, F.col("length")).otherwise(0)).alias("scratch_tokens"),
        F.sum(F.when(~scratch, F.col("length")).otherwise(0)).alias("add_track_tokens"),
        F.max("length").alias("max_length"),
    ]
    by = samples.groupBy("split").agg(*sums)
    names = [c for c in by.columns if c != "split"]
    all_ = by.agg(*[(F.max(c) if c == "max_length" else F.sum(c)).alias(c) for c in names]).select(F.lit("total").alias("split"), *names)
    want = samples.sparkSession.createDataFrame([("train",), ("val",), ("total",)], "split string")
    out = want.join(F.broadcast(by.unionByName(all_)), "split", "left").select("split", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in names])
    n = F.greatest(F.lit(1), F.col("samples"))
    return out.withColumn("mean_length", F.round(F.col("input_tokens") / n, 3)).withColumn("mean_targets", F.round(F.col("target_tokens") / n, 3))


def first_distinct(df: DataFrame, key: str, order: str, text: str, most: int) -> DataFrame:
    """The first distinct texts of each key by first appearance; blank texts left out.
    Texts are made distinct before they are gathered."""
    first = df.where(F.length(text) > 0).groupBy(key, text).agg(F.min(order).alias("_o"))
    listed = F.array_sort(F.collect_list(F.struct("_o", text)))
    return first.groupBy(key).agg(F.slice(F.transform(listed, lambda x: x[text]), 1, most).alias("texts"))


def score_stats(notes: DataFrame, tpq: int = 480, digits: int = 2) -> DataFrame:
    """Tracks, notes, distinct programs without drums, any drum, last end, beats."""
    end = F.max(F.col("time") + F.col("dur"))
    return notes.groupBy("score_id").agg(
        F.countDistinct("track").alias("tracks"), F.count("*").alias("notes"), F.sort_array(F.collect_set(F.when(~F.col("is_drum"), F.col("program")))).alias("programs"), F.bool_or("is_drum").alias("any_drum"), end.alias("last_end"), F.round(end / tpq, digits).alias("beats")
    )


def mode_ratios(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg((F.col("mode") == "scratch").cast("double")).alias("scratch_ratio"), F.avg((F.col("mode") != "scratch").cast("double")).alias("add_track_ratio"))


def mean_of_batches(df: DataFrame, batch: str, loss: str) -> DataFrame:
    """Mean of batch losses; batches that are empty or not finite are skipped."""
    by = df.groupBy(batch).agg(F.avg(loss).alias("_l")).where("_l is not null and not isnan(_l) and abs(_l) < double('infinity')")
    return by.agg(F.avg("_l").alias("loss"), F.count("*").alias("batches"))


#: The kinds that are counted for a score, tracks aside.
KINDS = ("notes", "controls", "pedals", "pitch_bends", "lyrics", "markers", "tempos", "time_signatures", "key_signatures")


def event_counts(scores: DataFrame, tracks: DataFrame, events: DataFrame) -> DataFrame:
    """Tracks and events of each kind for every score, zeros included: scores (score_id),
    tracks (score_id, one row a track), events (score_id, kind).  Counted in one
    aggregation; other kinds are left out."""
    tagged = events.select("score_id", "kind").unionByName(tracks.select("score_id", F.lit("tracks").alias("kind")))
    tagged = tagged.unionByName(scores.select("score_id", F.lit("").alias("kind")))
    return tagged.groupBy("score_id").agg(F.max(F.col("kind") == "").alias("_listed"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("tracks", *KINDS)]).where("_listed").drop("_listed")


def control_numbers(controls: DataFrame, key: str = "score_id", number: str = "number") -> DataFrame:
    """Distinct control numbers of each score, ascending."""
    return controls.groupBy(key).agg(F.sort_array(F.collect_set(number)).alias("numbers"))


def has_any(scores: DataFrame, pedals: DataFrame, bends: DataFrame, key: str = "score_id") -> DataFrame:
    """Whether each score has a pedal, and whether it has a bend."""
    none = F.lit(False)
    tagged = scores.select(key, none.alias("p"), none.alias("b"))
    tagged = tagged.unionByName(pedals.select(key, F.lit(True).alias("p"), none.alias("b"))).unionByName(bends.select(key, none.alias("p"), F.lit(True).alias("b")))
    return tagged.groupBy(key).agg(F.bool_or("p").alias("has_pedals"), F.bool_or("b").alias("has_bends"))


def parameter_norm(values: DataFrame, value: str) -> DataFrame:
    """Root of the sum of squares, and the number of values."""
    return values.agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"), F.count(value).alias("n"))


def epoch_summary(items: DataFrame) -> DataFrame:
    """Samples of each epoch, from (epoch, mode, error, num_notes, num_tracks): successes,
    errors, their rate (null without a scratch sample), totals, averages over successes
    (null without one), and the add-track sample (null without one; its totals are zero if
    it failed)."""
    scratch, ok = F.col("mode") == "scratch", F.col("error").isNull()
    add = F.col("mode") == "add_track"
    some = lambda when, c: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    out = items.groupBy("epoch").agg(
        F.count_if(scratch & ok).alias("scratch_success"),
        F.count_if(scratch & ~ok).alias("scratch_errors"),
        some(scratch & ok, "num_notes").alias("scratch_total_notes"),
        some(scratch & ok, "num_tracks").alias("scratch_total_tracks"),
        F.min(F.when(add, ok)).alias("_add"),
        some(add & ok, "num_notes").alias("_notes"),
        some(add & ok, "num_tracks").alias("_tracks"),
    )
    n, good = F.col("scratch_success") + F.col("scratch_errors"), F.col("scratch_success")
    return out.select(
        "*",
        F.when(n > 0, F.col("scratch_errors") / n).alias("scratch_error_rate"),
        F.when(good > 0, F.col("scratch_total_notes") / good).alias("scratch_avg_notes_per_sample"),
        F.when(good > 0, F.col("scratch_total_tracks") / good).alias("scratch_avg_tracks_per_sample"),
        F.col("_add").cast("int").alias("add_track_success"),
        F.when(F.col("_add").isNotNull(), F.col("_notes")).alias("add_track_total_notes"),
        F.when(F.col("_add").isNotNull(), F.col("_tracks")).alias("add_track_total_tracks"),
    ).drop("_add", "_notes", "_tracks")


def run_counters(records: DataFrame) -> DataFrame:
    """Counters of a run from its records (skipped, n_train, n_val, flush): one row."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return records.agg(F.count("*").alias("processed"), whole("skipped").alias("skipped"), whole("n_train").alias("num_train"), whole("n_val").alias("num_val"), F.countDistinct("flush").alias("flushes"))


def payload_hash(payload: dict) -> str:
    """SHA-256 of canonical JSON (sorted keys)."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()
