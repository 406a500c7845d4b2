"""Timeline operators: DataFrame to DataFrame, on columns (score_id, track, seq, time, ...).

``seq`` is the place in the original list and decides every tie.  A window is a row
(score_id, s, e); bounds are normalised to ``s = max(0, s)``, ``e = max(s + 1, e)``.
All joins are equi-joins on score_id with a range condition beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("score_id", "track")


def bounded(windows: DataFrame) -> DataFrame:
    w = windows.withColumn("s", F.greatest(F.lit(0), F.col("s")))
    return w.withColumn("e", F.greatest(F.col("s") + 1, F.col("e")))


def clip(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Intervals that overlap the window, cut to it and shifted; a cut length is at least 1."""
    end = F.col("time") + F.col("dur")
    j = events.join(bounded(windows), "score_id").where((end > F.col("s")) & (F.col("time") < F.col("e")))
    start = F.greatest("s", "time")
    return j.withColumn("start", start - F.col("s")).withColumn("length", F.greatest(F.lit(1), F.least(F.col("e"), end) - start)).drop("s", "e")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each signature: the first in list order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def signatures(df: DataFrame, payload: list[str], keys: tuple[str, ...] = KEYS, rounded: tuple[str, ...] = ("qpm",)) -> DataFrame:
    """The first event of each (key, time, payload); payload columns in ``rounded`` are
    compared to six places."""
    held = {c: f"_sig{k}" for k, c in enumerate(payload)}
    for c, h in held.items():
        df = df.withColumn(h, F.round(c, 6) if c in rounded else F.col(c))
    return keep_first(df, [*keys, "time", *held.values()], ["seq"]).drop(*held.values())


def points(events: DataFrame, windows: DataFrame, payload: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Point events inside [s, e), shifted, without repeated signatures."""
    j = events.join(bounded(windows), "score_id").where("time >= s and time < e").withColumn("time", F.col("time") - F.col("s"))
    return keep_first(j, [*keys, "time", *payload], ["seq"]).drop("s", "e")


def last_at(events: DataFrame, ticks: DataFrame, payload: list[str], keys: list[str], tick: str = "s") -> DataFrame:
    """As-of: for each tick row and key the last event at or before the tick; of equal
    times the later list place wins.  One aggregation, no sort of the events."""
    j = events.join(ticks, "score_id").where(F.col("time") <= F.col(tick))
    last = F.max(F.struct("time", "seq", *payload)).alias("_l")
    return j.groupBy(*keys, *[c for c in ticks.columns if c not in keys]).agg(last).select("*", "_l.*").drop("_l")


def carry_in(events: DataFrame, windows: DataFrame, payload: list[str], keys: list[str]) -> DataFrame:
    """State that holds at the window's start, at time 0, then changes strictly inside.  With
    ``keys`` score_id alone this is the form without a default (key signatures)."""
    w = bounded(windows)
    held = last_at(events, w, payload, keys).select(*keys, F.lit(0).cast("long").alias("time"), *payload)
    inside = events.join(w, "score_id").where("time > s and time < e").select(*keys, (F.col("time") - F.col("s")).alias("time"), *payload)
    return held.unionByName(inside).distinct()


def meta_window(events: DataFrame, windows: DataFrame, value: str, default: Column) -> DataFrame:
    """As carry_in without a key, but every window has a value at 0: ``default`` where
    nothing came before."""
    w = bounded(windows)
    held = last_at(events, w, [value], ["score_id"]).select("score_id", F.col(value).alias("_v"))
    at0 = w.join(held, "score_id", "left").select("score_id", F.lit(0).cast("long").alias("time"), F.coalesce("_v", default).alias(value))
    inside = events.join(w, "score_id").where("time > s and time < e").select("score_id", (F.col("time") - F.col("s")).alias("time"), value)
    return at0.unionByName(inside).distinct()


def sustain_pairs(controls: DataFrame, keys: tuple[str, ...] = KEYS, threshold: int = 64) -> DataFrame:
    """On/off controls to intervals: a repeated on is ignored, an off without an on too, an
    on without an off lasts 1; equal (start, end) once; length at least 1."""
    order = Window.partitionBy(*keys).orderBy("time", "seq")
    on = (F.col("value") >= threshold).cast("int")
    turns = controls.withColumn("_on", on).withColumn("_was", F.coalesce(F.lag("_on").over(order), F.lit(0))).where("_on <> _was")
    ends = turns.withColumn("_end", F.lead("time").over(order)).where("_on = 1")
    raw = ends.select(*keys, F.col("time").alias("start"), F.coalesce(F.col("_end"), F.col("time") + 1).alias("stop")).distinct()
    return raw.select(*keys, "start", F.greatest(F.lit(1), F.col("stop") - F.col("start")).alias("length"))


def merge(base: DataFrame, *overlays: DataFrame) -> DataFrame:
    """Tracks of the base, then of each overlay, renumbered in order (track_idx)."""
    out = base.withColumn("part", F.lit(0))
    for k, o in enumerate(overlays, 1):
        out = out.unionByName(o.withColumn("part", F.lit(k)))
    tracks = out.select("score_id", "part", "track").distinct()
    place = F.row_number().over(Window.partitionBy("score_id").orderBy("part", "track")) - 1
    return out.join(tracks.withColumn("track_idx", place), ["score_id", "part", "track"])


def end_tick(events: DataFrame) -> DataFrame:
    """max(1, latest end) for each score."""
    return events.groupBy("score_id").agg(F.greatest(F.lit(1), F.max(F.col("time") + F.col("dur"))).alias("end_tick"))


def tokenizable(events: DataFrame, notes: str, pedals: str | None, bends: str | None, numbers: list[int]) -> DataFrame:
    """Tracks with a note, an enabled pedal or bend, or a control of an allowed number.
    One aggregation for each (score, number): ``kind`` is the event's track name."""
    has = F.col("track") == notes
    if pedals:
        has = has | (F.col("track") == pedals)
    if bends:
        has = has | (F.col("track") == bends)
    has = has | F.col("number").isin(numbers)
    return events.groupBy(*KEYS).agg(F.bool_or(has).alias("keep")).where("keep").drop("keep")


def retained(clipped: DataFrame, tracks: DataFrame, markers: DataFrame) -> DataFrame:
    """Tracks kept after windowing: any event left, or wholly empty before while a marker
    lies in the window.  tracks: (score_id, track, n_events); markers: (score_id)."""
    left = tracks.join(clipped.select(*KEYS).distinct(), list(KEYS), "left_semi")
    empty = tracks.where("n_events = 0").join(markers.select("score_id").distinct(), "score_id", "left_semi")
    return left.unionByName(empty.select(*left.columns)).distinct()


def split_track(events: DataFrame, track: str) -> tuple[DataFrame, DataFrame]:
    """(context, target): all other tracks, and the chosen one."""
    return events.where(F.col("track") != track), events.where(F.col("track") == track)


def split_at(tracks: DataFrame, picks: DataFrame) -> DataFrame:
    """Role of every track (score_id, track_idx): ``target`` where picks (score_id, index)
    name it, else ``context``.  An index outside a score's tracks raises an error."""
    n = tracks.groupBy("score_id").agg(F.count("*").alias("_n"))
    wrong = (F.col("index") < 0) | (F.col("index") >= F.col("_n"))
    sound = n.join(picks, "score_id").withColumn("index", F.when(wrong, F.raise_error(F.concat(F.lit("no track "), F.col("index").cast("string")))).otherwise(F.col("index")))
    return tracks.join(sound.drop("_n"), "score_id").withColumn("role", F.when(F.col("track_idx") == F.col("index"), "target").otherwise("context")).drop("index")


def ordered(events: DataFrame, *keys: str) -> DataFrame:
    """Events sorted by key, time and list place."""
    return events.orderBy(*(keys or KEYS), "time", "seq")


def without_number(controls: DataFrame, number: int) -> DataFrame:
    """Stored controls of one number dropped."""
    return controls.where(F.col("number") != number)


def pedal_controls(pedals: DataFrame, number: int = 64) -> DataFrame:
    """Pedal intervals as on (127) and off (0) controls."""
    on = pedals.select(*KEYS, F.col("start").alias("time"), F.lit(number).alias("number"), F.lit(127).alias("value"))
    off = pedals.select(*KEYS, (F.col("start") + F.col("length")).alias("time"), F.lit(number).alias("number"), F.lit(0).alias("value"))
    return on.unionByName(off)


def with_program(tracks: DataFrame, name: str, program: int, drum: bool) -> DataFrame:
    return tracks.withColumn("name", F.lit(name)).withColumn("program", F.lit(program)).withColumn("is_drum", F.lit(drum))


def anchor_ticks(*tables: DataFrame) -> DataFrame:
    """Onsets of all events."""
    out = tables[0].select("score_id", "time")
    for t in tables[1:]:
        out = out.unionByName(t.select("score_id", "time"))
    return out


def beat_floor(time: Column, beat: Column) -> Column:
    return time - F.pmod(time, beat)


def ticks_per_beat(tpq: Column) -> Column:
    return F.coalesce(F.nullif(tpq, F.lit(0)), F.lit(480))
