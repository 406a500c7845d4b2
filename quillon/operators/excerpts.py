"""Budgeted excerpts, seeded order, and notes from token rows.

*Excerpts.*  Every score draws one of its onsets and a share u by a seeded hash.  Windows of
k beats around the onset's beat, ``left(k) = floor(k * u)`` of them before it, lie one
within the other, so each event has a least k from which on it overlaps the window, by
arithmetic alone.  The widest window within a budget of b events ends one beat before the
(b + 1)-th of these numbers: no search, and of a score only b + 1 rows are ranked.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 4096
_NEVER = 1 << 40


def drawn(seed: int, *key: Column) -> Column:
    """32 hexadecimal digits that depend on the seed and the key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary"))


def share(digits: Column) -> Column:
    """A number from 0 to PARTS - 1 of the first three digits."""
    return F.conv(F.substring(digits, 1, 3), 16, 10).cast("long")


def least_beats(time: Column, stop: Column, home: Column, u: Column, beat: int) -> Column:
    """The least k for which an event [time, stop) overlaps the window of k beats."""
    before = F.when(home >= stop, F.floor((home - stop) / beat) + 1).otherwise(0)
    after = F.when(time >= home, F.floor((time - home) / beat)).otherwise(0)
    reach_left = F.when(before == 0, 1).when(u == 0, _NEVER).otherwise(F.ceil(before * PARTS / u))
    reach_right = F.floor(after * PARTS / (PARTS - u)) + 1
    return F.greatest(reach_left, reach_right).cast("long")


def fit_excerpts(events: DataFrame, budgets: dict[str, int], beat: int, seed: int = 42, role: Column | None = None, keep_over: bool = True) -> DataFrame:
    """(score_id, start, stop, tokens, over) for each score.

    An event costs one token of the budget of its ``role`` (one role by default).  A score
    that fits is kept whole.  If one beat is over budget the shortest window is kept with
    ``over`` true, or the score is dropped where ``keep_over`` is false, as it is if a role
    has no event in the window."""
    by = Window.partitionBy("score_id")
    role = F.lit(next(iter(budgets))) if role is None else role
    budget = F.coalesce(*[F.when(F.col("role") == r, n) for r, n in budgets.items()])
    ev = events.select("score_id", "seq", "time", (F.col("time") + F.col("dur")).alias("stop"), role.alias("role"))
    onset = F.min(F.struct(drawn(seed, F.col("score_id"), F.col("seq")).alias("d"), "time")).alias("o")
    home = ev.groupBy("score_id").agg(onset, F.max("stop").alias("end")).select("score_id", "end", (F.floor(F.col("o.time") / beat) * beat).cast("long").alias("home"), share(drawn(seed + 1, F.col("score_id"))).alias("u"))
    near = ev.join(home, "score_id").withColumn("k", least_beats(F.col("time"), F.col("stop"), F.col("home"), F.col("u"), beat)).withColumn("most", budget)
    # one row over each budget, if there is one, bounds the window
    place = F.row_number().over(Window.partitionBy("score_id", "role").orderBy("k", "seq"))
    first = near.withColumn("place", place).where(F.col("place") <= max(budgets.values()) + 1).where(F.col("place") == F.col("most") + 1)
    bound = first.groupBy("score_id").agg(F.greatest(F.min("k") - 1, F.lit(1)).alias("beats"))
    cut = near.join(bound, "score_id", "left").withColumn("inside", F.col("beats").isNull() | (F.col("k") <= F.col("beats")))
    counts = cut.groupBy("score_id", "role").agg(F.sum(F.col("inside").cast("long")).alias("n"), F.first("most").alias("most"), F.first("beats").alias("beats"), *[F.first(c).alias(c) for c in ("home", "u", "end")])
    rows = counts.groupBy("score_id").agg(F.sum("n").alias("tokens"), F.max(F.col("n") > F.col("most")).alias("over"), F.count_if(F.col("n") > 0).alias("roles"), *[F.first(c).alias(c) for c in ("beats", "home", "u", "end")])
    left = F.floor(F.col("beats") * F.col("u") / PARTS)
    start = F.when(F.col("beats").isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("home") - left * beat)).cast("long")
    stop = F.when(F.col("beats").isNull(), F.col("end")).otherwise(F.least(F.col("end"), F.col("home") + (F.col("beats") - left) * beat)).cast("long")
    if not keep_over:
        rows = rows.where(~F.col("over") & (F.col("roles") == len(budgets)))
    return rows.select("score_id", start.alias("start"), stop.alias("stop"), "tokens", "over")


def ranked(df: DataFrame, bucket: Column, order: list[Column], key: list[str] | None = None) -> DataFrame:
    """``place`` (from 0) of each row in ``order`` within its key.  ``bucket`` must grow with
    the order: rows are numbered bucket by bucket, after the rows of lower buckets have been
    counted, so that no key is sorted in one task."""
    key = key or []
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*key, "_bucket").orderBy(*order))
    placed = rows.withColumn("_inner", inner).join(offsets, [*key, "_bucket"])
    return placed.withColumn("place", (F.col("_before") + F.col("_inner") - 1).cast("long")).drop("_bucket", "_inner", "_before")


def shuffled(df: DataFrame, key: str, order: str, seed: int) -> DataFrame:
    """Rows of each key in an order drawn by a seeded hash of ``order``: key, order, place."""
    rows = df.where(F.col(key).isNotNull()).select(key, order, drawn(seed, F.col(order)).alias("_d"))
    return ranked(rows, F.substring("_d", 1, 3), [F.col("_d"), F.col(order)], [key]).select(key, order, "place")


#: Ticks of a quarter, places of a quarter, and the least of each event's fields.
QUARTER = 480
GRID = 120
DEFAULT_SIGNATURE = (4, 4)


def decode(tokens: DataFrame) -> DataFrame:
    """Token rows (score_id, pos, token) to events (score_id, program, time, dur, kind, number,
    value), by a state machine over one score at a time.

    Bar begins the next bar of the time signature in force; Position_k sets the place on
    the grid; Rest_b.p moves on by beats and grid places from where the last note ended;
    TimeSig_n/d holds from its bar on; Program_p chooses the track; Pitch_p, Velocity_v and
    Duration_d in a row make a note; Tempo_q, PitchBend_v and ControlChange_n with CCValue_v
    are events without length; Pedal begins a pedal, closed by PedalOff or the end of the
    score, or has the length of a Duration that follows it.  Other tokens change nothing."""
    names = ["program", "time", "dur", "kind", "number", "value"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = machine(g.sort_values("pos")["token"].tolist())
        d = pd.DataFrame(out, columns=names)
        d.insert(0, "score_id", g["score_id"].iloc[0])
        return d

    return tokens.groupBy("score_id").applyInPandas(run, "score_id long, program long, time long, dur long, kind string, number long, value double")


def machine(tokens: list[str]) -> list[tuple]:
    """The events of one score."""
    out: list[list] = []
    bar_at, tick, ended, bars = 0, 0, 0, 0
    signature, program = DEFAULT_SIGNATURE, 0
    note: list[int] = []  # pitch, then velocity
    control: int | None = None
    pedals: dict[int, int] = {}  # program: its open pedal among ``out``
    fresh: int | None = None  # a pedal that a Duration may close
    width = lambda: QUARTER * 4 * signature[0] // signature[1]

    def add(kind: str, number: int, value: float, dur: int = 0) -> int:
        out.append([program, tick, dur, kind, number, value])
        return len(out) - 1

    for token in tokens:
        kind, _, text = token.partition("_")
        was, fresh = fresh, None
        if kind == "Bar":
            bar_at = bar_at + width() if bars else bar_at
            tick, bars = bar_at, bars + 1
        elif kind == "TimeSig":
            n, d = map(int, text.split("/"))
            signature = (n, d)
            add("TimeSig", n, d)
        elif kind == "Position":
            bars = max(bars, 1)
            tick = bar_at + int(text) * GRID
        elif kind == "Rest":
            beats, places = map(int, text.split("."))
            tick = max(tick, ended) + beats * QUARTER + places * GRID
            over = (tick - bar_at) // width()
            bar_at, bars = bar_at + over * width(), max(bars, 1) + over
        elif kind == "Program":
            program = int(text)
        elif kind == "Tempo":
            add("Tempo", 0, float(text))
        elif kind in ("Pitch", "PitchDrum"):
            note = [int(text)]
        elif kind == "Velocity" and len(note) == 1:
            note.append(int(text))
        elif kind == "Duration":
            dur = int(text) * GRID
            if was is not None:
                out[was][2] = dur
                pedals.pop(out[was][0], None)
            elif len(note) == 2:
                add("Note", note[0], note[1], dur)
                ended, note = max(ended, tick + dur), []
        elif kind == "PitchBend":
            add("PitchBend", 0, float(text))
        elif kind == "ControlChange":
            control = int(text)
        elif kind == "CCValue" and control is not None:
            add("Control", control, float(text))
            control = None
        elif kind == "Pedal":
            if program not in pedals:
                fresh = pedals[program] = add("Pedal", 64, 127)
        elif kind == "PedalOff" and program in pedals:
            k = pedals.pop(program)
            out[k][2] = max(0, tick - out[k][1])
    last = max([tick, *(e[1] + e[2] for e in out)])
    for k in pedals.values():
        out[k][2] = max(0, last - out[k][1])
    return [tuple(e) for e in out]
