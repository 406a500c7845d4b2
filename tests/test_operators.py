import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import arrays, text
from quillon.operators import excerpts, sequences, statistics, timeline, vocab


def fold_pairs(events):
    """Sustain pairs of one track by a loop over (time, seq, value)."""
    on, out = None, []
    for time, _, value in sorted(events):
        if value >= 64:
            on = time if on is None else on
        elif on is not None:
            out.append((on, time))
            on = None
    if on is not None:
        out.append((on, on + 1))
    return sorted((a, max(1, b - a)) for a, b in set(out))


def test_sustain_pairs_fold(spark):
    rnd = random.Random(0)
    rows = [(s, "t", k, rnd.randint(0, 15), rnd.choice([0, 64, 127])) for s in range(40) for k in range(25)]
    got = timeline.sustain_pairs(spark.createDataFrame(rows, "score_id int, track string, seq int, time int, value int")).collect()
    for s in range(40):
        assert sorted((r.start, r.length) for r in got if r.score_id == s) == fold_pairs([(t, q, v) for i, _, q, t, v in rows if i == s])


def test_clip_and_ties(spark):
    ev = spark.createDataFrame([(1, "a", 0, 0, 100), (1, "a", 1, 10, 0), (1, "a", 2, 15, 9), (1, "b", 3, 20, 5)], "score_id int, track string, seq int, time int, dur int")
    w = spark.createDataFrame([(1, 10, 20)], "score_id int, s int, e int")
    assert sorted((r.seq, r.start, r.length) for r in timeline.clip(ev, w).collect()) == [(0, 0, 10), (2, 5, 5)]
    held = spark.createDataFrame([(1, "a", 0, 5, 1), (1, "a", 1, 5, 2), (1, "a", 2, 12, 3)], "score_id int, track string, seq int, time int, value int")
    assert timeline.last_at(held, w, ["value"], ["score_id", "track"]).first().value == 2
    assert timeline.end_tick(ev).first().end_tick == 100
    assert timeline.bounded(spark.createDataFrame([(1, -5, -9)], "score_id int, s int, e int")).first()[1:] == (0, 1)


def test_totals_of_a_missing_split(spark):
    rows = spark.createDataFrame([("train", "scratch", 5, 2)], "split string, mode string, length long, n_targets long")
    got = {r.split: r for r in statistics.token_totals(rows).collect()}
    assert got["val"].samples == 0 and got["total"].input_tokens == 5 and got["val"].mean_length == 0
    assert {r.split for r in statistics.token_totals(rows.limit(0)).collect()} == {"train", "val", "total"}


def test_sequences(spark):
    df = spark.createDataFrame([([300, 301], [400], 1)], "p array<int>, c array<int>, x int")
    ids, labels = sequences.add_track(F.col("p"), F.col("c"), F.array(F.lit(500)), F.lit(True))
    r = df.select(ids.alias("i"), labels.alias("l"), sequences.generated(ids).alias("g")).first()
    assert r.i == [3, 300, 301, 4, 5, 400, 6, 8, 9, 1, 500, 2] and r.l == [-100] * 10 + [500, 2] and r.g == [234]
    packs = spark.createDataFrame([("s", k, n) for k, n in enumerate([5, 6, 0, 20, 1, 9])], "s string, k int, n int")
    assert [r.pack for r in sequences.pack(packs, "s", ["k"], "n", 10).orderBy("k").collect()] == [0, 1, 1, 2, 3, 3]
    one = sequences.chunk_split(spark.createDataFrame([("s", 1)], "s string, k int"), "s", ["k"], 20, 0.95).first()
    assert one.split == "val"


def test_packed_samples_of_repeated_missing_and_empty(spark):
    """Each row once, whatever its key and length."""
    rows = [("s", 1, "a", [1] * 4), ("s", 1, "a", [1] * 4), ("s", 1, "b", [2] * 3), ("s", 2, "a", []), ("s", 3, "a", None), ("s", None, "b", [5] * 9), (None, 1, "a", [6]), (None, None, "b", [7]), ("e", 1, "b", [])]
    df = spark.createDataFrame([(s, k, m, x, x) for s, k, m, x in rows], "s string, k int, mode string, input_ids array<int>, labels array<int>")
    got = {(r.s, r.pack): (r.mode, r.input_ids, [x.k for x in r.samples]) for r in sequences.packed_samples(df, "s", ["k"], 10).collect()}
    assert got == {
        ("s", 0): ("b", [2] * 3 + [1] * 4, [1, 1]),
        ("s", 1): ("a", [1] * 4, [1, 2, 3]),
        ("s", 2): ("b", [5] * 9, [None]),
        (None, 0): ("a", [6, 7], [1, None]),
        ("e", 0): ("b", [], [1]),
    }


def test_text(spark):
    df = spark.createDataFrame([("  a b\u0085c\x1cd ", "Grand--Piano!"), ("", "___")], "t string, n string")
    got = df.select(text.collapse(F.col("t")).alias("c"), text.slug(F.col("n"), F.lit("track")).alias("s"), text.byte_tokens(F.col("t")).alias("b")).collect()
    assert [r.c for r in got] == ["a b c d", ""] and [r.s for r in got] == ["grand_piano", "track"]
    assert got[0].b == list("  a b\u0085c\x1cd ".encode()) and got[1].b == []


def test_excerpts_are_the_widest_that_fit(spark):
    """Whole scores within budget, else the widest window of the drawn family."""
    rnd = random.Random(7)
    rows = [(s, k, rnd.randint(0, 5000), rnd.randint(1, 400), rnd.choice("ab")) for s in range(40) for k in range(rnd.randint(1, 60))]
    df = spark.createDataFrame(rows, "score_id long, seq long, time long, dur long, r string")
    for budgets, keep in (({"x": 12}, True), ({"a": 5, "b": 9}, False)):
        role = None if keep else F.col("r")
        got = {r.score_id: r for r in excerpts.fit_excerpts(df, budgets, 480, role=role, keep_over=keep).collect()}
        assert got and (not keep or len(got) == 40)
        for s in range(40):
            own = [r for r in rows if r[0] == s]
            inside = lambda a, b: [r for r in own if r[2] + r[3] > a and r[2] < b]
            most = lambda part: {k: sum(keep or r[4] == k for r in part) for k in budgets}
            fits = lambda part: all(n <= budgets[k] for k, n in most(part).items())
            if s not in got:
                continue
            g = got[s]
            part = inside(g.start, g.stop)
            end = max(r[2] + r[3] for r in own)
            assert 0 <= g.start < g.stop <= end and g.tokens == len(part) and g.over == (not fits(part))
            if fits(own):
                assert (g.start, g.stop) == (0, end)
            elif not g.over:  # a beat more on some side is over the budget
                assert not (fits(inside(g.start - 480, g.stop)) and fits(inside(g.start, g.stop + 480)))
            else:
                assert keep and g.stop - g.start <= 480


def test_shuffle_is_a_seeded_permutation(spark):
    df = spark.createDataFrame([(s, k) for s in "ab" for k in range(50)] + [(None, 1)], "s string, k int")
    by = {seed: {(r.s, r.place): r.k for r in excerpts.shuffled(df, "s", "k", seed).collect()} for seed in (3, 4)}
    for order in by.values():
        for s in "ab":
            assert sorted(order[s, p] for p in range(50)) == list(range(50))
    assert by[3] != by[4] and [by[3]["a", p] for p in range(50)] != list(range(50))
    got = excerpts.ranked(df.where("s = 'a'"), F.expr("k div 7"), [F.col("k")]).collect()
    assert all(r.place == r.k for r in got)


def test_decode_of_every_token_kind(spark):
    tokens = "Bar_None TimeSig_3/4 Position_4 Program_3 Pitch_60 Velocity_90 Duration_2 Tempo_121.5 Pedal_0 Bar_None Pitch_1 Duration_2 Velocity_5 ControlChange_11 CCValue_40 PedalOff_0 PitchBend_-64 Rest_1.2 Pitch_7 Velocity_8 Duration_9 Pedal_0 Duration_3 Rest_2.0 Position_0 Pedal_0 Pitch_9 Velocity_1 Duration_1".split()
    got = [tuple(r)[1:] for r in excerpts.decode(spark.createDataFrame([(1, k, t) for k, t in enumerate(tokens)], "score_id long, pos long, token string")).collect()]
    assert got == [
        (0, 0, 0, "TimeSig", 3, 4.0),
        (3, 480, 240, "Note", 60, 90.0),
        (3, 480, 0, "Tempo", 0, 121.5),
        (3, 480, 960, "Pedal", 64, 127.0),  # closed a bar of 1,440 ticks after it began
        (3, 1440, 0, "Control", 11, 40.0),
        (3, 1440, 0, "PitchBend", 0, -64.0),
        (3, 2160, 1080, "Note", 7, 8.0),
        (3, 2160, 360, "Pedal", 64, 127.0),
        (3, 2880, 360, "Pedal", 64, 127.0),  # open at the end of the score
        (3, 2880, 120, "Note", 9, 1.0),
    ]


def test_logit_filter_ignores_top_p_of_zero(spark):
    df = spark.createDataFrame([(1, k, float(k)) for k in range(5)], "row_id int, token_id int, logit double")
    assert [arrays.filter_logits(df, 1.0, 0, p).count() for p in (0.0, 1.0, 1e-9)] == [5, 5, 1]


def test_vocab_extension(spark):
    v = vocab.extend(spark.createDataFrame([(0, "Bar_None")], "token_id long, piece string"), [7], 2)
    assert sorted((r.token_id, r.piece) for r in v.collect()) == [(0, "Bar_None"), (1, "ControlChange_7"), (2, "CCValue_0"), (3, "CCValue_1")]
