"""Vocabulary introspection: raw tokens, event types, categories, statistics, type graph.

A piece is one or more raw tokens joined by single blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event type of a raw token, and its category.
CATEGORIES = {
    "Bar": "bar",
    "Position": "position",
    "Pitch": "pitch",
    "PitchDrum": "pitch",
    "PitchIntervalTime": "pitch",
    "PitchIntervalChord": "pitch",
    "Velocity": "velocity",
    "Duration": "duration",
    "Program": "program",
    "Tempo": "tempo",
    "TimeSig": "time_signature",
    "Chord": "chord",
    "Rest": "rest",
    "Pedal": "pedal",
    "PedalOff": "pedal",
    "PitchBend": "pitch_bend",
    "ControlChange": "control_change",
    "CCValue": "control_change_value",
}
STATISTICS = ("pitch", "bar", "tempo", "time_signature", "chord", "program", "rest", "pedal", "pitch_bend", "control_change")


def raw_tokens(piece: Column) -> Column:
    return F.when(piece == "", F.array().cast("array<string>")).otherwise(F.split(piece, " "))


def event_type(token: Column) -> Column:
    head = F.substring_index(token, "_", 1)
    head = F.when(head == "TimeSignature", "TimeSig").otherwise(head)
    return F.when(head.isin(*CATEGORIES), head).otherwise("Other")


def category(token: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, event_type(token)), F.lit("other"))


def signature(vocab: DataFrame) -> DataFrame:
    """Raw tokens, event types, categories, first and last category, and what is inside."""
    df = vocab.withColumn("raw_tokens", F.split("piece", " "))
    df = df.withColumn("event_types", F.transform("raw_tokens", event_type)).withColumn("categories", F.transform("raw_tokens", category))
    df = df.withColumn("first_raw_type", F.element_at("categories", 1)).withColumn("last_raw_type", F.element_at("categories", -1))
    inside = (*STATISTICS, "velocity", "duration", "position")
    return df.withColumns({f"contains_{c}": F.array_contains("categories", c) for c in inside})


def statistics(vocab: DataFrame) -> DataFrame:
    """One row: ids, mean raw tokens, single and multiple, longest, ids with each category."""
    df = signature(vocab).withColumn("n", F.size("raw_tokens"))
    return df.agg(
        F.count("*").alias("total_ids"),
        F.round(F.sum("n") / F.greatest(F.lit(1), F.count("*")), 3).alias("mean_raw_tokens_per_id"),
        F.count_if(F.col("n") == 1).alias("ids_single_raw_token"),
        F.count_if(F.col("n") != 1).alias("ids_multi_raw_token"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_raw_tokens_per_id"),
        *[F.count_if(f"contains_{c}").alias(f"ids_with_{c}") for c in STATISTICS],
    )


def id_class(ids: DataFrame, vocab: DataFrame, id_col: str, text_offset: int, event_offset: int) -> DataFrame:
    """special, text, the category of the first raw token, or other, for each id."""
    names = vocab.select((F.col("token_id") + event_offset).alias(id_col), category(F.element_at(raw_tokens(F.col("piece")), 1)).alias("_c"))
    out = ids.join(names, id_col, "left")
    kind = F.when(F.col(id_col) < text_offset, "special").when(F.col(id_col) < event_offset, "text").otherwise(F.coalesce("_c", F.lit("other")))
    return out.withColumn("id_class", kind).drop("_c")


def pieces_of(ids: DataFrame, key: str, ids_col: str, vocab: DataFrame) -> DataFrame:
    """Ids of each row as the raw tokens of their pieces, in order."""
    long = ids.select(key, F.posexplode(ids_col).alias("pos", "token_id")).join(vocab, "token_id", "left")
    return long.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(raw_tokens(F.col("piece")), F.array().cast("array<string>")).alias("t")))), lambda x: x["t"])).alias("raw_tokens"))


def fit_words(texts: DataFrame, text_col: str) -> DataFrame:
    """A vocabulary of words: ids by descending count, then word.  Ranks are global, so
    this sorts the distinct words once."""
    words = texts.select(F.explode(F.split(F.col(text_col), r"\s+")).alias("piece")).where("piece <> ''").groupBy("piece").count()
    return words.withColumn("token_id", F.row_number().over(Window.orderBy(F.desc("count"), "piece")) - 1)


def extend(vocab: DataFrame, numbers: list[int], bins: int) -> DataFrame:
    """Add control-change tokens: one for each number and one for each value bin."""
    spark = vocab.sparkSession
    names = [f"ControlChange_{n}" for n in numbers] + [f"CCValue_{b}" for b in range(bins)]
    top = F.coalesce(F.max("token_id"), F.lit(-1)).cast("long").alias("top")
    more = spark.createDataFrame(list(enumerate(names, 1)), "k long, piece string").crossJoin(F.broadcast(vocab.agg(top)))
    return vocab.select("token_id", "piece").unionByName(more.select((F.col("top") + F.col("k")).alias("token_id"), "piece"))


def control_events(controls: DataFrame, numbers: list[int], bins: int, quantize, program: str | None = None) -> DataFrame:
    """Each allowed control as ControlChange then CCValue, with their order (sub); a column
    ``program`` puts a Program token before them (-1 for drums)."""
    kept = controls.where(F.col("number").isin(numbers))
    tokens = [F.concat(F.lit("ControlChange_"), F.col("number").cast("string")), F.concat(F.lit("CCValue_"), quantize(F.col("value"), bins).cast("string"))]
    if program:
        tokens.insert(0, F.concat(F.lit("Program_"), F.col(program).cast("string")))
    parts = F.array(*[F.struct(F.lit(k).alias("sub"), t.alias("token")) for k, t in enumerate(tokens)])
    return kept.select("score_id", "track", "time", "seq", F.explode(parts).alias("p")).select("score_id", "track", "time", "seq", "p.*")


def graph_violations(tokens: DataFrame, key: str, order: str, type_col: str, edges: DataFrame) -> DataFrame:
    """Neighbouring tokens whose types are no edge (src, dst) of the type graph."""
    after = F.lead(type_col).over(Window.partitionBy(key).orderBy(order))
    steps = tokens.withColumn("src", F.col(type_col)).withColumn("dst", after).where(F.col("dst").isNotNull())
    return steps.join(F.broadcast(edges), ["src", "dst"], "left_anti")
