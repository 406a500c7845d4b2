"""Token sequences: assembly, budgets, split, packing, collation, extraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Special ids, in order from 0; text ids follow, then event ids.
SPECIALS = ("PAD", "BOS", "EOS", "PROMPT", "/PROMPT", "CONTEXT", "/CONTEXT", "GEN_ALL", "ADD_TRACK", "/ADD_TRACK")  # fixed values
ID = {name: k for k, name in enumerate(SPECIALS)}
TEXT_OFFSET = len(SPECIALS)
EVENT_OFFSET = TEXT_OFFSET + 256
IGNORE = -100


def _ids(*names: str) -> Column:
    return F.array(*[F.lit(ID[n]) for n in names])


def shift(ids: Column, offset: int) -> Column:
    return F.transform(ids, lambda x: x + offset)


def labelled(prefix: Column, target: Column) -> tuple[Column, Column]:
    """(input ids, labels): the prefix has no loss."""
    return F.concat(prefix, target), F.concat(F.array_repeat(F.lit(IGNORE), F.size(prefix)), target)


def scratch(text: Column, events: Column, eos: Column) -> tuple[Column, Column]:
    """Prompt, generate-all, start, events and, where ``eos`` holds, the end."""
    prefix = F.concat(_ids("PROMPT"), text, _ids("/PROMPT", "GEN_ALL", "BOS"))
    return labelled(prefix, F.concat(events, F.when(eos, _ids("EOS")).otherwise(F.array().cast("array<int>"))))


def add_track(text: Column, context: Column, target: Column, eos: Column) -> tuple[Column, Column]:
    """Prompt, context, add-track mark, start, target."""
    prefix = F.concat(_ids("PROMPT"), text, _ids("/PROMPT", "CONTEXT"), context, _ids("/CONTEXT", "ADD_TRACK", "/ADD_TRACK", "BOS"))
    return labelled(prefix, F.concat(target, F.when(eos, _ids("EOS")).otherwise(F.array().cast("array<int>"))))


def scratch_budget(limit: int, prompt: Column, most: int, eos: Column) -> Column:
    """Tokens left for events: the limit less prompt and framing, at least 1; 0 as ``most``
    is no cap of its own."""
    room = F.greatest(F.lit(1), F.lit(limit) - prompt - F.when(eos, 5).otherwise(4))
    return F.least(room, F.lit(most)) if most else room


def add_track_budget(limit: int, prompt: Column, eos: Column) -> Column:
    return F.greatest(F.lit(1), F.lit(limit) - prompt - F.when(eos, 8).otherwise(7))


def chunk_split(df: DataFrame, key: str, order: list[Column | str], chunk: int, ratio: float) -> DataFrame:
    """Split by chunks of ``chunk`` rows in ``order``: of each, the first floor(n * ratio)
    are train.  Ranks need one order; give a partition column as ``key`` to rank shards apart."""
    by = Window.partitionBy(key).orderBy(*order)
    df = df.withColumn("_r", F.row_number().over(by) - 1).withColumn("_c", F.expr(f"_r div {chunk}"))
    n = F.count("*").over(Window.partitionBy(key, "_c"))
    return df.withColumn("split", F.when(F.col("_r") % chunk < F.floor(n * ratio), "train").otherwise("val")).drop("_r", "_c")


def pack(df: DataFrame, shard: str, order: list[str], length: str, limit: int) -> DataFrame:
    """Greedy packing within each shard: a sample joins the open pack while the sum stays
    within the limit, else it opens the next; a sample over the limit has its own pack.
    A shard is one group of rows (order and length alone), so shards must be bounded; the
    packs are found by one search in its running sums each.  ``place`` counts the rows of a
    shard from 0; nulls come last, and rows of one order go by length."""
    rows = df.select(shard, *order, length)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in (*order, length)], null_placement="at_end"))
        total = np.cumsum(table[length].fill_null(0).to_numpy().astype(np.int64))
        packs, at, number = np.zeros(len(total), np.int32), 0, 0
        while at < len(total):
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
            packs[at:end] = number
            at, number = end, number + 1
        return table.append_column("pack", pa.array(packs)).append_column("place", pa.array(np.arange(len(total))))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(shard).applyInArrow(run, f"{kinds}, pack int, place bigint")


def packed_samples(df: DataFrame, shard: str, order: list[str], limit: int) -> DataFrame:
    """Samples (shard, order, mode, input_ids, labels) joined pack by pack in their order; a
    pack has the mode of its first sample, and ``samples`` holds the order of each sample,
    empty ones too.  Samples of one order are told apart by length, then by content.  Nulls
    are keys like any other; null ids are empty."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    given = [F.coalesce(F.col(c), F.array().cast(kinds[c])).alias(c) for c in ("input_ids", "labels")]
    # A struct equals another with the same nulls; its fields are cast to nullable ones, or a join shuffles it again.
    key = F.struct(shard, *order).cast("struct<" + ", ".join(f"`{c}`: {kinds[c].simpleString()}" for c in (shard, *order)) + ">").alias("_k")
    rows = df.select(key, "mode", *given).withColumn("_n", F.size("input_ids"))
    # One row a key: a key that repeats must not meet itself.
    places = pack(rows.select("_k.*", "_n"), shard, order, "_n", limit).groupBy(key)
    places = places.agg(F.array_sort(F.collect_list(F.struct("place", "pack"))).alias("_at"))
    ties = Window.partitionBy("_k").orderBy("_n", "mode", "input_ids", "labels")
    # Sizes of files and of packed shuffles say nothing of the arrays: neither side is sent to
    # all tasks, and numbered partitions are not put together again.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "_k").withColumn("_i", F.row_number().over(ties)).join(places.hint("merge"), "_k").withColumn("_at", F.element_at("_at", F.col("_i")))
    sample = F.struct("_at.place", "mode", "input_ids", "labels", F.struct(*[f"_k.{c}" for c in order]).alias("order"))
    g = rows.select(f"_k.{shard}", "_at.pack", sample.alias("_s")).repartition(n, shard, "pack").groupBy(shard, "pack").agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    whole = lambda c: F.flatten(F.transform("_s", lambda x: x[c]))
    return g.select(shard, "pack", F.element_at("_s", 1)["mode"].alias("mode"), whole("input_ids").alias("input_ids"), whole("labels").alias("labels"), F.transform("_s", lambda x: x["order"]).alias("samples"))


def compact(samples: DataFrame) -> DataFrame:
    """Mode, ids and labels as 32-bit integers, and the source path where there is one."""
    kept = [F.col("mode"), *[F.col(c).cast("array<int>").alias(c) for c in ("input_ids", "labels")]]
    return samples.select(*kept, *[F.col(c) for c in ("source_midi_path",) if c in samples.columns])


def shard_order(shards: DataFrame, split: str, shard: str, seed: int, epoch: int, workers: int) -> DataFrame:
    """Place of each shard in an epoch, drawn by a hash of seed + epoch, and its worker."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed + epoch)), F.col(shard).cast("string")).cast("binary"))
    place = F.row_number().over(Window.partitionBy(split).orderBy(drawn, shard)) - 1
    return shards.withColumn("place", place).withColumn("worker", F.pmod(F.col("place"), F.lit(workers)))


def collate(df: DataFrame, batch: str, ids: str, labels: str, most: int) -> DataFrame:
    """Clip, pad to the longest of the batch (ids 0, labels -100), mask."""
    df = df.withColumn("_i", F.slice(F.col(ids), 1, most)).withColumn("_l", F.slice(F.col(labels), 1, most))
    wide = F.max(F.size("_i")).over(Window.partitionBy(batch))
    df = df.withColumn("_w", wide).withColumn("_pad", F.col("_w") - F.size("_i"))
    return (
        df.withColumn("mask", F.concat(F.array_repeat(F.lit(1), F.size("_i")), F.array_repeat(F.lit(0), F.col("_pad"))))
        .withColumn(ids, F.concat("_i", F.array_repeat(F.lit(ID["PAD"]), F.col("_pad"))))
        .withColumn(labels, F.concat("_l", F.array_repeat(F.lit(IGNORE), F.col("_pad"))))
        .drop("_i", "_l", "_w", "_pad")
    )


def generated(ids: Column, offset: int = EVENT_OFFSET) -> Column:
    """Event ids after the first start up to the first end, without their offset."""
    bos = F.array_position(ids, ID["BOS"])
    tail = F.when(bos > 0, F.slice(ids, (bos + 1).cast("int"), F.size(ids))).otherwise(ids)
    eos = F.array_position(tail, ID["EOS"])
    body = F.when(eos > 0, F.slice(tail, F.lit(1), (eos - 1).cast("int"))).otherwise(tail)
    return F.transform(F.filter(body, lambda x: x >= offset), lambda x: x - offset)


def event_ids(ids: Column, vocabulary: int, offset: int = EVENT_OFFSET) -> Column:
    """Ids of the event range, without their offset."""
    return F.transform(F.filter(ids, lambda x: (x >= offset) & (x < offset + vocabulary)), lambda x: x - offset)


def allow_list(vocabulary: int, offset: int = EVENT_OFFSET) -> Column:
    return F.concat(F.sequence(F.lit(offset), F.lit(offset + vocabulary - 1)), _ids("EOS"))


def has_target(labels: Column) -> Column:
    return F.exists(labels, lambda x: x != IGNORE)


def shifted_labels(labels: Column) -> Column:
    """Position t predicts t + 1."""
    return F.slice(labels, F.lit(2), F.greatest(F.lit(0), F.size(labels) - 1))


def continuation(ids: Column, context: Column) -> Column:
    """What follows the context; null if the output is shorter than it."""
    return F.when(F.size(ids) >= context, F.slice(ids, (context + 1).cast("int"), F.greatest(F.lit(0), F.size(ids) - context).cast("int")))


def stride(df: DataFrame, rank: Column, workers: int, worker: int) -> DataFrame:
    return df.where(F.pmod(rank, F.lit(workers)) == worker)


def resume_from(df: DataFrame, index: str, done: int, most: int = 0) -> DataFrame:
    """Rows after the first ``done``; at most record ``most`` (0: all)."""
    out = df.where(F.col(index) >= done)
    return out.where(F.col(index) < most) if most else out
