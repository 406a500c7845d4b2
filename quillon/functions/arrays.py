"""Array mathematics: normalisation, logits, losses, quantisation, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def rms_norm(v: Column, eps: float = 1e-6) -> Column:
    """v / sqrt(mean(v^2) + eps)."""
    mean = total(F.transform(v, lambda x: x * x)) / F.size(v)
    return F.transform(v, lambda x: x / F.sqrt(mean + eps))


def l2_norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def rotary(v: Column, position: int, base: float = 10000.0) -> Column:
    """Rotate halves of an even-sized vector by position-dependent angles."""
    half = F.size(v) / 2
    angle = lambda i: F.lit(float(position)) / F.pow(F.lit(base), i.cast("double") / half)
    i = lambda k: (k % half.cast("int")).cast("int")

    def one(x: Column, k: Column) -> Column:
        other = F.when(k < half, -F.element_at(v, (k + half.cast("int") + 1).cast("int"))).otherwise(F.element_at(v, (k - half.cast("int") + 1).cast("int")))
        return x * F.cos(angle(i(k))) + other * F.sin(angle(i(k)))

    return F.transform(v, one)


def silu(x: Column) -> Column:
    return x / (F.lit(1.0) + F.exp(-x))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax at ``target`` (from 0); null where the target is -100."""
    top = F.array_max(logits)
    lse = top + F.log(total(F.transform(logits, lambda x: F.exp(x - top))))
    return F.when(target != -100, lse - F.element_at(logits, (target + 1).cast("int")))


def filter_logits(rows: DataFrame, temperature: float, top_k: int, top_p: float, allowed: Column | None = None) -> DataFrame:
    """(row_id, token_id, p) of the tokens that stay: temperature (at least 1e-5), an
    allow-list, top-k with ties kept, then, for 0 < top_p < 1, the smallest set whose
    probability before its last token is at most top_p."""
    df = rows if allowed is None else rows.where(allowed)
    df = df.withColumn("z", F.col("logit") / max(temperature, 1e-5))
    by = Window.partitionBy("row_id")
    if top_k > 0:
        df = df.withColumn("r", F.rank().over(by.orderBy(F.desc("z")))).where(F.col("r") <= top_k)
    df = df.withColumn("w", F.exp(F.col("z") - F.max("z").over(by)))
    df = df.withColumn("p", F.col("w") / F.sum("w").over(by))
    if not 0 < top_p < 1:
        return df.select("row_id", "token_id", "p")
    before = by.orderBy(F.desc("z"), "token_id").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("before", F.coalesce(F.sum("p").over(before), F.lit(0.0)))
    return df.where(F.col("before") <= top_p).select("row_id", "token_id", "p")


def most_likely(rows: DataFrame) -> DataFrame:
    """(row_id, token_id) of rows (row_id, token_id, logit, p) whose probabilities cannot be
    drawn from (null, not a number, or a sum under 1e-8): the allowed token of the greatest
    logit, the least id of equals."""
    bad = F.coalesce(F.max(F.isnan("p") | F.col("p").isNull()) | (F.sum("p") < 1e-8), F.lit(True))
    best = F.max_by(F.col("token_id"), F.struct("logit", (-F.col("token_id")).alias("back")))
    return rows.groupBy("row_id").agg(bad.alias("bad"), best.alias("token_id")).where("bad").drop("bad")


def histogram(df: DataFrame, value: str, bins: int = 64) -> DataFrame:
    """Equal-width bins over [min, max], the last closed; a constant column is widened by
    half to each side.  Two aggregations; the bounds are one row."""
    lim = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lim = lim.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))).cast("int")
    return df.join(F.broadcast(lim)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def quantize(v: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.round(v * (bins - 1) / 127.0))).cast("int")


def dequantize(i: Column, bins: int) -> Column:
    return F.least(F.lit(127), F.greatest(F.lit(0), F.round(i * 127.0 / (bins - 1)))).cast("int")


def learning_rate(step: Column, peak: float, warm: int, last: int, floor_ratio: float) -> Column:
    """Linear warm-up, then a cosine to ``peak * floor_ratio``."""
    progress = F.least(F.lit(1.0), (step - warm) / float(max(1, last - warm)))
    cosine = F.lit(floor_ratio) + F.lit((1 - floor_ratio) * 0.5) * (F.lit(1.0) + F.cos(progress * math.pi))
    return F.lit(peak) * F.when(step < warm, step / float(max(1, warm))).otherwise(cosine)


def utilization(params: Column, tokens: Column, seconds: Column, peak: float = 312e12) -> Column:
    """Share of peak: 6 * params * tokens / seconds / peak."""
    return F.lit(6.0) * params * tokens / seconds / peak
