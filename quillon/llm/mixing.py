"""Mixing sources to target weights by soft membership.

Everything here is DataFrame functions; the driver holds numbers for each domain only.

*Posteriors.*  A table of labels (id, domain) trains a multinomial naive Bayes classifier
on words hashed into ``BUCKETS`` buckets.  At most ``max_labelled`` labelled rows are
used, the first by hash of id: half train it, half choose the sharpness of its posteriors
by log loss.  Every document then belongs to every domain with a probability.

*Rates.*  Each document i gets a rate r_i in [low, high].  With n_i tokens and posteriors
p_ik, the expected tokens of domain k are T_k = sum_i r_i n_i p_ik.  Projected gradient
descent minimises ``sum_k (T_k - t_k)^2 / (S m_k) + ridge * sum_i n_i (r_i - 1)^2`` over
the rates, where t_k = target_k * S is the wanted number, S the number of tokens and m_k
the share of domain k before mixing.  A step moves r_i by a function of the residuals of
all domains, so an iteration is one aggregation of the table to K numbers, and a rate is
a fold over the list of residuals; no rate is stored between iterations.

*Finish.*  Where the descent has not met the targets, Newton steps on the dual end the fit.
At the least, r_i is 1 - sum_k p_ik e_k / ridge within the bounds, with the residuals
e_k = (T_k - t_k) / (S m_k); these K numbers are found from aggregations to K + K^2 + 1
numbers, until they agree with the totals to ``FINISHED`` of all tokens.  What is left of
the gap to the targets is then due to the bounds, the posteriors and the ridge.

Null and empty texts have no tokens: they have the prior as posteriors and a rate like any
other.  Rows that share an id and a text get the same rate and each count.  A null domain
is not learned from.  Domains that occur only in the targets, or only in labels, count
with the number zero on the other side.  Without usable labels or documents all rates are 1.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

BUCKETS = 4096
MAX_LABELLED = 20_000
SHARPNESS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.5, 4.0)
RIDGE = 1e-3
FINISHED = 1e-7


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; empty strings may stand at the ends."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+")


def _exploded(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, first, bucket): a row for each word; bucket null for none."""
    return docs.select("doc_id", "text_hash", F.posexplode(words(F.col("text"))).alias("pos", "word")).select(
        "doc_id", "text_hash", (F.col("pos") == 0).cast("long").alias("first"), F.when(F.col("word") != "", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")).alias("bucket")
    )


class Mixture:
    """table: one row for each distinct (doc_id, text_hash) with copies, n_tokens and
    p_0.. (posteriors); domains; history: the residuals of each iteration of the descent; dual:
    the residuals at the least where Newton steps ended the fit, else None; gap: expected
    less wanted share of each domain; finished: whether the targets or the least are met."""

    def __init__(self, table: DataFrame, domains: list[str], history: list[list[float]], step: float, low: float, high: float, ridge: float):
        self.table, self.domains, self.history = table, domains, history
        self.step, self.low, self.high, self.ridge = step, low, high, ridge
        self.dual: list[float] | None = None
        self.gap: dict[str, float] = {}
        self.finished = False

    def rate_of(self, dual: list[float]) -> Column:
        """The rate that is best at given residuals."""
        slope = _total([F.lit(float(e)) * F.col(f"p_{k}") for k, e in enumerate(dual)])
        return F.greatest(F.lit(self.low), F.least(F.lit(self.high), 1.0 - slope / F.lit(self.ridge)))

    def rate(self) -> Column:
        """Rate of a row: from the residuals at the least, or a fold over the residuals of
        all iterations."""
        if self.dual is not None:
            return self.rate_of(self.dual)
        start = F.lit(min(max(1.0, self.low), self.high))
        if not self.history:
            return start
        past = F.array(*[F.array(*[F.lit(float(x)) for x in e]) for e in self.history])

        def move(r: Column, e: Column) -> Column:
            slope = F.lit(self.ridge) * (r - 1.0)
            for k in range(len(self.domains)):
                slope = slope + F.col(f"p_{k}") * F.element_at(e, k + 1)
            return F.greatest(F.lit(self.low), F.least(F.lit(self.high), r - F.lit(self.step) * slope))

        return F.aggregate(past, start, move)

    def rates(self) -> DataFrame:
        return self.table.withColumn("rate", self.rate())


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for x in parts[1:]:
        out = out + x
    return out


def finish(mix: Mixture, mass: Column, everything: float, base: list[float], share: list[float], start: list[float], steps: int = 100) -> None:
    """Newton steps with a line search on the convex dual, from the residuals ``start``."""
    size, m, t = len(base), np.array(base), np.array(share)

    def at(e: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Dual value, totals as shares, and second moments of the rows between the bounds."""
        p = [F.col(f"p_{k}") for k in range(size)]
        slope = _total([F.lit(float(x)) * q for x, q in zip(e, p, strict=True)])
        r, n = F.col("_r"), F.col("_n")
        rows = mix.table.withColumn("_r", mix.rate_of(e.tolist())).withColumn("_n", mass / F.lit(everything)).withColumn("_z", slope)
        free = F.when((r > mix.low) & (r < mix.high), n).otherwise(F.lit(0.0))
        value = F.sum(-n * (F.lit(mix.ridge / 2) * (r - 1.0) * (r - 1.0) + F.col("_z") * r))
        pairs = [(j, k) for j in range(size) for k in range(j, size)]
        got = rows.agg(value, *[F.sum(n * r * q) for q in p], *[F.sum(free * p[j] * p[k]) for j, k in pairs]).first()
        second = np.zeros((size, size))
        for (j, k), x in zip(pairs, got[1 + size :], strict=True):
            second[j, k] = second[k, j] = x
        return float(got[0] + (m * e * e).sum() / 2 + t @ e), np.array(got[1 : 1 + size], dtype=float), second

    e = np.array(start, dtype=float)
    value, totals, second = at(e)
    for _ in range(steps):
        slope = m * e - (totals - t)
        if np.abs(slope).max() < FINISHED:
            mix.finished = True
            break
        move = -np.linalg.solve(np.diag(m) + second / mix.ridge, slope)
        length = 1.0
        while length > 1e-9:
            new = at(e + length * move)
            if new[0] <= value + 1e-4 * length * float(slope @ move) + 1e-15:
                break
            length /= 2
        else:
            break
        e = e + length * move
        value, totals, second = new
    mix.dual = e.tolist()
    mix.gap = dict(zip(mix.domains, (totals - t).tolist(), strict=True))
    if not mix.finished:
        warnings.warn(f"mixing rates are not at the least; gap {mix.gap}", stacklevel=3)


def _posterior(sums: list[Column], prior: list[float], n: Column, sharp: float) -> list[Column]:
    scale = F.lit(sharp) / F.sqrt(F.greatest(n, F.lit(1.0)))
    z = [s * scale + F.lit(math.log(p)) for s, p in zip(sums, prior, strict=True)]
    top = F.greatest(*z) if len(z) > 1 else z[0]
    e = [F.exp(x - top) for x in z]
    total = e[0]
    for x in e[1:]:
        total = total + x
    return [x / total for x in e]


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", low: float = 0.0, high: float = 8.0, ridge: float = RIDGE, max_labelled: int = MAX_LABELLED, iterations: int = 40, tolerance: float = 1e-3) -> Mixture:
    """Fit posteriors and rates.  ``targets`` are weights of domains; they are divided by
    their sum."""
    if any(w < 0 for w in targets.values()) or sum(targets.values()) <= 0:
        raise ValueError("targets must be nonnegative and not all zero")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    known = labels.where(F.col(id_col).isNotNull() & F.col(domain_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(F.col(domain_col).cast("string")).alias("domain"))
    first = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = common.materialise(first.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))), "mix-labels")
    domains = sorted({r["domain"] for r in known.select("domain").distinct().collect()} | set(targets))
    share = [targets.get(d, 0.0) / sum(targets.values()) for d in domains]
    size = len(domains)
    # naive Bayes on the first half
    train = rows.join(F.broadcast(known.where("half = 0").select("doc_id", "domain")), "doc_id")
    counts = _exploded_domain(train).groupBy("domain", "bucket").count().collect()
    total = dict.fromkeys(domains, 0)
    cells: dict[tuple[str, int], int] = {}
    for r in counts:
        cells[r["domain"], r["bucket"]] = r["count"]
        total[r["domain"]] += r["count"]
    texts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    prior = [(texts.get(d, 0) + 0.5) / (sum(texts.values()) + 0.5 * size) for d in domains]
    weight = [(b, *[math.log((cells.get((d, b), 0) + 0.5) / (total[d] + 0.5 * BUCKETS)) for d in domains]) for b in range(BUCKETS)]
    spark = docs.sparkSession
    bound = spark.createDataFrame(weight, "bucket int, " + ", ".join(f"w_{k} double" for k in range(size)))
    seen = _exploded(rows).join(F.broadcast(bound), "bucket", "left")
    sums = seen.groupBy("doc_id", "text_hash").agg(F.sum("first").alias("copies"), F.count("bucket").alias("words"), *[F.coalesce(F.sum(f"w_{k}"), F.lit(0.0)).alias(f"s_{k}") for k in range(size)])
    sums = sums.select("doc_id", "text_hash", "copies", (F.col("words") / F.col("copies")).alias("n"), *[(F.col(f"s_{k}") / F.col("copies")).alias(f"s_{k}") for k in range(size)])
    scored = common.materialise(sums, "mix-sums")
    s, n = [F.col(f"s_{k}") for k in range(size)], F.col("n")
    # sharpness on the second half
    held = scored.join(F.broadcast(known.where("half = 1").select("doc_id", "domain")), "doc_id")
    losses = []
    for sharp in SHARPNESS:
        p = _posterior(s, prior, n, sharp)
        own = p[0]
        for d, x in zip(domains[1:], p[1:], strict=True):
            own = F.when(F.col("domain") == d, x).otherwise(own)
        losses.append(F.avg(-F.log(F.greatest(own, F.lit(1e-12)))))
    got = held.agg(*[x.alias(f"l{k}") for k, x in enumerate(losses)]).first()
    sharp = min((x, v) for x, v in zip(got, SHARPNESS, strict=True))[1] if got[0] is not None else 0.0
    p = _posterior(s, prior, n, sharp)
    table = common.materialise(scored.select("doc_id", "text_hash", "copies", n.cast("long").alias("n_tokens"), *[x.alias(f"p_{k}") for k, x in enumerate(p)]), "mix-posteriors")
    common.discard(scored)
    # projected gradient
    mass = F.col("copies") * F.col("n_tokens")
    before = table.agg(F.sum(mass), *[F.sum(mass * F.col(f"p_{k}")) for k in range(size)]).first()
    everything = float(before[0] or 0)
    mix = Mixture(table, domains, [], 1.0 / (1.0 + ridge), low, high, ridge)
    if not everything or not texts:
        return mix
    base = [max(float(x or 0) / everything, 1e-9) for x in before[1:]]
    for k in range(iterations + 1):
        now = table.withColumn("_m", mass * mix.rate()).agg(*[F.sum(F.col("_m") * F.col(f"p_{k}")) for k in range(size)]).first()
        gap = [(float(x or 0) / everything - t) for x, t in zip(now, share, strict=True)]
        mix.gap = dict(zip(domains, gap, strict=True))
        if max(map(abs, gap)) < tolerance:
            mix.finished = True
            break
        if k < iterations:
            mix.history.append([g / b for g, b in zip(gap, base, strict=True)])
    if not mix.finished and ridge > 0:
        finish(mix, mass, everything, base, share, [g / b for g, b in zip(gap, base, strict=True)])
    return mix


def _exploded_domain(train: DataFrame) -> DataFrame:
    word = train.select("domain", F.explode(words(F.col("text"))).alias("word")).where("word <> ''")
    return word.select("domain", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def copies(rate: Column, *key: str) -> Column:
    """Whole copies of a row: the rate rounded up or down by a hash of ``key``, so that the
    expected number is the rate."""
    unit = F.pmod(F.xxhash64(*[F.col(c) for c in key], F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (F.floor(rate) + (unit < rate - F.floor(rate)).cast("long")).cast("int")
