"""Quality rules with robust multivariate outliers.

*Statistics.*  One pass over the whole texts gives word counts, symbol counts, repeated
lines and repeated three-word windows, and a vector of transformed statistics
(``FEATURES``), each a logarithm of a length, a ratio or a share.

*Base rules.*  Fewer than 50 words, or more than half the words inside three-word
windows found twice or more: the document fails.

*Minimum covariance determinant.*  For each language and source, location and scatter
are those of the share ``SUPPORT`` of its documents whose scatter has the least
determinant.  Two starts (quartiles, and plain moments) are improved by
concentration steps; the one with the smaller determinant goes on.  All groups step
together: documents meet the estimates of their group, and counts, sums and products
are added up by group and bin of log distance, within a task first.  Of the bin that holds
the support's last document the missing share is taken, so the support has its size but the
order within that bin does not count; a group with a third of all rows costs no more than
its share.  The scatter is scaled so that the median distance is that
of the chi-squared law, and a document is kept if its squared Mahalanobis distance is at
most the cutoff.

Groups of fewer than ``min_group`` documents are estimated together with the other small
groups of their language, and if those are few, with all such documents.  A null language
or source is a value like any other.  Documents that fail the base rules have no say in
the estimates.  Null and empty texts have no words and fail.  Each row has one result;
repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

FEATURES = ("log_words", "log_word_length", "log_distinct", "log_symbols", "log_upper", "log_other")
P = len(FEATURES)
SUPPORT = 0.75
MIN_GROUP = 60
#: Smallest standard deviation of each feature: spreads below it are noise of short texts.
FLOOR = np.array([0.25, 0.06, 0.15, 0.25, 0.3, 0.3])
TAIL = 1e-9
_BINS = 16
_SYMBOLS = b"#*$%&|<>"
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " + ", ".join(f"x{i} double" for i in range(P))


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while abs(term) > abs(total) * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma_p(df / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def text_statistics(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, features."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, 0, 0, 0, True, *[0.0] * P)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=n)
    repeat = 0
    if n > 3:
        m = len(names)
        if m < 1 << 21:
            key = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
        else:
            pair = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1]
            key = pair[:-1] * m + ids[2:]
        _, place, times = np.unique(key, return_inverse=True, return_counts=True)
        again = (times > 1)[place]
        cover = np.zeros(n, dtype=bool)
        cover[:-2] = again
        cover[1:-1] |= again
        cover[2:] |= again
        repeat = int(cover.sum())
    size = len(joined)
    upper = size - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    plain = size - len(joined.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    high = len(joined) - len(joined.decode("utf-8", "surrogatepass").encode("ascii", "ignore"))
    other = size - plain - high - symbols
    vector = (
        math.log(n),
        math.log(chars / n),
        math.log(len(names)),
        math.log(100 * symbols / n + 1),
        math.log((upper + 1) / (plain + high + 50)),
        math.log((other + 1) / (chars + 50)),
    )
    return (n, chars, symbols, dup, repeat, n < 50 or 100 * repeat > 50 * n, *vector)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, statistics and features) for each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = [x.split()[0] for x in _STATS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*map(text_statistics, common.texts(batch, "text")), strict=True)) or [[]] * len(names)
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * P
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], names=["doc_id", "lang", "source", *names])

    return rows.mapInArrow(run, f"doc_id {kind}, lang string, source string, {_STATS}")


# ---- estimates ------------------------------------------------------------------------

_X = [f"x{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_FIT = "key string, start int, n long, log_det double, scale double, " + ", ".join([f"m{i} double" for i in range(P)] + [f"a{i}{j} double" for i, j in _PAIRS])


def _moments():
    return [F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(x) for x in _X), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _PAIRS)]


def _fit(n: float, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Location, inverse scatter and log determinant from count, sums and products."""
    mean = s / n
    cov = np.zeros((P, P))
    for (i, j), v in zip(_PAIRS, q, strict=True):
        cov[i, j] = cov[j, i] = v / n - mean[i] * mean[j]
    cov = (cov + cov.T) / 2 + np.diag(FLOOR**2)
    return mean, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def _row(key: str, start: int, n: int, fit: tuple, scale: float) -> tuple:
    mean, inv, det = fit
    return (key, start, n, det, scale, *mean, *(inv[i, j] for i, j in _PAIRS))


_NAMES = [x.split()[0] for x in _FIT.split(", ")]


def _first(stats: DataFrame) -> DataFrame:
    """Start 0: quartiles, with independent features.  Start 1: plain moments."""
    quart = [F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"p_{x}") for x in _X]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                p = np.array([r[f"p_{x}"] for x in _X], dtype=float)
                sd2 = ((p[:, 2] - p[:, 0]) / 1.349) ** 2 + FLOOR**2
                out.append(_row(r["key"], 0, r["n"], (p[:, 1], np.diag(1 / sd2), float(np.log(sd2).sum())), 1.0))
                out.append(_row(r["key"], 1, r["n"], _fit(r["n"], np.array([r[x] for x in _X]), np.array([r[f"q{i}{j}"] for i, j in _PAIRS])), 1.0))
            yield pd.DataFrame(out, columns=_NAMES)

    return stats.groupBy("key").agg(*_moments(), *quart).mapInPandas(run, _FIT)


def distance(prefix: str = ""):
    """Squared Mahalanobis distance of features x to the estimate m, a beside them."""
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + F.col(f"a{i}{j}") * d[i] * d[j] * F.lit(1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def _support(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The fit of the h nearest rows from counts, sums and products of bins in ascending
    distance: whole bins, and of the bin that holds the h-th row the share that is missing."""
    h = math.ceil(SUPPORT * int(n.sum()))
    share = np.clip((h - (n.cumsum() - n)) / n, 0.0, 1.0)
    return _fit(float(h), share @ s, share @ q)


def _concentrate(stats: DataFrame, fits: DataFrame, choose: bool, median: float) -> DataFrame:
    """One step of all groups: the moments of the support nearest to the last estimate.
    ``choose`` keeps only the start with the least determinant."""
    near = stats.join(fits.select("key", "start", *_NAMES[5:]), "key")
    binned = near.withColumn("bin", F.floor(F.log(distance() + 1e-9) * _BINS).cast("int")).groupBy("key", "start", "bin").agg(*_moments())

    def run(group: pd.DataFrame) -> pd.DataFrame:
        best = None
        for start, g in group.groupby("start"):
            g = g.sort_values("bin")
            n = g["n"].cumsum().to_numpy()
            total = int(n[-1])
            fit = _support(g["n"].to_numpy(), g[_X].to_numpy(), g[[f"q{i}{j}" for i, j in _PAIRS]].to_numpy())
            mid = int(np.searchsorted(n, total / 2))
            scale = math.exp((float(g["bin"].iloc[mid]) + 0.5) / _BINS) / median
            row = _row(str(g["key"].iloc[0]), int(start), total, fit, scale)
            if choose:
                best = [row] if best is None or row[3] < best[0][3] else best
            else:
                best = [*(best or []), row]
        return pd.DataFrame(best, columns=_NAMES)

    return binned.groupBy("key").applyInPandas(run, _FIT)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", steps: int = 5, min_group: int = MIN_GROUP, tail: float = TAIL) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, distance (null if the base rules fail) for each row."""
    stats = common.materialise(statistics(docs, id_col, text_col, lang_col, source_col).withColumn("_own", F.to_json(F.struct("lang", "source"))), "quality-stats")
    good = stats.where(~F.col("base_failed"))
    sizes = good.groupBy("_own", "lang").agg(F.count("*").alias("_n"))
    few = F.col("_n") < min_group
    rest = sizes.where(few).groupBy("lang").agg(F.sum("_n").alias("_m")).withColumnRenamed("lang", "_l")
    keys = sizes.join(rest, sizes["lang"].eqNullSafe(rest["_l"]), "left").select("_own", F.when(~few, F.col("_own")).when(F.col("_m") >= min_group, F.concat(F.lit("lang:"), F.to_json(F.struct("lang")))).otherwise("all").alias("key"))
    keyed = common.materialise(stats.join(keys, "_own", "left"), "quality-keyed")
    common.discard(stats)
    good = keyed.where(~F.col("base_failed")).select("key", *_X)
    median = chi2_quantile(0.5, P)
    fits = common.materialise(_first(good), "quality-fit")
    for step in range(steps + 1):
        after = common.materialise(_concentrate(good, fits, step == 1, median), "quality-fit")
        common.discard(fits)
        fits = after
    # the scale of an estimate is seen one step later: one more pass over its own distances
    scale = common.materialise(_concentrate(good, fits, False, median).select("key", "scale"), "quality-scale")
    final = fits.drop("scale").join(scale, "key")
    judged = keyed.join(final, "key", "left").withColumn("distance", F.when(~F.col("base_failed"), distance() / F.greatest("scale", F.lit(1.0))))
    cutoff = chi2_quantile(1 - tail, P)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"), "distance")
