"""Secret scans: fixed patterns, and a randomness test battery for other tokens.

Everything here is DataFrame functions.

*Patterns.*  Matches of a pattern are found leftmost and without overlap; their places
come from ``split``: the lengths of the texts between matches and of the matches add up
to code point offsets.

*Battery.*  A candidate is a run of at least ``MIN_LENGTH`` token characters with a digit.
Its encoding is the smallest alphabet that holds it.  Under the hypothesis that it is
random over that alphabet three statistics are taken: chi-squared uniformity (with the
exact mean and variance of few draws from many symbols), runs above and below the middle
of the alphabet, and lag-one serial correlation.  Sidak's combination of the three gives
one p-value, about uniform from 0 to 1 if the candidate is random.

*False discovery control.*  What is controlled is the share of ordinary text among the
candidates that are reported.  The p-values of random candidates are uniform; those of
ordinary text of ``MIN_LENGTH`` characters or more lie near 0.  So for each encoding and
length class (short candidates have weak tests and must not set the limit of long ones) the
number of random candidates is estimated: for each bound b up to ``_SURE`` bins (p of 0.78
down to 0.05) those with p over b, with two standard deviations more for all but the last
bound, are 1 - b of them; the least of these numbers holds, as only ordinary text can make
an estimate too large.  The limit is the least p for which

    1 - (random candidates expected above the limit) / (candidates above the limit) <= FDR.

The limits come from counts of p-values by bin, a table bounded by the number of classes.
Candidates above the limit are spans of kind ``random`` unless they overlap a pattern's
span.

Null texts are empty.  Rows are independent but for the thresholds: repeated rows each
have their result and each count as a candidate.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

#: Kinds in their order, with pattern, the group that has a least length, and that length.
PATTERNS = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
MIN_LENGTH = 20
FDR = 0.05
_TOKEN = "A-Za-z0-9+/_-"
CANDIDATE = rf"(?<![{_TOKEN}])(?=[A-Za-z+/_-]*[0-9])[{_TOKEN}]{{{MIN_LENGTH},}}"
#: Encodings from the smallest alphabet to the largest.
ENCODINGS = (
    ("hex", "0123456789abcdef", "^[0-9a-f]+$"),
    ("HEX", "0123456789ABCDEF", "^[0-9A-F]+$"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "^[A-Z2-7]+$"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz", "^[0-9a-z]+$"),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "^[0-9A-Z]+$"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "^[0-9A-Za-z]+$"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", "^.+$"),
)
_P_BINS = 4  # bins of ln p
_SURE = 12  # bins that tell how many candidates are random: p over exp(-3)


def _places(text: Column, pattern: str, found: Column) -> Column:
    """Start of each match, by the lengths between and of matches."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    long = F.transform(found, lambda m: F.length(m))
    step = F.zip_with(F.slice(gaps, F.lit(1), F.size(long)), long, lambda g, n: F.struct(g.alias("g"), n.alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(step, start, lambda a, s: F.struct((a["at"] + s["g"] + s["n"]).alias("at"), F.concat(a["out"], F.array(a["at"] + s["g"])).alias("out")), lambda a: a["out"])


_SPAN = "array<struct<start:int,kind:int,stop:int>>"


def pattern_spans(text: Column, order: int) -> Column:
    """Spans of one fixed pattern as (start, kind, stop), code points."""
    name, pattern, group, least = PATTERNS[order]
    if name == "assign":
        low = F.lower(text)
        may = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    elif name == "access":
        may = F.contains(text, F.lit("AKIA"))
    else:
        may = F.rlike(text, F.lit(rf"[0-9a-f]{{{least}}}"))
        pattern = rf"(?<![0-9a-f])[0-9a-f]{{{least},}}"  # the same spans without the short ones
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    all_ = F.arrays_zip(_places(text, pattern, found).alias("start"), F.transform(found, lambda m: F.length(m)).alias("n"), F.transform(tested, lambda m: F.length(m)).alias("t"))
    kept = F.filter(all_, lambda s: s["t"] >= least)
    spans = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind"), (s["start"] + s["n"]).alias("stop")))
    return F.when(may, spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) by Abramowitz and Stegun 7.1.26 on the complementary error function."""
    x = F.abs(z) / math.sqrt(2)
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.3275911)
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * 1.061405429))))
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-300), poly * F.exp(-x * x)))


def _place_in(alphabet: str):
    """A function of one character: its place in the alphabet."""
    return lambda c: F.position(c, F.lit(alphabet)) - 1


def _value(token: Column) -> Column:
    """(encoding, alphabet size, places in the alphabet) of a token."""
    out = None
    for k, (_, alphabet, shape) in reversed(list(enumerate(ENCODINGS))):
        found = F.struct(F.lit(k).alias("enc"), F.lit(len(alphabet)).alias("k"), F.transform(F.split(token, ""), _place_in(alphabet)).alias("v"))
        out = found if out is None else F.when(F.rlike(token, F.lit(shape)), found).otherwise(out)
    return out


def p_value(enc: Column) -> Column:
    """Combined p-value of randomness for a struct of :func:`_value`."""
    v, k = enc["v"], enc["k"].cast("double")
    n = F.size(v).cast("double")
    counts = F.transform(F.array_distinct(v), lambda d: F.size(F.filter(v, lambda x: x == d)).cast("double"))
    squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
    chi = k / n * squares - n
    z1 = (chi - (k - 1)) / F.sqrt(F.lit(2.0) * (k - 1) * (n - 1) / n)
    uneven = F.when(z1 > 0, _two_sided(z1) / 2).otherwise(F.lit(1.0) - _two_sided(z1) / 2)
    side = F.transform(v, lambda x: F.when(x * 2 < enc["k"], 0).otherwise(1))
    ones = F.aggregate(side, F.lit(0), lambda a, x: a + x).cast("double")
    zeros = n - ones
    follow = F.zip_with(F.slice(side, F.lit(1), F.size(side) - 1), F.slice(side, F.lit(2), F.size(side) - 1), lambda a, b: F.when(a == b, 0).otherwise(1))
    runs = F.aggregate(follow, F.lit(1), lambda a, x: a + x).cast("double")
    mean = F.lit(2.0) * ones * zeros / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    run = F.when(var > 0, _two_sided((runs - mean) / F.sqrt(F.greatest(var, F.lit(1e-12))))).otherwise(F.lit(1e-12))
    middle = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    dev = F.transform(v, lambda x: x - middle)
    spread = F.aggregate(dev, F.lit(0.0), lambda a, d: a + d * d)
    pair = F.zip_with(F.slice(dev, F.lit(1), F.size(dev) - 1), F.slice(dev, F.lit(2), F.size(dev) - 1), lambda a, b: a * b)
    lag = F.aggregate(pair, F.lit(0.0), lambda a, x: a + x)
    serial = F.when(spread > 0, _two_sided((lag / F.greatest(spread, F.lit(1e-12)) + F.lit(1.0) / n) * F.sqrt(n))).otherwise(F.lit(1e-12))
    least = F.least(uneven, run, serial)
    return F.greatest(F.lit(1e-300), F.when(least < 1, -F.expm1(F.log1p(-least) * 3)).otherwise(1.0))


def candidates(text: Column) -> Column:
    """Candidates as (start, stop, class, pbin): class joins encoding and length class."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    zipped = F.arrays_zip(_places(text, CANDIDATE, found).alias("start"), found.alias("t"), F.transform(found, _value).alias("e"))

    def one(c: Column) -> Column:
        size = F.length(c["t"])
        cls = c["e"]["enc"] * 64 + F.floor(F.log2(size.cast("double"))).cast("int")
        return F.struct(c["start"].alias("start"), (c["start"] + size).alias("stop"), cls.alias("cls"), F.floor(-F.log(p_value(c["e"])) * _P_BINS).cast("int").alias("pbin"))

    kind = "array<struct<start:int,stop:int,cls:int,pbin:int>>"
    return F.when(F.rlike(text, F.lit(CANDIDATE)), F.transform(zipped, one).cast(kind)).otherwise(F.array().cast(kind))


def limits(counts: dict[int, int], fdr: float = FDR) -> int:
    """The last bin of -ln p that is reported, for the counts by bin of one class; -1: none."""

    def estimate(b: int) -> float:
        over = sum(n for k, n in counts.items() if k < b)
        return (over + (2 * math.sqrt(over + 1) if b < _SURE else 0)) / -math.expm1(-b / _P_BINS)

    random = min(map(estimate, range(1, _SURE + 1)))
    last, seen = -1, 0
    for b in sorted({*counts, *range(_SURE)}):
        seen += counts.get(b, 0)
        if seen and 1 + random * math.expm1(-(b + 1) / _P_BINS) / seen <= fdr:
            last = b
    return last


def thresholds(found: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """For each class the last bin of -ln p that is reported.  The counts have at most
    (encodings x length classes x bins) rows."""
    bins = found.select(F.explode("cands").alias("c")).groupBy("c.cls", "c.pbin").count().collect()
    by: dict[int, dict[int, int]] = {}
    for r in bins:
        by.setdefault(r["cls"], {})[r["pbin"]] = r["count"]
    return {cls: limits(counts, fdr) for cls, counts in by.items()}


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``spans``: (start, kind, stop) sorted by start, then kind; kind
    counts as in PATTERNS, and ``len(PATTERNS)`` is ``random``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*[pattern_spans(text, k) for k in range(len(PATTERNS))])
    found = common.materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("keep"), base.alias("_base"), candidates(text).alias("cands")), "secrets")
    last = thresholds(found)
    random = len(PATTERNS)
    if last:
        limit = F.create_map(*[F.lit(z) for pair in last.items() for z in pair])
        high = lambda c: c["pbin"] <= F.try_element_at(limit, c["cls"])
    else:
        high = lambda c: F.lit(False)
    free = lambda c: ~F.exists("_base", lambda s: (s["start"] < c["stop"]) & (c["start"] < s["stop"]))
    more = F.transform(F.filter("cands", lambda c: high(c) & free(c)), lambda c: F.struct(c["start"].alias("start"), F.lit(random).alias("kind"), c["stop"].alias("stop"))).cast(_SPAN)
    return found.select("keep.*", F.sort_array(F.concat("_base", more)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(p[0]) for p in PATTERNS], F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch covered by spans (sorted by start) replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        out = F.when(fresh, F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substr(text, done["at"] + 1, F.greatest(F.length(text) - done["at"], F.lit(0))))).otherwise(text)
