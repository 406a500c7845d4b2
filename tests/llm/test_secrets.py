import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from quillon.llm import secrets

RES = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def brute(text):
    out = []
    for k, (name, pattern, group, least) in enumerate(RES):
        out += [(m.start(), k, m.end(), name) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(out))


def test_base_spans_brute(spark):
    rnd = random.Random(0)
    bits = ["password", "Secret", "API_KEY", "apikey", "token", ":", "=", " ", "'", '"', "AKIA", "A1B2C3", "0123456789abcdef", "é", "\U0001f600", "abc", "\n", "deadbeef", "x.y", "ſecret", "toKen"]
    texts = [None, "", "a", "password=abc", "token = 'abcdef", "AKIA" + "Z" * 16, "0" * 23, "0" * 24 + "g" + "f" * 40, "passwordpassword:token=secret=abcdef", "p" * 3000 + "passwd:" + "q" * 3000]
    texts += ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    texts.append(" ".join(["password=abcdef12 é"] * 500))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: r.t for r in secrets.scan(df).select("doc_id", secrets.span_text(F.filter("spans", lambda s: s["kind"] < 3)).alias("t")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == brute(t), t
    assert secrets.scan(df.limit(0)).count() == 0


def test_battery(spark):
    rnd = random.Random(5)
    alpha = secrets.ENCODINGS[5][1]
    rows = [(k, "key " + "".join(rnd.choice(alpha) for _ in range(40)) + " end") for k in range(60)]
    rows += [(100 + k, "id " + ("item-number-" * 4 + f"{k:04d}") + " 11111111111111111111111111112222222222222222") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.t for r in secrets.scan(df).select("doc_id", secrets.span_text(F.col("spans")).alias("t")).collect()}
    assert sum(got[k] == "random:4:44" for k in range(60)) >= 55
    assert sum("random" in got[100 + k] for k in range(60)) <= 5


def normal_tail(z):
    """P(|Z| >= |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


def brute_p(token):
    """The battery by its definition, with the library's own error function."""
    alphabet = next(a for _, a, shape in secrets.ENCODINGS if re.search(shape, token))
    v, k, n = [alphabet.index(c) for c in token], len(alphabet), len(token)
    chi = sum((v.count(x) - n / k) ** 2 / (n / k) for x in range(k))
    z = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    uneven = normal_tail(z) / 2 if z > 0 else 1 - normal_tail(z) / 2
    side = [2 * x >= k for x in v]
    runs, ones = 1 + sum(a != b for a, b in zip(side, side[1:])), sum(side)
    mean = 2 * ones * (n - ones) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    run = normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1e-12
    dev = [x - sum(v) / n for x in v]
    spread = sum(d * d for d in dev)
    serial = normal_tail((sum(a * b for a, b in zip(dev, dev[1:])) / spread + 1 / n) * math.sqrt(n)) if spread > 0 else 1e-12
    return 1 - (1 - min(uneven, run, serial)) ** 3


def test_p_values_brute(spark):
    rnd = random.Random(3)
    tokens = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(20, 70))) + "1" for _, alphabet, _ in secrets.ENCODINGS for _ in range(150)]
    tokens += ["item-number-" * 3 + "0001", "1" * 30, "a1" * 20, "0123456789abcdef" * 2]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(tokens)], "k long, t string")
    got = {r.k: r.p for r in df.select("k", secrets._value(F.col("t")).alias("e")).select("k", secrets.p_value(F.col("e")).alias("p")).collect()}
    want = {k: brute_p(t) for k, t in enumerate(tokens)}
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)
    share = [sum(want[k] > t for k in range(1050)) / 1050 for t in (0.5, 0.2, 0.05)]
    assert abs(share[0] - 0.5) < 0.1 and abs(share[1] - 0.8) < 0.07 and abs(share[2] - 0.95) < 0.04, share


def test_limits():
    level = {k: round(1000 * (math.exp(-k / 4) - math.exp(-(k + 1) / 4))) for k in range(12)}  # 1,000 random candidates
    assert secrets.limits({60: 5}) == -1  # ordinary text alone: nothing is reported
    assert secrets.limits({2: 1}) == 11 and secrets.limits({10: 1}) == 11  # one candidate that may well be random
    assert secrets.limits(level | {13: 20, 60: 10}) == 60  # 10 of about 1,000 are few enough
    assert secrets.limits(level | {13: 20, 60: 400}) == 13
    assert secrets.limits(level | {10: 600, 11: 600}) < 10  # too many small ones to be random


def test_planted_among_ordinary(spark):
    """Secrets that no pattern names, of several encodings, beside ordinary long tokens."""
    rnd = random.Random(11)
    words = "server archive number report update config module release static content image draft table session".split()
    rows, planted = [], {}
    for k in range(600):
        plain = rnd.choice("-_/").join(rnd.choice(words) for _ in range(rnd.randint(3, 7))) + f"-{rnd.randint(1, 9999)}"
        text = f"see {plain} for more"
        if k % 3 == 0:
            alphabet = secrets.ENCODINGS[(3, 5, 6)[k // 3 % 3]][1]
            token = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(28, 60))) + "7"
            planted[k] = token
            text += f" value {token} end"
        rows.append((k, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    said = [(r.doc_id, rows[r.doc_id][1][s.start : s.stop]) for r in secrets.scan(df).collect() for s in r.spans if s.kind == 3]
    true = sum(planted.get(k) == t for k, t in said)
    assert true >= 0.9 * len(planted) and len(said) - true <= 0.1 * len(said), (true, len(planted), len(said))


def test_redact(spark):
    df = spark.createDataFrame([(1, "aé password=abcdef1 tail"), (2, "plain"), (3, None), (3, "x token=" + "ab12" * 10)], "doc_id long, text string")
    got = [r.r for r in secrets.scan(df, keep=("doc_id", "text")).select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("r")).orderBy("doc_id", "r").collect()]
    assert got == ["aé [SECRET] tail", "plain", None, "x [SECRET]"]


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
