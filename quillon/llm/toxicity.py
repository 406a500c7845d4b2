"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

*Sentences.*  A text is cut into sentences at ``. ! ?`` before white space and at line ends.
White space runs are one space; runs of three or more single characters are joined
("i d i o t").  A sentence is judged by its windows of ``WINDOW`` characters, one from each
of its places (and shorter ones where it begins and ends), words and what lies between them
alike; its worst window decides, and the
worst sentence decides for the text.

*Kernel.*  Two strings are alike if they share subsequences of three characters; an
occurrence that spans s characters weighs ``DECAY ** s`` and spans over ``SPAN`` weigh
nothing, so gaps and inserted characters lower the likeness without ending it.  Values are
divided by the norms of both strings; a window's norm is at least that of a full one.

*Training.*  Sentences of texts labelled 0 are not toxic; a text labelled 1 has at least one
toxic sentence, which is not known.  Subsequences that weigh more in toxic sentences than
in clean ones give a first table of weights.  Each round then takes as witnesses the worst
windows of toxic texts that are worse than nearly all clean texts, and the worst windows of
clean texts, adding to those of earlier rounds; some of both are the landmarks of a Nyström
map, and a linear support vector machine (squared hinge) is fitted on the mapped windows.
A logistic curve, fitted on the clean texts and the toxic ones with a witness, turns a
text's worst window into a score; 0.5 separates the classes with equal weight.

*Bounds.*  The fit takes at most ``max_rows`` labelled texts of each class, the first by
hash of id, as long as they have at most ``max_bytes`` bytes together (whole texts; one is
always taken).  It is held on the driver.  Each round takes at most ``WITNESSES`` windows
of a text, ``SAMPLE`` windows of a class, and ``LANDMARKS`` landmarks.  Scoring covers all
windows of all texts.

*Scoring.*  Landmarks, map and weights collapse into one table of weights over character
triples (``SYMBOLS`` cubed numbers), so a window costs sums over its own subsequences.
Windows within the clean margin are not told apart: a text of such windows has the score of
the margin.

Null and empty texts have no window and get the score of the margin too.  Null
labels are not learned from, nor are labels of ids that ``docs`` does not hold; rows that
repeat an id and a text count once in the fit, and every row is scored.  Other columns are
not read.  Without labels of both classes every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

DECAY = 0.7
SPAN = 8
WINDOW = 16
SYMBOLS = 64
MAX_ROWS = 2000
MAX_BYTES = 4_000_000
LANDMARKS = 256
SAMPLE = 3000
WITNESSES = 4
ROUNDS = 4
CALM = 0.98
_SPACE, _WALL = 26, 63
_APART = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?![^\s.,;:!?])")
_CUT = re.compile(r"[.!?]+(?:\s+|$)")
_BLANK = re.compile(r"\s{2,}|[\t\r\x0b\x0c]")
_CHUNK = 1 << 19
_STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _apart(text: str) -> bool:
    """Whether two single characters stand side by side."""
    gap = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") <= 32
    return bool((gap[2:-2] & ~gap[1:-3] & ~gap[3:-1] & (gap[:-4] | gap[4:])).any())


def plain(text: str) -> str:
    """Lower-case text with a space at both sides of each word and a wall between sentences."""
    text = text.lower().replace("\0", " ")
    if _apart(text):
        text = _APART.sub(lambda m: "".join(m.group().split()), text)
    text = _BLANK.sub(" ", _CUT.sub("\0", text).replace("\n", "\0"))
    return f" {text} ".replace("\0", " " + "\0" * WINDOW + " ") if text else text


def symbols(text: str) -> np.ndarray:
    """Symbols 0..SYMBOLS-1; the wall is the last."""
    out = np.empty(len(text), dtype=np.int32)
    for lo in range(0, len(text), _CHUNK):
        code = np.frombuffer(text[lo : lo + _CHUNK].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
        part = np.where((code >= 97) & (code <= 122), code - 97, _SPACE + 1 + code % (_WALL - _SPACE - 1))
        part[code == 32] = _SPACE
        part[code == 0] = _WALL
        out[lo : lo + len(part)] = part
    return out


def _triples(size: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array([t for t in combinations(range(size), 3) if t[2] - t[0] < SPAN], dtype=np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


#: Norm of a window whose subsequences all differ.
FULL = float(np.sqrt((_triples(WINDOW)[1] ** 2).sum()))


_AT, _WEIGHT = _triples(WINDOW)
_WEIGHT = _WEIGHT.astype(np.float32)


def rows(windows: list[str]) -> np.ndarray:
    """Symbols of windows, shorter ones filled up with walls."""
    return symbols("".join(w[:WINDOW].ljust(WINDOW, "\0") for w in windows)).reshape(-1, WINDOW)


def _codes(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the subsequences of each window, and their weights (none across walls)."""
    x, y, z = (part[:, _AT[:, k]] for k in range(3))
    return (x * SYMBOLS + y) * SYMBOLS + z, np.where((x == _WALL) | (y == _WALL) | (z == _WALL), np.float32(0), _WEIGHT)


def norms(part: np.ndarray, least: float = FULL) -> np.ndarray:
    """Norm of each window, at least that of a full one: repeated subsequences add up."""
    out = np.empty(len(part))
    for lo in range(0, len(part), 2000):
        code, weight = _codes(part[lo : lo + 2000])
        order = np.argsort(code, axis=1)
        code, weight = np.take_along_axis(code, order, axis=1), np.take_along_axis(weight, order, axis=1)
        fresh = np.ones(code.shape, dtype=bool)
        fresh[:, 1:] = code[:, 1:] != code[:, :-1]
        cut = np.flatnonzero(fresh)
        sums = np.add.reduceat(weight.ravel(), cut).astype(np.float64)
        out[lo : lo + 2000] = np.sqrt(np.bincount(cut // code.shape[1], weights=sums * sums, minlength=len(code)))
    return np.maximum(out, least)


def gram(windows: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of each window with each landmark."""
    if not windows or not landmarks:
        return np.zeros((len(windows), len(landmarks)))
    marks = rows(landmarks)
    code, weight = _codes(marks)
    weight = weight / norms(marks, 1e-12)[:, None]
    kinds, row = np.unique(code, return_inverse=True)
    dense = np.zeros((len(kinds) + 1, len(landmarks)), dtype=np.float32)
    np.add.at(dense, (row.ravel() + 1, np.repeat(np.arange(len(landmarks)), code.shape[1])), weight.ravel())
    place = np.zeros(SYMBOLS**3, dtype=np.int32)
    place[kinds] = np.arange(1, len(kinds) + 1)
    part = rows(windows)
    norm, out = norms(part), np.zeros((len(windows), len(landmarks)))
    for lo in range(0, len(part), 50):
        code, weight = _codes(part[lo : lo + 50])
        at = np.where(weight > 0, place[code], 0)
        i, j = np.nonzero(at)
        if len(i):
            cut = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            out[lo + i[cut]] = np.add.reduceat(dense[at[i, j]] * weight[i, j, None], cut, axis=0)
    return out / norm[:, None]


def contributions(flat: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(SPAN - 2, n): weight of the subsequences that start at each place, by their span."""
    out = np.zeros((SPAN - 2, len(flat)), dtype=np.float32)
    head = flat * SYMBOLS
    pair = [None] + [(head[: len(flat) - a] + flat[a:]) * SYMBOLS for a in range(1, SPAN - 1)]
    for a, b in _STEPS:
        n = len(flat) - b
        if n > 0:
            out[b - 2, :n] += np.take(table, pair[a][:n] + flat[b:])
    for b in range(2, SPAN):
        out[b - 2] *= DECAY ** (b + 1) / FULL
    return out


def decisions(flat: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Weight of the window that starts at each place; windows reach to the end of ``flat``."""
    out = np.zeros(len(flat), dtype=np.float32)
    for lo in range(0, len(flat), _CHUNK):
        part = flat[lo : lo + _CHUNK + WINDOW]
        n = min(_CHUNK, len(flat) - lo)
        total = np.zeros(n, dtype=np.float64)
        for k, c in enumerate(contributions(part, table)):
            inside = WINDOW - 2 - k  # places of a window where a span of k + 3 can start
            sums = np.concatenate(([0.0], np.cumsum(c, dtype=np.float64)))
            start = np.arange(n)
            total += sums[np.minimum(start + inside, len(part))] - sums[:n]
        out[lo : lo + n] = total
    return out


def laid(texts: list[str]) -> tuple[str, np.ndarray]:
    """The texts one after another with walls between, and where each begins (and the end)."""
    parts = [plain(t) for t in texts]
    wall = "\0" * WINDOW
    begin = np.concatenate(([0], np.cumsum([len(p) + WINDOW for p in parts], dtype=np.int64)))
    return wall.join(parts) + wall, begin


def worst(texts: list[str], table: np.ndarray, floor: float) -> tuple[np.ndarray, list[str | None]]:
    """Each text's greatest weight of a window, divided by the window's norm, and the window;
    ``floor`` and none where no window is over it.

    The weight divided by the norm of a full window is a bound from above, so only windows
    whose bound is over the floor need their own norm."""
    value, name = np.full(len(texts), floor), [None] * len(texts)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _CHUNK):
            size += len(texts[hi])
            hi += 1
        line, begin = laid(texts[lo:hi])
        flat = symbols(line)
        bound = decisions(flat, table)
        at = np.flatnonzero(bound[: max(0, len(flat) - WINDOW)] > floor)
        exact = np.empty(len(at))
        for k in range(0, len(at), _CHUNK // 8):
            part = at[k : k + _CHUNK // 8]
            exact[k : k + len(part)] = bound[part] * (FULL / norms(flat[part[:, None] + np.arange(WINDOW)]))
        of = np.searchsorted(begin, at + (WINDOW - 1), side="right") - 1  # a window in the wall reaches the next text
        order = np.lexsort((at, -exact, of))
        first = order[np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1])))] if len(at) else order
        for k in first.tolist():
            if exact[k] > floor:
                value[lo + of[k]] = exact[k]
                name[lo + of[k]] = line[at[k] : at[k] + WINDOW].replace("\0", " ").strip()
        lo = hi
    return value, name


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Linear support vector machine with squared hinge, by Newton's method; the last
    column of x is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        gap = 1 - y * (x @ w)
        act = gap > 0
        grad = ridge * w - 2 * x[act].T @ (cost[act] * y[act] * gap[act])
        hess = ridge * np.eye(len(w)) + 2 * (x[act] * cost[act, None]).T @ x[act]
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, classes weighted equally, slightly ridged."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    target = np.where(y > 0, 0.999, 0.001)
    a = np.zeros(2)
    z = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -40, 40)))
        grad = z.T @ (weight * (p - target)) + 1e-5 * a
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-5 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a -= np.clip(step, -5, 5)
    return float(a[0]), float(a[1])


class Model:
    """table: weights over triples; bias; floor: the least value told apart, the margin of
    clean windows; slope and offset of the curve."""

    def __init__(self, table: np.ndarray, bias: float, floor: float, slope: float, offset: float):
        self.floor = floor
        self.table, self.bias, self.slope, self.offset = table.astype(np.float32), bias, slope, offset

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (value + self.bias) + self.offset, -40, 40)))


def odds(flat: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """First table: log odds of subsequences by their weight in toxic and clean sentences."""
    sums = np.zeros((2, SYMBOLS**3))
    for a, b in _STEPS:
        counts = np.zeros((2, SYMBOLS**3), dtype=np.int64)
        for lo in range(0, len(flat) - b, _CHUNK):
            n = min(_CHUNK, len(flat) - b - lo)
            x, y, z = (flat[lo + k : lo + k + n].astype(np.int64) for k in (0, a, b))
            code = (x * SYMBOLS + y) * SYMBOLS + z
            ok = (x != _WALL) & (y != _WALL) & (z != _WALL)
            for label in (0, 1):
                counts[label] += np.bincount(code[ok & (toxic[lo : lo + n] == label)], minlength=SYMBOLS**3)
        for label in (0, 1):
            sums[label] += DECAY ** (b + 1) * counts[label]
    share = sums.sum(axis=0) / max(sums.sum(), 1e-9)
    smooth = 200.0 * SYMBOLS * share + 1e-9
    rate = [(s + smooth) / max(s.sum() + smooth.sum(), 1e-9) for s in sums]
    table = np.log(rate[1] / rate[0])
    table[sums.sum(axis=0) == 0] = 0
    return table


def _tops(flat: np.ndarray, bound: np.ndarray, edge: list[tuple[int, int]], count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, weight) of the ``count`` windows of each text with the greatest bounds that
    do not overlap, by their own norms."""
    who, at = [], []
    for k, (a, z) in enumerate(edge):
        part = bound[a:z].copy()
        for _ in range(count):
            if not len(part):
                break
            j = int(part.argmax())
            if part[j] == -np.inf:
                break
            who.append(k)
            at.append(a + j)
            part[max(0, j - WINDOW + 1) : j + WINDOW] = -np.inf
    who, at = np.array(who, dtype=np.int64), np.array(at, dtype=np.int64)
    return who, at, bound[at] * (FULL / norms(flat[at[:, None] + np.arange(WINDOW)]))


def _several(rng: np.random.Generator, items: list, most: int) -> list:
    if len(items) <= most:
        return list(items)
    return [items[k] for k in sorted(rng.choice(len(items), most, replace=False).tolist())]


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS) -> Model | None:
    """Fit on labelled texts; None without both classes."""
    y = np.array(labels)
    if not (y > 0).any() or not (y == 0).any():
        return None
    line, begin = laid(texts)
    flat = symbols(line)
    edge = [(int(begin[k]), int(begin[k + 1]) - WINDOW) for k in range(len(texts))]
    owner = np.repeat((y > 0).astype(np.int8), np.diff(begin))
    table, bias = odds(flat, owner[: len(flat)]), 0.0
    rng = np.random.default_rng(0)
    window = lambda at: line[at : at + WINDOW].strip("\0").split("\0")[0]
    calm = [k for k in range(len(texts)) if y[k] == 0 and edge[k][1] > edge[k][0]]
    negative: dict[str, None] = {}
    for k in _several(rng, calm * max(1, SAMPLE // max(1, len(calm))), SAMPLE):
        negative[window(int(rng.integers(*edge[k])))] = None
    for turn in range(rounds):
        who, at, value = _tops(flat, decisions(flat, table), edge, WITNESSES)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, who, value)
        limit = float(np.quantile(best[y == 0], CALM))
        toxic = y[who] > 0
        chosen = np.flatnonzero(toxic & (value > limit))
        if not len(chosen):
            chosen = np.flatnonzero(toxic & (value == best[who]))
        positive = _several(rng, [window(k) for k in at[chosen].tolist()], SAMPLE)
        hard = np.flatnonzero(~toxic)
        hard = hard[np.argsort(-value[hard], kind="stable")][:SAMPLE]
        negative |= dict.fromkeys(window(k) for k in at[hard].tolist())
        against = list(negative)[-2 * SAMPLE :]
        marks = [m for m in dict.fromkeys([*_several(rng, sorted(set(positive)), LANDMARKS * 2 // 3), *_several(rng, against[::-1], LANDMARKS // 3)]) if len(m) >= 3]
        if not marks or not positive:
            return None
        own = rows(marks)
        norm = norms(own, 1e-12)
        kmm = gram(marks, marks) * (norms(own) / norm)[:, None]
        root_value, vector = np.linalg.eigh((kmm + kmm.T) / 2)
        root = vector / np.sqrt(np.maximum(root_value, 1e-3))
        x = gram(positive + against, marks) @ root
        x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        sign = np.concatenate([np.ones(len(positive)), -np.ones(len(against))])
        cost = np.where(sign > 0, min(10.0, max(1.0, len(against) / len(positive))), 1.0)
        w = svm(x, sign, cost)
        table, bias = np.zeros(SYMBOLS**3), float(w[-1])
        code, weight = _codes(own)
        np.add.at(table, code, weight * ((root @ w[:-1]) / norm)[:, None])
    floor = -1.0 - bias
    best, _ = worst(texts, table, floor)
    # a toxic text without a witness tells nothing about the border
    told = (y == 0) | (best > max(float(np.quantile(best[y == 0], CALM)), floor))
    told = told if (y[told] > 0).any() else np.ones(len(y), dtype=bool)
    return Model(table, bias, floor, *logistic((best + bias)[told], y[told]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model | None:
    """Train on at most ``max_rows`` labelled texts and ``max_bytes`` bytes of each class, the
    first by hash of id among the labelled ids that ``docs`` holds; rows that repeat an id
    and a text count once."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.xxhash64(text_col).alias("_h"))
    held = common.materialise(texts.where("_id is not null").select("_id", "_h", F.coalesce(F.octet_length("_t"), F.lit(0)).alias("_n")).distinct().join(marked, "_id"), "toxicity-labelled")
    chosen = []
    for y in (0, 1):
        room = max_bytes
        for r in held.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id", "_h").limit(max_rows).collect():
            if room <= 0 or (r["_n"] > room and room < max_bytes):
                break
            room -= r["_n"]
            chosen.append((r["_id"], r["_h"], y))
    common.discard(held)
    if not chosen:
        return None
    kind = docs.schema[id_col].dataType.simpleString()
    keys = docs.sparkSession.createDataFrame(chosen, f"_id {kind}, _h long, _y int")
    got = texts.join(F.broadcast(keys), ["_id", "_h"]).dropDuplicates(["_id", "_h"]).select("_y", "_id", "_h", "_t").collect()
    got.sort(key=lambda r: (r["_y"], r["_h"], str(r["_id"])))
    return train([r["_t"] or "" for r in got], [r["_y"] for r in got])


def score_batches(model: Model | None, column: int, extend):
    """A mapInArrow function: ``extend(batch, score, worst window)`` makes each output batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.kept("toxicity")
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                if model is None:
                    yield extend(batch, np.zeros(batch.num_rows), [None] * batch.num_rows)
                    continue
                value, window = worst([x or "" for x in batch.column(column).to_pylist()], model.table, model.floor)
                yield extend(batch, model.probability(value), window)

    return run


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, worst) for each row: worst is the window that decided."""
    kind = docs.schema[id_col].dataType.simpleString()

    def extend(batch: pa.RecordBatch, p: np.ndarray, window: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(window, pa.string())], names=["doc_id", "score", "worst"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score_batches(model, 1, extend), f"doc_id {kind}, score double, worst string")
