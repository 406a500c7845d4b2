"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams (1 to 3 letters of words
padded with a blank), by rank; ties go to the smaller n-gram.  A text is ranked the
same way, and the out-of-place distance adds, for each n-gram of the text, how far its
rank is from the rank in the profile (``top`` where the profile lacks it).  The nearest
profile wins; ties go to the smaller name.

An n-gram of at most three code points is one exact 63-bit integer, so counting is array
work.  Training counts are added within a task before they are shuffled.  Profiles are
``top`` rows for each language: bounded, given ``max_languages``, beyond which the fit
raises an error.

Texts that are null or have no letter give ``und`` with score 0, and so does every text
where nothing could be learned.  Null languages are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import common

TOP = 400
MAX_LANGUAGES = 2000
_CELLS = 4_000_000
_BLANK = 0x20


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of each padded word, and the place of the word of each."""
    line = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    of = np.cumsum(line == _BLANK) - 1  # a blank belongs to the word after it
    one = line != _BLANK
    two = np.ones(len(line) - 1, dtype=bool)
    mid = one[1:-1]
    gram = [line[one], (line[:-1] << 21 | line[1:])[two], (line[:-2] << 42 | line[1:-1] << 21 | line[2:])[mid]]
    word = [of[one], of[:-1][two], of[1:-1][mid]]
    return np.concatenate(gram), np.concatenate(word)


def _count(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, distinct n-grams sorted, counts as a texts x n-grams array)."""
    import regex

    letters = regex.compile(r"\p{L}+")
    for lo in range(0, len(texts), 256):
        split = [letters.findall(t.lower()) for t in texts[lo : lo + 256]]
        names: dict[str, int] = {}
        pair = np.concatenate([np.fromiter((names.setdefault(w, len(names)) for w in ws), dtype=np.int64, count=len(ws)) + (k << 32) for k, ws in enumerate(split)] or [np.zeros(0, np.int64)])
        if not names:
            yield lo, np.zeros(0, np.int64), np.zeros((len(split), 0))
            continue
        pair, times = np.unique(pair, return_counts=True)
        doc, word = pair >> 32, pair & 0xFFFFFFFF
        gram, of = _grams(list(names))
        kinds, place = np.unique(gram, return_inverse=True)
        order = np.argsort(of, kind="stable")
        place, first = place[order], np.searchsorted(of[order], np.arange(len(names) + 1))
        step = max(1, _CELLS // len(kinds))
        for a in range(0, len(split), step):
            b = min(len(split), a + step)
            i, j = np.searchsorted(doc, (a, b))
            n = (first[1:] - first[:-1])[word[i:j]]
            at = np.repeat(first[:-1][word[i:j]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            cell = np.repeat(doc[i:j] - a, n) * len(kinds) + place[at]
            yield lo + a, kinds, np.bincount(cell, weights=np.repeat(times[i:j], n), minlength=(b - a) * len(kinds)).reshape(b - a, len(kinds))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush(lang: str) -> pa.RecordBatch:
        gram, n = sums.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        texts = [x or "" for x in batch.column(0).to_pylist()]
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            gram, n = sums.get(lang, (np.zeros(0, np.int64), np.zeros(0)))
            parts = [(gram, n)] + [(kinds, counts.sum(axis=0)) for _, kinds, counts in _count(own)]
            gram, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            sums[lang] = gram, np.bincount(place, weights=np.concatenate([p[1] for p in parts]), minlength=len(gram))
            if len(gram) > 500_000:
                yield flush(lang)
    for lang in list(sums):
        yield flush(lang)


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, gram, rank): the ``top`` n-grams of each language, rank from 0."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(_learn, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < top).select("lang", "gram", "rank")


def _ranked(counts: np.ndarray, top: int) -> np.ndarray:
    """Places of the most frequent n-grams of each row, -1 beyond the row's own."""
    kinds = counts.shape[1]
    width = min(top, kinds)
    key = counts * kinds + (kinds - 1 - np.arange(kinds))  # ties: the smaller n-gram first
    at = np.argpartition(-key, width - 1, axis=1)[:, :width] if width < kinds else np.tile(np.arange(kinds), (len(counts), 1))
    at = np.take_along_axis(at, np.argsort(-np.take_along_axis(key, at, axis=1), axis=1), axis=1)
    return np.where(np.take_along_axis(counts, at, axis=1) > 0, at, -1)


def predict(docs: DataFrame, learned: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """(doc_id, lang_pred, score) for each row.  The score is the winner's share of the
    nearness (largest possible distance less the distance) of all profiles."""
    rows = learned.limit(max_languages * top + 1).collect()
    langs = sorted({r["lang"] for r in rows})
    if len(langs) > max_languages or len(rows) > max_languages * top:
        raise ValueError(f"more than {max_languages} languages")
    known = np.unique(np.array([r["gram"] for r in rows], dtype=np.int64))
    ranks = np.full((len(langs), len(known) + 1), top, dtype=np.int32)
    for r in rows:
        ranks[langs.index(r["lang"]), np.searchsorted(known, r["gram"])] = r["rank"]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["und"] * batch.num_rows
            score = np.zeros(batch.num_rows)
            for lo, kinds, counts in _count([x or "" for x in batch.column(1).to_pylist()]):
                if not langs or not len(kinds):
                    continue
                place = np.minimum(np.searchsorted(known, kinds), len(known) - 1)
                place = np.where(known[place] == kinds, place, len(known))
                at = _ranked(counts, top)
                own = np.arange(at.shape[1])
                far = np.zeros((len(at), len(langs)))
                for k in range(len(langs)):
                    r = ranks[k][place[at]]
                    far[:, k] = np.where(at >= 0, np.where(r == top, top, np.abs(r - own)), 0).sum(axis=1)
                n = (at >= 0).sum(axis=1)
                best = far.argmin(axis=1)
                near = n[:, None] * top - far
                share = near[np.arange(len(at)), best] / np.maximum(near.sum(axis=1), 1)
                for i in np.flatnonzero(n > 0):
                    names[lo + i] = langs[best[i]]
                    score[lo + i] = share[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
