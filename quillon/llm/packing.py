"""Best-fit packing by the linear grouping scheme.

Documents become token sequences, sequences longer than the capacity are cut, and
the pieces are packed into as few bins as possible:

1. *Histogram.*  Piece lengths are integers of 1..capacity, so the whole instance
   is a table of at most ``capacity`` counts whatever the size of the corpus.  Only
   this bounded table reaches the driver.
2. *Linear grouping.*  Large lengths, sorted descending, are cut into groups of
   equal cardinality, and every length is rounded up to the largest of its group.
3. *Configurations.*  The few rounded sizes give a covering linear program over
   bin configurations, solved by column generation; its rounded-down solution says
   how often each configuration is used.
4. *Substitution.*  Actual pieces take the slots of their group, largest first.
5. *Best fit.*  What is left over, then the small lengths, go where they leave the
   least room, whole runs of equal bins at a time.

The plan is a list of runs ("pieces of length s with rank in [a, b) go to bins
n, n+1, ... at offset o"); pieces find their run by their rank within their length.
Ranks come from counts per (length, hash bucket), so a length that holds a third
of all pieces is ranked by many tasks.

Null and empty texts are the end token alone (one piece of length 1).  Rows repeated
in the input are packed once each.  An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import common

CAPACITY = 2048
END_ID = 0
#: Texts of these characters take the path with a cache of words.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \u0085 "
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_CACHE_WORDS = 600_000
_CACHE_CHARS = 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases, drops white space and encodes each word alone, each
    word ending in a token that carries the word-end mark.  A text of Latin-1
    characters is cut into words here and each word is encoded once per cache;
    any other text, or one that spells a special token, goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for piece, i in vocab.items():
            self.ends[i] = piece.endswith("</w>")
        self.special = [str(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words by one call: the word-end tokens cut the result."""
        ids = np.array(self.tok.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):  # a word without an end mark: one by one
            return {w: self.whole(w) for w in words}
        raw, at, out = ids.tobytes(), 0, {}
        for w, end in zip(words, (cuts * 4).tolist(), strict=True):
            out[w] = raw[at:end]
            at = end
        return out

    def __call__(self, batch: list[str]) -> list[bytes]:
        cut: list[list[str] | None] = []
        for text in batch:
            try:
                text.isascii() or text.encode("latin-1")
            except UnicodeEncodeError:
                plain = False
            else:
                plain = not any(s in text for s in self.special)
            cut.append(_PIECE.findall(text.lower()) if plain else None)
        if len(self.cache) > _CACHE_WORDS:
            self.cache.clear()
        new = list(set().union(*(c for c in cut if c)).difference(self.cache))  # walks the words, not the cache
        long = {}
        for at in range(0, len(new), 2000):
            long |= self._words(new[at : at + 2000])
        self.cache.update((w, b) for w, b in long.items() if len(w) <= _CACHE_CHARS)
        long = {w: b for w, b in long.items() if len(w) > _CACHE_CHARS}
        get = self.cache.__getitem__
        find = get if not long else lambda w: long[w] if len(w) > _CACHE_CHARS else get(w)
        return [self.whole(t) if c is None else b"".join(map(find, c)) for t, c in zip(batch, cut, strict=True)]


def encoder(path: str) -> WordEncoder:
    """The encoder of a file; later tasks of a worker find its words encoded, until the worker
    takes up another operator."""
    held = os.stat(path)
    key = (path, held.st_mtime_ns, held.st_size)
    encoders = common.kept("packing")
    if key not in encoders:
        encoders.clear()
        encoders[key] = WordEncoder(path)
    return encoders[key]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id,
    cut where they exceed the capacity."""
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), END_ID.to_bytes(4, "little")
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                take, no, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(encode([x or "" for x in batch.column(1).to_pylist()])):
                    ids += end
                    for n, s in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[s : s + 4 * capacity]
                        take.append(k)
                        no.append(n)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(take)), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    )


# ---- the plan, on the driver: its input has at most `capacity` rows -------------


def _price(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration: an unbounded knapsack over the capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        worth = best[c - sizes[fits]] + value[fits]
        k = int(worth.argmax())
        if worth[k] > best[c - 1] + 1e-12:
            best[c], last[c] = worth[k], fits[k]
        else:
            best[c] = best[c - 1]
    config, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0 or best[c] == best[c - 1]:
            c -= 1
            continue
        config[last[c]] += 1
        c -= int(sizes[last[c]])
    return float(best[capacity]), config


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Covering program over bin configurations by column generation; rounded down."""
    m = len(sizes)
    if not m:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    x = counts / np.diag(basis)
    for _ in range(rounds):
        dual = np.maximum(np.linalg.solve(basis.T, np.ones(m)), 0)
        worth, config = _price(sizes, dual, capacity)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, config)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        move = max(0.0, ratio[leave])
        x = np.maximum(x - move * step, 0)
        x[leave] = move
        basis[:, leave] = config
    return [(basis[:, k].astype(int), int(x[k] + 1e-9)) for k in range(m) if x[k] >= 1]


class Run:
    """``count`` equal bins: the room left, and (length, first rank, offset) slots."""

    __slots__ = ("count", "room", "slots")

    def __init__(self, count: int, room: int, slots: list):
        self.count, self.room, self.slots = count, room, slots

    def split(self, n: int) -> "Run":
        """Take the first n bins away as a run of their own."""
        head = Run(n, self.room, list(self.slots))
        self.slots = [(s, r + n, o) for s, r, o in self.slots]
        self.count -= n
        return head


def _groups(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Cut the descending (length, count) list into groups of equal cardinality."""
    total = sum(n for _, n in large)
    each = max(1, -(-total // groups))
    out, now, room = [], [], each
    for s, n in large:
        while n:
            k = min(n, room)
            now.append((s, k))
            n -= k
            room -= k
            if not room:
                out.append(now)
                now, room = [], each
    if now:
        out.append(now)
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 64, small: float = 0.45) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset) that pack everything.

    ``groups`` bounds the number of rounded sizes; lengths of at most
    ``small * capacity`` are left to the last step.
    """
    limit = int(small * capacity)
    left = {s: n for s, n in histogram.items() if n > 0}
    rank = dict.fromkeys(left, 0)
    done: list[Run] = []
    if n := left.pop(capacity, 0):
        done.append(Run(n, 0, [(capacity, 0, 0)]))
    large = sorted(((s, n) for s, n in left.items() if s > limit), reverse=True)
    cut = _groups(large, groups)
    by_size: dict[int, list[list[int]]] = {}
    for g in cut:  # groups that round to one size are one size
        by_size.setdefault(g[0][0], []).extend([s, n] for s, n in g)
    sizes = np.array(sorted(by_size, reverse=True), dtype=int)
    counts = np.array([sum(n for _, n in by_size[int(s)]) for s in sizes], dtype=float)
    runs: list[Run] = []
    for config, times in sorted(configurations(sizes, counts, capacity), key=lambda c: -float(c[0] @ sizes)):
        while times > 0:
            slots, need = [], [(int(s), int(k)) for s, k in zip(sizes, config, strict=True) if k]
            t, short = times, False
            picks: list[list[int]] = []
            for s, k in need:
                stock = by_size[s]
                for _ in range(k):
                    while stock and stock[0][1] == 0:
                        stock.pop(0)
                    if not stock:
                        short = True
                        break
                    # slots of one bin that draw from one length share its stock
                    picks.append(stock[0])
                if short:
                    break
            if short:
                break
            for entry in {id(p): p for p in picks}.values():
                t = min(t, entry[1] // sum(p is entry for p in picks))
            if t == 0:  # the stock of one length ends inside a bin: this bin mixes lengths
                t, picks, undo = 1, [], []
                for s, k in need:
                    for _ in range(k):
                        stock = [e for e in by_size[s] if e[1] > 0]
                        if not stock:
                            short = True
                            break
                        stock[0][1] -= 1
                        undo.append(stock[0])
                        picks.append(stock[0])
                for e in undo:
                    e[1] += 1
                if short:
                    break
            at = 0
            for entry in picks:
                s = entry[0]
                slots.append((s, rank[s], at))
                rank[s] += t
                left[s] -= t
                entry[1] -= t
                at += s
            runs.append(Run(t, capacity - at, slots))
            times -= t
    # best fit: what the rounded-down program left over, then the small lengths
    rooms: dict[int, list[Run]] = {}

    def keep(run: Run) -> None:
        if run.room <= 0:
            done.append(run)
            return
        rooms.setdefault(run.room, []).append(run)

    for run in runs:
        keep(run)
    for s in sorted((s for s, n in left.items() if n > 0), reverse=True):
        n = left[s]
        while n:
            fit = min((r for r, x in rooms.items() if r >= s and x), default=None)
            if fit is None:
                t = -(-n // (capacity // s))
                run = Run(t, capacity, [])
            else:
                run = rooms[fit].pop()
                if not rooms[fit]:
                    del rooms[fit]
            each = min(run.room // s, -(-n // run.count)) if n >= run.count else 1
            if n < run.count:
                head = run.split(n)
                keep(run)
                run = head
            each = max(1, min(each, n // run.count))
            for _ in range(each):
                run.slots.append((s, rank[s], capacity - run.room))
                rank[s] += run.count
                run.room -= s
                n -= run.count
            keep(run)
    done += [r for x in rooms.values() for r in x]
    out, first = [], 0
    for run in done:
        out += [(s, r, run.count, first, o) for s, r, o in run.slots]
        first += run.count
    return out


# ---- assignment -------------------------------------------------------------------


def pack(parts: DataFrame, capacity: int = CAPACITY, groups: int = 64, small: float = 0.45, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32"), rows_per_bucket: int = 1_000_000) -> DataFrame:
    """``parts`` (one row for each piece, with ``length`` of 1..capacity) and
    ``sequence_id``, ``offset``.  ``parts`` must be a written table: it is read again."""
    spark = parts.sparkSession
    total = parts.count()
    buckets = max(8, -(-total // rows_per_bucket))
    keyed = parts.withColumn("_b", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", "_b").count()
    ahead = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = common.materialise(counts.withColumn("_ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0))), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs = plan(histogram, capacity, groups, small)
    runs.sort()
    shift = 1 << 40
    key = np.array([s * shift + r for s, r, *_ in runs] or [0], dtype=np.int64)
    number = np.array([r[2] for r in runs] or [0], dtype=np.int64)
    first = np.array([r[3] for r in runs] or [0], dtype=np.int64)
    offset = np.array([r[4] for r in runs] or [0], dtype=np.int64)

    def find(where: pd.Series) -> pd.DataFrame:
        w = where.to_numpy()
        k = np.searchsorted(key, w, side="right") - 1
        inside = w - key[k]
        if len(w) and ((k < 0) | (inside >= number[k])).any():
            raise ValueError("a piece outside the plan: its table changed while it was packed")
        return pd.DataFrame({"sequence_id": first[k] + inside, "offset": offset[k]})

    find_udf = F.pandas_udf(find, "sequence_id long, offset long")
    inner = Window.partitionBy("length", "_b").orderBy(*order)
    ranked = keyed.withColumn("_r", F.row_number().over(inner) - 1).join(counts.select("length", "_b", "_ahead"), ["length", "_b"])
    where: Column = F.col("length") * F.lit(shift) + F.col("_ahead") + F.col("_r")
    placed = ranked.withColumn("_p", find_udf(where))
    return placed.select(*parts.columns, F.col("_p.sequence_id").alias("sequence_id"), F.col("_p.offset").alias("offset"))


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(common.materialise(pieces(docs, id_col, text_col, tokenizer, capacity), "pieces"), capacity)
