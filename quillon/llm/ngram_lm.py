"""Language-model scoring with a weighted backoff automaton.

*Model.*  Words and one end token; texts begin with ``order - 1`` start marks.  The unigram
estimate is ``P(w) = (c(w) + 1) / (N + V + 1)``.  After a history h seen in training a word
seen after it has ``P(w | h) = (c(h w) - discount) / c(h)``; the mass that the discounts
free goes to the other words in proportion to the shorter history g:
``P(w | h) = a(h) * P(w | g)`` with ``a(h) = discount * T(h) / c(h) / (1 - S(h))``, where
T(h) counts the distinct words seen after h and S(h) is the sum of their ``P(. | g)``.
All next words, the unseen one included, sum to one.

*Automaton.*  A state is a history seen in training (the empty one too).  Its arcs are the
words seen after it, with ``log10 P``, and lead to the longest suffix of the words read
that is a state; its failure arc consumes nothing, weighs ``log10 a(h)`` and leads to the
history without its first word.  The empty history has an arc for every word.  A text is
read once from left to right: the machine follows the arc of the next word, or failure
arcs until there is one, carries its state on and adds the weights up.  All texts of a
block are read in step.  Texts over ``SEGMENT`` tokens are read in segments, each after the
``order - 1`` words before it: a state depends on no more than these.

*Scale.*  The automaton of the corpus never sits in one place.  Texts are gathered into
blocks of bounded size where they are read and stay there, as token numbers in a bucketed
table.  Blocks exchange packed sorted hashes with the owners of hash ranges
(:mod:`quillon.llm.exchange`): first counts of n-grams, then T and S of histories, to
which each distinct n-gram contributes once (one block is told to speak for it).  A block
then holds the states and arcs that its texts can reach, bounded by its own size.

Hashes have 64 bits; two n-grams of one order with one hash would be counted together.
Null and empty texts are the end token alone; an empty table gives an empty result;
repeated rows are scored (and counted) once each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common, exchange

ORDER = 2
DISCOUNT = 0.5
BLOCK_BYTES = 12 << 20
SEGMENT = 2048
_START, _END = 0, 1  # local numbers; neither name can be a word, since no word holds white space
_NAMES = [b"\t", b"\n"]
_TOTAL = ["<u8", "?"]


class Grams:
    """The distinct n-grams of a block's token numbers, sizes 1 to ``order``.

    For each size: ``history`` (number of the n-gram without its last word, among those
    one shorter), ``last`` (its last word), ``suffix`` (number without its first word),
    ``hash``, ``place`` (number of the n-gram that ends at each token, -1 where the text
    is too short) and ``rank`` (order of the hashes)."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray, names: np.ndarray, order: int):
        self.ids, self.lens, self.names, self.order = ids, lens, names, order
        self.stop = np.cumsum(lens)
        self.into = np.arange(len(ids), dtype=np.int32) - np.repeat((self.stop - lens).astype(np.int32), lens)
        width = len(names)
        zero = np.zeros(width, dtype=np.int32)
        self.history, self.last, self.suffix, self.hash, self.place = [zero], [np.arange(width, dtype=np.int32)], [zero], [names], [ids.astype(np.int32, copy=False)]
        with np.errstate(over="ignore"):
            for n in range(2, order + 1):
                at = np.flatnonzero(self.into >= n - 1).astype(np.int32)
                code = self.place[-1][at - 1].astype(np.int64)
                code *= width
                code += ids[at]
                by = np.argsort(code, kind="stable").astype(np.int32)
                code = code[by]
                fresh = np.ones(len(code), dtype=bool)
                np.not_equal(code[1:], code[:-1], out=fresh[1:])
                kinds, first = code[fresh], by[fresh]
                del code
                number = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
                place = np.full(len(ids), -1, dtype=np.int32)
                place[at[by]] = number
                self.history.append((kinds // width).astype(np.int32))
                self.last.append((kinds % width).astype(np.int32))
                self.suffix.append(self.place[n - 2][at[first]])
                self.place.append(place)
                del at, by, fresh, kinds, first, number
                self.hash.append(common.mix(self.hash[-1][self.history[-1]] * np.uint64(0x9E3779B97F4A7C15) + names[self.last[-1]] + np.uint64(n)))
        self.rank = [np.argsort(h, kind="stable").astype(np.int32) for h in self.hash]

    def counts(self, which: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram ends at the tokens of ``which``; of the start marks of a text
        only the last counts, so that a history counts what follows it."""
        which = which & (self.into >= self.order - 2)
        return [np.bincount(p[which & (p >= 0)], minlength=len(h)) for p, h in zip(self.place, self.hash, strict=True)]


class Weights:
    """Arc and failure weights from totals: ``c`` counts of the n-grams of each size."""

    def __init__(self, grams: Grams, c: list[np.ndarray], n: int, v: int, discount: float):
        self.grams, self.c, self.discount = grams, [x.astype(np.float64) for x in c], discount
        self.arc = [(self.c[0] + 1.0) / (n + v + 1.0)]
        for k in range(1, grams.order):
            self.arc.append((self.c[k] - discount) / np.maximum(self.c[k - 1][grams.history[k]], 1))

    def following(self, size: int, speaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """T and S of each history of ``size`` words, from the n-grams that this block speaks for."""
        own = np.flatnonzero(speaks & (self.c[size] > 0) & (self.grams.last[size] != _START))
        of, shorter = self.grams.history[size][own], self.arc[size - 1][self.grams.suffix[size][own]]
        m = len(self.c[size - 1])
        return np.bincount(of, minlength=m).astype(np.uint32), np.bincount(of, weights=shorter, minlength=m)


class Automaton:
    """States and arcs that one block can reach.

    ``spare[m - 1]`` holds T / (1 - S) of each history of m words."""

    def __init__(self, weights: Weights, spare: list[np.ndarray]):
        g, order, c = weights.grams, weights.grams.order, weights.c
        width = len(g.names)
        # the empty history is state 0; a history of m words that was seen has the next number
        number = [np.zeros(1, dtype=np.int64)]
        failure, weight = [np.zeros(1, dtype=np.int64)], [np.zeros(1)]
        size = 1
        for m in range(1, order):
            seen = (c[m - 1] > 0) & (spare[m - 1] > 0)
            shorter = number[0][np.zeros(len(seen), dtype=np.int64)] if m == 1 else number[m - 1][g.suffix[m - 1]]
            own = shorter.copy()  # a history that was not seen is its longest seen suffix
            own[seen] = size + np.arange(int(seen.sum()))
            size += int(seen.sum())
            number.append(own)
            failure.append(shorter[seen])
            weight.append(np.log10(weights.discount * spare[m - 1][seen] / c[m - 1][seen]))
        self.failure, self.weight = np.concatenate(failure), np.concatenate(weight)
        code, value, to = [], [], []
        for n in range(1, order + 1):
            ok = np.ones(width, dtype=bool) if n == 1 else c[n - 1] > 0
            of = np.zeros(int(ok.sum()), dtype=np.int64) if n == 1 else number[n - 1][g.history[n - 1][ok]]
            # the longest state that the words read end with
            reach = number[n][np.flatnonzero(ok)] if n < order else (number[n - 1][g.suffix[n - 1][ok]] if n > 1 else np.zeros(width, dtype=np.int64))
            code.append(of * width + g.last[n - 1][ok])
            value.append(np.log10(weights.arc[n - 1][ok]))
            to.append(reach.astype(np.int32))
        code = np.concatenate(code)
        order_ = np.argsort(code, kind="stable").astype(np.int32)
        self.code, self.value, self.to, self.width = code[order_], np.concatenate(value)[order_], np.concatenate(to)[order_], width

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and log10 probabilities of one word for each of many readers."""
        total = np.zeros(len(state))
        state = state.astype(np.int64)  # codes of arcs exceed 32 bits
        left = np.arange(len(state))
        arc = np.empty(len(state), dtype=np.int64)
        while len(left):
            want = state[left] * self.width + word[left]
            at = np.minimum(np.searchsorted(self.code, want), len(self.code) - 1)
            hit = self.code[at] == want
            arc[left[hit]] = at[hit]
            left = left[~hit]
            total[left] += self.weight[state[left]]
            state[left] = self.failure[state[left]]
        return self.to[arc], total + self.value[arc]

    def read(self, ids: np.ndarray, lens: np.ndarray, order: int, segment: int = SEGMENT) -> np.ndarray:
        """log10 probability of each text: start marks set the state, the rest is scored."""
        begin = np.cumsum(lens) - lens
        first = begin + order - 1  # the first scored token
        pieces = -(-(lens - (order - 1)) // segment)
        text = np.repeat(np.arange(len(lens)), pieces)
        part = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = first[text] + part * segment
        stop = np.minimum(start + segment, (begin + lens)[text])
        size = stop - start
        by = np.argsort(-size, kind="stable")
        start, size, text = start[by], size[by], text[by]
        state, score = np.zeros(len(start), dtype=np.int64), np.zeros(len(start))
        for back in range(order - 1, 0, -1):  # the words before a segment set its state
            state, _ = self.step(state, ids[start - back].astype(np.int64))
        active = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")
        for t, n in enumerate(active.tolist()):
            state[:n], more = self.step(state[:n], ids[start[:n] + t].astype(np.int64))
            score[:n] += more
        return np.bincount(text, weights=score, minlength=len(lens))


# ---- blocks -------------------------------------------------------------------------------


def _gather(order: int, block_bytes: int):
    """Token numbers of the texts of a partition, in blocks of about ``block_bytes``."""
    import xxhash

    def made(pid: int, serial: int, got: list, names: dict) -> pa.RecordBatch:
        docs, train, lens, ids = zip(*got, strict=True)
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, names), dtype=np.uint64, count=len(names))
        raw = [pa.array([exchange.pack(x)], pa.binary()) for x in (np.array(train, dtype=bool), np.array(lens, dtype=np.int32), np.concatenate(ids), hashed)]
        whole = pa.concat_arrays(docs)
        held = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
        return pa.RecordBatch.from_arrays([pa.array([(pid << 24) + serial], pa.int64()), held, pa.array([len(lens)], pa.int32()), pa.array([sum(lens)], pa.int64()), pa.array([len(names)], pa.int32()), *raw], names=["block", "docs", "texts", "tokens", "width", "train", "lens", "ids", "names"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, serial = TaskContext.get().partitionId(), 0
        got, held = [], 0
        names: dict[bytes, int] = {w: k for k, w in enumerate(_NAMES)}
        for batch in batches:
            train = batch.column(2).to_pylist()
            for k in range(batch.num_rows):
                raw = batch.column(1)[k].as_py() or b""
                words = raw.lower().split()
                ids = np.empty(len(words) + order, dtype=np.int32)
                ids[: order - 1], ids[-1] = _START, _END
                for w in words:
                    if w not in names:
                        names[w] = len(names)
                ids[order - 1 : -1] = np.fromiter(map(names.__getitem__, words), dtype=np.int32, count=len(words))
                got.append((batch.column(0).slice(k, 1), train[k], len(ids), ids))
                held += len(raw) + 64
                if held >= block_bytes:
                    yield made(pid, serial, got, names)
                    got, held, serial = [], 0, serial + 1
                    names = {w: k for k, w in enumerate(_NAMES)}
        if got:
            yield made(pid, serial, got, names)

    return run


def _block(rows: pa.Table, order: int) -> tuple[Grams, np.ndarray]:
    """The n-grams of a stored block, and which of its texts are trained on."""
    one = {c: rows.column(c)[0].as_py() for c in ("texts", "tokens", "width", "train", "lens", "ids", "names")}
    lens = exchange.unpack(one["lens"], "<i4", one["texts"]).astype(np.int64)
    ids, names = exchange.unpack(one["ids"], "<i4", one["tokens"]), exchange.unpack(one["names"], "<u8", one["width"])
    return Grams(ids, lens, names, order), exchange.unpack(one["train"], "?", one["texts"])


def _count(order: int, bits: int, fan: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        grams, train = _block(rows, order)
        out = exchange.Outbox(key[0].as_py(), bits, fan)
        for n, c in enumerate(grams.counts(np.repeat(train, grams.lens))):
            out.send(n + 1, grams.hash[n][grams.rank[n]], [c[grams.rank[n]].astype(np.uint32)])
        return out.table()

    return run


def _total(keys: np.ndarray, counts: np.ndarray):
    """Totals, and which entry speaks for its n-gram."""
    kinds, first, place = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(place, weights=counts, minlength=len(kinds)).astype(np.uint64)
    speaks = np.zeros(len(keys), dtype=bool)
    speaks[first] = True
    return [total[place], speaks], total.sum(), (total > 0).sum()


def _totals(grams: Grams, answers: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    got = exchange.received(answers, {n + 1: _TOTAL for n in range(grams.order)})
    total, speaks = [], []
    for n in range(grams.order):
        c, s = np.empty(len(grams.rank[n]), dtype=np.uint64), np.empty(len(grams.rank[n]), dtype=bool)
        c[grams.rank[n]], s[grams.rank[n]] = got[n + 1]
        total.append(c)
        speaks.append(s)
    return total, speaks


def _follow(order: int, bits: int, fan: int, n: int, v: int, discount: float):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return exchange.Outbox(0, bits, fan).table()
        grams, _ = _block(rows, order)
        total, speaks = _totals(grams, answers)
        weights = Weights(grams, total, n, v, discount)
        out = exchange.Outbox(rows.column("block")[0].as_py(), bits, fan)
        for m in range(1, order):
            t, s = weights.following(m, speaks[m])
            asked = grams.rank[m - 1]
            asked = asked[total[m - 1][asked] > 0]
            out.send(m, grams.hash[m - 1][asked], [t[asked], s[asked]])
        return out.table()

    return run


def _spare(keys: np.ndarray, t: np.ndarray, s: np.ndarray):
    kinds, place = np.unique(keys, return_inverse=True)
    after = np.bincount(place, weights=t, minlength=len(kinds))
    mass = np.bincount(place, weights=s, minlength=len(kinds))
    return [(after / (1 - mass))[place]], 0, 0


def _score(order: int, n: int, v: int, discount: float):
    names = ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        grams, train = _block(rows, order)
        total, speaks = _totals(grams, answers)
        del speaks
        weights = Weights(grams, total, n, v, discount)
        ids = rows.column("docs").combine_chunks().flatten()
        scored = grams.into >= order - 1
        text = np.repeat(np.arange(len(grams.lens)), grams.lens)[scored]
        word = grams.ids[scored]
        known = np.bincount(text, weights=(total[0] > 0)[word], minlength=len(ids)).astype(np.int64)
        base = np.bincount(text, weights=np.log10(weights.arc[0])[word], minlength=len(ids))
        del scored, text, word
        got = exchange.received(answers, {-m: ["<f8"] for m in range(1, order)})
        spare = []
        for m in range(1, order):
            x = np.zeros(len(grams.rank[m - 1]))
            asked = grams.rank[m - 1]
            x[asked[total[m - 1][asked] > 0]] = got[-m][0]
            spare.append(x)
        grams.place = grams.into = grams.hash = grams.rank = None  # what the automaton does not need
        del total, got
        machine = Automaton(weights, spare)
        del weights, spare
        columns = [ids, pa.array(train), pa.array(grams.lens - (order - 1)), pa.array(known), pa.array(np.full(len(ids), n, dtype=np.int64)), pa.array(base), pa.array(machine.read(grams.ids, grams.lens, order))]
        return pa.table(columns, names=names)

    def guarded(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if rows.num_rows:
            return run(rows, answers)
        kind = rows.schema.field("docs").type.value_type
        return pa.table([pa.array([], t) for t in (kind, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)

    return guarded


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, order: int = ORDER, discount: float = DISCOUNT, block_bytes: int = BLOCK_BYTES, fan: int = exchange.FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row;
    rows whose crc32 of the id modulo ``modulus`` is ``held`` are scored but not learned."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), (common.remainder(id_col, modulus) != held).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(common.partitions(spark), -(-size // block_bytes))
    bits = exchange.bits_for(buckets)
    stored = common.bucketed(rows.mapInArrow(_gather(order, block_bytes), f"block long, docs array<{kind}>, texts int, tokens long, width int, train binary, lens binary, ids binary, names binary"), "block", buckets)
    sent = stored.groupBy("block").applyInArrow(_count(order, bits, fan), exchange.MESSAGE)
    answers = common.materialise(exchange.ask(sent, _total, bits, buckets, ["<u4"], fan), "lm-totals")
    starts = stored.select(F.sum("texts")).first()[0] or 0
    trained = rows.agg(F.count_if("train")).first()[0] if order > 1 else 0
    n, v = answers.where("kind = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    # start marks are counted for histories only
    n, v = int(n) - int(trained or 0), int(v) - int(bool(trained))
    totals = exchange.deliver(answers, bits, _TOTAL, fan)
    if order > 1 and starts:
        sent = stored.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_follow(order, bits, fan, n, v, discount), exchange.MESSAGE)
        spare = common.materialise(exchange.ask(sent, _spare, bits, buckets, ["<u4", "<f8"], fan), "lm-spare")
        back = exchange.deliver(spare, bits, ["<f8"], fan).withColumn("kind", -F.col("kind"))
        totals = totals.unionByName(back)
    out = stored.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        _score(order, n, v, discount), f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
