"""Packed exchange between blocks of rows and the owners of hash ranges.

A block holds sorted distinct 64-bit keys with some numbers for each.  It sends them to
the ranges that own them; an owner sees all entries of its range, whatever block they
come from, and answers with numbers in the order received.  A very frequent key is one
entry for each block.

*Routes.*  A block cuts its keys into at most ``2 ** FAN`` messages.  Where more ranges are
needed the blocks of a super-block of about ``2 ** FAN`` blocks first meet, a coarse range
at a time, and their messages are joined and cut again.  So the number of messages is that
of the blocks times a constant, not times the number of ranges; answers go back along the
same way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 10
_NAMES = ["kind", "range", "home", "blocks", "sizes", "keys", "values"]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary())]
MESSAGE = "kind int, range int, home long, blocks array<long>, sizes array<int>, keys binary, values array<binary>"
ANSWER = "kind int, range int, home long, blocks array<long>, sizes array<int>, values array<binary>, total long, distinct long"
_ANSWER_NAMES = ["kind", "range", "home", "blocks", "sizes", "values", "total", "distinct"]
_ANSWER_KINDS = [*_KINDS[:5], _KINDS[6], pa.int64(), pa.int64()]


def pack(a: np.ndarray) -> bytes:
    """Bytes of equal weight together (sorted hashes then compress well); eight flags a byte."""
    if a.dtype == bool:
        return np.packbits(a).tobytes()
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unpack(b: bytes, kind: str, n: int) -> np.ndarray:
    if kind == "?":
        return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel()


def _table(names: list[str], kinds: list, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def bits_for(blocks: int) -> int:
    """Bits of the ranges: about as many ranges as blocks."""
    return max(1, (max(1, blocks) - 1).bit_length())


def _edges(keys: np.ndarray, first: int, count: int, bits: int) -> np.ndarray:
    """Where the ranges ``first`` .. ``first + count`` of ``bits`` bits begin among sorted keys."""
    return np.searchsorted((keys >> np.uint64(64 - bits)).astype(np.int64), first + np.arange(count + 1))


class Outbox:
    """Messages of one block."""

    def __init__(self, block: int, bits: int, fan: int = FAN):
        self.block, self.bits, self.rows = block, min(bits, fan), []

    def send(self, kind: int, keys: np.ndarray, values: list[np.ndarray]) -> None:
        """Sorted keys and the numbers of each."""
        edge = _edges(keys, 0, 1 << self.bits, self.bits)
        for r in np.flatnonzero(np.diff(edge)).tolist():
            part = slice(edge[r], edge[r + 1])
            self.rows.append((kind, r, 0, [self.block], [int(edge[r + 1] - edge[r])], pack(keys[part]), [pack(v[part]) for v in values]))

    def table(self) -> pa.Table:
        return _table(_NAMES, _KINDS, self.rows)


def _resplit(bits: int, fan: int, kinds: list[str]):
    """Join the messages of a super-block for one coarse range and cut them again."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        more = bits - fan
        fine: list[list] = [[[], [], [], [[] for _ in kinds]] for _ in range(1 << more)]
        coarse = group.column("range")[0].as_py()
        for block, size, raw, values in zip(group.column("blocks").to_pylist(), group.column("sizes").to_pylist(), group.column("keys").to_pylist(), group.column("values").to_pylist(), strict=True):
            keys = unpack(raw, "<u8", size[0])
            numbers = [unpack(v, k, size[0]) for v, k in zip(values, kinds, strict=True)]
            edge = _edges(keys, coarse << more, 1 << more, bits)
            for r in np.flatnonzero(np.diff(edge)).tolist():
                part = slice(edge[r], edge[r + 1])
                fine[r][0].append(block[0])
                fine[r][1].append(int(edge[r + 1] - edge[r]))
                fine[r][2].append(keys[part])
                for have, v in zip(fine[r][3], numbers, strict=True):
                    have.append(v[part])
        rows = [(group.column("kind")[0].as_py(), (coarse << more) + r, key[0].as_py(), b, n, pack(np.concatenate(k)), [pack(np.concatenate(v)) for v in vs]) for r, (b, n, k, vs) in enumerate(fine) if b]
        return _table(_NAMES, _KINDS, rows)

    return run


def _own(answer: Callable, kinds: list[str]):
    def run(group: pa.Table) -> pa.Table:
        sizes = [sum(s) for s in group.column("sizes").to_pylist()]
        keys = np.concatenate([unpack(b, "<u8", n) for b, n in zip(group.column("keys").to_pylist(), sizes, strict=True)])
        values = group.column("values").to_pylist()
        numbers = [np.concatenate([unpack(v[c], k, n) for v, n in zip(values, sizes, strict=True)]) for c, k in enumerate(kinds)]
        del values
        out, total, distinct = answer(keys, *numbers)
        at, packed = 0, []
        for n in sizes:
            packed.append([pack(a[at : at + n]) for a in out])
            at += n
        first = [1] + [0] * (len(sizes) - 1)
        told = [pa.array(packed, pa.list_(pa.binary())), pa.array([int(total) * f for f in first], pa.int64()), pa.array([int(distinct) * f for f in first], pa.int64())]
        return pa.table([*(group.column(c) for c in _ANSWER_NAMES[:5]), *told], names=_ANSWER_NAMES)

    return run


def _return(fan_more: int, kinds: list[str]):
    """Answers of a super-block and coarse range, back in one piece for each block."""

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("range").to_numpy(), kind="stable").tolist()
        blocks, sizes, values = (group.column(c).to_pylist() for c in ("blocks", "sizes", "values"))
        got: dict[int, list[list[np.ndarray]]] = {}
        for r in order:
            arrays, at = [unpack(v, k, sum(sizes[r])) for v, k in zip(values[r], kinds, strict=True)], 0
            for b, n in zip(blocks[r], sizes[r], strict=True):
                have = got.setdefault(b, [[] for _ in kinds])
                for have_k, a in zip(have, arrays, strict=True):
                    have_k.append(a[at : at + n])
                at += n
        coarse, kind = group.column("range")[0].as_py() >> fan_more, group.column("kind")[0].as_py()
        rows = [(kind, coarse, 0, [b], [sum(map(len, v[0]))], [pack(np.concatenate(a)) for a in v], 0, 0) for b, v in got.items()]
        return _table(_ANSWER_NAMES, _ANSWER_KINDS, rows)

    return run


def ask(sent: DataFrame, answer: Callable, bits: int, blocks: int, sent_kinds: list[str], fan: int = FAN) -> DataFrame:
    """Answers (the columns of ``ANSWER``) of the owners to messages of :class:`Outbox`.

    ``answer(keys, *numbers)`` gets all entries of a range and returns the arrays to send
    back, in the same order, and two counts of the range."""
    if bits > fan:
        homes = -(-blocks // (1 << fan))
        home = F.pmod(F.xxhash64(F.col("blocks")[0]), F.lit(homes))
        sent = sent.withColumn("home", home).groupBy("home", "kind", "range").applyInArrow(_resplit(bits, fan, sent_kinds), MESSAGE)
    return sent.groupBy("kind", "range").applyInArrow(_own(answer, sent_kinds), ANSWER)


def deliver(answers: DataFrame, bits: int, answer_kinds: list[str], fan: int = FAN) -> DataFrame:
    """(block, kind, range, size, values): the answers, one row for each block and message."""
    if bits > fan:
        coarse = F.shiftright("range", bits - fan)
        answers = answers.groupBy("home", "kind", coarse.alias("coarse")).applyInArrow(_return(bits - fan, answer_kinds), ANSWER)
    return answers.select(F.col("blocks")[0].alias("block"), "kind", "range", F.col("sizes")[0].alias("size"), "values")


def received(rows: pa.Table, answer_kinds: dict[int, list[str]]) -> dict[int, list[np.ndarray]]:
    """The arrays of each kind, in the order of the keys that were sent."""
    order = np.argsort(rows.column("range").to_numpy(), kind="stable").tolist() if rows.num_rows else []
    kind, size, values = (rows.column(c).to_pylist() for c in ("kind", "size", "values"))
    out: dict[int, list[list[np.ndarray]]] = {k: [[np.zeros(0, t)] for t in ts] for k, ts in answer_kinds.items()}
    for r in order:
        if kind[r] in out:
            for have, v, t in zip(out[kind[r]], values[r], answer_kinds[kind[r]], strict=True):
                have.append(unpack(v, t, size[r]))
    return {k: [np.concatenate(a) for a in have] for k, have in out.items()}
