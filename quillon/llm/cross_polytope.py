"""Approximate nearest neighbours by cross-polytope hashing.

*Hash.*  A fast Hadamard pseudo-rotation (three rounds of random signs and a
Walsh-Hadamard transform, in n log n steps) turns a unit vector; its hash is the nearest
signed axis.  ``tables`` independent rotations give as many tables of 2 * dim buckets.
Largest inner product is made largest cosine by dividing by the greatest norm and adding
the coordinate that completes each stored vector to unit length (queries get zero there);
where all norms are equal nothing is added.

Norms are cut into ranges of ratio ``RANGE``; each range, however small, is hashed with a
scale and buckets of its own.

*Multiprobe.*  A query visits, in each range and table, the ``probes`` signed axes nearest
to it among those that hold rows; so a range of few rows is seen whole.

*Rerank.*  Every row is indexed.  Rows and probing queries of a bucket meet in one task,
which computes inner products in double precision and keeps each query's best; the best
of all buckets are merged.  No list of candidate pairs is ever written.  Buckets over
``block_rows`` are dealt into blocks that are searched separately, and a query visits all
of them, so a bucket with a third of all rows is whole and still bounded in memory.

A query left with fewer than ``k`` neighbours is then searched exactly.

The bucket counts (tables x 2 x dimension numbers for each range) and the sizes of the
ranges are the only data on the driver.

Vectors that are null, zero, hold null or non-finite components, or are not of the
table's commonest length take no part.  Rows without an id take no part.  Rows that share
an id and a vector are one candidate; a query's own id is never its neighbour.  Equal
scores go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import common

TABLES = 12
PROBES = 12
BLOCK_ROWS = 8192
RANGE = 1.25
SEED = 20


def hadamard(a: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of each row (length a power of two)."""
    n, half = a.shape[1], 1
    while half < n:
        pair = a.reshape(len(a), n // (2 * half), 2, half)
        a = np.concatenate([pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]], axis=2).reshape(len(a), n)
        half *= 2
    return a / np.sqrt(n)


def axes(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Rotated vectors and their opposites side by side: column k is the nearness to
    signed axis k."""
    size = 1 << max(1, int(np.ceil(np.log2(max(2, x.shape[1])))))
    rng = np.random.default_rng([seed, table])
    a = np.zeros((len(x), size), dtype=np.float32)
    a[:, : x.shape[1]] = x
    for _ in range(3):
        a = hadamard(a * rng.choice(np.array([-1, 1], dtype=np.float32), size))
    return np.concatenate([a, -a], axis=1)


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), dim)


def _best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best in one block."""
    out = []
    for lo in range(0, len(q), 256):
        near = q[lo : lo + 256] @ x.T
        near[query_ids[lo : lo + 256, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
            keep = (near >= least - 1e-9 * np.maximum(1, np.abs(least))) & (near > -np.inf)
        else:
            keep = near > -np.inf
        i, j = np.nonzero(keep)
        exact = np.empty(len(i))
        for a in range(0, len(i), 1 << 16):
            exact[a : a + (1 << 16)] = (q[lo + i[a : a + (1 << 16)]] * x[j[a : a + (1 << 16)]]).sum(axis=1)
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        first = place < k
        out.append((query_ids[lo + i[first]], ids[j[first]], exact[first]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def usable(vector: str, dim: Column | int | None = None) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ok = v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    return ok if dim is None else ok & (F.size(v) == dim)


def nearest(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, tables: int = TABLES, probes: int = PROBES, block_rows: int = BLOCK_ROWS, exact_rows: int = 0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row where
    ``is_query`` (a condition on ``id``), against every other row.  A caller may ask for ranges
    of at most ``exact_rows`` rows to be searched exactly; at 0 all are hashed."""
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull()).where(usable("vector")).dropDuplicates()
    sizes = base.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 1
    base = base.where(F.size("vector") == dim)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    high, low = base.agg(F.max(norm), F.min(norm)).first()
    top = float(high or 1.0)
    even = high is None or low > top * (1 - 1e-6)
    # range 0 holds the greatest norms; a little is added so that rounding splits no range of equal norms
    part = F.floor(F.log(F.lit(top) / norm) / F.lit(float(np.log(RANGE))) + F.lit(1e-4)).cast("int")
    base = base.withColumn("part", part)
    ranges = {r["part"]: (r["n"], r["top"]) for r in base.groupBy("part").agg(F.count("*").alias("n"), F.max(norm).alias("top")).collect()}
    hashed_parts = sorted(p for p, (n, _) in ranges.items() if n > exact_rows)
    place = {p: i for i, p in enumerate(hashed_parts)}
    scale = {p: ranges[p][1] for p in hashed_parts}
    in_hashed = F.col("part").isin(hashed_parts) if hashed_parts else F.lit(False)
    asks = base.where(is_query).select("id", "vector")
    kind = "cell int, id long, vector array<double>"

    def hashed(query: bool, occupied: np.ndarray | None = None):
        def run(batches):
            for batch in batches:
                x = _vectors(batch.column(1), dim)
                if query:
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    extra = np.zeros((len(x), 1))
                else:
                    parts = batch.column(2).to_pylist()
                    x = x / np.array([scale[p] for p in parts]).reshape(-1, 1)
                    extra = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))
                x = x if even else np.concatenate([x, extra], axis=1)
                for t in range(tables):
                    near = axes(x, t)
                    width = near.shape[1]
                    if query:
                        cell = []
                        for i in range(len(hashed_parts)):
                            begin = (i * tables + t) * width
                            at = np.searchsorted(occupied, [begin, begin + width])
                            held = occupied[at[0] : at[1]] - begin
                            n = min(probes, len(held))
                            cell.append(held[np.argpartition(-near[:, held], n - 1, axis=1)[:, :n]] + begin)
                        cell = np.concatenate(cell, axis=1)
                    else:
                        cell = near.argmax(axis=1)[:, None] + t * width + np.array([place[p] for p in parts], dtype=np.int64).reshape(-1, 1) * tables * width
                    take = pa.array(np.repeat(np.arange(len(x)), cell.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.ravel().astype(np.int32)), *(c.take(take) for c in batch.columns[:2])], names=["cell", "id", "vector"])

        return run

    def dealt(index: DataFrame, asked: DataFrame, counts: dict) -> DataFrame:
        """Rows and queries of a cell meet in blocks of at most ``block_rows`` rows or so."""
        large = {c: -(-n // block_rows) for c, n in counts.items() if n > block_rows}
        if large:
            blocks = F.coalesce(F.try_element_at(F.create_map(*[F.lit(z) for pair in large.items() for z in pair]), F.col("cell")), F.lit(1))
        else:
            blocks = F.lit(1)
        index = index.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        return index.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")

    def exact(index: DataFrame, asked: DataFrame, n: int) -> DataFrame:
        cell = F.lit(-1).alias("cell")
        return dealt(index.select(cell, "id", "vector"), asked.select(cell, "id", "vector"), {-1: n})

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            found = _best(left.column("id").to_numpy(), _vectors(left.column("vector"), dim), right.column("id").to_numpy(), _vectors(right.column("vector"), dim), k)
        return pa.table([pa.array(z) for z in found], names=["query_id", "vec_id", "score"])

    def best(found: DataFrame) -> DataFrame:
        merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    few = sum(n for n, _ in ranges.values() if n <= exact_rows)
    if not hashed_parts:
        return best(exact(base, asks, few))
    index = base.where(in_hashed).select("id", "vector", "part").mapInArrow(hashed(False), kind)
    counts = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}
    occupied = np.array(sorted(counts), dtype=np.int64)
    found = dealt(index, asks.mapInArrow(hashed(True, occupied), kind), counts)
    if few:
        found = found.unionByName(exact(base.where(~in_hashed), asks, few))
    first = common.materialise(best(found), "polytope-best")
    full = first.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = common.materialise(asks.join(full, "id", "left_anti"), "polytope-short")
    if short.isEmpty():
        return first
    again = best(exact(base, short, sum(n for n, _ in ranges.values())))
    return first.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(again)
