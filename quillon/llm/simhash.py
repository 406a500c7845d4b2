"""SimHash near-dedup by segment-popcount embedding.

A 64-bit fingerprint is cut into ``SEGMENTS`` segments and mapped to the vector of
their bit counts.  The Manhattan distance of two vectors never exceeds the Hamming
distance of the fingerprints, so pairs within the radius lie within it there too.

*Grid range-join.*  The coordinates are dealt into G groups.  Of two vectors within
Manhattan distance r, at least G - r groups agree entirely, so both fall into the
grid cell of some choice of G - r groups.  A fingerprint enters one cell for each
choice; G (6, 7 or 8) grows with the number of distinct fingerprints so that cells
stay small.  Inside a cell the Manhattan distance filters and the exact Hamming
distance decides.

*Large cells.*  Cells over ``CELL_LIMIT`` distinct fingerprints are cut into blocks,
and each pair of blocks is a cell of its own.  Inside any cell a search from each
fingerprint over those not yet reached emits a spanning forest: no pair of a group of
near copies is listed twice, and none is lost to the components.

Equal fingerprints are one node from the start.  Components are found by alternating
large-star and small-star steps, each a written table.

Null and empty texts have fingerprint zero and are linked like any other.  A null id
takes part, but never names a component unless all ids of it are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

SHINGLE = 5
RADIUS = 3
SEGMENTS = 32
CELL_LIMIT = 20_000
SEED = 42


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the word shingles, repeats included; a shorter text is one shingle."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
        parts = [line[a:b] for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, SEED) for p in parts), dtype="<u8", count=len(parts))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included."""
    h = shingles(text, shingle)
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.kept("simhash")
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in common.texts(batch, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def popcounts(fps: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Bit counts of each segment: an (n, segments) array."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(len(fps), 8), axis=1, bitorder="little")
    return bits.reshape(len(fps), segments, 64 // segments).sum(axis=2, dtype=np.uint8)


def choose_groups(n: int, radius: int) -> int:
    """Groups of coordinates: more for more fingerprints, so cells stay small."""
    return radius + (2 if n < 4_000_000 else 3 if n < 500_000_000 else 4)


def cells(fps: np.ndarray, radius: int, groups: int, segments: int = SEGMENTS) -> np.ndarray:
    """Grid cells of each fingerprint: an (n, choices) array of 64-bit names."""
    counts = popcounts(fps, segments).astype(np.uint64)
    deal = np.arange(segments) % groups
    weight = common.mix(np.arange(1, segments + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    with np.errstate(over="ignore"):
        part = np.stack([(common.mix(counts[:, deal == g] + weight[deal == g])).sum(axis=1, dtype=np.uint64) for g in range(groups)], axis=1)
        out = [common.mix(common.mix(part[:, list(c)] * np.arange(3, 3 + 2 * len(c), 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) + np.uint64(k)) for k, c in enumerate(combinations(range(groups), groups - radius))]
    return np.stack(out, axis=1)


def unary(fps: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The embedding with each segment's count as that many ones: the Manhattan distance of
    two embeddings is the number of bits in which these differ."""
    width = 64 // segments
    ones = np.arange(width) < popcounts(fps, segments)[:, :, None]
    return np.packbits(ones.reshape(len(fps), 64), axis=1, bitorder="little").view("<u8").ravel()


def _near(a, b: np.ndarray, ua, ub: np.ndarray, radius: int) -> np.ndarray:
    """Manhattan distance of the embeddings first; of pairs within it the Hamming distance
    decides."""
    ok = np.bitwise_count(ua ^ ub) <= radius
    hit = np.flatnonzero(ok)
    ok[hit] = np.bitwise_count((a[hit] if np.ndim(a) else a) ^ b[hit]) <= radius
    return ok


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints: pairs of positions."""
    counts = unary(fps)
    rest = np.arange(len(fps))
    out = []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            k = queue.pop()
            hit = _near(fps[k], fps[rest], counts[k], counts[rest], radius)
            if hit.any():
                new = rest[hit].tolist()
                out += [(k, j) for j in new]
                queue += new
                rest = rest[~hit]
    return out


def _links(cell: np.ndarray, fps: np.ndarray, radius: int, small: int = 12) -> np.ndarray:
    """Links inside the cells of one task, as (m, 2) fingerprints."""
    order = np.lexsort((fps, cell))
    cell, fps = cell[order], fps[order]
    fresh = np.ones(len(cell), dtype=bool)
    fresh[1:] = (cell[1:] != cell[:-1]) | (fps[1:] != fps[:-1])
    cell, fps = cell[fresh], fps[fresh]
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, dtype=int)
    sizes = np.diff(np.append(starts, len(cell)))
    out = []
    counts = unary(fps)
    few = np.repeat((sizes > 1) & (sizes <= small), sizes)
    at = np.flatnonzero(few)
    for d in range(1, small):
        at = at[at + d < len(cell)]
        at = at[cell[at] == cell[at + d]]
        if not len(at):
            break
        for lo in range(0, len(at), 1 << 18):
            i = at[lo : lo + (1 << 18)]
            a, b = fps[i], fps[i + d]
            ok = _near(a, b, counts[i], counts[i + d], radius)
            out.append(np.stack([a[ok], b[ok]], axis=1))
    for k in np.flatnonzero(sizes > small):
        part = fps[starts[k] : starts[k] + sizes[k]]
        if pairs := forest(part, radius):
            out.append(part[np.array(pairs)])
    return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.uint64)


def links(nodes: DataFrame, radius: int = RADIUS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Links (fp_a, fp_b) that connect all distinct fingerprints ``nodes.fp`` within
    the radius as the full set of pairs would.  ``nodes`` must be a written table."""
    groups = choose_groups(nodes.count(), radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.kept("simhash")
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            names = cells(fps.view(np.uint64), radius, groups)
            yield pa.RecordBatch.from_arrays([pa.array(names.ravel().view(np.int64)), pa.array(np.repeat(fps, names.shape[1]))], names=["cell", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.kept("simhash")
        cell, fps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            cell.append(batch.column(0).to_numpy(zero_copy_only=False))
            fps.append(batch.column(1).to_numpy(zero_copy_only=False))
        found = np.unique(np.sort(_links(np.concatenate(cell), np.concatenate(fps).view(np.uint64), radius), axis=1), axis=0).view(np.int64)
        for at in range(0, len(found), 50_000):
            part = found[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["fp_a", "fp_b"])

    dealt = nodes.select("fp").mapInArrow(deal, "cell long, fp long")
    large = common.materialise(dealt.groupBy("cell").count().where(F.col("count") > cell_limit), "simhash-cells")
    if large.isEmpty():
        ready = dealt
    else:
        blocks = F.ceil(F.col("count") / F.lit(cell_limit)).cast("long")
        tagged = dealt.join(large, "cell", "left").withColumn("_k", F.coalesce(blocks, F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("_k"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))
        pairs = tagged.withColumn("_own", own).withColumn("_other", other)
        name = F.xxhash64("cell", F.least("_own", "_other"), F.greatest("_own", "_other"))
        ready = pairs.select(F.when(F.col("_k") > 1, name).otherwise(F.col("cell")).alias("cell"), "fp")
    parts = max(common.partitions(nodes.sparkSession), 1)
    return ready.repartition(parts, "cell").mapInArrow(join, "fp_a long, fp_b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges``
    (columns a, b of one orderable type).  Large-star and small-star steps alternate
    until nothing changes; each step is a written table."""
    now = common.materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        star = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        hung = star.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = common.materialise(hung.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        common.discard(now)
        now = after
        if before == tuple(sums):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = tuple(sums)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """One row for each document: doc_id, fp (signed long), component_id."""
    fps = common.materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    nodes = common.materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    found = common.materialise(links(nodes, radius, cell_limit), "simhash-links")
    by_fp = components(found.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))
    linked = nodes.join(by_fp.select(F.col("node").alias("fp"), F.col("component").alias("_c")), "fp", "left")
    linked = linked.withColumn("_c", F.coalesce("_c", "fp"))
    least = linked.groupBy("_c").agg(F.min("rep").alias("component_id"))
    named = common.materialise(linked.join(least, "_c").select("fp", "component_id"), "simhash-named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
