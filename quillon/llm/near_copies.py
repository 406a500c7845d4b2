"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least
``SIMILARITY``.

*Candidates.*  Each set gets ``BANDS * ROWS`` MinHash values; sets that agree in all values
of a band share a cell.  A pair of similarity s shares one with probability
1 - (1 - s^ROWS)^BANDS: 0.9999 at 0.8.

*Check.*  A candidate pair counts if the exact similarity of its sets (of 64-bit hashes of
shingles) is large enough; sets whose sizes differ too much are not compared.  First each
set is compared with the least and the greatest of its cells, which joins most of a group
of copies.  Then all pairs of a cell that are in different components yet are compared, so
no candidate is left out, and a large group is not listed pair by pair.  These pairs meet in
a task that holds the sets of their cell, each once; cells of over ``CELL_HASHES`` hashes are
cut into blocks, and each pair of blocks is a cell of its own.

*Sets.*  The first pass over the texts keeps names and cells only.  Sets are made by a
second pass, of the texts that share a cell with another set: a bitmap of their hashes,
bounded by ``BITMAP`` bits, goes to the tasks.  The few others that it lets through are
stored and not used.

The operator only adds to SimHash groups: fingerprints within a few bits reach few of the
pairs near the similarity asked for.

Equal sets are one node from the start.  Texts without a word have no set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common, simhash

SIMILARITY = 0.8
BANDS = 24
ROWS = 5
SEED = 43
CELL_HASHES = 400_000
BITMAP = 1 << 25


def shingle_set(text: bytes, shingle: int = simhash.SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    return np.unique(simhash.shingles(text, shingle))


def bands(members: np.ndarray) -> np.ndarray:
    """Cell names of a set that is not empty, one for each band."""
    rng = np.random.default_rng(SEED)
    turn, factor = rng.integers(0, 2**63, (2, BANDS * ROWS, 1), dtype=np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(members), 2048):
            part = (members[None, at : at + 2048] ^ turn) * (factor | np.uint64(1))
            np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=1), out=least)
        odd = np.arange(3, 3 + 2 * ROWS, 2, dtype=np.uint64)
        names = (common.mix(least.reshape(BANDS, ROWS)) * odd).sum(axis=1, dtype=np.uint64)
        return common.mix(names + np.arange(1, BANDS + 1, dtype=np.uint64))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = simhash.SHINGLE) -> DataFrame:
    """(doc_id, text_hash, node, n, cells) of each row: n is the size of the set; node is null
    without a word."""
    import xxhash

    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.kept("near_copies")
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                sets = [shingle_set(t, shingle) for t in common.texts(batch, "text")]
                node = pa.array([int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)) if len(s) else None for s in sets], pa.int64())
                cells = pa.array([bands(s).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))
                size = pa.array([len(s) for s in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, size, cells], names=["doc_id", "text_hash", "node", "n", "cells"])

    ready = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return ready.mapInArrow(run, f"doc_id {kind}, text_hash long, node long, n int, cells array<long>")


def _bits(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a bitmap of ``width`` bits (a power of two)."""
    return hashes & (width - 1), (hashes >> 32) & (width - 1)


def _bitmap(hashes: DataFrame, column: str, most: int = BITMAP) -> np.ndarray:
    """Bitmap of the hashes in 64-bit words, about 16 bits for each, ``most`` in all."""
    width = min(most, 1 << max(12, (16 * hashes.count()).bit_length()))
    place = F.explode(F.array(*[h.bitwiseAND(F.lit(width - 1)) for h in (F.col(column), F.shiftright(column, 32))]))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = hashes.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(width // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def stored_sets(docs: DataFrame, asked: DataFrame, shingle: int = simhash.SHINGLE, text_col: str = "text") -> DataFrame:
    """(node, members), bucketed by node: the sets of the texts whose hashes are in
    ``asked.text_hash``, and of a few others."""
    import uuid

    import xxhash

    spark = docs.sparkSession
    bitmap = _bitmap(asked, "text_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.kept("near_copies")
        seen: set[int] = set()
        for batch in batches:
            hashes = batch.column(0).to_numpy()
            ok = np.ones(len(hashes), dtype=bool)
            for at in _bits(hashes, 64 * len(bitmap)):
                ok &= (bitmap[at >> 6] >> (at & 63)) & 1 > 0
            new = []
            for k, h in zip(np.flatnonzero(ok).tolist(), hashes[ok].tolist(), strict=True):
                if h not in seen:
                    seen.add(h)
                    new.append(k)
            for lo in range(0, len(new), 100):
                sets = [s for t in common.texts(batch.take(pa.array(new[lo : lo + 100])), "text") if len(s := shingle_set(t, shingle))]
                node = pa.array([int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([node, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "members"])

    ready = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    buckets = common.partitions(spark)
    name = f"quillon_{uuid.uuid4().hex}"
    made = ready.mapInArrow(run, "node long, members array<long>").repartition(buckets, "node").dropDuplicates(["node"])
    made.write.bucketBy(buckets, "node").format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._quillon_table = name
    return out


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("_x")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("_y")), "b")
    shared = F.size(F.array_intersect("_x", "_y"))
    return common.materialise(both.where(shared >= F.lit(similarity) * (F.size("_x") + F.size("_y") - shared)).select("a", "b"), "near-links")


def _similar(similarity: float):
    """Links between the sets of a cell, or of a pair of its blocks, that are in different
    components."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        common.kept("near_copies")
        within = key[1].as_py() == key[2].as_py()
        node, part, own = (group.column(c).to_numpy() for c in ("node", "component", "own"))
        size = group.column("n").to_numpy().astype(np.int64)
        flat = group.column("members").combine_chunks().flatten().to_numpy()
        kinds, number = np.unique(flat, return_inverse=True)
        start = np.cumsum(size) - size
        held = np.zeros(len(kinds), dtype=bool)
        a, b = [], []
        for k in range(len(node) - 1):
            asked = (part[k + 1 :] != part[k]) & (np.minimum(size[k + 1 :], size[k]) >= similarity * np.maximum(size[k + 1 :], size[k]))
            if not within:
                asked &= own[k + 1 :] != own[k]
            if not asked.any():
                continue
            mine = number[start[k] : start[k] + size[k]]
            held[mine] = True
            shared = np.add.reduceat(held[number[start[k + 1] :]], start[k + 1 :] - start[k + 1], dtype=np.int64)
            held[mine] = False
            for j in (k + 1 + np.flatnonzero(asked & (shared >= similarity * (size[k + 1 :] + size[k] - shared)))).tolist():
                a.append(min(node[k], node[j]))
                b.append(max(node[k], node[j]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _compared(cells: DataFrame, sets: DataFrame, similarity: float, cell_hashes: int) -> DataFrame:
    """Links among the rows (cell, node, n, component) of each cell, across components."""
    blocks = F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(cell_hashes))).cast("int")
    dealt = cells.join(cells.groupBy("cell").agg(blocks.alias("blocks")), "cell").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ready = dealt.join(sets, "node").select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "n", "component", "members")
    return common.materialise(ready.groupBy("cell", "low", "high").applyInArrow(_similar(similarity), "a long, b long").distinct(), "near-links")


def components(rows: DataFrame, docs: DataFrame, shingle: int = simhash.SHINGLE, similarity: float = SIMILARITY, links: DataFrame | None = None, text_col: str = "text", cell_hashes: int = CELL_HASHES) -> DataFrame:
    """(node, component) of the nodes that have a near copy; ``rows`` is a written table of
    :func:`sketches` of ``docs``, ``links`` (a, b) are pairs of nodes known to be near copies."""
    nodes = rows.where("node is not null").select("node", "n", "cells").dropDuplicates(["node"])
    cells = nodes.select("node", "n", F.explode("cells").alias("cell")).repartition(common.partitions(rows.sparkSession), "cell")
    ends = cells.groupBy("cell").agg(F.min(F.struct("node", "n")).alias("low"), F.max(F.struct("node", "n")).alias("high")).where("low.node <> high.node")
    shared = common.materialise(cells.join(ends, "cell"), "near-shared")
    meeting = shared.select("node").distinct()
    asked = common.materialise(rows.join(meeting, "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("text_hash")), "near-asked")
    sets = stored_sets(docs, asked, shingle, text_col)
    common.discard(asked)
    alike = lambda m, n: F.least(m, n) >= F.lit(similarity) * F.greatest(m, n)
    star = [shared.where(F.col("node") != F.col(f"{e}.node")).where(alike(F.col("n"), F.col(f"{e}.n"))).select(F.least("node", f"{e}.node").alias("a"), F.greatest("node", f"{e}.node").alias("b")) for e in ("low", "high")]
    first = _verified(star[0].unionByName(star[1]).distinct(), sets, similarity)
    if links is not None:
        first = first.unionByName(links.select("a", "b"))
    label = simhash.components(first)
    placed = shared.select("cell", "node", "n").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("cell").agg(F.min("component").alias("_p"), F.max("component").alias("_q"), F.count("*").alias("_k")).where("_p <> _q and _k > 2").select("cell")
    open_cells = common.materialise(placed.join(split, "cell", "left_semi"), "near-open")
    found = first.unionByName(_compared(open_cells, sets, similarity, cell_hashes))
    out = simhash.components(found)
    for step in (shared, sets, open_cells):
        common.discard(step)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = simhash.SHINGLE, similarity: float = SIMILARITY, classes: DataFrame | None = None) -> DataFrame:
    """One row for each document: doc_id, text_hash, component (null for texts without a
    word).  ``classes`` (text_hash, class) names texts that are near copies already."""
    rows = common.materialise(sketches(docs, id_col, text_col, shingle), "near-sketches")
    links = None
    if classes is not None:
        placed = rows.where("node is not null").select("text_hash", "node").distinct().join(classes.distinct(), "text_hash").select("class", "node").distinct()
        least = placed.groupBy("class").agg(F.min("node").alias("b"))
        links = common.materialise(placed.join(least, "class").where("node <> b").select(F.col("node").alias("a"), "b"), "near-known")
    found = components(rows, docs, shingle, similarity, links, text_col)
    return rows.select("doc_id", "text_hash", "node").join(found, "node", "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("component"))
