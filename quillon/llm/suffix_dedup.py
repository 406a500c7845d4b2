"""Suffix-array dedup with a linear grouping construction.

A byte is removed if a 50-byte string that covers it also starts in a document with a
smaller id.  Texts are UTF-8 bytes; strings never cross documents and are judged on the
input.

*Anchors.*  Each 50-byte window has a minimizer: the 18-byte string with the least hash
in it.  Equal windows have equal minimizers, so a window occurs twice only if its anchor
does.  An anchor's context is all windows it stands for.

*Exchange.*  Distinct texts are dealt into blocks of bounded size (exact copies meet in
one; a task sends the text of a copy once).  Blocks send anchor hashes, packed and sorted,
to their owners by hash range, which answer with one bit each: does the anchor occur in
another text?  Blocks then send hashes of the contexts of such anchors.  A context that
an earlier document has entirely is a repeat as a whole.  Contexts that share
42 bytes around the anchor with a different context (every window holds one of four such
strings), and are the first of their kind, need their strings compared.

*Suffix array.*  The bytes of those contexts, a chunk of whole anchors at a time, are
sorted by :func:`suffix_array`: groups of suffixes with equal Lyndon prefixes are
processed in descending order; each suffix points to the previous suffix of a lower
group, and what is pointed to leaves its group for a new one right above it, by number of
pointers; then one pass from the least suffix upward emits every group's order along the
same pointers.  No renaming, no recursion.  Windows that are neighbours in suffix order
and equal in 50 bytes form a class; those after the class's least document are removed.

Hashes of anchors and contexts have 64 bits, and texts count as copies by 128; the
strings of the last step are compared byte by byte.

Null and empty texts have no bytes.  Rows that share an id do not count against each
other.  A null id counts as larger than all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

SPAN = 50
GRAM = 18
#: A window reaches at least 24 bytes beyond its anchor in total on the two sides of one of
#: these splits: (bytes before, bytes after).
SIDES = ((24, 0), (16, 8), (8, 16), (0, 24))
BLOCK_BYTES = 12 << 20
CHUNK_BYTES = 60_000
_BASE = 0x9E3779B97F4A7C15 | 1
_NO_ID = (1 << 63) - 1
_CONTEXT = np.dtype([("h", "<u8"), ("ctx", "<u8"), *((f"s{k}", "<u4") for k in range(4)), ("doc", "<i8"), ("idx", "<i4"), ("first", "<i4"), ("n", "<i2"), ("off", "<i2")])
_RANGE = np.dtype([("idx", "<i4"), ("first", "<i4"), ("n", "<i4")])
_NEED = np.dtype([("h", "<u8"), ("doc", "<i8"), ("idx", "<i4"), ("first", "<i4"), ("n", "<i2"), ("off", "<i2")])


# ---- suffix array -----------------------------------------------------------------------


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a list whose last item is its only least one.

    A group is the stretch of the array that its suffixes will fill; it is named by its
    start.  ``members`` holds a suffix, or a set of them, for each start."""
    n = len(text)
    by: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by.setdefault(c, []).append(i)
    group, members, start_at_end, at = [0] * n, [None] * n, [0] * (n + 1), 0
    for c in sorted(by):
        own = by[c]
        for i in own:
            group[i] = at
        members[at] = set(own) if len(own) > 1 else own[0]
        start_at_end[at + len(own)] = at
        at += len(own)
    previous = [-1] * n
    end = n
    while end > 0:
        g = start_at_end[end]
        if end - g == 1:  # one suffix: it moves at most one other
            i = members[g]
            if i.__class__ is set:
                (i,) = i
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                lower = group[j]
                rest = members[lower]
                if rest.__class__ is set:
                    size = len(rest) - 1
                    if size:
                        rest.discard(j)
                        new = lower + size
                        group[j] = new
                        members[new] = j
                        start_at_end[new + 1] = new
                        start_at_end[new] = lower
            end = g
            continue
        pointed: dict[int, int] = {}
        for i in sorted(members[g]):
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        parts: dict[int, dict[int, list[int]]] = {}
        for j, k in pointed.items():
            parts.setdefault(k, {}).setdefault(group[j], []).append(j)
        for k in sorted(parts, reverse=True):
            for lower, moved in parts[k].items():
                lower = group[moved[0]]
                rest = members[lower]
                if rest.__class__ is not set or len(moved) == len(rest):
                    continue
                rest.difference_update(moved)
                new = lower + len(rest)
                for j in moved:
                    group[j] = new
                members[new] = set(moved) if len(moved) > 1 else moved[0]
                start_at_end[new + len(moved)] = new
                start_at_end[new] = lower
        end = g
    order = [-1] * n
    free = list(range(n))
    placed = bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return order


# ---- anchors --------------------------------------------------------------------------


def rolling(buf: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` bytes, by doubling."""
    with np.errstate(over="ignore"):
        cur = common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))[buf]
        n, out, off, rest = 1, None, 0, size
        while True:
            if rest & 1:
                if out is None:
                    out, off = cur, n
                else:
                    m = len(buf) - off - n + 1
                    out = out[:m] * np.uint64(pow(_BASE, n, 1 << 64)) + cur[off : off + m]
                    off += n
            rest >>= 1
            if not rest:
                return common.mix(out)
            cur = cur[: len(cur) - n] * np.uint64(pow(_BASE, n, 1 << 64)) + cur[n:]
            n *= 2


def anchors(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, number of windows, hash) of the anchors of one text.  Of equal
    hashes in a window the leftmost is the minimizer; an anchor whose windows are not
    consecutive occurs once for each run."""
    if len(buf) < SPAN:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    h = rolling(buf, GRAM)
    w = SPAN - GRAM + 1
    # 36 bits of hash, then the place; of equal 36 bits the leftmost wins everywhere alike
    low = (h >> np.uint64(28) << np.uint64(28)) | np.arange(len(h), dtype=np.uint64)
    n = 1
    while n * 2 <= w:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if w > n:
        low = np.minimum(low[: len(low) - (w - n)], low[w - n :])
    place = (low & np.uint64((1 << 28) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return place[first], first, np.diff(np.append(first, len(place))), h[place[first]]


class Block:
    """The distinct texts of one block, ordered by hash, with their least ids."""

    def __init__(self, rows: pa.Table):
        h1, h2 = rows.column("h1").to_numpy(), rows.column("h2").to_numpy()
        ids = rows.column("doc_id").to_numpy()
        text = rows.column("text").combine_chunks()
        has = text.is_valid().to_numpy(zero_copy_only=False)
        order = np.lexsort((~has, h2, h1))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
        at = np.flatnonzero(fresh)
        self.h1, self.h2 = h1[order[at]], h2[order[at]]
        self.ids = np.minimum.reduceat(ids[order], at) if len(at) else ids
        self.texts = [text[int(k)].as_buffer() for k in order[at]]

    def bytes_of(self, k: int) -> np.ndarray:
        return np.frombuffer(self.texts[k], dtype=np.uint8)


def _cuts(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    owner = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sorted_hashes), np.int64)
    return np.searchsorted(owner, np.arange((1 << bits) + 1))


def _table(names: str, kinds: list, columns: list[list]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names.split())


def _block_anchors(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct anchor hashes of a block's texts, and whether several texts have each."""
    own = [np.unique(h) for h in hashes]
    keys, times = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, int))
    return keys, times > 1


def _send(bits: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        block = Block(rows)
        keys, many = _block_anchors([anchors(block.bytes_of(k))[3] for k in range(len(block.texts))])
        cut, b = _cuts(keys, bits), key[0].as_py()
        out: list[list] = [[], [], [], []]
        for p in range(1 << bits):
            if cut[p + 1] > cut[p]:
                part = slice(cut[p], cut[p + 1])
                raw = np.ascontiguousarray(keys[part].view(np.uint8).reshape(-1, 8).T).tobytes()
                for o, v in zip(out, (p, b, raw, np.packbits(many[part]).tobytes()), strict=True):
                    o.append(v)
        return _table("part block hashes many", [pa.int32(), pa.int64(), pa.binary(), pa.binary()], out)

    return run


def _answer(group: pa.Table) -> pa.Table:
    lists = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel() for b in group.column("hashes").to_pylist()]
    many = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(x)) for b, x in zip(group.column("many").to_pylist(), lists, strict=True)])
    keys, place, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = (times > 1) | (np.bincount(place, weights=many, minlength=len(keys)) > 0)
    flags, out, at = shared[place], [], 0
    for x in lists:
        out.append(np.packbits(flags[at : at + len(x)]).tobytes())
        at += len(x)
    return _table("part block n shared", [pa.int32(), pa.int64(), pa.int32(), pa.binary()], [group.column("part").to_pylist(), group.column("block").to_pylist(), [len(x) for x in lists], out])


def merged(ranges: np.ndarray) -> np.ndarray:
    """Ranges of window starts, joined where they touch or overlap."""
    if not len(ranges):
        return ranges
    r = np.sort(ranges, order=["idx", "first"])
    reach = r["idx"].astype(np.int64) << 32
    stop = np.maximum.accumulate(reach + r["first"] + r["n"])
    begin = reach + r["first"]
    fresh = np.concatenate(([True], begin[1:] > stop[:-1]))
    at = np.flatnonzero(fresh)
    out = r[at].copy()
    out["n"] = stop[np.append(at[1:], len(r)) - 1] - begin[at]
    return out


_OUT = "part int, block long, kind int, payload binary"
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]


def _contexts(bits: int):
    """Contexts of shared anchors to their owners (kind 0) and repeats found here (kind 1)."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        import xxhash

        if not rows.num_rows:
            return _table("part block kind payload", _KINDS, [[], [], [], []])
        block, b = Block(rows), rows.column("block")[0].as_py()
        all_anchors = [tuple(x.astype(t) for x, t in zip(anchors(block.bytes_of(k)), ("i4", "i4", "i4", "u8"), strict=True)) for k in range(len(block.texts))]
        keys, _ = _block_anchors([a[3] for a in all_anchors])
        shared = np.zeros(len(keys), dtype=bool)
        cut = _cuts(keys, bits)
        for p, n, raw in zip(answers.column("part").to_pylist(), answers.column("n").to_pylist(), answers.column("shared").to_pylist(), strict=True):
            shared[cut[p] : cut[p + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
        known, found = keys[shared], []
        for k in range(len(block.texts)):
            buf = block.bytes_of(k)
            place, first, n, h = all_anchors[k]
            if not len(h) or not len(known):
                continue
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            if not hit.any():
                continue
            place, first, n, h = place[hit], first[hit], n[hit], h[hit]
            beside = (rolling(buf, GRAM + 24) >> np.uint64(32)).astype(np.uint32)
            raw = memoryview(block.texts[k])
            out = np.zeros(len(h), dtype=_CONTEXT)
            out["h"], out["doc"], out["idx"], out["first"], out["n"], out["off"] = h, block.ids[k], k, first, n, place - first
            out["ctx"] = np.fromiter((xxhash.xxh64_intdigest(raw[a:z]) for a, z in zip(first.tolist(), (first + n + SPAN - 1).tolist(), strict=True)), dtype=np.uint64, count=len(h))
            for k, (before, after) in enumerate(SIDES):  # zero where the text ends within the side
                ok = (place >= before) & (place + GRAM + after <= len(buf))
                out[f"s{k}"][ok] = beside[place[ok] - before] | np.uint32(1)
            found.append(out)
        part, blocks, kind, payload = [], [], [], []
        if found:
            all_ = np.concatenate(found)
            all_ = all_[np.lexsort((all_["doc"], all_["ctx"], all_["h"]))]
            fresh = np.concatenate(([True], (all_["h"][1:] != all_["h"][:-1]) | (all_["ctx"][1:] != all_["ctx"][:-1])))
            least = all_["doc"][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            later = all_["doc"] > least
            gone = merged(_ranges(all_[later]))
            if len(gone):
                part.append(b % (1 << bits))
                blocks.append(b)
                kind.append(1)
                payload.append(gone.tobytes())
            kept = all_[~later]
            cut = _cuts(kept["h"], bits)
            for p in range(1 << bits):
                if cut[p + 1] > cut[p]:
                    part.append(p)
                    blocks.append(b)
                    kind.append(0)
                    payload.append(kept[cut[p] : cut[p + 1]].tobytes())
        return _table("part block kind payload", _KINDS, [part, blocks, kind, payload])

    return run


def _ranges(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), dtype=_RANGE)
    for c in ("idx", "first", "n"):
        out[c] = a[c]
    return out


def _several(key: np.ndarray, ctx: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Whether each row's key occurs with more than one context."""
    out = np.zeros(len(key), dtype=bool)
    at = np.flatnonzero(valid)
    if not len(at):
        return out
    names, place = np.unique(key[at], return_inverse=True)
    kinds = np.unique(np.stack([place.astype(np.uint64), ctx[at]], axis=1), axis=0)
    out[at] = (np.bincount(kinds[:, 0].astype(np.int64), minlength=len(names)) > 1)[place]
    return out


def _judge(group: pa.Table) -> pa.Table:
    """Owners: repeats of whole contexts (kind 1), and contexts to compare (kind 2)."""
    part = group.column("part")[0].as_py()
    blocks, kinds, raw = group.column("block").to_pylist(), group.column("kind").to_pylist(), group.column("payload").to_pylist()
    out = [[part, b, 1, r] for b, k, r in zip(blocks, kinds, raw, strict=True) if k == 1]
    lists = [(b, np.frombuffer(r, dtype=_CONTEXT)) for b, k, r in zip(blocks, kinds, raw, strict=True) if k == 0]
    if lists:
        all_ = np.concatenate([x for _, x in lists])
        home = np.repeat([b for b, _ in lists], [len(x) for _, x in lists])
        order = np.lexsort((all_["doc"], all_["ctx"], all_["h"]))
        all_, home = all_[order], home[order]
        fresh = np.concatenate(([True], (all_["h"][1:] != all_["h"][:-1]) | (all_["ctx"][1:] != all_["ctx"][:-1])))
        least = all_["doc"][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        later = all_["doc"] > least
        both = lambda side: common.mix(all_["h"] ^ (all_[side].astype(np.uint64) << np.uint64(17)))
        # windows that may recur: the bytes before the anchor are 24..32, 16..23, 8..15 or 0..7
        near, far = np.full(len(all_), SPAN), np.full(len(all_), -1)
        for k, (before, _) in enumerate(SIDES):
            some = _several(both(f"s{k}"), all_["ctx"], all_[f"s{k}"] > 0)
            near[some] = before
            far[some] = np.maximum(far[some], before + (8 if k == 0 else 7))
        place = all_["first"].astype(np.int64) + all_["off"]
        low = np.maximum(all_["first"], place - far)
        high = np.minimum(all_["first"].astype(np.int64) + all_["n"] - 1, place - near)
        need = ~later & (low <= high)
        for b in np.unique(home).tolist():
            own = home == b
            if len(gone := merged(_ranges(all_[own & later]))):
                out.append([part, b, 1, gone.tobytes()])
            if len(ask := all_[own & need]):
                a = np.zeros(len(ask), dtype=_NEED)
                for c in ("h", "doc", "idx"):
                    a[c] = ask[c]
                a["first"], a["n"], a["off"] = (x[own & need] for x in (low, high - low + 1, place - low))
                out.append([part, b, 2, a.tobytes()])
    return _table("part block kind payload", _KINDS, [list(c) for c in zip(*out, strict=True)] if out else [[], [], [], []])


def _fetch(chunks: int):
    """The bytes of contexts to compare, dealt by anchor."""

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        names, kinds = "chunk h block idx doc first before after", [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        if not rows.num_rows or not asks.num_rows:
            return _table(names, kinds, [[]] * 8)
        block, b = Block(rows), rows.column("block")[0].as_py()
        ask = np.concatenate([np.frombuffer(r, dtype=_NEED) for r in asks.column("payload").to_pylist()])
        raw = [memoryview(t) for t in block.texts]
        place = list(zip(ask["idx"].tolist(), ask["first"].tolist(), ask["n"].tolist(), ask["off"].tolist(), strict=True))
        before = [bytes(raw[k][a : a + o]) for k, a, n, o in place]
        after = [bytes(raw[k][a + o + GRAM : a + n + SPAN - 1]) for k, a, n, o in place]
        chunk = (common.mix(ask["h"] + np.uint64(1)) % np.uint64(chunks)).astype(np.int32)
        return _table(names, kinds, [chunk, ask["h"].view(np.int64), [b] * len(ask), ask["idx"], ask["doc"], ask["first"], before, after])

    return run


def repeated_windows(anchor: np.ndarray, left: list[bytes], right: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of each window that also starts in a context of a smaller doc.

    A context is the bytes before its anchor and those after it; the anchor between
    them is one symbol, since every window of the context holds all of it."""
    name = np.unique(anchor, return_inverse=True)[1]
    lens = np.array([(len(a), len(b)) for a, b in zip(left, right, strict=True)], dtype=np.int64)
    width = lens.sum(axis=1) + 2
    stop = np.cumsum(width)
    begin = stop - width
    # symbols: 0 the end, 1 between contexts, bytes from 2, anchors from 258
    text = np.ones(int(stop[-1]) + 1, dtype=np.int64)
    text[-1] = 0
    owner = np.repeat(np.arange(len(width)), width)
    within = np.arange(int(stop[-1])) - begin[owner]
    fill = np.ones(len(owner), dtype=bool)
    fill[begin + lens[:, 0]] = False
    fill[stop - 1] = False
    text[:-1][fill] = np.frombuffer(b"".join(x for pair in zip(left, right, strict=True) for x in pair), dtype=np.uint8).astype(np.int64) + 2
    text[begin + lens[:, 0]] = 258 + name
    order = np.array(suffix_array(text.tolist()), dtype=np.int64)[1:]
    size = SPAN - GRAM + 1  # symbols of a window
    starts = (within <= lens[owner, 0]) & (within + size < width[owner])
    order = order[starts[order]]
    if len(order) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.ones(len(order) - 1, dtype=bool)
    for k in range(size):
        same &= text[order[1:] + k] == text[order[:-1] + k]
    fresh = np.flatnonzero(np.concatenate(([True], ~same)))
    doc = docs[owner[order]]
    least = np.repeat(np.minimum.reduceat(doc, fresh), np.diff(np.append(fresh, len(doc))))
    gone = order[doc > least]
    return owner[gone], within[gone]


def _compare(group: pa.Table) -> pa.Table:
    """Sort the suffixes of one chunk's contexts, a few whole anchors at a time."""
    h = group.column("h").to_numpy()
    order = np.argsort(h, kind="stable")
    h = h[order]
    block, idx = group.column("block").to_numpy()[order], group.column("idx").to_numpy()[order]
    doc, first = group.column("doc").to_numpy()[order], group.column("first").to_numpy()[order]
    before, after = (group.column(c).take(pa.array(order)).to_pylist() for c in ("before", "after"))
    size = np.cumsum([len(a) + len(b) + 2 for a, b in zip(before, after, strict=True)])
    found: dict[int, list[np.ndarray]] = {}
    edges = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    lo = 0
    while lo < len(h):  # whole anchors, about CHUNK_BYTES of them
        k = np.searchsorted(edges, np.searchsorted(size, size[lo] + CHUNK_BYTES))
        hi = int(edges[k]) if k < len(edges) else len(h)
        hi = hi if hi > lo else int(edges[np.searchsorted(edges, lo, side="right")]) if lo < edges[-1] else len(h)
        own, window = repeated_windows(h[lo:hi], before[lo:hi], after[lo:hi], doc[lo:hi])
        gone = np.zeros(len(own), dtype=_RANGE)
        gone["idx"], gone["first"], gone["n"] = idx[lo + own], first[lo + own] + window, 1
        for b in np.unique(block[lo + own]).tolist():
            found.setdefault(b, []).append(merged(gone[block[lo + own] == b]))
        lo = hi
    part = group.column("chunk")[0].as_py()
    out = [[part, b, 1, merged(np.concatenate(r)).tobytes()] for b, r in found.items()]
    return _table("part block kind payload", _KINDS, [list(c) for c in zip(*out, strict=True)] if out else [[], [], [], []])


def _remove(rows: pa.Table, gone: pa.Table) -> pa.Table:
    """Remove the bytes that repeated windows cover; digest of the rest for each text."""
    names, kinds = "h1 h2 rep n_removed n_spans kept_sha256", [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    if not rows.num_rows:
        return _table(names, kinds, [[]] * 6)
    block = Block(rows)
    parts = [np.frombuffer(r, dtype=_RANGE) for r in gone.column("payload").to_pylist()]
    ranges = np.concatenate(parts).copy() if parts else np.zeros(0, dtype=_RANGE)
    ranges["n"] += SPAN - 1  # from window starts to bytes
    ranges = merged(ranges)
    cut = np.searchsorted(ranges["idx"], np.arange(len(block.texts) + 1))
    removed, spans, sha = [], [], []
    for k, t in enumerate(block.texts):
        digest, at, total, raw = hashlib.sha256(), 0, 0, memoryview(t)
        for a, n in zip(ranges["first"][cut[k] : cut[k + 1]].tolist(), ranges["n"][cut[k] : cut[k + 1]].tolist(), strict=True):
            digest.update(raw[at:a])
            at, total = a + n, total + n
        digest.update(raw[at:])
        removed.append(total)
        spans.append(int(cut[k + 1] - cut[k]))
        sha.append(digest.hexdigest())
    return _table(names, kinds, [block.h1, block.h2, block.ids, removed, spans, sha])


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct text of a task once; at the end the least id of its later copies."""
    seen: dict[tuple[int, int], list[int]] = {}
    # one schema for all batches: fields of the input may be marked as never null
    kind = pa.schema([("block", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary())])
    for batch in batches:
        h1, h2, ids, blocks = (batch.column(k).to_pylist() for k in (1, 2, 3, 0))
        keep = []
        for k, (key, i) in enumerate(zip(zip(h1, h2, strict=True), ids, strict=True)):
            if key in seen:
                seen[key][1] = min(seen[key][1], i)
            else:
                seen[key] = [i, i, blocks[k]]
                keep.append(k)
        if keep:
            yield pa.RecordBatch.from_arrays(batch.take(pa.array(keep)).columns, schema=kind)
    late = [(b, *key, low) for key, (first, low, b) in seen.items() if low < first]
    if late:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*late, strict=True)] + [pa.nulls(len(late), pa.binary())], schema=kind)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    import uuid

    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text"), "n_bytes": F.octet_length("text").cast("long")})
    size = rows.agg(F.sum("n_bytes")).first()[0] or 0
    parts = common.partitions(spark)
    blocks = max(parts, -(-size // block_bytes))
    bits = max(1, int(np.ceil(np.log2(blocks))))
    dealt = rows.where(F.col("n_bytes") >= SPAN).select(F.pmod("h1", F.lit(blocks)).alias("block"), "h1", "h2", F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    name = f"quillon_blocks_{uuid.uuid4().hex}"
    firsts = dealt.mapInArrow(_firsts, "block long, h1 long, h2 long, doc_id long, text binary")
    firsts.repartition(blocks, "block").write.bucketBy(blocks, "block").format("parquet").saveAsTable(name)
    stored = spark.table(name)

    out = "part int, block long, kind int, payload binary"
    answers = stored.groupBy("block").applyInArrow(_send(bits), "part int, block long, hashes binary, many binary").groupBy("part").applyInArrow(_answer, "part int, block long, n int, shared binary")
    contexts = stored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_contexts(bits), out)
    judged = common.materialise(contexts.groupBy("part").applyInArrow(_judge, out), "suffix-judged")
    asks = judged.where("kind = 2")
    n_bytes = asks.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    chunks = int(max(parts, -(-n_bytes * (SPAN + 16) // _NEED.itemsize // (4 * CHUNK_BYTES))))
    fetched = stored.groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(_fetch(chunks), "chunk int, h long, block long, idx int, doc long, first int, before binary, after binary")
    compared = common.materialise(fetched.groupBy("chunk").applyInArrow(_compare, out), "suffix-compared")
    gone = judged.where("kind = 1").unionByName(compared)
    done = stored.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(_remove, "h1 long, h2 long, rep long, n_removed long, n_spans long, kept_sha256 string")
    done = common.materialise(done, "suffix-done")
    spark.sql(f"drop table {name}")
    for df in (judged, compared):
        common.discard(df)
    short = F.sha2(F.col("text").cast("binary"), 256)
    ends = rows.select("doc_id", "h1", "h2", "n_bytes", F.when(F.col("n_bytes") < SPAN, short).alias("_short")).join(done, ["h1", "h2"], "left")
    copy = F.coalesce("doc_id", F.lit(_NO_ID)) > F.col("rep")
    return ends.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("rep").isNull(), 0).when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(F.col("rep").isNull(), 0).when(copy, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(F.col("rep").isNull(), F.col("_short")).when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
