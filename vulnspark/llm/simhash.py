"""SimHash near-duplicates: fingerprints linked through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import as_bytes, col, map_rows, partitions, stored
from vulnspark.llm.components import components

SEED = 42
FANOUT = 8


# -- fingerprints -----------------------------------------------------------------


def _lanes() -> np.ndarray:
    """For each byte, its eight bits spread over the eight bytes of a word."""
    v = np.arange(256, dtype=np.uint64)
    out = np.zeros(256, np.uint64)
    for b in range(8):
        out |= ((v >> np.uint64(b)) & np.uint64(1)) << np.uint64(8 * b)
    return out


def _fingerprints(width: int, texts: pa.Array) -> list:
    """Majority of the bits of all shingle hashes of each text."""
    import xxhash

    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    hashes, sizes = [], []
    for text in as_bytes(texts):
        w = text.lower().split()
        if len(w) > width:
            shingles = map(b" ".join, zip(*(w[i:] for i in range(width))))
            h = np.fromiter(map(digest, shingles), np.uint64, len(w) - width + 1)
        else:
            h = np.array([digest(b" ".join(w))] if w else [], np.uint64)
        hashes.append(h)
        sizes.append(len(h))
    sizes = np.array(sizes, np.int64)
    fps = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        # Byte lanes hold 255 at most, so hashes are added up in blocks of so many.
        first = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        blocks = [np.arange(a, a + n, 255) for a, n in zip(first.tolist(), sizes[full].tolist())]
        per_doc = np.array([len(b) for b in blocks])
        spread = _lanes()[np.concatenate(hashes).view(np.uint8)].reshape(-1, 8)
        sums = np.add.reduceat(spread, np.concatenate(blocks), axis=0).view(np.uint8)
        ones = np.add.reduceat(sums.astype(np.int64), np.concatenate(([0], np.cumsum(per_doc)[:-1])), axis=0)
        bits = (2 * ones > sizes[full][:, None]).astype(np.uint8)
        fps[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return [fps.view(np.int64)]


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", width: int = 3) -> DataFrame:
    """Row for row the ``keep`` columns and ``fp``, the 64 bits as a signed long."""
    return map_rows(docs, [text_col], keep, "fp bigint", partial(_fingerprints, width))


# -- the index --------------------------------------------------------------------


def _gray_rank(x: np.ndarray) -> np.ndarray:
    """Place in the Gray sequence: neighbours there differ in one bit."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _levels(fps: np.ndarray, group: np.ndarray) -> list[dict]:
    """The index from its leaves up: eight nodes of a group, in Gray order, share a parent.

    A node keeps the bits on which all its leaves agree, but for those that its
    parent already holds: differences then add up on the way down.
    """
    n = len(fps)
    level = {"group": group, "end": np.arange(1, n + 1), "and": fps, "or": fps}
    levels = [level]
    while len(levels[-1]["group"]) > len(np.unique(group)):
        below = levels[-1]
        g = below["group"]
        new = np.concatenate(([True], g[1:] != g[:-1]))
        start_of = np.flatnonzero(new)
        place = np.arange(len(g)) - np.repeat(start_of, np.diff(np.concatenate((start_of, [len(g)]))))
        first = np.flatnonzero(place % FANOUT == 0)
        count = np.diff(np.concatenate((first, [len(g)])))
        below["parent"] = np.repeat(np.arange(len(first)), count)
        levels.append(
            {
                "group": g[first], "end": below["end"][first + count - 1], "first": first, "count": count,
                "and": np.bitwise_and.reduceat(below["and"], first), "or": np.bitwise_or.reduceat(below["or"], first),
            }
        )
    for level in levels:
        level["shared"] = ~(level["and"] ^ level["or"])
    for below, above in zip(levels, levels[1:]):
        below["own"] = below["shared"] & ~above["shared"][below["parent"]]
    levels[-1]["own"] = levels[-1]["shared"]
    return levels


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the links in place: a label is the smallest leaf reached so far."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def link_groups(masks: np.ndarray, fps: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of one group (mask, bits under it) that differ in ``within`` bits or fewer.

    Returns a spanning forest, not the pairs: (fingerprint, root), one row at most per
    fingerprint and group.
    """
    key = fps & masks
    order = np.lexsort((_gray_rank(fps), key, masks))
    masks, fps, key = masks[order], fps[order], key[order]
    new = np.concatenate(([True], (masks[1:] != masks[:-1]) | (key[1:] != key[:-1])))
    group = np.cumsum(new) - 1
    size = np.bincount(group)[group]
    several = size > 1
    fps, group, size = fps[several], group[several], size[several]
    if not len(fps):
        return fps, fps
    levels = _levels(fps, group)
    label = np.arange(len(fps))
    root_of = np.searchsorted(levels[-1]["group"], group)
    # As many queries at once as can meet some millions of leaves.
    chunk = np.cumsum(size) // 4_000_000
    for queries in np.split(np.arange(len(fps)), np.flatnonzero(np.diff(chunk)) + 1):
        query, node = queries, root_of[queries]
        top = levels[-1]
        gap = np.bitwise_count((fps[query] ^ top["and"][node]) & top["own"][node])
        for above, below in zip(levels[::-1], levels[-2::-1]):
            near = (gap <= within) & (above["end"][node] > query + 1)
            query, node, gap = query[near], node[near], gap[near]
            count = above["count"][node]
            total = int(count.sum())
            inner = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            query, gap = np.repeat(query, count), np.repeat(gap, count)
            node = np.repeat(above["first"][node], count) + inner
            gap = gap + np.bitwise_count((fps[query] ^ below["and"][node]) & below["own"][node])
        found = (gap <= within) & (node > query)
        _merge(label, query[found], node[found])
    tied = np.flatnonzero(label != np.arange(len(label)))
    return fps[tied], fps[label[tied]]


def _split(mask: int, parts: int) -> list[int]:
    """Divide the bits outside a mask into ``parts`` and add each to it."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [free[len(free) * i // parts : len(free) * (i + 1) // parts] for i in range(parts)]
    return [mask | sum(1 << b for b in bits) for bits in cut]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, within: int = 2, agree: int = 1, group_limit: int = 50_000, free_bits: int = 20) -> DataFrame:
    """Links (a, b) that join distinct fingerprints ``fp`` as all pairs within ``within`` bits would.

    Of ``within + agree`` parts of the bits, two such fingerprints have ``agree`` in common, so
    each is dealt to a group per choice of parts. A group of more than ``group_limit`` is
    dealt again, by parts of its other bits, until no more than ``free_bits`` are left:
    no group can hold more than 2^20 fingerprints.
    """
    parts = _split(0, within + agree)
    masks = [sum(some) for some in combinations(parts, agree)]
    rows = distinct.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    free = 64 - min(m.bit_count() for m in masks)

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for b in batches:
            out = []
            for m in b.column(1).to_pylist():
                if m not in known:
                    known[m] = [_signed(x) for x in _split(m % (1 << 64), within + 1)]
                out.append(known[m])
            fps = np.repeat(b.column(0).to_numpy(), within + 1)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(np.array(out, np.int64).ravel())], names=["fp", "mask"])

    ready = None
    while True:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        hot = stored(rows.groupBy("mask", "key").count().filter(F.col("count") > group_limit).select("mask", "key"), "hot_groups")
        if free <= free_bits or hot.isEmpty():
            ready = rows if ready is None else ready.unionByName(rows)
            break
        small = rows.join(hot, ["mask", "key"], "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        rows = stored(rows.join(hot, ["mask", "key"]).select("fp", "mask").mapInArrow(finer, "fp bigint, mask bigint"), "finer")
        free -= free // (within + 1)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            m, f = (np.concatenate(x).view(np.uint64) for x in zip(*held))
            a, b = link_groups(m, f, within)
            for i in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[i : i + 100_000].view(np.int64)) for x in (a, b)], names=["a", "b"]
                )

    dealt = ready.repartition(partitions(distinct.sparkSession), "mask", "key")
    return dealt.select("mask", "fp").mapInArrow(link, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, within: int = 2, agree: int = 1
) -> DataFrame:
    """Per document ``id_col, fp, component``: the smallest id among all documents that links can reach.

    Documents with one fingerprint share it as one node, however many they are. A
    text without words, or null, has the fingerprint 0. Null ids never become a
    component's id unless no other is there; repeated rows stay and agree; an
    empty table gives an empty result.
    """
    docs = stored(fingerprints(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), ["id"], "text", width), "fingerprints")
    nodes = docs.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(nodes.select("fp"), within, agree))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = placed.join(least, "root").select("fp", "component")
    return docs.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component")
