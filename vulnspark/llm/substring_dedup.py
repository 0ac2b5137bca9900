"""Remove repeated word sequences with suffix trees partitioned by variable-length prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import (
    _ODD, INVERSE, as_bytes, col, mixed, partitions, powers, prefix_sums, slices, word_bounds,
    word_hashes,
)

BLOCK_BYTES = 3 << 20
GROUP_SUFFIXES = 1_000_000
PREFIXES = (1, 2, 4, 8)
NO_ID = np.iinfo(np.int64).max


@dataclass
class Block:
    """The suffixes of some documents, in the order of their ids."""

    texts: list[bytes]
    ids: np.ndarray
    order: np.ndarray
    bounds: list[tuple[np.ndarray, np.ndarray]]
    words: np.ndarray  # hashes of all words
    first: np.ndarray  # place of each suffix among the words
    doc: np.ndarray  # of each suffix

    @staticmethod
    def of(table: pa.Table, width: int) -> Block:
        texts = as_bytes(table.column("text").combine_chunks())
        ids = table.column("id").fill_null(NO_ID).to_numpy()
        order = np.lexsort((table.column("t").to_numpy(), table.column("d").to_numpy(), ids))
        texts, ids = [texts[i] for i in order], ids[order]
        bounds, words, first, doc, at = [], [], [], [], 0
        joined = b" ".join(texts)
        data = np.frombuffer(joined, np.uint8)
        starts, ends = word_bounds(data)
        words = word_hashes(data, starts, ends)
        edges = np.cumsum([0] + [len(t) + 1 for t in texts])
        cut = np.searchsorted(starts, edges)
        for i in range(len(texts)):
            s = slice(cut[i], cut[i + 1])
            bounds.append((starts[s] - edges[i], ends[s] - edges[i]))
        n = np.maximum(0, np.diff(cut) - width + 1)
        doc = np.repeat(np.arange(len(texts)), n)
        first = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(cut[:-1], n)
        return Block(texts, ids, order, bounds, words, first, doc)

    def prefixes(self) -> _Prefixes:
        return _Prefixes(self)


class _Prefixes:
    """Hashes of the first words of every suffix, to any depth."""

    def __init__(self, block: Block):
        self.sums = prefix_sums(block.words)
        self.first = block.first
        self.back = powers(len(self.sums), INVERSE)[block.first]

    def to(self, depth: int) -> np.ndarray:
        h = (self.sums[self.first + depth] - self.sums[self.first]) * self.back
        return mixed(h + np.uint64(depth * _ODD % (1 << 64)))


def _frequent_here(part: pa.RecordBatch, width: int, least: int) -> pa.RecordBatch:
    """Prefixes that very many suffixes of some documents share, and their numbers."""
    block = Block.of(pa.Table.from_batches([part]), width)
    prefixes = block.prefixes()
    found = []
    for depth in (p for p in PREFIXES if p < width):
        values, counts = np.unique(prefixes.to(depth), return_counts=True)
        found.append((values[counts >= least], counts[counts >= least]))
    if not found:
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    columns = [np.concatenate([v for v, _ in found]).view(np.int64), np.concatenate([c for _, c in found])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["prefix", "n"])


def _groups(prefixes: _Prefixes, whole: np.ndarray, frequent: np.ndarray, width: int, groups: int) -> np.ndarray:
    """The group of each suffix: that of its shortest prefix which is not frequent."""
    out = whole % np.uint64(groups)
    open_ = np.ones(len(whole), bool)
    for depth in (p for p in PREFIXES if p < width):
        h = prefixes.to(depth)
        rare = open_ & ~np.isin(h, frequent)
        out[rare] = h[rare] % np.uint64(groups)
        open_ &= ~rare
    return out.astype(np.int64)


def _suffixes(table: pa.Table, width: int, frequent: np.ndarray, groups: int):
    """A block's different suffixes, each with the first document that has it, sorted by group."""
    block = Block.of(table, width)
    prefixes = block.prefixes()
    whole = prefixes.to(width)
    values, first, of = np.unique(whole, return_index=True, return_inverse=True)
    group = _groups(prefixes, whole, frequent, width, groups)[first]
    order = np.lexsort((first, group))  # in a group by document
    return block, values, first, of, group, order


def _send(table: pa.Table, width: int, frequent: np.ndarray, groups: int, bucket: int) -> pa.Table:
    """One row per group: hashes of the suffixes to full depth, and how many each document has."""
    block, values, first, _, group, order = _suffixes(table, width, frequent, groups)
    found, starts = np.unique(group[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    rows = []
    for a, b in zip(starts, ends):
        part = order[a:b]
        docs, n = np.unique(block.doc[first[part]], return_counts=True)
        rows.append((values[part].tobytes(), block.ids[docs].astype("<i8").tobytes(), n.astype("<i4").tobytes()))
    hashes, ids, counts = zip(*rows) if rows else ((), (), ())
    return pa.table(
        {
            "grp": pa.array(found, pa.int64()), "bucket": pa.array([bucket] * len(found), pa.int64()),
            "hashes": pa.array(hashes, pa.binary()), "ids": pa.array(ids, pa.binary()), "counts": pa.array(counts, pa.binary()),
        }
    )


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group the hashes of whole windows: equal ones are leaves that would meet in a node at full depth.

    Back goes, per block, which of its suffixes meet one of a smaller id there.
    """
    groups: dict[int, list] = {}
    for b in batches:
        for row in b.to_pylist():
            groups.setdefault(row["grp"], []).append(row)
    while groups:
        group, rows = groups.popitem()
        parts = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        path = np.concatenate(parts)
        ids = np.concatenate([np.repeat(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["counts"], "<i4")) for r in rows])
        order = np.argsort(path, kind="stable")
        node = np.flatnonzero(np.concatenate(([True], path[order][1:] != path[order][:-1])))
        least = np.repeat(np.minimum.reduceat(ids[order], node), np.diff(np.append(node, len(path))))
        later = np.empty(len(path), bool)
        later[order] = ids[order] > least
        at = np.cumsum([len(p) for p in parts])[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(later, at)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r["bucket"] for r in rows], pa.int64()), pa.array([group] * len(rows), pa.int64()),
                pa.array(bits, pa.binary()),
            ],
            names=["bucket", "grp", "later"],
        )


def _remove(table: pa.Table, answers: pa.Table, width: int, frequent: np.ndarray, groups: int) -> pa.Table:
    block, values, first, of, group, order = _suffixes(table, width, frequent, groups)
    later = np.zeros(len(values), bool)
    said = dict(zip(answers.column("grp").to_pylist(), answers.column("later").to_pylist()))
    found, starts = np.unique(group[order], return_index=True)
    for g, a, b in zip(found.tolist(), starts, np.append(starts[1:], len(order))):
        bits = np.unpackbits(np.frombuffer(said[g], np.uint8), count=b - a)
        later[order[a:b]] = bits.astype(bool)
    ids = block.ids[block.doc]
    gone = later[of] | (ids > ids[first][of]) if len(of) else np.zeros(0, bool)
    step = np.zeros(len(block.words) + 1, np.int64)
    np.add.at(step, block.first[gone], 1)
    np.add.at(step, block.first[gone] + width, -1)
    removed = np.cumsum(step[:-1]) > 0
    n_words, n_removed, kept, at = [], [], [], 0
    for text, (s, e) in zip(block.texts, block.bounds):
        r = removed[at : at + len(s)]
        at += len(s)
        n_words.append(len(s))
        n_removed.append(int(r.sum()))
        w = text.split()
        kept.append(b" ".join(w if not r.any() else [w[i] for i in np.flatnonzero(~r)]).decode())
    columns = {c: table.column(c).take(pa.array(block.order)) for c in table.column_names if c.startswith("c")}
    return pa.table(
        columns
        | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())}
    )


def remove_repeated_words(
    docs: DataFrame, keep: list[str], width: int = 13, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document the ``keep`` columns and ``n_words, n_removed, kept``.

    Every word goes that a sequence of ``width`` words covers which also starts in a
    document with a smaller id. ``kept`` joins the other words by one space. Sequences
    are judged on the input and never cross documents.

    A suffix is a place in a text with ``width`` words from there. Suffixes are dealt to
    groups by prefix: by the first word, or by as many more words as it takes until
    not too many suffixes share it. No tree is built: a suffix is the hash of its whole
    window, and equal hashes meet. Repeats longer than ``width`` are not reported as such. Suffixes
    that a block of documents has several times are sent once, so a passage in a third
    of all documents makes one row per block.

    Null texts have no words. Documents with one id do not remove from each other; a null
    id counts as larger than all. Paths are compared by 64-bit hashes. An empty table
    gives an empty result.
    """
    columns = list(dict.fromkeys(keep))
    rows = docs.select(
        *(col(c).alias(f"c{i}") for i, c in enumerate(columns)),
        col(id_col).cast("long").alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
        F.xxhash64(col(id_col)).alias("d"), F.xxhash64(col(text_col)).alias("t"),
    )
    spark = docs.sparkSession
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(partitions(spark), -(-size // BLOCK_BYTES))
    groups = max(partitions(spark), -(-size // (6 * GROUP_SUFFIXES)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("d", "t"), F.lit(buckets)))
    by_block = rows.groupBy("bucket")
    # A prefix is too frequent for one group from an average group's share on.
    limit = max(1000, size // 6 // groups)
    least = max(2, limit // buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _frequent_here(part, width, least)

    counted = rows.select("id", "text", "d", "t").mapInArrow(count, "prefix bigint, n bigint")
    frequent = counted.groupBy("prefix").agg(F.sum("n").alias("n")).filter(F.col("n") >= limit).select("prefix")
    # A few times the number of groups at most, because the counts of each length add up to all suffixes.
    frequent = np.sort(np.array([r[0] for r in frequent.collect()], np.int64).view(np.uint64))
    held = spark.sparkContext.broadcast(frequent)
    sent = by_block.applyInArrow(
        lambda key, t: _send(t, width, held.value, groups, key[0].as_py()),
        "grp bigint, bucket bigint, hashes binary, ids binary, counts binary",
    )
    answers = sent.repartition(partitions(spark), "grp").mapInArrow(_subtrees, "bucket bigint, grp bigint, later binary")
    kinds = "".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}, " for i in range(len(columns)))
    out = by_block.cogroup(answers.groupBy("bucket")).applyInArrow(
        lambda t, a: _remove(t, a, width, held.value, groups), kinds + "n_words bigint, n_removed bigint, kept string"
    )
    new = ["n_words", "n_removed", "kept"]
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns) if c.lower() not in new), *new)
