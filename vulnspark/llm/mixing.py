"""Mix the sources of a corpus to target weights, block by block.

The words of a source, document after document, are packed into blocks of fixed length.
Each output shard draws from a multinomial how many of its slots every source gets. A
source's slots, counted over all shards, run through pseudorandom permutations of its
blocks, one permutation per pass over the source, and meet the blocks by index.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnspark.llm.common import col, mixed, stored
from vulnspark.llm.running import attach, running

WORD = r"[^\x20\x09-\x0D]+"

# Sources that one task draws for in one step.
BUNDLE = 1 << 16


@dataclass(frozen=True)
class Settings:
    """``weights``: dealt to the sources in their order, again and again; ``most``: how often
    a word may be taken; ``block``: words per block; ``slots``: blocks per output shard."""

    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    block: int = 512
    slots: int = 4096
    seed: int = 12


# -- permutations of block indexes ------------------------------------------------


def _network(x: np.ndarray, half: np.ndarray, key: np.ndarray, backward: bool) -> np.ndarray:
    """One pass of a balanced Feistel network of four rounds over 2 * half bits, or its inverse."""
    mask = (np.uint64(1) << half) - np.uint64(1)
    left, right = x >> half, x & mask
    for turn in (3, 2, 1, 0) if backward else (0, 1, 2, 3):
        if backward:
            left, right = right ^ (mixed(left + key + np.uint64(turn * 0x9E3779B9)) & mask), left
        else:
            left, right = right, left ^ (mixed(right + key + np.uint64(turn * 0x9E3779B9)) & mask)
    return (left << half) | right


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, backward: bool = False) -> np.ndarray:
    """Where ``index`` goes in the permutation of 0 to size - 1 that ``key`` names; ``backward`` finds where from.

    The network permutes the next power of four; what leaves 0 to size - 1 goes through
    again until it is back, which keeps it a permutation.
    """
    size, key = size.astype(np.uint64), key.astype(np.uint64)
    bits = np.frexp(np.maximum(size.astype(np.float64) - 1, 1))[1]
    half = np.maximum((bits + 1) // 2, 1).astype(np.uint64)
    at = _network(index.astype(np.uint64), half, key, backward)
    out = np.flatnonzero(at >= size)
    while len(out):
        at[out] = _network(at[out], half[out], key[out], backward)
        out = out[at[out] >= size[out]]
    return at.astype(np.int64)


def _pass_key(key: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return mixed(key.view(np.uint64) + turn.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def _numpy(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


# -- sources and targets ----------------------------------------------------------


def targets(sources: DataFrame, settings: Settings) -> DataFrame:
    """Add ``number`` and ``target`` to (none, source, source_size), one row per source.

    Every source wants its weight's share of all sizes, at most ``most`` times its own; what is
    over is shared among the others by weight until none is above. All sources below
    their bound then get one and the same amount per weight. In the order in which the
    bounds are reached, it is the first amount that does not reach the next bound.
    """
    kinds = F.lit(list(settings.weights))
    ranked = running(sources, [], ["none", "source"], {"number": F.lit(1)}, "sources")
    ranked = ranked.withColumn("weight", F.get(kinds, F.col("number") % len(settings.weights)))
    ranked = stored(ranked.withColumn("bound", F.col("source_size") * settings.most / F.col("weight")), "ranked")
    everything, weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    reached = running(ranked, [], ["bound", "number"], {"full": F.col("source_size"), "gone": F.col("weight")}, "bounds")
    level = (F.lit(everything) - settings.most * F.col("full")) / (F.lit(weights) - F.col("gone"))
    first = reached.withColumn("level", level).filter("level <= bound").agg(F.min(F.struct("bound", "number", "level")).alias("at")).first()
    level = first["at"]["level"] if first["at"] is not None else 0.0
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), (F.col("source_size") * settings.most).cast("double")))


def _passes(sources: DataFrame, settings: Settings) -> DataFrame:
    """Per source: its blocks, the words of the last one, whole passes, the words of the pass after, and its slots."""
    block = settings.block
    words = F.least(F.round("target").cast("long"), F.col("source_size") * settings.most)
    rows = sources.filter("source_size > 0").select(
        "none", "source", "number", F.xxhash64(F.lit(settings.seed), "none", "source").alias("key"),
        F.ceil(F.col("source_size") / block).alias("blocks"), F.col("source_size").alias("size"), words.alias("words"),
    )

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, blocks, size, words = _numpy(batch, "key", "blocks", "size", "words")
            last = size - (blocks - 1) * block
            whole, rest = words // size, words % size
            short = permuted(blocks - 1, blocks, _pass_key(key, whole), backward=True)
            more = -(-rest // block)
            # With the short block among them, the same number of blocks may hold too little.
            more += (short < more) & (more * block - (block - last) < rest)
            made = [key, blocks, last, whole, rest, whole * blocks + more]
            names = ["none", "source", "number", "key", "blocks", "last", "whole", "rest", "n"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), *map(pa.array, made)], names)

    schema = "none boolean, source string, number long, key long, blocks long, last long, whole long, rest long, n long"
    return rows.mapInArrow(plan, schema)


# -- drawing ----------------------------------------------------------------------


def _draw(sources: DataFrame, settings: Settings) -> DataFrame:
    """(shard, number, start, count): the slots of every source in every shard.

    All shards but the last ones draw independently from one multinomial. A draw for very many
    sources goes in two steps, which come to the same: for bundles of sources, then within
    each. What a source has drawn beyond its slots falls away; what it still lacks comes in
    further shards, so that every source takes exactly what it should.
    """
    spark = sources.sparkSession
    bundles = sources.groupBy(F.floor(F.col("number") / BUNDLE).alias("bundle")).agg(
        F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("number", "n"))).alias("members")
    )
    sums = sorted(tuple(r) for r in bundles.select("bundle", "total").collect())  # one per 65,536 sources
    total = sum(n for _, n in sums)
    seed, slots = settings.seed, settings.slots
    shards = -(-total // slots)
    names, parts = np.array([b for b, _ in sums], np.int64), np.array([n for _, n in sums], np.float64)

    def rough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                wanted = min(slots, total - shard * slots)
                counts = np.random.default_rng([seed, shard]).multinomial(wanted, parts / parts.sum())
                some = np.flatnonzero(counts)
                columns = [np.full(len(some), shard), names[some], counts[some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "bundle", "drawn"])

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array([m["n"] for m in row["members"]], np.float64)
                rng = np.random.default_rng([seed, row["shard"], row["bundle"], 1])
                counts = rng.multinomial(row["drawn"], n / n.sum())
                some = np.flatnonzero(counts)
                number = np.array([m["number"] for m in row["members"]], np.int64)[some]
                columns = [np.full(len(some), row["shard"]), number, counts[some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "number", "drawn"])

    by_bundle = spark.range(shards).mapInArrow(rough, "shard long, bundle long, drawn long")
    drawn = by_bundle.join(bundles.select("bundle", "members"), "bundle").select("shard", "bundle", "drawn", "members")
    drawn = stored(drawn.mapInArrow(fine, "shard long, number long, drawn long"), "drawn")

    earlier = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = drawn.withColumn("start", F.coalesce(F.sum("drawn").over(earlier), F.lit(0).cast("long")))
    bounded = places.join(sources.select("number", "n"), "number").withColumn("count", F.least("drawn", F.col("n") - F.col("start")))
    used = drawn.groupBy("number").agg(F.sum("drawn").alias("used"))
    lacking = sources.join(used, "number", "left").withColumn("used", F.coalesce("used", F.lit(0).cast("long"))).filter("used < n")
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - F.col("used") - 1) / slots))
    late = lacking.select("number", "n", "used", F.explode(pieces).alias("piece")).withColumn("start", F.col("used") + F.col("piece") * slots)
    late = late.withColumn("count", F.least(F.lit(slots).cast("long"), F.col("n") - F.col("start")))
    return bounded.filter("count > 0").select("shard", "number", "start", "count").unionByName(
        late.select((F.col("piece") + shards).alias("shard"), "number", "start", "count")
    )


def _slots(sources: DataFrame, spans: DataFrame, settings: Settings) -> DataFrame:
    """(shard, number, slot, turn, block, words): which block each slot takes, and how many of its words."""
    length = settings.block

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, key, blocks, last, whole, rest = _numpy(batch, "slot", "key", "blocks", "last", "whole", "rest")
            turn, at = slot // blocks, slot % blocks
            keys = _pass_key(key, turn)
            block = permuted(at, blocks, keys)
            words = np.where(block == blocks - 1, last, length)
            ending = np.flatnonzero(turn == whole)
            if len(ending):
                short = permuted(blocks[ending] - 1, blocks[ending], keys[ending], backward=True)
                before = at[ending] * length - (short < at[ending]) * (length - last[ending])
                words[ending] = np.clip(rest[ending] - before, 0, words[ending])
            made = [slot, turn, block, words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("number"), *(pa.array(m, pa.int64()) for m in made)],
                ["shard", "number", "slot", "turn", "block", "words"],
            )

    each = spans.join(sources.select("number", "key", "blocks", "last", "whole", "rest"), "number")
    last = F.col("start") + F.col("count") - 1
    each = each.withColumn("slot", F.explode(F.sequence("start", last))).drop("start", "count")
    return each.mapInArrow(choose, "shard long, number long, slot long, turn long, block long, words long").filter("words > 0")


@dataclass(frozen=True)
class Mix:
    """``documents``: the kept columns, size, source_size, target, number (of the source) and start
    (of the document among the source's words). ``slots``: (shard, number, slot, turn, block, words).
    ``pieces``: (shard, number, slot, start, first, length), the words each slot takes of each
    document of its block, counted from the document's first; (number, start) names a document."""

    documents: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """The documents with ``taken``: how many words the mix takes of each, repeats counted."""
        counted = self.pieces.groupBy("number", "start").agg(F.sum("length").alias("taken"))
        columns = self.documents.columns
        # Documents without a word share their start with the next one.
        filled = (F.col("size") > 0).alias("filled")
        rows = self.documents.select(F.struct(*map(col, columns)).alias("doc"), "number", "start", filled)
        found = rows.join(counted.withColumn("filled", F.lit(True)), ["number", "start", "filled"], "left")
        return found.select(*(F.col("doc").getField(c).alias(c) for c in columns), F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mix(
    docs: DataFrame, keep: Sequence[str] = (), doc_id: str = "doc_id", text: str = "text", source: str = "source",
    settings: Settings = Settings(),
) -> Mix:
    """Draw a mix of all documents in which every source has its target of words.

    Null and empty texts have no word and take no part; a null source is a source of its own,
    after all others. Documents stand in their source by id (null first) and the hash of their
    text, so reruns agree; rows alike in both are documents of their own, one after the other.
    An empty table gives empty ones. A kept column with the name of a new one is replaced by it.
    """
    new = {"size", "source_size", "target", "number", "start", "taken"}
    kept = [c for c in keep if c.lower() not in new]
    rows = docs.select(
        *(col(c).alias(f"k{i}") for i, c in enumerate(kept)), col(source).isNull().alias("none"),
        F.coalesce(col(source).cast("string"), F.lit("")).alias("source"), col(doc_id).alias("id"), F.xxhash64(col(text)).alias("x"),
        F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    placed = stored(running(rows, ["none", "source"], ["id", "x"], {"start": F.col("size")}, "documents"), "placed")
    sums = placed.groupBy("none", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = stored(targets(stored(sums, "sums"), settings), "targets")

    wanted = sources.select("none", "source", "number", "source_size", "target", "rows")
    n_rows = sources.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    documents = attach(placed, wanted, ["none", "source"], "rows", n_rows)
    documents = stored(
        documents.select(*(f"k{i}" for i in range(len(kept))), "size", "source_size", "target", "number", "start"), "documents"
    )

    plan = stored(_passes(sources, settings), "passes")
    slots = stored(_slots(plan, _draw(plan, settings), settings), "slots")

    block = settings.block
    end = F.col("start") + F.col("size")
    held = documents.filter("size > 0").select(
        "number", "start", end.alias("end"),
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"),
    )
    lo = F.greatest("start", F.col("block") * block)
    hi = F.least("end", F.col("block") * block + F.col("words"))
    met = slots.join(held, ["number", "block"]).withColumns({"first": lo - F.col("start"), "length": hi - lo})
    pieces = met.filter("length > 0").select("shard", "number", "slot", "start", "first", "length")
    documents = documents.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)), "size", "source_size", "target", "number", "start")
    return Mix(documents, slots, pieces)
