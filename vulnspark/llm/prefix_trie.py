"""The trie of conversations, built from whole sequences.

Identical conversations collapse to one weighted sequence first; the prefixes of the
sequences, not of the conversations, are then summed up to nodes. A node is known by its
depth and two 64-bit hashes of its turns. Rows are (conversation, turn) throughout: no
step holds a whole conversation, a whole group of equal ones or the children of a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnspark.llm.common import bound_batches, col, discard, stored
from vulnspark.llm.running import BLOCK, attach, running, running_in_blocks

WORD = r"[^\x20\x09-\x0D]+"

_NODE = ["depth", "a", "b"]
_ID_BITS = 16


def numbered_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, place, digest, words): the turns of each conversation from 1 on, by ``turn``, null first.

    Null roles and texts count as empty. Turns of one number come in the order of their
    digests, equal rows count as often as they are there. Rows without a conversation's
    id belong to none and are left out. A conversation of any length is numbered by
    ranges, not in one task.
    """
    who, said = (F.coalesce(col(c), F.lit("")) for c in (role, text))
    rows = turns.filter(col(conv).isNotNull()).select(
        col(conv).cast("long").alias("conv"), col(turn).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said))).alias("digest"),
        F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"),
    )
    placed = running(rows, ["conv"], [F.col("turn").asc_nulls_first(), "digest"], {"before": F.lit(1)}, "turns")
    return stored(placed.select("conv", (F.col("before") + 1).alias("place"), "digest", "words"), "places")


def _blocks(conversations: DataFrame, last: str, *names: str) -> DataFrame:
    """One row per conversation and block of places up to ``last``."""
    numbers = F.sequence(F.lit(0).cast("long"), F.floor(F.col(last) / BLOCK))
    return conversations.select("conv", *names, F.explode(numbers).alias("block"))


def borrow_turns(rows: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Give every conversation the first turns of another one in place of its own.

    ``base`` and ``head`` are expressions over ``conv``: whose turns, and how many (at most
    ``most``). The conversation then holds the first ``head`` turns of its base, as far as
    there are any, and its own turns after its first ``head``. Returns (conv, place, digest,
    words, length) and (conv, length), which has the conversations that are left without a turn.
    How many share a base is up to ``base``; the caller keeps it small.
    """
    lengths = rows.groupBy("conv").agg(F.max("place").alias("had"))
    plan = lengths.select("conv", "had", base.alias("base"), head.cast("long").alias("head"))
    lent = lengths.select(F.col("conv").alias("base"), F.least("had", F.lit(most)).alias("lent"))
    got = F.least("head", F.coalesce("lent", F.lit(0)))
    plan = plan.join(lent, "base", "left").withColumn("got", got)
    plan = stored(plan.withColumn("length", F.col("got") + F.greatest(F.col("had") - F.col("head"), F.lit(0))), "lengths")

    own = rows.withColumn("block", F.floor(F.col("place") / BLOCK)).join(
        _blocks(plan, "had", "head", "got", "length"), ["conv", "block"]
    ).filter("place > head")
    own = own.select("conv", (F.col("place") - F.col("head") + F.col("got")).alias("place"), "digest", "words", "length")
    first = rows.filter(F.col("place") <= most).withColumnRenamed("conv", "base")
    borrowed = plan.filter("got > 0").join(first, "base").filter("place <= got")
    whole = own.unionByName(borrowed.select("conv", "place", "digest", "words", "length"))
    return whole, plan.select("conv", "length")


def _prefixes(rows: DataFrame) -> DataFrame:
    """(conv, length, words, depth, a, b) and the node before as (pa, pb), for every turn.

    The hash of a prefix is the exclusive or of its turns' hashes, each of which depends on
    the turn's place; so prefixes of any length are summed up in blocks.
    """
    lanes = rows.select(
        "conv", "length", "words", F.col("place").alias("depth"),
        F.xxhash64("place", "digest").alias("x"), F.xxhash64(F.lit("second"), "place", "digest").alias("y"),
    )
    lanes = stored(lanes, "lanes")
    summed = running_in_blocks(
        lanes, ["conv"], F.col("depth"), {"a": F.col("x"), "b": F.col("y")}, F.bit_xor, lambda p, q: p.bitwiseXOR(q)
    )
    out = summed.select(
        "conv", "length", "words", *_NODE, F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb")
    )
    out = stored(out, "prefixes")
    discard(lanes)
    return out


def _end_lists(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the ids that end at a node, ascending and joined by commas.

    Ids are listed in blocks of 2^16 neighbouring ids; the lists of a node, in order, run
    through its hash one after the other, so that a task holds one list at a time.
    """
    block = F.shiftright("conv", _ID_BITS)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    lists = ends.groupBy(*_NODE, block.alias("block")).agg(listed.alias("ids"))
    schema = "depth long, a long, b long, ends_sha256 string"
    bound_batches(ends.sparkSession)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []

        def rows() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[], [], [], []]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*_NODE, "ends_sha256"])

        for batch in batches:
            for *node, ids in zip(*(batch.column(n).to_pylist() for n in [*_NODE, "ids"])):
                if node == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256()
                digest.update(ids.encode())
            yield rows()
            done = []
        if now is not None:
            done = [(*now, digest.hexdigest())]
            yield rows()

    ordered = lists.repartition(*_NODE).sortWithinPartitions(*_NODE, "block")
    return ordered.select(*_NODE, "ids").mapInArrow(digests, schema)


def trie(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node, from ``(conv, place, digest, words, length)`` and ``(conv, length)``.

    conv_id: the smallest member; depth; parent_conv_id (null for the root); n_convs;
    n_children; n_leaves: nodes without children at or below; saved_tokens: over the same
    nodes, (members - 1) times the words of the last turn; ends_sha256 of the ids that end here;
    ends: how many. No conversations, no nodes. Repeated conversations are members of their own.
    """
    prefixes = _prefixes(rows)
    none = [F.lit(0).cast("long").alias(n) for n in _NODE]
    ends = prefixes.filter("depth = length").select("conv", *_NODE).unionByName(
        conversations.filter("length = 0").select("conv", *none)
    )

    # Whole sequences with their weights; a sequence is a leaf unless it is a proper prefix of another.
    sequences = ends.groupBy(*_NODE).agg(F.count("*").alias("weight"), F.min("conv").alias("conv"))
    sequences = stored(sequences, "sequences")
    continued = prefixes.select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
    leaves = sequences.join(continued, _NODE, "left_anti").select("conv", F.lit(True).alias("leaf"))
    weighted = sequences.join(leaves, "conv", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False)))
    weighted = stored(weighted.select("conv", "weight", "leaf", F.col("depth").alias("last")), "weighted")

    # The prefixes of one conversation per sequence, and the root.
    place = prefixes.drop("length").withColumn("block", F.floor(F.col("depth") / BLOCK))
    along = place.join(_blocks(weighted, "last", "weight", "leaf"), ["conv", "block"]).drop("block")
    root = weighted.select("conv", "weight", "leaf", *none, F.lit(0).cast("long").alias("words"),
                           F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"))
    along = stored(along.unionByName(root), "along")

    nodes = along.groupBy(*_NODE).agg(
        F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count_if("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf"), F.col("conv"))).alias("owner"), F.min("words").alias("words"),
        F.min("pa").alias("pa"), F.min("pb").alias("pb"),
    )
    nodes = stored(nodes, "nodes")

    # A node's own saving is booked once, on the smallest of the leaf sequences through it.
    # Summed from the end of each sequence upward, and then over the sequences through a
    # node, the bookings at and below the node come out once each.
    own = ((F.col("n_convs") - 1) * F.col("words")).alias("own")
    booked = nodes.select(F.col("owner").alias("conv"), "depth", own).filter("own > 0")
    paths = along.filter("leaf").select("conv", *_NODE).join(booked, ["conv", "depth"], "left").fillna(0, ["own"])
    paths = stored(paths, "paths")
    upward = running_in_blocks(paths, ["conv"], -F.col("depth"), {"saved": F.col("own")}, F.sum, lambda p, q: p + q)
    saved = upward.groupBy(*_NODE).agg(F.sum("saved").alias("saved_tokens"))

    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")
    ).agg(F.count("*").alias("n_children"))
    ended = _end_lists(ends).join(sequences.select(*_NODE, F.col("weight").alias("ends")), _NODE)
    full = nodes.drop("owner", "words").join(saved, _NODE).join(children, _NODE, "left").join(ended, _NODE, "left")
    full = stored(full.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "full")

    # Every node looks up its parent; parents of very many children are broadcast.
    parents = full.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"),
                          F.col("conv_id").alias("parent_conv_id"), "n_children").filter("n_children > 0")
    below = attach(
        full.filter("depth > 0").withColumnRenamed("n_children", "children"), parents, ["depth", "pa", "pb"],
        "n_children", full.count(),
    ).withColumnRenamed("children", "n_children")
    top = full.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast(full.schema["conv_id"].dataType))
    out = below.unionByName(top).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.coalesce("ends", F.lit(0).cast("long")).alias("ends"),
    )
    discard(prefixes, sequences, weighted, along, nodes, paths)
    return out
