"""Shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vulnspark.llm.common import col, stored

_CELL_BITS = 13
_STRETCH = 4096


def _place(*parts: Column | str) -> Column:
    """A place on the ring, 0 to 2^63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 1)


def _ring(spark: SparkSession, shards: int, replicas: int) -> DataFrame:
    """One row per arc: the stretch (lo, hi] before a virtual node, and the node's shard.

    The ring has shards * replicas nodes, whatever the input.
    """
    nodes = spark.range(shards * replicas).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        _place(F.lit("node"), F.col("id") % shards, F.floor(F.col("id") / shards)).alias("hi"),
    )
    ordered = W.orderBy("hi", "shard")
    arcs = nodes.select(
        (F.row_number().over(ordered) - 1).alias("arc"), "shard", F.lag("hi", 1, -1).over(ordered).alias("lo"), "hi"
    )
    # What lies behind the last node belongs to the first.
    last = arcs.agg(F.max("hi").alias("lo")).select(F.lit(0).alias("arc"), "lo", F.lit((1 << 63) - 1).alias("hi"))
    first = arcs.filter("arc = 0").select("arc", "shard")
    return arcs.unionByName(last.join(first, "arc").select("arc", "shard", "lo", "hi"))


def _on_arcs(keys: DataFrame, ring: DataFrame) -> DataFrame:
    """Find each key's arc through equal cells of the ring; a cell meets one or two arcs."""
    shift = 63 - _CELL_BITS
    cells = ring.select(
        "arc", "lo", "hi",
        F.explode(F.sequence(F.shiftright(F.greatest("lo", F.lit(0)), shift), F.shiftright("hi", shift))).alias("cell"),
    )
    at = keys.withColumn("cell", F.shiftright("place", shift))
    return at.join(F.broadcast(cells), "cell").filter("place > lo AND place <= hi").drop("cell", "lo", "hi")


def _walk(loads: DataFrame, shards: int, slack: float) -> DataFrame:
    """Ranges of the ranks on each arc and the shard that takes them.

    A shard takes the keys of its own arcs in ring order up to its capacity. What is
    left goes on clockwise, first come first served, and each shard on the way takes
    what it has room for; after two rounds nothing is left, because the capacities
    add up to the number of keys at least. Everything here has one row per arc, shard
    or range, a number that the ring alone bounds.
    """
    exact = F.floor(F.col("total") / shards) + F.when(F.col("shard") < F.col("total") % shards, 1).otherwise(0)
    capacity = F.greatest(exact, F.ceil(F.col("total") * (1 + slack) / shards)) if slack > 0 else exact
    before = F.sum("load").over(W.partitionBy("shard").orderBy("arc")) - F.col("load")
    arcs = (
        loads.withColumn("total", F.sum("load").over(W.partitionBy(F.lit(0))))
        .withColumn("capacity", capacity.cast("long"))
        .withColumn("home", F.least("load", F.greatest(F.col("capacity") - before, F.lit(0))))
        .withColumn("over", F.col("load") - F.col("home"))
    )
    room = F.col("capacity") - F.sum("home").over(W.partitionBy("shard"))
    rounds = arcs.withColumn("room", room).agg(
        F.array_sort(F.collect_list(F.struct("arc", "shard", "over"))).alias("lap"),
        F.transform(F.array_sort(F.collect_set(F.struct("shard", "room"))), lambda x: x["room"]).alias("rooms"),
    )
    second = F.transform("lap", lambda x: F.struct(x["arc"].alias("arc"), x["shard"].alias("shard"), F.lit(0).cast("long").alias("over")))

    def visit(state, arc):
        waiting = state["waiting"] + arc["over"]
        taken = F.least(waiting, F.get(state["rooms"], arc["shard"]))
        return F.struct(
            F.when(
                taken > 0,
                F.transform(state["rooms"], lambda r, i: F.when(i == arc["shard"], r - taken).otherwise(r)),
            ).otherwise(state["rooms"]).alias("rooms"),
            (waiting - taken).alias("waiting"),
            F.when(
                taken > 0,
                F.array_append(state["taken"], F.struct(arc["shard"].alias("shard"), taken.alias("length"))),
            ).otherwise(state["taken"]).alias("taken"),
        )

    start = F.struct(
        F.col("rooms").alias("rooms"), F.lit(0).cast("long").alias("waiting"),
        F.array().cast("array<struct<shard:int,length:bigint>>").alias("taken"),
    )
    taken = rounds.select(F.posexplode(F.aggregate(F.concat("lap", second), start, visit, lambda s: s["taken"])))
    taken = taken.select("pos", "col.shard", "col.length")
    taken = taken.select(
        (F.sum("length").over(W.orderBy("pos")) - F.col("length")).alias("at"),
        F.lit(None).cast("int").alias("arc"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("end"),
        "shard",
    )
    left = arcs.filter("over > 0").select(
        (F.sum("over").over(W.orderBy("arc")) - F.col("over")).alias("at"), "arc", F.col("home").alias("first"), "over"
    )
    left = left.select("at", "arc", "first", (F.col("at") + F.col("over")).alias("end"), F.lit(None).cast("int").alias("shard"))
    # Both lists cut the same line of waiting keys; their cuts together give the ranges.
    line = W.orderBy("at")
    filled = line.rowsBetween(W.unboundedPreceding, 0)
    cuts = left.unionByName(taken).groupBy("at").agg(*(F.max(c).alias(c) for c in ("arc", "first", "end", "shard")))
    began = F.last(F.when(F.col("arc").isNotNull(), F.col("at")), True).over(filled)
    moved = cuts.select(
        F.last("arc", True).over(filled).alias("arc"),
        (F.last("first", True).over(filled) + F.col("at") - began).alias("lo"),
        (F.coalesce(F.lead("at").over(line), F.last("end", True).over(filled)) - F.col("at")).alias("length"),
        F.last("shard", True).over(filled).alias("shard"),
    )
    ranges = moved.unionByName(arcs.filter("home > 0").select("arc", F.lit(0).cast("long").alias("lo"), F.col("home").alias("length"), "shard"))
    base = F.sum("length").over(W.partitionBy("shard").orderBy("arc", "lo")) - F.col("length")
    return ranges.select("arc", "lo", (F.col("lo") + F.col("length")).alias("hi"), "shard", base.alias("base"))


def ring_shards(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    replicas: int = 128,
    slack: float = 0.0,
) -> DataFrame:
    """Give every row a shard and a slot: id, size, text_crc32, shard, slot.

    A row's place on the ring follows from its id, its text's size and checksum, and
    its number among equal rows, so that one id or one text that fills the table
    spreads over the ring. A shard holds at most its capacity: ``(1 + slack)`` times
    the mean, or, with no slack, the mean rounded down or up, so that counts are at
    most one apart. Slots count from 0 in each shard without gaps.

    A null text has no bytes and the checksum of an empty one; null ids are a value
    like any other; other columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    key = ["id", "size", "text_crc32"]
    equal = rows.groupBy(*key).count()
    # Equal rows are numbered in stretches; the stretches of a row that is there very often are dealt out first.
    stretches = F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / _STRETCH))
    often = equal.filter(F.col("count") > _STRETCH).withColumn("stretch", F.explode(stretches)).repartition(*key, "stretch")
    seldom = equal.filter(F.col("count") <= _STRETCH).withColumn("stretch", F.lit(0).cast("long"))
    first = F.col("stretch") * _STRETCH + 1
    copies = F.sequence(first, F.least(F.col("count"), first + (_STRETCH - 1)))
    keys = seldom.unionByName(often).select(*key, F.explode(copies).alias("copy"))
    keys = keys.withColumn("place", _place(F.lit("key"), *key, "copy"))
    ring = _ring(docs.sparkSession, shards, replicas)
    keys = stored(_on_arcs(keys, ring), "ring_keys")
    loads = (
        ring.groupBy("arc", "shard").agg(F.lit(0).cast("long").alias("none"))
        .join(keys.groupBy("arc").agg(F.count("*").alias("load")), "arc", "left")
        .select("arc", "shard", F.coalesce("load", "none").alias("load"))
    )
    ranges = stored(_walk(stored(loads, "ring_loads"), shards, slack), "ring_ranges")
    ranked = keys.withColumn(
        "rank", (F.row_number().over(W.partitionBy("arc").orderBy("place", "id", "size", "text_crc32", "copy")) - 1).cast("long")
    )
    placed = ranked.join(F.broadcast(ranges), "arc").filter("rank >= lo AND rank < hi")
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot")
    )
