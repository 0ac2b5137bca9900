"""Running sums within groups of any size, and joins to tables with one row per key.

No step holds a whole group: rows are cut into ranges or blocks, each is summed up on
its own, and what lies before it is added.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnspark.llm.common import discard, partitions, stored

BLOCK = 1024

# A key is hot if it holds at least one part in HOT_KEYS of the rows: there are never more than HOT_KEYS.
HOT_KEYS = 1000


def running(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], values: Mapping[str, Column], name: str
) -> DataFrame:
    """Add, per entry of ``values``, the sum of the column over the rows before this one in its group.

    Rows are dealt by ranges of (group, order) and written, so that a group of a third of
    all rows lies in a third of the partitions. At most one group goes on from one
    partition to the next, so the sums to add are two rows per partition at most: they
    are broadcast. Group columns must hold no null. Rows of one group that are equal in
    ``order`` come in the order in which they are read.
    """
    spark = df.sparkSession
    within = [*groups, "_part"]
    sort = [*(F.col(c) if isinstance(c, str) else c for c in order), F.col("_tie")]
    # Written first: dealing by ranges reads its input twice, to sample it and to deal it.
    tied = stored(df.withColumn("_tie", F.monotonically_increasing_id()), name)
    dealt = tied.repartitionByRange(partitions(spark), *groups, *sort).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, name)
    discard(tied)

    before = Window.partitionBy(*within).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    here = dealt.withColumns({n: F.coalesce(F.sum(v).over(before), F.lit(0)).cast("long") for n, v in values.items()})

    totals = dealt.groupBy(*within).agg(*(F.sum(v).alias(f"_{n}") for n, v in values.items()))
    if groups:
        parts = F.count("*").over(Window.partitionBy(*groups))
        totals = totals.withColumn("_parts", parts).filter("_parts > 1").drop("_parts")
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*within, *(F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in values))
    found = here.join(F.broadcast(carried), within, "left")
    summed = {n: F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0)).cast("long") for n in values}
    return found.withColumns(summed).select(*df.columns, *values)


def running_in_blocks(
    df: DataFrame, groups: Sequence[str], place: Column, values: Mapping[str, Column],
    total: Callable[[Column | str], Column], add: Callable[[Column, Column], Column], neutral: int = 0,
) -> DataFrame:
    """Add, per entry of ``values``, its running total up to and including this row, by ``place`` in the group.

    ``place`` numbers the rows of a group without repeats, so a block of ``BLOCK`` places
    is a bounded set of rows whatever the size of the group. ``df`` is read twice.
    """
    cut = df.withColumns({"_place": place, "_block": F.floor(place / BLOCK)})
    within = [*groups, "_block"]
    so_far = Window.partitionBy(*within).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    here = cut.withColumns({n: total(v).over(so_far) for n, v in values.items()})

    blocks = cut.groupBy(*within).agg(*(total(v).alias(f"_{n}") for n, v in values.items()))
    many = F.count("*").over(Window.partitionBy(*groups))
    earlier = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocks.withColumn("_many", many).filter("_many > 1")
        .select(*within, *(total(f"_{n}").over(earlier).alias(f"_{n}") for n in values))
    )
    found = here.join(carried, within, "left")
    summed = {n: add(F.col(n), F.coalesce(F.col(f"_{n}"), F.lit(neutral))) for n in values}
    return found.withColumns(summed).select(*df.columns, *values)


def attach(rows: DataFrame, values: DataFrame, keys: Sequence[str], weight: str, n_rows: int) -> DataFrame:
    """Left join to a table with one row per key that knows how many rows a key has (``weight``).

    The keys of at least one part in ``HOT_KEYS`` of the ``n_rows`` rows, never more than
    ``HOT_KEYS``, are broadcast; the rest has no large key and is shuffled. ``rows`` is
    read twice. Key columns must hold no null.
    """
    hot = F.broadcast(values.filter(F.col(weight) * HOT_KEYS >= n_rows).drop(weight))
    tail = values.filter(F.col(weight) * HOT_KEYS < n_rows).drop(weight)
    names = hot.select(*keys)
    many = rows.join(hot, list(keys))
    few = rows.join(names, list(keys), "left_anti").join(tail, list(keys), "left")
    return many.unionByName(few)
