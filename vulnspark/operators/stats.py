"""Counts, summaries and distributions.

Every grouped count is a partial plus a final hash aggregate, so a value held by
a third of all rows costs one row per task. Reports over a fixed list of values
(dense counts, cross-tabs, key figures) are a single global aggregate without a
shuffle by key and without a join against the list.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnspark.functions.text import COLUMN_FORMATS, date_in, fixed, format_of, one_of_levels, strip


def value_counts(df: DataFrame, key: str, count: str = "n", dropna: bool = True) -> DataFrame:
    """Rows per value, most frequent first, ties by value."""
    rows = df.where(F.col(key).isNotNull()) if dropna else df
    return rows.groupBy(key).agg(F.count("*").alias(count)).orderBy(F.desc(count), key)


def top_values(df: DataFrame, key: str, k: int = 10, count: str = "n") -> DataFrame:
    return value_counts(df, key, count).limit(k)


def top_present(
    df: DataFrame, key: str, k: int = 10, missing: str = "N/A", count: str = "n"
) -> DataFrame:
    """Top values without the marker for missing ones."""
    return top_values(df.where(F.col(key) != missing), key, k, count)


def exploded_counts(
    df: DataFrame, key: str, separator: str = ", ", missing: str | None = "N/A", count: str = "n"
) -> DataFrame:
    """Split a list text, trim the parts and count them."""
    parts = df.select(F.explode(F.split(key, rf"\Q{separator}\E")).alias(key)).select(
        strip(F.col(key)).alias(key)
    )
    if missing is not None:
        parts = parts.where(F.col(key) != missing)
    return value_counts(parts, key, count)


def ordered_counts(
    df: DataFrame, key: str, display_order: Sequence[str], count: str = "n"
) -> DataFrame:
    """Rows per value in a fixed display order, values outside it at the end."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(count))
    position = one_of_levels(F.col(key), display_order)
    return counts.orderBy(position.asc_nulls_last(), key)


def shares(df: DataFrame, key: str, count: str = "n", share: str = "share") -> DataFrame:
    """Rows per value and their part of the whole."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(count))
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(share, F.col(count) / total).orderBy(F.desc(count), key)


def mean_by(df: DataFrame, key: str, value: str, mean: str = "mean") -> DataFrame:
    """Mean per group; a null key is a group, groups without any value are left out."""
    means = df.groupBy(key).agg(F.avg(value).alias(mean))
    return means.where(F.col(mean).isNotNull()).orderBy(F.desc(mean), key)


def dense_counts(
    df: DataFrame, key: str | Column, domain: Sequence[str], name: str = "value", count: str = "n"
) -> DataFrame:
    """Rows per value of a fixed domain, zero where there is none."""
    column = F.col(key) if isinstance(key, str) else key
    cells = df.agg(*[F.count_if(column == v).alias(f"_{i}") for i, v in enumerate(domain)])
    rows = [
        F.struct(F.lit(v).alias(name), F.col(f"_{i}").alias(count)) for i, v in enumerate(domain)
    ]
    return cells.select(F.inline(F.array(*rows)))


def dense_crosstab(
    df: DataFrame,
    row: Column,
    col: Column,
    row_domain: Sequence[str],
    col_domain: Sequence[str],
    row_name: str = "row",
    col_name: str = "col",
    count: str = "n",
) -> DataFrame:
    """Rows per pair of two short fixed domains, zero where there is none."""
    pairs = [(r, c) for r in row_domain for c in col_domain]
    projected = df.select(row.alias("_r"), col.alias("_c"))
    cells = projected.agg(
        *[
            F.count_if((F.col("_r") == r) & (F.col("_c") == c)).alias(f"_{i}")
            for i, (r, c) in enumerate(pairs)
        ]
    )
    rows = [
        F.struct(F.lit(r).alias(row_name), F.lit(c).alias(col_name), F.col(f"_{i}").alias(count))
        for i, (r, c) in enumerate(pairs)
    ]
    return cells.select(F.inline(F.array(*rows)))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column (empty text is not null)."""
    names = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(n).isNull()).alias(f"_{i}") for i, n in enumerate(names)])
    rows = [
        F.struct(F.lit(n).alias("column"), F.col(f"_{i}").alias("nulls"))
        for i, n in enumerate(names)
    ]
    return counts.select(F.inline(F.array(*rows)))


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def preview(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """The first rows in order."""
    return df.orderBy(*order).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """Number of rows, and the column names."""
    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(", ".join(df.columns)).alias("columns")
    )


def summary(df: DataFrame, means: Mapping[str, str]) -> DataFrame:
    """Row count and the means of the given columns (alias -> column)."""
    return df.agg(
        F.count("*").alias("rows"), *[F.avg(c).alias(alias) for alias, c in means.items()]
    )


def key_figures(
    df: DataFrame, severity: str, score: str, levels: Sequence[str] = ("Critical", "High", "Medium")
) -> DataFrame:
    """Total, rows per level and the mean score as text with one decimal or ``N/A``."""
    return df.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(severity) == x).alias(x.lower()) for x in levels],
        F.coalesce(fixed(F.avg(score), 1), F.lit("N/A")).alias("mean_score"),
    )


def timeline(df: DataFrame, day: Column, name: str = "day", count: str = "n") -> DataFrame:
    """Rows per day in order of the days; rows without a day are left out."""
    days = df.select(day.alias(name)).where(F.col(name).isNotNull())
    return days.groupBy(name).agg(F.count("*").alias(count)).orderBy(name)


def with_inferred_days(
    df: DataFrame, value: str, order: Sequence[str], name: str = "day", formats: Sequence[str] = COLUMN_FORMATS
) -> DataFrame:
    """Add the day of a text column whose format its own values decide.

    The first value in ``order`` that fits a format settles it for the whole column;
    texts in another format have no day, even where they could be read. The format is one
    number, found by one aggregate and met by broadcast.
    """
    text = F.col(value)
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])
    chosen = df.select(format_of(text, formats).alias("which"), place.alias("place")).where("which IS NOT NULL")
    chosen = chosen.agg(F.min_by("which", "place").alias("_which"))
    return df.join(F.broadcast(chosen)).withColumn(name, date_in(text, F.col("_which"), formats)).drop("_which")


def any_null(df: DataFrame, value: Column, name: str = "any_null") -> DataFrame:
    return df.agg(F.coalesce(F.bool_or(value.isNull()), F.lit(False)).alias(name))


def histogram(
    df: DataFrame, value: str, width: float = 0.5, low: float = 0.0, high: float = 10.0
) -> DataFrame:
    """Rows per equal bin; every value that is a number is counted.

    The bins start at ``low`` and go on at both ends as far as there are values; the
    value ``high`` itself belongs to the last bin below it. Bins without rows are left out,
    as are nulls and NaN; the infinities have bins of their own.
    """
    x = F.col(value).cast("double")
    cell = F.floor((x - F.lit(float(low))) / F.lit(float(width))).cast("double")
    index = F.when(F.abs(x) == float("inf"), x).when(x == float(high), F.lit(round((high - low) / width) - 1.0)).otherwise(cell)
    counts = (
        df.where(x.isNotNull() & ~F.isnan(x))
        .groupBy(index.alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    start = F.lit(float(low)) + F.col("bin") * F.lit(float(width))
    return counts.select(start.alias("bin_start"), "n").orderBy("bin_start")


def fitted_histogram(df: DataFrame, value: str, most: int = 20) -> DataFrame:
    """Rows per equal bin, at most ``most`` bins of a round width that the range of the values decides.

    The width is the smallest of 1, 2 or 5 times a power of ten for which the bins, which begin at
    multiples of it, are no more than ``most``; the largest value belongs to the last bin even on
    its edge. Every finite value is counted; bins without rows are left out. One plan: the
    range is one row, which meets the rows by broadcast.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & (F.abs(x) < float("inf"))).select(x.alias("x"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    power = F.pow(F.lit(10.0), F.floor(F.log10((F.col("hi") - F.col("lo")) / most)))
    widths = F.transform(F.array(*(F.lit(w) for w in (1.0, 2.0, 5.0, 10.0, 20.0))), lambda w: w * power)
    fits = F.filter(widths, lambda w: F.ceil(F.col("hi") / w) - F.floor(F.col("lo") / w) <= most)
    width = F.when(F.col("hi") > F.col("lo"), F.get(fits, F.lit(0))).otherwise(1.0)
    ends = ends.withColumn("width", width)
    first, last = F.floor(F.col("lo") / F.col("width")), F.ceil(F.col("hi") / F.col("width")) - 1
    index = F.greatest(F.least(F.floor(F.col("x") / F.col("width")), last), first)
    bins = rows.join(F.broadcast(ends)).groupBy((index.cast("double") * F.col("width")).alias("bin_start"), F.col("width").alias("bin_width"))
    return bins.agg(F.count("*").alias("n")).orderBy("bin_start")


def at_least(df: DataFrame, value: str, limits: Sequence[float]) -> DataFrame:
    """Rows at or above each limit."""
    return df.agg(
        *[
            F.count_if(F.col(value) >= F.lit(float(x))).alias(f"at_least_{x:g}".replace(".", "_"))
            for x in limits
        ]
    )


QUARTILES = (0.25, 0.5, 0.75)


def describe(
    df: DataFrame, value: str, quantiles: Sequence[float] = QUARTILES, accuracy: int = 20_000
) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quantiles, maximum; NaN counts as the largest value.

    Quantiles interpolate linearly between the two neighbours in rank. Two scans: the first
    also keeps a mergeable sketch of ``accuracy`` that brackets each wanted rank between two
    values; the second counts what lies below each bracket, and every value in one. Only
    these, some parts in ``accuracy`` of the rows, are sorted to find the ranks. Up to
    ``accuracy`` rows the bracket is the whole range.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull()).select(x.alias("v"))
    quantiles = sorted(float(q) for q in quantiles)
    many = len(quantiles)
    # The sketch is off by one part in ``accuracy`` at most; neighbours in rank add one row.
    margin = 4 / accuracy
    ends = [max(0.0, q - margin) for q in quantiles] + [min(1.0, q + margin) for q in quantiles]
    sketch = F.percentile_approx("v", ends, accuracy)
    first = rows.agg(
        F.count("*").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"),
        F.max("v").alias("max"), sketch.alias("ends"),
    )
    few = F.col("count") <= accuracy
    lo = F.when(few, F.transform(F.slice("ends", 1, many), lambda e: F.col("min"))).otherwise(F.slice("ends", 1, many))
    hi = F.when(few, F.transform(F.slice("ends", 1, many), lambda e: F.col("max"))).otherwise(F.slice("ends", many + 1, many))
    first = first.withColumns({"lo": lo, "hi": hi}).drop("ends")

    # Rows outside all brackets are counted between them, rows inside by their value.
    marked = rows.join(F.broadcast(first.select("lo", "hi")))
    inside = F.exists(F.arrays_zip("lo", "hi"), lambda b: (F.col("v") >= b["lo"]) & (F.col("v") <= b["hi"]))
    above = F.size(F.filter("lo", lambda b: b > F.col("v")))
    marked = marked.withColumns({"inside": inside, "above": above})
    counted = marked.groupBy(F.when(F.col("inside"), F.col("v")).alias("v"), "above").agg(F.count("*").alias("n"))

    # Per bracket: the rank at which each of its values begins.
    numbers = F.sequence(F.lit(0), F.lit(many - 1))
    spread = counted.join(F.broadcast(first.select("lo", "hi", "count"))).withColumn("i", F.explode(numbers))
    below = F.col("above") >= many - F.col("i")
    within = F.col("v").isNotNull() & (F.col("v") >= F.get("lo", F.col("i"))) & (F.col("v") <= F.get("hi", F.col("i")))
    kept = spread.where(below | within).select("i", "n", "count", F.when(within & ~below, F.col("v")).alias("v"))
    # All that lies below a bracket becomes one row, which comes first.
    kept = kept.groupBy("i", "v").agg(F.sum("n").alias("n"), F.max("count").alias("count"))
    earlier = Window.partitionBy("i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = kept.withColumn("at", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    position = F.get(F.lit(quantiles), F.col("i")) * (F.col("count") - 1)

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("at")) & (rank < F.col("at") + F.col("n")), F.col("v")))

    found = ranked.withColumn("p", position).groupBy("i").agg(
        value_at(F.floor("p")).alias("lower"), value_at(F.ceil("p")).alias("upper"), F.max(F.col("p") - F.floor("p")).alias("part")
    )
    exact = F.col("lower") + (F.col("upper") - F.col("lower")) * F.col("part")
    row = found.agg(*(F.max(F.when(F.col("i") == i, exact)).alias(f"p{q * 100:g}") for i, q in enumerate(quantiles)))
    # Squares that overflow leave no number; the deviation of finite values is then beyond all.
    overflow = F.isnan("std") & (F.abs("min") < float("inf")) & (F.abs("max") < float("inf"))
    first = first.withColumn("std", F.when(overflow, float("inf")).otherwise(F.col("std")))
    return first.join(F.broadcast(row)).select("count", "mean", "std", "min", *row.columns, "max")
