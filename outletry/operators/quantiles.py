"""Exact group quantiles that do not need a whole group in one place.

``percentile`` keeps every distinct value of a group in one aggregation buffer. That is right for
groups of bounded size (months of an outlet) and wrong for open ones (prices of a SKU, months of a
peer group), where one group may hold a third of all rows. Here the values are counted first, then
counted per narrow magnitude bucket, and only the few buckets holding a wanted rank are sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outletry.session import stage

#: Groups of at most this many values are sorted in one task.
SORTED_ROWS = 200_000


def magnitude_bucket(value: Column) -> Column:
    """Order-preserving coarse bucket of a double: the value rounded to four significant digits.

    That is about 9,000 buckets for every power of ten, below 1 as well as above, of either sign. Rounding
    decimal digits keeps the order and needs no statistics of the data, so every evaluation agrees. Null
    stays null.
    """
    return F.format_string("%.3e", value).try_cast("double")


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, float],
    count_as: str | None = None,
) -> DataFrame:
    """One row per key with each quantile of ``wanted`` (name -> fraction), linearly interpolated.

    Null values are left out. Groups without any value give no row. Keys must not be null.
    ``count_as`` names a column for the number of values.
    """
    keys = list(keys)
    constant = not keys
    if constant:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]

    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", magnitude_bucket(F.col("_v")))
    )

    # Running totals over buckets: the window sees bucket counts, never rows.
    per_key = Window.partitionBy(*keys)
    buckets = (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_upto", F.sum("_bn").over(per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_bn").over(per_key))
        .withColumn("_before", F.col("_upto") - F.col("_bn"))
    )
    positions = {name: q * (F.col("_total") - 1) for name, q in wanted.items()}
    ranks = F.array_distinct(
        F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in positions.values()]))
    )
    hit = buckets.withColumn(
        "_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_upto")))
    ).where(F.size("_ranks") > 0).select(
        *[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)],
        F.col("_b").alias("_hb"), "_before", "_total", "_ranks",
    )

    matched = F.col("_b") == F.col("_hb")
    for i, k in enumerate(keys):
        matched = matched & (F.col(k) == F.col(f"_h{i}"))
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counts.join(hit, matched)
        .withColumn("_end", F.col("_before") + F.sum("_n").over(in_bucket))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn(
            "_ranks", F.filter("_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_end")))
        )
        .where(F.size("_ranks") > 0)
    )

    def at(rank: Column) -> Column:
        return F.max(F.when(F.array_contains("_ranks", rank), F.col("_v")))

    edges = ranked.groupBy(*keys).agg(
        F.first("_total").alias("_total"),
        *[at(F.floor(p)).alias(f"_lo_{name}") for name, p in positions.items()],
        *[at(F.ceil(p)).alias(f"_hi_{name}") for name, p in positions.items()],
    )
    out = _interpolated(edges, keys, positions, count_as)
    return out.drop("_all") if constant else out


def open_group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, float],
    count_as: str | None = None,
    sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """As ``group_quantiles``, for keys that grow with the data and mostly have few rows each.

    The sizes of the groups are counted first and staged. A group of at most ``sorted_rows`` values is sorted in
    one place: one exchange of key and value serves the ranks and the result. Larger groups go through
    ``group_quantiles``, so no group is too large for a task.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value))
    large = stage(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > sorted_rows).select(*keys),
        "large_groups",
    )
    some_large = not large.isEmpty()
    small = rows.join(large, keys, "left_anti") if some_large else rows
    group = Window.partitionBy(*keys)
    ranked = small.select(
        *keys, F.col(value).alias("_v"), (F.row_number().over(group.orderBy(value)) - 1).alias("_at"),
        F.count(F.lit(1)).over(group).alias("_total"),
    )
    positions = {name: q * (F.col("_total") - 1) for name, q in wanted.items()}

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("_at") == rank, F.col("_v")))

    edges = ranked.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        *[at(F.floor(p)).alias(f"_lo_{name}") for name, p in positions.items()],
        *[at(F.ceil(p)).alias(f"_hi_{name}") for name, p in positions.items()],
    )
    out = _interpolated(edges, keys, positions, count_as)
    if not some_large:
        return out
    return out.unionByName(group_quantiles(rows.join(large, keys, "left_semi"), keys, value, wanted, count_as))


def _interpolated(
    edges: DataFrame, keys: Sequence[str], positions: Mapping[str, Column], count_as: str | None
) -> DataFrame:
    """The quantiles from the values on both sides of each position."""
    return edges.select(
        *keys,
        *([F.col("_total").alias(count_as)] if count_as else []),
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (p - F.floor(p))
            ).alias(name)
            for name, p in positions.items()
        ],
    )


def bounded_quantile(value: Column, fraction: float) -> Column:
    """Quantile for groups of bounded size, as a plain aggregate."""
    return F.percentile(value, F.lit(fraction))
