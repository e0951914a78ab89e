"""Population around outlets, spread over months and filled where it is missing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletry.config import (
    DEFAULTS,
    MONTHLY_TOURISM_FACTOR,
    YEARLY_MOBILITY_FACTOR,
    PipelineConfig,
)
from outletry.functions.dates import month_spine
from outletry.functions.numeric import half_even, ratio
from outletry.functions.text import lookup
from outletry.operators.quantiles import group_quantiles
from outletry.session import stage


def yearly_population(
    populations: DataFrame, column: str = "population", config: PipelineConfig = DEFAULTS
) -> DataFrame:
    """One row per location and year with the population grown from the base year.

    Years up to the base year use the raster of that year, so they do not grow.
    """
    years = F.explode(F.array(*[F.lit(y) for y in config.density_years]))
    steps = F.greatest(F.col("year") - config.population_base_year, F.lit(0))
    grown = F.greatest(F.col(column) * F.pow(F.lit(1 + config.annual_growth), steps), F.lit(0.0))
    return populations.withColumn("year", years).withColumn(
        "base_population", half_even(grown).cast("bigint")
    ).drop(column)


def zero_audit(yearly: DataFrame) -> DataFrame:
    return yearly.groupBy("year").agg(
        F.count(F.lit(1)).alias("location_count"),
        F.count_if(F.col("base_population") <= 0).alias("zero_population_count"),
    )


def monthly_density(
    yearly: DataFrame,
    tourism: Mapping[int, float] = MONTHLY_TOURISM_FACTOR,
    mobility: Mapping[int, float] = YEARLY_MOBILITY_FACTOR,
) -> DataFrame:
    """Twelve months per location and year, with the mobility and tourism factors applied.

    The month table is bounded by the years listed in ``mobility``, so it is broadcast.
    """
    spark = yearly.sparkSession
    months = month_spine(spark, f"{min(mobility)}-01-01", f"{max(mobility)}-12-01").select(
        "month", "year", "month_num",
        lookup(F.col("month_num"), tourism).alias("tourism_factor"),
        lookup(F.col("year"), mobility).alias("mobility_factor"),
    ).where("mobility_factor is not null")
    if "province" not in yearly.columns:
        yearly = yearly.withColumn("province", F.lit("Unknown"))
    value = F.col("base_population") * F.col("mobility_factor") * F.col("tourism_factor")
    return yearly.join(F.broadcast(months), "year").withColumn(
        "monthly_density", half_even(value).cast("bigint")
    )


def fill_density(df: DataFrame) -> DataFrame:
    """Replace missing or zero density by the mean of province and month, province, month or all.

    All four means come from sums and counts per province and month. That small table is staged, so
    the large one is aggregated once; rows of a hot province are combined before the shuffle.
    """
    density = F.col("monthly_density")
    parts = stage(
        df.where(density > 0)
        .groupBy("province", "month")
        .agg(F.sum("monthly_density").alias("_s"), F.count(F.lit(1)).alias("_c")),
        "density_totals",
    )

    def mean(name: str, *keys: str) -> DataFrame:
        return parts.groupBy(*keys).agg(ratio(F.sum("_s"), F.sum("_c")).alias(name))

    overall = F.coalesce(parts.agg(ratio(F.sum("_s"), F.sum("_c"))).scalar(), F.lit(1.0))
    missing = density.isNull() | (density <= 0)
    fill = half_even(F.coalesce("_province_month", "_province", "_month", overall)).cast("bigint")
    last = half_even(overall).cast("bigint")
    filled = F.when(missing, fill).otherwise(density)
    return (
        df.join(mean("_province_month", "province", "month"), ["province", "month"], "left")
        .join(mean("_province", "province"), "province", "left")
        .join(F.broadcast(mean("_month", "month")), "month", "left")
        .withColumn("monthly_density", F.when(filled > 0, filled).otherwise(last))
        .drop("_province_month", "_province", "_month")
    )


def percentile_bands(df: DataFrame) -> DataFrame:
    """Spread of the density over all locations, per month."""
    return group_quantiles(
        df, ["month"], "monthly_density",
        {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95},
    )


def top_locations(df: DataFrame, n: int = 10) -> DataFrame:
    """Monthly rows of the ``n`` locations with the highest median density.

    A location has one row per month, so its median has a bounded buffer. The top list has ``n``
    rows and may be broadcast.
    """
    top = (
        df.groupBy("location_name")
        .agg(F.median("monthly_density").alias("_median"))
        .orderBy(F.desc("_median"), "location_name")
        .limit(n)
    )
    return df.join(F.broadcast(top.select("location_name")), "location_name", "left_semi")
