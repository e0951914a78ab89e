"""Monthly sales facts and the monthly Gold table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletry.config import HOLIDAY_MONTH_COLUMNS
from outletry.functions.dates import month_index
from outletry.functions.text import flag
from outletry.operators.seasonality import context_flags

KEYS = ["Outlet_ID", "Year", "Month"]


def monthly_sales(sales: DataFrame) -> DataFrame:
    """One row per outlet and month."""
    keyed = sales.where(
        F.col("Outlet_ID").isNotNull() & F.col("Year").isNotNull() & F.col("Month").isNotNull()
    )
    return keyed.groupBy(*KEYS).agg(
        F.sum("Volume_Liters").alias("monthly_liters"),
        F.sum("Total_Bill_Value").alias("monthly_bill_value"),
        F.count_distinct("SKU_ID").alias("monthly_sku_count"),
        F.avg("Price_Per_Liter").alias("monthly_avg_price_per_liter"),
        F.count(F.lit(1)).alias("monthly_transaction_count"),
    )


def primary_key(df: DataFrame, entity: str, key: str, counted_as: str) -> DataFrame:
    """Most frequent ``key`` of every entity (smallest on a tie) and how many it has.

    Counting per (entity, key) first keeps the buffers to one struct per entity.
    """
    pairs = (
        df.where(F.col(entity).isNotNull() & F.col(key).isNotNull())
        .groupBy(entity, key)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(key).alias("key")))
    return (
        pairs.groupBy(entity)
        .agg(best.alias("_best"), F.count(F.lit(1)).alias(counted_as))
        .select(entity, F.col("_best.key").alias(key), counted_as)
    )


def primary_distributor(sales: DataFrame) -> DataFrame:
    return primary_key(sales, "Outlet_ID", "Distributor_ID", "distributor_count")


def with_recency(monthly: DataFrame) -> DataFrame:
    """Month index and flags for the last 3 and 6 calendar months of the whole table."""
    latest = monthly.agg(F.max(month_index(F.col("Year"), F.col("Month")))).scalar()
    index = F.col("Month_Index")
    return monthly.withColumn("Month_Index", month_index(F.col("Year"), F.col("Month"))).withColumns(
        {
            "is_recent_3_months": flag(index >= latest - 2),
            "is_recent_6_months": flag(index >= latest - 5),
        }
    )


def monthly_sales_gold(
    monthly: DataFrame,
    main_distributor: DataFrame,
    holiday_months: DataFrame,
    seasonality: DataFrame,
    context: DataFrame | None,
    density: DataFrame | None,
) -> DataFrame:
    """Monthly facts with distributor, calendar, seasonality, context and density.

    The joins on the outlet share one partitioning by outlet; the calendar is bounded by the number
    of months and broadcast; the distributor tables grow with the data and carry no hint.
    """
    holidays = [c for c in HOLIDAY_MONTH_COLUMNS if c in holiday_months.columns]
    gold = (
        with_recency(monthly)
        .join(main_distributor, "Outlet_ID", "left")
        .join(
            F.broadcast(holiday_months.select("Year", "Month", "Year_Month", *holidays)),
            ["Year", "Month"],
            "left",
        )
        .withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in holidays})
    )

    keys = ["Distributor_ID", "Year", "Month"]
    by_distributor = seasonality.select(
        *keys, "Seasonality_Index", "seasonality_score", "seasonality_multiplier"
    )
    extra = [
        "seasonality_multiplier_calibrated", "seasonality_multiplier_source",
        "distributor_month_demand_context_score", "distributor_month_context_score_0_100",
        "is_favorable_holiday_month", "is_unfavorable_holiday_month", "is_festive_favorable_month",
    ]
    if context is not None:
        extra = [c for c in extra if c in context.columns]
        by_distributor = by_distributor.join(context.select(*keys, *extra), keys, "full")
    gold = gold.join(by_distributor, keys, "left").withColumns(
        {
            "Seasonality_Index": F.coalesce("Seasonality_Index", F.lit("Moderate")),
            "seasonality_score": F.coalesce("seasonality_score", F.lit(0)),
            "seasonality_multiplier": F.coalesce("seasonality_multiplier", F.lit(1.0)),
        }
    )
    if context is None:
        gold = gold.withColumns(
            {
                "seasonality_multiplier_calibrated": F.lit(None).cast("double"),
                "seasonality_multiplier_source": F.lit("seasonality_default"),
                "distributor_month_demand_context_score": F.lit(None).cast("double"),
                **context_flags(),
            }
        )
    gold = gold.withColumn(
        "seasonality_multiplier_calibrated",
        F.coalesce("seasonality_multiplier_calibrated", "seasonality_multiplier"),
    )
    adjusted = F.col("holiday_intensity_score") * F.col("seasonality_multiplier_calibrated")
    gold = gold.withColumns(
        {
            "distributor_month_demand_context_score": F.coalesce(
                F.col("distributor_month_demand_context_score"), adjusted
            ),
            "seasonality_adjusted_holiday_score": adjusted,
        }
    )
    density_columns = {
        "base_population": "double", "monthly_density": "double",
        "mobility_factor": "double", "tourism_factor": "double", "province": "string",
    }
    if density is None:
        return gold.withColumns({c: F.lit(None).cast(t) for c, t in density_columns.items()})
    return gold.join(
        density.select(*KEYS, *[F.col(c).cast(t).alias(c) for c, t in density_columns.items()]),
        KEYS,
        "left",
    )
