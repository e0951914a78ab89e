"""Outlet-level feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outletry.config import DEFAULTS, PipelineConfig
from outletry.functions.numeric import ratio
from outletry.functions.text import flag
from outletry.operators.quantiles import bounded_quantile

ID = "Outlet_ID"


def _means(**columns: str):
    return [F.avg(src).alias(out) for out, src in columns.items()]


def _maxima(**columns: str):
    return [F.max(src).alias(out) for out, src in columns.items()]


def sales_profile() -> list:
    """Aggregates of monthly sales shared by the Gold and the imputation features.

    An outlet has at most one row per calendar month, so its exact quantiles have a small buffer.
    """
    liters = F.col("monthly_liters")
    return [
        *_means(
            avg_monthly_liters="monthly_liters",
            avg_bill_value="monthly_bill_value",
            avg_sku_count="monthly_sku_count",
            avg_transaction_count="monthly_transaction_count",
            avg_price_per_liter="monthly_avg_price_per_liter",
        ),
        *_maxima(
            max_monthly_liters="monthly_liters",
            max_bill_value="monthly_bill_value",
            max_sku_count="monthly_sku_count",
        ),
        bounded_quantile(liters, 0.5).alias("median_monthly_liters"),
        F.stddev_samp(liters).alias("sales_std"),
        F.sum(liters).alias("total_liters"),
        F.sum("monthly_bill_value").alias("total_bill_value"),
        F.sum("monthly_transaction_count").alias("total_transaction_count"),
        F.count(liters).alias("active_months"),
    ]


def recent_months() -> list:
    """Averages and totals of the last 3 and 6 calendar months (flags from ``with_recency``)."""
    out = []
    for n in (3, 6):
        value = F.when(F.col(f"is_recent_{n}_months") == 1, F.col("monthly_liters"))
        out += [
            F.avg(value).alias(f"recent_{n}_month_avg_liters"),
            F.sum(value).alias(f"recent_{n}_month_total_liters"),
        ]
    return out


def month_slices(with_context: bool = True) -> list:
    """Averages restricted to January, April, December and to all but April and December."""
    month, liters = F.col("Month"), F.col("monthly_liters")

    def january(column: str):
        return F.when(month == 1, F.col(column))

    out = [
        F.avg(january("monthly_liters")).alias("avg_january_liters"),
        F.max(january("monthly_liters")).alias("max_january_liters"),
        F.avg(january("monthly_bill_value")).alias("avg_january_bill_value"),
        F.avg(january("monthly_sku_count")).alias("avg_january_sku_count"),
        F.avg(F.when(~month.isin(4, 12), liters)).alias("avg_monthly_liters_excluding_apr_dec"),
        F.avg(F.when(month == 4, liters)).alias("april_avg_liters"),
        F.avg(F.when(month == 12, liters)).alias("december_avg_liters"),
    ]
    if with_context:
        out += [
            F.avg(january("monthly_density")).alias("avg_january_density"),
            F.max(january("monthly_density")).alias("max_january_density"),
            F.avg(january("distributor_month_demand_context_score")).alias("avg_january_context_score"),
            F.avg(january("seasonality_adjusted_holiday_score")).alias(
                "avg_january_adjusted_holiday_score"
            ),
        ]
    return out


def context_profile() -> list:
    """Averages, maxima and counts of the monthly context columns."""
    return [
        *_means(
            avg_holiday_intensity_score="holiday_intensity_score",
            avg_public_holiday_date_count="public_holiday_date_count",
            avg_poya_day_date_count="poya_day_date_count",
            avg_festive_holiday_date_count="festive_holiday_date_count",
            avg_long_weekend_holiday_date_count="long_weekend_holiday_date_count",
            avg_seasonality_score="seasonality_score",
            avg_seasonality_multiplier="seasonality_multiplier",
            avg_seasonality_multiplier_calibrated="seasonality_multiplier_calibrated",
            avg_seasonality_adjusted_holiday_score="seasonality_adjusted_holiday_score",
            avg_distributor_month_context_score="distributor_month_demand_context_score",
            avg_base_population="base_population",
            avg_monthly_density="monthly_density",
            avg_mobility_factor="mobility_factor",
            avg_tourism_factor="tourism_factor",
        ),
        *_maxima(
            max_holiday_intensity_score="holiday_intensity_score",
            max_seasonality_adjusted_holiday_score="seasonality_adjusted_holiday_score",
            max_distributor_month_context_score="distributor_month_demand_context_score",
            max_base_population="base_population",
            max_monthly_density="monthly_density",
        ),
        F.sum("is_favorable_holiday_month").alias("favorable_holiday_month_count"),
        F.sum("is_unfavorable_holiday_month").alias("unfavorable_holiday_month_count"),
        F.sum("is_festive_favorable_month").alias("festive_favorable_month_count"),
        F.mode("province", True).alias("province"),
    ]


def with_variation(features: DataFrame) -> DataFrame:
    return features.withColumn("sales_cv", ratio(F.col("sales_std"), F.col("avg_monthly_liters")))


def with_spikes(features: DataFrame, config: PipelineConfig = DEFAULTS) -> DataFrame:
    """Ratios of the April and December averages to the median month, and the spike flag."""
    april, december = F.col("april_avg_liters"), F.col("december_avg_liters")
    median = F.col("median_monthly_liters")
    return features.withColumns(
        {
            "april_spike_ratio": ratio(april, median, 0.0),
            "december_spike_ratio": ratio(december, median, 0.0),
            "seasonal_peak_liters": F.greatest(april, december),
        }
    ).withColumn("peak_to_median_ratio", ratio(F.col("seasonal_peak_liters"), median, 0.0)).withColumn(
        "seasonal_spike_flag", flag(F.col("peak_to_median_ratio") >= config.spike_ratio)
    )


def distinct_skus(sales: DataFrame) -> DataFrame:
    return sales.where(F.col(ID).isNotNull()).groupBy(ID).agg(
        F.count_distinct("SKU_ID").alias("total_unique_skus")
    )


def outlet_features(
    monthly_gold: DataFrame,
    sales: DataFrame,
    main_distributor: DataFrame,
    config: PipelineConfig = DEFAULTS,
) -> DataFrame:
    """All outlet features from one aggregate over the monthly Gold table.

    What are eight aggregates and eight joins when done one by one is a single pass with
    conditional aggregates: one shuffle on the outlet.
    """
    liters = F.col("monthly_liters")
    features = monthly_gold.groupBy(ID).agg(
        *sales_profile(),
        bounded_quantile(liters, 0.75).alias("p75_monthly_liters"),
        bounded_quantile(liters, 0.9).alias("p90_monthly_liters"),
        *context_profile(),
        *recent_months(),
        *month_slices(),
    )
    return with_spikes(with_variation(features), config).join(
        distinct_skus(sales), ID, "left"
    ).join(main_distributor, ID, "left")


def recent_n_rows(monthly: DataFrame, sizes: tuple[int, ...] = (3, 6)) -> DataFrame:
    """Averages and totals of the last N monthly rows of each outlet, whatever their distance.

    The window holds the months of one outlet, which the calendar bounds.
    """
    newest_first = Window.partitionBy(ID).orderBy(F.desc("Year"), F.desc("Month"))
    ranked = monthly.select(ID, "monthly_liters", F.row_number().over(newest_first).alias("_rank"))
    aggregates = []
    for n in sizes:
        value = F.when(F.col("_rank") <= n, F.col("monthly_liters"))
        aggregates += [
            F.avg(value).alias(f"recent_{n}_month_avg_liters"),
            F.sum(value).alias(f"recent_{n}_month_total_liters"),
        ]
    return ranked.where(F.col("_rank") <= max(sizes)).groupBy(ID).agg(*aggregates)


def outlet_context_average(monthly: DataFrame, holiday_months: DataFrame) -> DataFrame:
    """Average of every monthly holiday number over the months an outlet was active."""
    columns = [
        f.name for f in holiday_months.schema
        if f.name not in ("Year", "Month") and f.dataType.typeName() not in ("string", "date")
    ]
    calendar = F.broadcast(holiday_months.select("Year", "Month", *columns))
    return monthly.join(calendar, ["Year", "Month"], "left").groupBy(ID).agg(
        *[F.avg(c).alias(c) for c in columns]
    )
