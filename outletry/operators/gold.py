"""Gold outlet table: assembly, target-month context, fills, ratios and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletry.config import DEFAULTS, PipelineConfig
from outletry.functions.numeric import fill_all_numbers, fill_numbers, numeric_columns, ratio
from outletry.functions.text import flag
from outletry.operators import features as feat
from outletry.operators.seasonality import LABEL

ID = "Outlet_ID"
_RETURNS = [
    "return_record_count", "return_liters_abs", "return_value_abs", "return_month_count",
    "return_sku_count",
]
_ANOMALIES = [
    "billing_anomaly_count", "zero_volume_positive_bill_count", "positive_volume_zero_bill_count",
    "zero_volume_zero_bill_count",
]
_MUST_EXIST = [*_RETURNS, "total_liters", "total_bill_value", *_ANOMALIES]
_CATEGORIES = ["Outlet_Size", "Outlet_Type", "Distributor_ID", "province", "jan_2026_seasonality_index"]
_MASTER_ONLY = [
    "Outlet_Size", "Outlet_Size_Invalid_Flag", "Outlet_Size_Missing_Flag", "Outlet_Type",
    "Cooler_Count", "Outlet_Size_Imputed", "Outlet_Size_Confidence", "Outlet_Size_Review_Flag",
]
_COORDINATES = [
    "Latitude", "Longitude", "Latitude_Original", "Longitude_Original",
    "coordinate_corrected_flag", "coordinate_correction_type",
]
_NOT_FILLED = {
    "Latitude", "Longitude", "Cooler_Count", "Outlet_Size_Confidence", "coordinate_corrected_flag",
}
HOLIDAY_PROXIES = {
    "holiday_intensity_score": "jan_2026_holiday_intensity_proxy",
    "holiday_date_count": "jan_2026_holiday_date_count_proxy",
    "public_holiday_date_count": "jan_2026_public_holiday_date_count_proxy",
    "poya_day_date_count": "jan_2026_poya_day_date_count_proxy",
    "festive_holiday_date_count": "jan_2026_festive_holiday_date_count_proxy",
    "long_weekend_holiday_date_count": "jan_2026_long_weekend_holiday_date_count_proxy",
}


def outlet_gold(
    master: DataFrame,
    coordinates: DataFrame,
    features: DataFrame,
    returns: DataFrame | None = None,
    anomalies: DataFrame | None = None,
) -> DataFrame:
    """One row per outlet. The master is cut to its own columns, so no name occurs twice.

    Every table joined here has one row per outlet and is partitioned by it.
    """
    own = [c for c in _MASTER_ONLY if c in master.columns]
    gold = (
        master.select(ID, *own)
        .join(coordinates.select(ID, *[c for c in _COORDINATES if c in coordinates.columns]), ID, "left")
        .join(features, ID, "left")
    )
    for optional in (returns, anomalies):
        if optional is not None:
            gold = gold.join(optional, ID, "left")
    return gold


def is_target(config: PipelineConfig) -> Column:
    return (F.col("Year") == config.target_year) & (F.col("Month") == config.target_month)


def target_or_history(
    df: DataFrame, keys: list[str], columns: dict[str, str], config: PipelineConfig,
    labels: dict[str, str] | None = None,
) -> DataFrame:
    """Mean of each column in the target period, or in past months of the same name if the table
    has no target period at all. Labels take the most frequent value instead of the mean.

    Both cases come from one conditional aggregate; which applies is a scalar over the table.
    """
    same_month = df.where(F.col("Month") == config.target_month)
    has_target = F.coalesce(same_month.agg(F.max(is_target(config))).scalar(), F.lit(False))
    wanted = same_month.where(is_target(config) | ~has_target)
    for key in keys:
        wanted = wanted.where(F.col(key).isNotNull())
    return wanted.groupBy(*keys).agg(
        *[F.avg(src).alias(out) for src, out in columns.items()],
        # A distributor has one label per year, and there are only three labels.
        *[F.mode(src, True).alias(out) for src, out in (labels or {}).items()],
    )


def add_target_context(
    gold: DataFrame,
    holiday_months: DataFrame,
    seasonality: DataFrame,
    context: DataFrame | None,
    density: DataFrame | None,
    config: PipelineConfig = DEFAULTS,
) -> DataFrame:
    """What is known about the target month for each outlet's distributor and place.

    The density is joined first, while the outlets still lie partitioned by their own key.
    """
    density_columns = {
        "monthly_density": "jan_2026_monthly_density",
        "base_population": "jan_2026_base_population",
        "mobility_factor": "jan_2026_mobility_factor",
        "tourism_factor": "jan_2026_tourism_factor",
    }
    if density is None:
        gold = gold.withColumns({c: F.lit(None).cast("double") for c in density_columns.values()})
    else:
        gold = gold.join(target_or_history(density, [ID], density_columns, config), ID, "left")
    label, score, multiplier, calibrated = (
        "jan_2026_seasonality_index", "jan_2026_seasonality_score",
        "jan_2026_seasonality_multiplier", "jan_2026_seasonality_multiplier_calibrated",
    )
    by_label = target_or_history(
        seasonality, ["Distributor_ID"],
        {"seasonality_score": score, "seasonality_multiplier": multiplier},
        config, {LABEL: label},
    )
    gold = gold.join(by_label, "Distributor_ID", "left").withColumns(
        {
            label: F.coalesce(label, F.lit("Moderate")),
            score: F.coalesce(score, F.lit(0.0)),
            multiplier: F.coalesce(multiplier, F.lit(1.0)),
        }
    )
    context_columns = {
        "seasonality_multiplier_calibrated": calibrated,
        "distributor_month_demand_context_score": "jan_2026_distributor_month_context_score",
    }
    if context is None:
        gold = gold.withColumns({c: F.lit(None).cast("double") for c in context_columns.values()})
    else:
        gold = gold.join(
            target_or_history(context, ["Distributor_ID"], context_columns, config),
            "Distributor_ID", "left",
        )

    proxies = holiday_proxies(holiday_months, config).scalar()
    used = F.coalesce(calibrated, multiplier)
    gold = gold.withColumn("_proxies", proxies).withColumns(
        {
            "jan_2026_seasonality_multiplier_used": used,
            **{c: F.col("_proxies")[c] for c in HOLIDAY_PROXIES.values()},
        }
    ).drop("_proxies")
    gold = gold.withColumn(
        "jan_2026_adjusted_holiday_score_proxy",
        F.col("jan_2026_holiday_intensity_proxy") * F.col("jan_2026_seasonality_multiplier_used"),
    )

    return gold


def holiday_proxies(holiday_months: DataFrame, config: PipelineConfig = DEFAULTS) -> DataFrame:
    """One row with one struct: the holiday numbers expected for the target month."""
    means = target_or_history(holiday_months, [], HOLIDAY_PROXIES, config)
    return means.select(
        F.struct(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in HOLIDAY_PROXIES.values()]).alias("proxies")
    )


def finish_outlet_gold(gold: DataFrame) -> DataFrame:
    """Fill numbers with 0, add return ratios and flags, name missing categories ``Unknown``."""
    gold = gold.withColumns(
        {c: F.lit(0.0 if "liters" in c or "value" in c else 0) for c in _MUST_EXIST if c not in gold.columns}
    )
    gold = fill_numbers(gold, numeric_columns(gold, _NOT_FILLED))
    latitude, longitude = F.col("Latitude"), F.col("Longitude")
    known = {"Latitude", "Longitude"} <= set(gold.columns)
    return gold.withColumns(
        {
            "return_ratio_liters": ratio(F.col("return_liters_abs"), F.col("total_liters"), 0.0),
            "return_ratio_value": ratio(F.col("return_value_abs"), F.col("total_bill_value"), 0.0),
            "has_return_flag": flag(F.col("return_record_count") > 0),
            "has_billing_anomaly_flag": flag(F.col("billing_anomaly_count") > 0),
            "missing_coordinate_flag": flag(latitude.isNull() | longitude.isNull()) if known else F.lit(1),
            **{c: F.coalesce(c, F.lit("Unknown")) for c in _CATEGORIES if c in gold.columns},
        }
    )


def modelling_table(gold: DataFrame) -> DataFrame:
    return gold.drop("Latitude_Original", "Longitude_Original")


def imputation_features(
    master: DataFrame,
    coordinates: DataFrame,
    monthly: DataFrame,
    sales: DataFrame,
    main_distributor: DataFrame,
    returns: DataFrame,
    holiday_months: DataFrame,
    seasonality: DataFrame,
) -> DataFrame:
    """Feature table of the size imputer: recency by last rows, averages of the calendar."""
    profile = feat.with_variation(
        monthly.groupBy(ID).agg(
            *feat.sales_profile(),
            F.avg(F.when(F.col("Month") == 1, F.col("monthly_liters"))).alias("avg_january_liters"),
            F.max(F.when(F.col("Month") == 1, F.col("monthly_liters"))).alias("max_january_liters"),
        )
    )
    scores = (
        monthly.select(ID, "Year", "Month")
        .join(main_distributor.select(ID, "Distributor_ID"), ID, "left")
        .join(
            seasonality.select("Distributor_ID", "Year", "Month", "seasonality_score"),
            ["Distributor_ID", "Year", "Month"], "left",
        )
        .groupBy(ID)
        .agg(F.avg("seasonality_score").alias("avg_seasonality_score"))
    )
    own = [c for c in _MASTER_ONLY if c in master.columns]
    base = (
        master.select(ID, *own)
        .join(coordinates.select(ID, "Latitude", "Longitude"), ID, "left")
        .join(profile, ID, "left")
        .join(feat.recent_n_rows(monthly), ID, "left")
        .join(feat.distinct_skus(sales), ID, "left")
        .join(main_distributor, ID, "left")
        .join(returns.select(ID, *_RETURNS[:3]), ID, "left")
        .join(feat.outlet_context_average(monthly, holiday_months), ID, "left")
        .join(scores, ID, "left")
    )
    base = fill_all_numbers(base, exclude=["Latitude", "Longitude"])
    return base.withColumns(
        {
            "return_ratio_liters": ratio(F.col("return_liters_abs"), F.col("total_liters"), 0.0),
            "return_ratio_value": ratio(F.col("return_value_abs"), F.col("total_bill_value"), 0.0),
        }
    )
