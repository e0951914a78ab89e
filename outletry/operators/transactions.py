"""Silver transactions: checks, sign classes, unit prices, price outliers, per-outlet summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletry.config import DEFAULTS, TRANSACTION_COLUMNS, PipelineConfig
from outletry.functions.numeric import finite, half_even, parsed_number, ratio
from outletry.functions.text import flag
from outletry.operators.outlets import clean_strings
from outletry.operators.quantiles import open_group_quantiles
from outletry.operators.repeats import REPEAT, mark_repeats
from outletry.operators.rules import REASONS, Rule, mandatory, require_columns, with_reasons

KIND = "kind"
SALE, RETURN, REJECTED, UNCLASSIFIED = "sale", "return", "rejected", "unclassified"
SIGN_MISMATCH = "sign_mismatch"
PRICE_OUTLIER = "sku_level_price_outlier"
BILLING_ANOMALIES = (
    "zero_volume_positive_bill", "positive_volume_zero_bill", "zero_volume_zero_bill",
)
SIGN_MISMATCH_REASON = "Sign mismatch between Volume_Liters and Total_Bill_Value"
_NUMBERS = ("Year", "Month", "Volume_Liters", "Total_Bill_Value")


def check_transactions(raw: DataFrame, config: PipelineConfig = DEFAULTS) -> DataFrame:
    """Typed transactions with the reasons against each row."""
    df = clean_strings(require_columns(raw, TRANSACTION_COLUMNS))
    lost = {f"_lost_{c}": F.col(c).isNull() for c in _NUMBERS}
    # Parsed first, infinities and NaN removed after that, so that no text is parsed twice.
    parsed = {c: parsed_number(F.col(c).cast("string")) for c in _NUMBERS}
    df = df.withColumns(lost).withColumns(parsed).withColumns({c: finite(F.col(c)) for c in _NUMBERS})
    df = mark_repeats(df, [c for c in raw.columns if not c.startswith("_")])
    years = config.transaction_years
    rules = (
        [
            Rule(
                f"Missing mandatory field: {c}",
                F.col(f"_lost_{c}") if c in _NUMBERS else F.col(c).isNull(),
            )
            for c in TRANSACTION_COLUMNS
        ]
        + [Rule(f"Invalid numeric value in {c}", ~F.col(f"_lost_{c}") & F.col(c).isNull()) for c in _NUMBERS]
        + [
            Rule(f"Year outside expected range {min(years)}-{max(years)}", ~F.col("Year").isin(*years)),
            Rule("Month outside range 1-12", ~F.col("Month").between(1, 12)),
            Rule("Exact duplicate row", F.col(REPEAT)),
        ]
    )
    df = with_reasons(df, rules).drop(*lost, REPEAT)
    return df.withColumns({c: F.col(c).cast("int") for c in ("Year", "Month")})


def classify(df: DataFrame) -> DataFrame:
    """Add ``kind`` from the signs of volume and bill, rejected where reasons are known."""
    volume, bill = F.col("Volume_Liters"), F.col("Total_Bill_Value")
    kind = (
        F.when((volume > 0) & (bill > 0), SALE)
        .when((volume < 0) & (bill < 0), RETURN)
        .when((volume == 0) & (bill > 0), "zero_volume_positive_bill")
        .when((volume > 0) & (bill == 0), "positive_volume_zero_bill")
        .when((volume == 0) & (bill == 0), "zero_volume_zero_bill")
        .when(((volume < 0) & (bill >= 0)) | ((volume > 0) & (bill < 0)), SIGN_MISMATCH)
        .otherwise(UNCLASSIFIED)
    )
    if REASONS in df.columns:
        kind = F.when(F.size(REASONS) > 0, REJECTED).otherwise(kind)
    return df.withColumn(KIND, kind)


def unit_price(df: DataFrame) -> DataFrame:
    """Add the price per litre of sales and (from absolute amounts) of returns."""
    price = ratio(F.abs("Total_Bill_Value"), F.abs("Volume_Liters"))
    if KIND in df.columns:
        price = F.when(F.col(KIND).isin(SALE, RETURN, PRICE_OUTLIER), price)
    return df.withColumn("Price_Per_Liter", price)


def price_bounds(sales: DataFrame, config: PipelineConfig = DEFAULTS) -> DataFrame:
    """Price bounds per SKU: quartiles widened by the IQR, or a band around the median."""
    sales = sales.where(F.col("SKU_ID").isNotNull() & F.col("Price_Per_Liter").isNotNull())
    quartiles = open_group_quantiles(
        sales, ["SKU_ID"], "Price_Per_Liter",
        {"sku_price_median": 0.5, "sku_price_q1": 0.25, "sku_price_q3": 0.75},
        count_as="sku_price_count",
    )
    iqr, median = F.col("sku_price_iqr"), F.col("sku_price_median")
    reach = config.price_iqr_factor * iqr
    low = F.when(iqr > 0, F.col("sku_price_q1") - reach).otherwise(median * (1 - config.price_tolerance))
    high = F.when(iqr > 0, F.col("sku_price_q3") + reach).otherwise(median * (1 + config.price_tolerance))
    return (
        quartiles.withColumn("sku_price_iqr", F.col("sku_price_q3") - F.col("sku_price_q1"))
        .withColumn("sku_price_lower_bound", F.greatest(low, F.lit(0.0)))
        .withColumn("sku_price_upper_bound", high)
    )


def flag_price_outliers(
    sales: DataFrame, bounds: DataFrame, config: PipelineConfig = DEFAULTS
) -> DataFrame:
    """Join the bounds and flag prices outside them for SKUs with enough records.

    No broadcast hint: SKUs grow with the data. The optimiser broadcasts the bounds when their
    measured size allows it and else splits hot SKUs of the sort-merge join.
    """
    price = F.col("Price_Per_Liter")
    outside = (price < F.col("sku_price_lower_bound")) | (price > F.col("sku_price_upper_bound"))
    enough = F.col("sku_price_count") >= config.min_records_per_sku
    return sales.join(bounds, "SKU_ID", "left").withColumn(
        "sku_price_outlier_flag", flag(enough & outside)
    )


def label_transactions(checked: DataFrame, config: PipelineConfig = DEFAULTS) -> DataFrame:
    """Every checked row once, with its final ``kind``, unit price and price bounds.

    One pass with one label instead of five tables: a single write partitioned by ``kind`` then
    serves sales, returns, anomalies, outliers and rejected rows.
    """
    return label_priced(unit_price(classify(checked)), config)


def label_priced(priced: DataFrame, config: PipelineConfig = DEFAULTS) -> DataFrame:
    """As ``label_transactions``, for rows that have their class by sign and their unit price."""
    sales = priced.where(F.col(KIND) == SALE)
    marked = flag_price_outliers(sales, price_bounds(sales, config), config).withColumn(
        KIND, F.when(F.col("sku_price_outlier_flag") == 1, PRICE_OUTLIER).otherwise(F.col(KIND))
    )
    return marked.unionByName(priced.where(F.col(KIND) != SALE), allowMissingColumns=True)


def sales_rows(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col(KIND) == SALE).drop(REASONS, KIND)


def return_rows(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col(KIND) == RETURN).select(*TRANSACTION_COLUMNS, "Price_Per_Liter")


def billing_anomalies(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col(KIND).isin(*BILLING_ANOMALIES)).select(
        *TRANSACTION_COLUMNS, F.col(KIND).alias("anomaly_type")
    )


def rejected_transactions(labelled: DataFrame) -> DataFrame:
    """Rows refused by a rule or for contradicting signs."""
    reason = F.when(F.col(KIND) == SIGN_MISMATCH, F.array(F.lit(SIGN_MISMATCH_REASON))).otherwise(
        F.col(REASONS)
    )
    return labelled.where(F.col(KIND).isin(REJECTED, SIGN_MISMATCH)).select(
        *TRANSACTION_COLUMNS, reason.alias(REASONS)
    )


def return_features(returns: DataFrame) -> DataFrame:
    return (
        returns.where(F.col("Outlet_ID").isNotNull())
        .groupBy("Outlet_ID")
        .agg(
            F.count(F.lit(1)).alias("return_record_count"),
            F.sum(F.abs("Volume_Liters")).alias("return_liters_abs"),
            F.sum(F.abs("Total_Bill_Value")).alias("return_value_abs"),
            F.count_distinct("Month").alias("return_month_count"),
            F.count_distinct("SKU_ID").alias("return_sku_count"),
        )
    )


def anomaly_features(anomalies: DataFrame) -> DataFrame:
    return (
        anomalies.where(F.col("Outlet_ID").isNotNull())
        .groupBy("Outlet_ID")
        .agg(
            F.count(F.lit(1)).alias("billing_anomaly_count"),
            *[
                F.count_if(F.col("anomaly_type") == name).alias(f"{name}_count")
                for name in BILLING_ANOMALIES
            ],
        )
    )


def quality_summary(labelled: DataFrame) -> DataFrame:
    """One row of counts and shares for the whole transaction load."""
    kind = F.col(KIND)
    counts = labelled.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(kind == SALE).alias("positive_sales_silver_rows"),
        F.count_if(kind == RETURN).alias("returns_silver_rows"),
        F.count_if(kind.isin(*BILLING_ANOMALIES)).alias("billing_anomaly_rows"),
        F.count_if(kind == PRICE_OUTLIER).alias("price_outlier_rows"),
        F.count_if(kind.isin(REJECTED, SIGN_MISMATCH)).alias("rejected_rows"),
    )

    def share(part: str, whole: Column) -> Column:
        return half_even(ratio(F.col(part), whole, 0.0), 5)

    raw = F.col("raw_rows")
    all_sales = F.greatest(F.col("positive_sales_silver_rows") + F.col("price_outlier_rows"), F.lit(1))
    return counts.select(
        F.lit("transactions").alias("dataset"),
        "*",
        share("returns_silver_rows", raw).alias("negative_return_share_of_raw"),
        share("billing_anomaly_rows", raw).alias("zero_volume_billing_anomaly_share_of_raw"),
        share("price_outlier_rows", all_sales).alias("sku_price_outlier_share_of_positive_sales"),
    )
