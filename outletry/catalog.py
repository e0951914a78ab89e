"""Every operator as a named query over one folder of driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outletry.config import DEFAULTS, OUTLET_SIZES
from outletry.functions import dates, labels, numeric, text
from outletry.operators import (
    clustering,
    density,
    features,
    gold,
    holidays,
    imputer,
    monthly,
    outlets,
    potential,
    reports,
    rules,
    seasonality,
    spatial,
    transactions,
)
from outletry.operators.repeats import REPEAT, mark_repeats, repeated_keys
from outletry.oracle import NUDGE
from outletry.plans import silver
from outletry.session import shared_folder, stage
from outletry.sources import readers, writers
from outletry.workload.lake import Lake, lake
from outletry.workload.tables import driver_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PEER = "Outlet_Type"


def query(build: Callable[[Lake], DataFrame]) -> Callable[[Lake], DataFrame]:
    """Register a query under its function name, doubles rounded to four digits."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(lake(spark, sf_dir)))

    QUERIES[build.__name__] = run
    return build


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(
        *[
            F.round(F.col(f.name) + NUDGE, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
            for f in df.schema
        ]
    )


def driver(lk: Lake, name: str) -> DataFrame:
    return driver_table(lk.spark, lk.sf_dir, name)


# --- sources and sinks -----------------------------------------------------------------------


@query
def scan_csv_roundtrip(lk: Lake) -> DataFrame:
    customer = driver(lk, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = f"{shared_folder(lk.spark)}/customer-csv-{uuid.uuid4().hex}"
    writers.write_csv(customer, path)
    back = readers.read_csv(lk.spark, path, customer.columns)
    return back.select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"),
        "c_name",
        numeric.to_number(F.col("c_acctbal")).alias("c_acctbal"),
        "c_mktsegment",
    )


@query
def bronze_landing(lk: Lake) -> DataFrame:
    """All raw tables as CSV files, landed with source and row id; a row id must occur once."""
    parts = []
    for name, df in raw_tables(lk).items():
        path = f"{shared_folder(lk.spark).rstrip('/')}/raw-{name}-{uuid.uuid4().hex}"
        writers.write_csv(df.drop("_row_id"), path)
        landed = stage(readers.with_lineage(readers.clean_columns(readers.read_csv(lk.spark, path))), "bronze")
        parts.append(landed.agg(
            F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("rows"),
            F.count_distinct("_row_id").alias("row_ids"), F.count_if(F.col("_source_file").isNull()).alias("no_source"),
            F.count(readers.CORRUPT).alias("broken_lines"),
        ))
    return reduce(DataFrame.unionByName, parts)


@query
def checkpoint_resume(lk: Lake) -> DataFrame:
    """A checkpoint that first has half of the places and one year less, and is then completed."""
    yearly = driver(lk, "orders").groupBy(
        F.col("o_custkey").alias("place"), F.year("o_orderdate").alias("year")
    ).agg(F.count(F.lit(1)).alias("orders"))
    path = f"{shared_folder(lk.spark).rstrip('/')}/checkpoint-{uuid.uuid4().hex}"
    writers.add_years(yearly.where("place % 2 = 0 and year <> 1996"), path, ["place"])
    return writers.add_years(yearly, path, ["place"])


@query
def optional_table(lk: Lake) -> DataFrame:
    schema = "s_suppkey bigint, s_name string"
    there = readers.optional_table(lk.spark, f"{lk.sf_dir.rstrip('/')}/supplier.parquet", schema)
    return there.unionByName(readers.optional_table(lk.spark, None, schema))


@query
def clean_columns(lk: Lake) -> DataFrame:
    part = driver(lk, "part").select("p_partkey", "p_name", "p_size")
    return readers.clean_columns(part.toDF(" p_partkey ", "p  name", "p\tsize "))


@query
def resolve_aliases(lk: Lake) -> DataFrame:
    raw = lk.raw("outlet_coordinates")
    return readers.resolve_locations(
        raw.select(
            F.col("Outlet_ID").alias("OUTLET_ID"), F.col("Latitude").alias("Lat"),
            F.col("Longitude").alias("LNG"), "_row_id",
        )
    )


@query
def unify_period_columns(lk: Lake) -> DataFrame:
    orders = driver(lk, "orders").select(
        F.concat(F.lit("O"), F.col("o_custkey").cast("string")).alias("location_name"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        "o_totalprice",
    )
    return readers.unify_period(orders).groupBy("Outlet_ID", "Year", "Month").agg(
        F.count(F.lit(1)).alias("order_count")
    )


@query
def legacy_alias_fill(lk: Lake) -> DataFrame:
    older = holidays.month_features_by_row(holidays.check_holidays_by_row(lk.raw("holidays")))
    filled = holidays.legacy_alias_fill(older)
    return filled.select("Year", "Month", *holidays.HOLIDAY_MONTH_COLUMNS)


# --- profiles and reports --------------------------------------------------------------------


def raw_tables(lk: Lake) -> dict[str, DataFrame]:
    names = ("transactions", "outlet_master", "outlet_coordinates", "seasonality", "holidays")
    return {n: lk.raw(n) for n in names}


@query
def profile_dataset(lk: Lake) -> DataFrame:
    return reports.dataset_summary({n: df.drop("_row_id") for n, df in raw_tables(lk).items()})


@query
def profile_columns(lk: Lake) -> DataFrame:
    return reports.each_table(reports.column_summary, raw_tables(lk))


@query
def profile_samples(lk: Lake) -> DataFrame:
    return reports.each_table(reports.sample_values, raw_tables(lk))


def checked_tables(lk: Lake) -> dict[str, DataFrame]:
    return {
        "outlet_master": outlets.check_outlet_master(lk.raw("outlet_master")),
        "outlet_coordinates": outlets.check_coordinates(lk.raw("outlet_coordinates")),
        "distributor_seasonality": seasonality.check_seasonality(lk.raw("seasonality")),
        "holiday_list": holidays.check_holidays(lk.raw("holidays")),
        "transactions": transactions.rejected_transactions(lk.labelled),
    }


@query
def rejection_reason_counts(lk: Lake) -> DataFrame:
    return reports.reason_counts(checked_tables(lk))


@query
def union_rejected(lk: Lake) -> DataFrame:
    tables = checked_tables(lk)
    return reports.union_rejected(tables).select(
        "dataset", "_row_id", "Outlet_ID", "Distributor_ID", "Year", "Month", "_dq_rejection_reason"
    )


@query
def silver_quality_summary(lk: Lake) -> DataFrame:
    tables = checked_tables(lk)
    master = reports.load_summary(
        tables["outlet_master"], "outlet_master",
        missing_outlet_size_rows_kept_for_imputation=F.col("Outlet_Size").isNull(),
        invalid_outlet_size_rows_set_to_missing=F.col("Outlet_Size_Invalid_Flag") == 1,
    )
    coordinates = reports.load_summary(
        tables["outlet_coordinates"], "outlet_coordinates",
        lat_lon_swapped_corrected_rows=F.col("coordinate_corrected_flag") == 1,
    )
    season = reports.load_summary(tables["distributor_seasonality"], "distributor_seasonality")
    days = reports.load_summary(tables["holiday_list"], "holiday_list")
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), (master, coordinates, season, days)
    )


@query
def transaction_quality_summary(lk: Lake) -> DataFrame:
    return transactions.quality_summary(lk.labelled)


@query
def duplicate_key_report(lk: Lake) -> DataFrame:
    return repeated_keys(
        lk.silver.sales, ["Outlet_ID", "Year", "Month", "Distributor_ID", "SKU_ID"]
    )


@query
def reject_share_by_key(lk: Lake) -> DataFrame:
    return reports.reject_share(
        lk.silver.sales, transactions.rejected_transactions(lk.labelled), "Distributor_ID"
    )


@query
def gold_missing_report(lk: Lake) -> DataFrame:
    return reports.missing_report(lk.outlet_gold)


@query
def gold_readiness(lk: Lake) -> DataFrame:
    return reports.readiness(lk.outlet_gold, lk.monthly_gold)


@query
def month_audit(lk: Lake) -> DataFrame:
    return holidays.audit_month(lk.holiday_dates)


# --- scalar cleaning -------------------------------------------------------------------------


@query
def clean_text(lk: Lake) -> DataFrame:
    clean = text.squash(F.col("text"))
    return driver(lk, "documents").select(
        "doc_id", F.md5(clean).alias("text_md5"), F.length(clean).cast("bigint").alias("n_clean")
    )


@query
def null_tokens(lk: Lake) -> DataFrame:
    return outlets.clean_strings(lk.raw("outlet_master"))


@query
def standardize_category(lk: Lake) -> DataFrame:
    return lk.raw("outlet_master").select(
        "_row_id", labels.outlet_size(F.col("Outlet_Size")).alias("Outlet_Size")
    )


@query
def typo_map(lk: Lake) -> DataFrame:
    return lk.raw("outlet_master").select(
        "_row_id", labels.outlet_type(F.col("Outlet_Type")).alias("Outlet_Type")
    )


@query
def standardize_label(lk: Lake) -> DataFrame:
    return lk.raw("seasonality").select(
        "_row_id", labels.seasonality(F.col("Seasonality_Index")).alias("Seasonality_Index")
    )


@query
def standardize_holiday_type(lk: Lake) -> DataFrame:
    return lk.raw("holidays").select(
        "_row_id", labels.holiday_type(F.col("Holiday_Type")).alias("Holiday_Type")
    )


@query
def keyword_flags(lk: Lake) -> DataFrame:
    name, kind = text.squash(F.col("Holiday_Name")), labels.holiday_type(F.col("Holiday_Type"))
    return lk.raw("holidays").select(
        "_row_id", *[c.alias(n) for n, c in holidays.holiday_flags(name, kind).items()]
    )


@query
def coerce_numeric(lk: Lake) -> DataFrame:
    volume = text.null_if_token(F.col("Volume_Liters"))
    return lk.raw("transactions").select(
        "_row_id", "Outlet_ID", "SKU_ID",
        numeric.to_number(volume).alias("Volume_Liters"),
        text.flag(numeric.bad_number(volume)).alias("invalid_flag"),
    )


@query
def fill_numeric(lk: Lake) -> DataFrame:
    typed = outlets.check_outlet_master(lk.raw("outlet_master")).select(
        "_row_id", "Cooler_Count", "Outlet_Size"
    )
    return numeric.fill_all_numbers(typed, exclude=["_row_id"])


@query
def safe_ratio(lk: Lake) -> DataFrame:
    volume, bill = F.col("Volume_Liters"), F.col("Total_Bill_Value")
    return lk.labelled.select(
        "_row_id", "Outlet_ID", "SKU_ID", numeric.ratio(bill, volume, 0.0).alias("bill_per_liter")
    )


@query
def clip_values(lk: Lake) -> DataFrame:
    return driver(lk, "customer").select(
        "c_custkey", numeric.clip(F.col("c_acctbal"), 0.0, 5000.0).alias("clipped"),
        numeric.half_even(numeric.clip(F.col("c_acctbal"), 0.0, 5000.0)).alias("whole"),
    )


@query
def unit_price(lk: Lake) -> DataFrame:
    priced = transactions.unit_price(transactions.classify(lk.labelled.drop("kind", "Price_Per_Liter")))
    return priced.where(F.col("kind").isin("sale", "return")).select(
        "_row_id", "Outlet_ID", "SKU_ID", "kind", "Price_Per_Liter"
    )


@query
def minmax_score(lk: Lake) -> DataFrame:
    customer = driver(lk, "customer").select("c_custkey", "c_acctbal")
    return seasonality.minmax_score(customer, "c_acctbal", "score_0_100")


@query
def label_score(lk: Lake) -> DataFrame:
    label = labels.seasonality(F.col("Seasonality_Index"))
    return lk.raw("seasonality").select(
        "_row_id",
        seasonality.label_score(label, 0).alias("seasonality_score"),
        seasonality.label_multiplier(label, 1.0).alias("seasonality_multiplier"),
    )


@query
def parse_dates(lk: Lake) -> DataFrame:
    return lk.raw("holidays").select(
        "_row_id", dates.parse_month_first(text.squash(F.col("Date"))).alias("holiday_date")
    )


@query
def zoned_dates(lk: Lake) -> DataFrame:
    zone = F.when(F.col("o_orderkey") % 3 == 0, "Z").when(F.col("o_orderkey") % 3 == 1, "-05:00").otherwise("+05:30")
    hour = F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0")
    said = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), hour, F.lit(":30:00"), zone)
    day = dates.parse_month_first(said)
    return driver(lk, "orders").select(
        "o_orderkey", day.alias("utc_day"), F.date_format(day, "yyyy-MM").alias("month")
    )


@query
def calendar_parts(lk: Lake) -> DataFrame:
    day = F.to_date("o_orderdate")
    return driver(lk, "orders").select(
        "o_orderkey", *[c.alias(n) for n, c in dates.calendar_columns(day).items()]
    )


@query
def month_spine(lk: Lake) -> DataFrame:
    counts = driver(lk, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n")
    )
    spine = dates.months_of(driver(lk, "orders"), F.col("o_orderdate"))
    return spine.join(counts, "month", "left").select(
        "month", "year", "month_num",
        dates.month_index(F.col("year"), F.col("month_num")).alias("month_index"),
        F.coalesce("n", F.lit(0)).alias("order_count"),
    )


# --- row rules -------------------------------------------------------------------------------


@query
def dq_rules(lk: Lake) -> DataFrame:
    checked = transactions.check_transactions(lk.raw("transactions"))
    return checked.select(
        "_row_id", "SKU_ID", "Volume_Liters", "Total_Bill_Value",
        F.array_join(rules.REASONS, rules.SEPARATOR).alias("reasons"),
    )


@query
def dq_split(lk: Lake) -> DataFrame:
    checked = outlets.check_outlet_master(lk.raw("outlet_master"))
    kept = rules.valid_rows(checked).select("_row_id", "Outlet_ID", F.lit("silver").alias("side"))
    refused = rules.rejected_rows(checked).select(
        "_row_id", "Outlet_ID", F.lit("rejected").alias("side")
    )
    return kept.unionByName(refused)


@query
def soft_invalid_category(lk: Lake) -> DataFrame:
    sized = lk.raw("outlet_master").select(
        "_row_id", labels.outlet_size(F.col("Outlet_Size")).alias("Outlet_Size")
    )
    return outlets.soft_category(sized, "Outlet_Size", OUTLET_SIZES)


@query
def dedupe_business_key(lk: Lake) -> DataFrame:
    marked = mark_repeats(outlets.clean_strings(lk.raw("outlet_coordinates")), ["Outlet_ID"])
    return marked.select("_row_id", "Outlet_ID", text.flag(F.col(REPEAT)).alias("is_repeat"))


@query
def dedupe_exact(lk: Lake) -> DataFrame:
    raw = lk.raw("transactions")
    marked = mark_repeats(raw, [c for c in raw.columns if c != "_row_id"])
    return marked.select(
        "_row_id", "Outlet_ID", "SKU_ID", "Volume_Liters", text.flag(F.col(REPEAT)).alias("is_repeat")
    )


@query
def coord_swap_fix(lk: Lake) -> DataFrame:
    return lk.coordinates


@query
def coordinate_corrections(lk: Lake) -> DataFrame:
    return outlets.correction_log(lk.coordinates)


@query
def classify_transactions(lk: Lake) -> DataFrame:
    classed = transactions.classify(lk.labelled.drop("kind"))
    return classed.select("_row_id", "Outlet_ID", "SKU_ID", "Volume_Liters", "kind")


@query
def price_bounds(lk: Lake) -> DataFrame:
    sales = lk.labelled.where(F.col("kind").isin("sale", transactions.PRICE_OUTLIER))
    return transactions.price_bounds(sales)


@query
def price_outliers(lk: Lake) -> DataFrame:
    sales = lk.labelled.where(F.col("kind").isin("sale", transactions.PRICE_OUTLIER)).select(
        "_row_id", "Outlet_ID", "SKU_ID", "Price_Per_Liter"
    )
    flagged = transactions.flag_price_outliers(sales, transactions.price_bounds(sales))
    return flagged.where("sku_price_outlier_flag = 1").select(
        "_row_id", "Outlet_ID", "SKU_ID", "Price_Per_Liter",
        F.lit(transactions.PRICE_OUTLIER).alias("anomaly_type"),
    )


@query
def silver_entity(lk: Lake) -> DataFrame:
    return lk.outlets


@query
def silver_seasonality(lk: Lake) -> DataFrame:
    return lk.seasonality


@query
def silver_calendar_rowcount(lk: Lake) -> DataFrame:
    return holidays.month_features_by_row(holidays.check_holidays_by_row(lk.raw("holidays")))


@query
def silver_transactions(lk: Lake) -> DataFrame:
    return transactions.sales_rows(lk.labelled)


@query
def silver_rejected_transactions(lk: Lake) -> DataFrame:
    return rules.rejected_rows(transactions.rejected_transactions(lk.labelled))


@query
def silver_billing_anomalies(lk: Lake) -> DataFrame:
    return transactions.billing_anomalies(lk.labelled)


@query
def returns_features(lk: Lake) -> DataFrame:
    return transactions.return_features(lk.silver.returns)


@query
def anomaly_features(lk: Lake) -> DataFrame:
    return transactions.anomaly_features(lk.silver.anomalies)


# --- calendar and seasonality ----------------------------------------------------------------


@query
def calendar_collapse(lk: Lake) -> DataFrame:
    return silver.holiday_dates(lk.raw("holidays"))


@query
def calendar_month_features(lk: Lake) -> DataFrame:
    return holidays.with_legacy_names(holidays.month_features(lk.holiday_dates))


@query
def pivot_counts(lk: Lake) -> DataFrame:
    return holidays.type_counts_by_month(holidays.holiday_rows(holidays.check_holidays(lk.raw("holidays"))))


@query
def calibrated_multiplier(lk: Lake) -> DataFrame:
    return seasonality.calibrated_multipliers(lk.silver.sales, lk.seasonality)


@query
def context_score(lk: Lake) -> DataFrame:
    return seasonality.context_score(lk.seasonality, lk.holiday_months, lk.multipliers)


@query
def context_summary(lk: Lake) -> DataFrame:
    return seasonality.context_summary(lk.context)


@query
def series_by_year(lk: Lake) -> DataFrame:
    return seasonality.series_by_year(lk.seasonality)


# --- monthly and outlet features -------------------------------------------------------------


@query
def monthly_sales(lk: Lake) -> DataFrame:
    return monthly.monthly_sales(lk.silver.sales)


@query
def primary_key_mode(lk: Lake) -> DataFrame:
    return monthly.primary_distributor(lk.silver.sales)


@query
def monthly_sales_gold(lk: Lake) -> DataFrame:
    return monthly.monthly_sales_gold(
        lk.monthly, lk.main_distributor, lk.holiday_months, lk.seasonality, lk.context, silver.as_gold_density(lk.density),
    )


@query
def outlet_features(lk: Lake) -> DataFrame:
    return features.outlet_features(
        lk.monthly_gold, lk.silver.sales, lk.main_distributor
    )


@query
def month_slice_features(lk: Lake) -> DataFrame:
    return lk.monthly_gold.groupBy("Outlet_ID").agg(*features.month_slices())


@query
def recent_n_rows(lk: Lake) -> DataFrame:
    return features.recent_n_rows(lk.monthly_gold)


@query
def recent_n_months(lk: Lake) -> DataFrame:
    table = monthly.with_recency(lk.monthly_gold.select("Outlet_ID", "Year", "Month", "monthly_liters"))
    return table.groupBy("Outlet_ID").agg(*features.recent_months())


@query
def seasonal_spike(lk: Lake) -> DataFrame:
    columns = ["Outlet_ID", "median_monthly_liters", "april_avg_liters", "december_avg_liters"]
    return features.with_spikes(lk.features.select(*columns))


@query
def outlet_context_avg(lk: Lake) -> DataFrame:
    table = lk.monthly_gold.select("Outlet_ID", "Year", "Month")
    return features.outlet_context_average(table, lk.holiday_months)


@query
def imputation_features(lk: Lake) -> DataFrame:
    s = lk.silver
    return gold.imputation_features(
        s.outlets, s.coordinates, lk.monthly, s.sales, lk.main_distributor, transactions.return_features(s.returns),
        s.holiday_months, s.seasonality,
    )


# --- spatial and density ---------------------------------------------------------------------


def outlet_points(lk: Lake) -> DataFrame:
    return lk.coordinates.select(
        F.col("Outlet_ID").alias("location_name"), F.col("Latitude").alias("latitude"),
        F.col("Longitude").alias("longitude"),
    )


@query
def spatial_within(lk: Lake) -> DataFrame:
    return spatial.points_in_regions(outlet_points(lk), lk.regions)


@query
def spatial_nearest(lk: Lake) -> DataFrame:
    return spatial.nearest_region(
        spatial.points_in_regions(outlet_points(lk), lk.regions), lk.regions
    )


@query
def dim_map_fallback(lk: Lake) -> DataFrame:
    return silver.located_outlets(lk.coordinates, lk.regions, lk.raw("district_map"))


@query
def radius_sum(lk: Lake) -> DataFrame:
    return spatial.sum_in_radius(
        outlet_points(lk), lk.raw("population_grid"), "people", "population", DEFAULTS.radius_km
    )


@query
def nearest_lookup(lk: Lake) -> DataFrame:
    return spatial.density_lookup(lk.raw("depots"), lk.density)


def customer_population(lk: Lake) -> DataFrame:
    return driver(lk, "customer").select(
        F.concat(F.lit("O"), F.col("c_custkey").cast("string")).alias("location_name"),
        F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("province"),
        F.greatest(F.floor("c_acctbal"), F.lit(0)).cast("double").alias("population"),
    )


@query
def growth_extrapolate(lk: Lake) -> DataFrame:
    return density.yearly_population(customer_population(lk))


@query
def zero_audit(lk: Lake) -> DataFrame:
    return density.zero_audit(density.yearly_population(customer_population(lk)))


@query
def expand_year_to_month(lk: Lake) -> DataFrame:
    return density.monthly_density(density.yearly_population(customer_population(lk)))


@query
def hierarchical_fill(lk: Lake) -> DataFrame:
    return density.fill_density(
        density.monthly_density(density.yearly_population(customer_population(lk)))
    )


@query
def percentile_bands(lk: Lake) -> DataFrame:
    return density.percentile_bands(lk.density)


@query
def topk_entities(lk: Lake) -> DataFrame:
    return density.top_locations(lk.density).select("location_name", "month", "monthly_density")


# --- Gold ------------------------------------------------------------------------------------


@query
def target_month_context(lk: Lake) -> DataFrame:
    base = lk.features.select("Outlet_ID", "Distributor_ID")
    return gold.add_target_context(
        base, lk.holiday_months, lk.seasonality, lk.context, silver.as_gold_density(lk.density)
    )


@query
def outlet_gold(lk: Lake) -> DataFrame:
    s = lk.silver
    assembled = gold.outlet_gold(
        s.outlets, s.coordinates, lk.features, transactions.return_features(s.returns),
        transactions.anomaly_features(s.anomalies),
    )
    return gold.finish_outlet_gold(
        gold.add_target_context(assembled, s.holiday_months, s.seasonality, lk.context, s.density)
    )


# --- potential with the outlet type as the peer group ----------------------------------------


def peer_table(lk: Lake) -> DataFrame:
    return lk._layer(
        "peer_benchmarks", lambda: potential.peer_benchmarks(lk.outlet_gold, lk.monthly_gold, PEER)
    )


def peer_potential(lk: Lake) -> DataFrame:
    return lk._layer(
        "potential", lambda: potential.outlet_potential(lk.outlet_gold, peer_table(lk), PEER)
    )


@query
def cluster_profiles(lk: Lake) -> DataFrame:
    return potential.peer_profiles(lk.outlet_gold, PEER)


@query
def cluster_benchmarks(lk: Lake) -> DataFrame:
    return potential.peer_benchmarks(lk.outlet_gold, lk.monthly_gold, PEER)


@query
def adjustments(lk: Lake) -> DataFrame:
    joined = potential.with_benchmarks(lk.outlet_gold, peer_table(lk), PEER)
    return potential.adjustments(joined).select(
        "Outlet_ID", "jan_2026_multiplier_used", "jan_2026_adjusted_holiday_score_used",
        "jan_2026_density_used", "seasonality_relative_adjustment", "holiday_relative_adjustment",
        "density_relative_adjustment", "recent_trend_adjustment", "capacity_relative_adjustment",
    )


@query
def potential_estimate(lk: Lake) -> DataFrame:
    return potential.outlet_potential(lk.outlet_gold, peer_table(lk), PEER)


QUERIES["potential"] = QUERIES.pop("potential_estimate")


@query
def potential_gap(lk: Lake) -> DataFrame:
    return potential.potential_gap(
        peer_potential(lk).select("Outlet_ID", "Maximum_Monthly_Liters").join(
            lk.outlet_gold.select("Outlet_ID", "avg_january_liters"), "Outlet_ID"
        )
    )


@query
def submission(lk: Lake) -> DataFrame:
    return potential.submission(peer_potential(lk))


@query
def validate_output(lk: Lake) -> DataFrame:
    return potential.validate_output(potential.submission(peer_potential(lk)), master=lk.outlets)


@query
def potential_summary(lk: Lake) -> DataFrame:
    return potential.potential_summary(peer_potential(lk), PEER)


@query
def cluster_prediction_summary(lk: Lake) -> DataFrame:
    return potential.peer_prediction_summary(peer_potential(lk), PEER)


# --- models ----------------------------------------------------------------------------------


@query
def class_balance(lk: Lake) -> DataFrame:
    return imputer.class_counts(driver(lk, "labels"), "quality")


@query
def class_weights(lk: Lake) -> DataFrame:
    return imputer.balanced_weights(driver(lk, "labels"), "quality")


@query
def stratified_folds(lk: Lake) -> DataFrame:
    split = imputer.stratified_folds(driver(lk, "labels"), "quality", "doc_id", 5, DEFAULTS.seed)
    return split.groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("fold_rows"))


@query
def confusion_matrix(lk: Lake) -> DataFrame:
    return imputer.confusion_matrix(driver(lk, "labels"), "quality", "toxic", [0, 1])


@query
def cv_metrics(lk: Lake) -> DataFrame:
    return imputer.CategoryImputer(config=DEFAULTS).cross_validate(lk.imputer_features)


@query
def class_report(lk: Lake) -> DataFrame:
    """Per-class, macro and weighted scores of the imputer's held-out predictions over all folds."""
    held = imputer.CategoryImputer(config=DEFAULTS).held_out_predictions(lk.imputer_features)
    return imputer.class_report(held, imputer.TARGET, "predicted")


def fitted_imputer(lk: Lake) -> imputer.CategoryImputer:
    if not hasattr(lk, "_imputer"):
        lk._imputer = imputer.CategoryImputer(config=DEFAULTS).fit(lk.imputer_features)
    return lk._imputer


def imputed(lk: Lake) -> DataFrame:
    return fitted_imputer(lk).impute(lk.imputer_features)


@query
def impute_category(lk: Lake) -> DataFrame:
    return imputed(lk).select(
        "Outlet_ID", "Outlet_Size", "Outlet_Size_Imputed", "Outlet_Size_Confidence",
        "Outlet_Size_Review_Flag",
    )


@query
def feature_importance(lk: Lake) -> DataFrame:
    return fitted_imputer(lk).feature_importance(lk.imputer_features)


@query
def impute_summary(lk: Lake) -> DataFrame:
    return imputer.imputation_summary(imputed(lk))


@query
def low_confidence_imputations(lk: Lake) -> DataFrame:
    return imputer.low_confidence(imputed(lk)).select(
        "Outlet_ID", "Outlet_Size", "Outlet_Size_Confidence"
    )


def clustered(lk: Lake) -> clustering.Clustering:
    if not hasattr(lk, "_clustering"):
        lk._clustering = clustering.cluster_outlets(lk.outlet_gold, DEFAULTS)
    return lk._clustering


@query
def k_selection(lk: Lake) -> DataFrame:
    return clustered(lk).scores


@query
def cluster_outlets(lk: Lake) -> DataFrame:
    return clustered(lk).assigned


@query
def clustered_potential(lk: Lake) -> DataFrame:
    grouped = lk.outlet_gold.join(clustered(lk).assigned, "Outlet_ID")
    benchmarks = potential.peer_benchmarks(grouped, lk.monthly_gold)
    return potential.outlet_potential(grouped, benchmarks)


