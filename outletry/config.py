"""Fixed values of the outlet-potential workload and the tunable pipeline settings."""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------
# These must be equal to the published method for equal results.
# --------------------------------------------------------------------------

NULL_TOKENS = ("", " ", "nan", "none", "null", "n/a", "na", "-", "--", "?", "missing")

OUTLET_SIZES = ("Small", "Medium", "Large", "Extra Large")
SEASONALITY_LABELS = ("Favorable", "Moderate", "Un-Favorable")
HOLIDAY_TYPES = ("Public", "Bank", "Mercantile", "Poya Day")

SIZE_NULL_WORDS = ("Nan", "None", "Null", "N/A", "Na")

OUTLET_TYPE_TYPOS = {
    "Grocry": "Grocery",
    "Grocerry": "Grocery",
    "Bakry": "Bakery",
    "Backery": "Bakery",
    "Pharamacy": "Pharmacy",
    "Pharmcy": "Pharmacy",
}

SEASONALITY_SYNONYMS = {
    "favorable": "Favorable",
    "favourable": "Favorable",
    "moderate": "Moderate",
    "unfavorable": "Un-Favorable",
    "un-favorable": "Un-Favorable",
    "un favourable": "Un-Favorable",
    "un favorable": "Un-Favorable",
}

HOLIDAY_TYPE_SYNONYMS = {
    "Public Holiday": "Public",
    "Bank Holiday": "Bank",
    "Mercantile Holiday": "Mercantile",
    "Poya": "Poya Day",
}

FESTIVE_KEYWORDS = (
    "New Year", "Vesak", "Christmas", "Pongal", "Deepavali",
    "Ramazan", "Eid", "Labour", "National Day",
)
POYA_KEYWORDS = ("Poya",)

SEASONALITY_SCORE = {"Favorable": 1, "Moderate": 0, "Un-Favorable": -1}
SEASONALITY_MULTIPLIER = {"Favorable": 1.10, "Moderate": 1.00, "Un-Favorable": 0.90}
# Label -> (lowest, highest) calibrated multiplier.
SEASONALITY_MULTIPLIER_LIMITS = {
    "Favorable": (1.00, 1.20),
    "Moderate": (1.00, 1.00),
    "Un-Favorable": (0.80, 1.00),
}

# Weight of each monthly count in the holiday intensity score.
HOLIDAY_INTENSITY_WEIGHTS = {
    "public": 1.00,
    "mercantile": 0.80,
    "bank": 0.50,
    "poya": 0.70,
    "long_weekend": 0.60,
    "festive": 1.20,
}

MONTHLY_TOURISM_FACTOR = {
    1: 1.18, 2: 1.15, 3: 1.08, 4: 0.82, 5: 0.70, 6: 0.75,
    7: 0.85, 8: 0.90, 9: 0.80, 10: 0.88, 11: 1.05, 12: 1.20,
}
YEARLY_MOBILITY_FACTOR = {
    2020: 0.60, 2021: 0.72, 2022: 0.85, 2023: 0.95, 2024: 1.00, 2025: 1.02,
}

DISTRICT_TO_PROVINCE = {
    "Colombo": "Western", "Gampaha": "Western", "Kalutara": "Western",
    "Kandy": "Central", "Matale": "Central", "Nuwara Eliya": "Central",
    "Galle": "Southern", "Matara": "Southern", "Hambantota": "Southern",
    "Jaffna": "Northern", "Kilinochchi": "Northern", "Mannar": "Northern",
    "Vavuniya": "Northern", "Mullaitivu": "Northern",
    "Trincomalee": "Eastern", "Batticaloa": "Eastern", "Ampara": "Eastern",
    "Kurunegala": "North Western", "Puttalam": "North Western",
    "Anuradhapura": "North Central", "Polonnaruwa": "North Central",
    "Badulla": "Uva", "Monaragala": "Uva",
    "Ratnapura": "Sabaragamuwa", "Kegalle": "Sabaragamuwa",
}

# Header variants accepted for a location table, first match wins.
LOCATION_ALIASES = {
    "latitude": ("latitude", "lat", "y"),
    "longitude": ("longitude", "lon", "long", "lng", "x"),
    "location_name": ("location_name", "outlet_id", "name", "id", "site_id"),
}

# Older header -> current header of the monthly holiday table.
LEGACY_HOLIDAY_COLUMNS = {
    "holiday_record_count": "holiday_classification_count",
    "public_holiday_count": "public_holiday_date_count",
    "bank_holiday_count": "bank_holiday_date_count",
    "mercantile_holiday_count": "mercantile_holiday_date_count",
    "poya_day_count": "poya_day_date_count",
    "weekend_holiday_count": "weekend_holiday_date_count",
    "long_weekend_holiday_count": "long_weekend_holiday_date_count",
    "festive_holiday_count": "festive_holiday_date_count",
}
HOLIDAY_MONTH_COLUMNS = ("holiday_date_count",) + tuple(LEGACY_HOLIDAY_COLUMNS.values()) + (
    "holiday_intensity_score",
)

TRANSACTION_COLUMNS = (
    "Outlet_ID", "Year", "Month", "Distributor_ID", "SKU_ID", "Volume_Liters", "Total_Bill_Value",
)

SUBMISSION_COLUMNS = ("Outlet_ID", "Maximum_Monthly_Liters")

# Columns the models read and the profiles report.
IMPUTER_NUMERIC = (
    "Cooler_Count", "Latitude", "Longitude", "avg_monthly_liters", "median_monthly_liters",
    "max_monthly_liters", "sales_std", "sales_cv", "total_liters", "avg_bill_value",
    "max_bill_value", "total_bill_value", "avg_sku_count", "max_sku_count", "total_unique_skus",
    "active_months", "recent_3_month_avg_liters", "recent_6_month_avg_liters",
    "avg_january_liters", "max_january_liters", "distributor_count", "return_record_count",
    "return_liters_abs", "return_ratio_liters", "return_ratio_value", "avg_seasonality_score",
)
IMPUTER_CATEGORICAL = ("Outlet_Type", "Distributor_ID")
CLUSTER_NUMERIC = (
    "Cooler_Count", "Latitude", "Longitude",
    "avg_monthly_liters", "median_monthly_liters", "avg_monthly_liters_excluding_apr_dec",
    "max_monthly_liters", "p75_monthly_liters", "p90_monthly_liters", "sales_std", "sales_cv",
    "total_liters", "avg_bill_value", "total_bill_value",
    "avg_sku_count", "max_sku_count", "total_unique_skus", "active_months",
    "recent_3_month_avg_liters", "recent_6_month_avg_liters",
    "avg_january_liters", "max_january_liters",
    "april_spike_ratio", "december_spike_ratio", "seasonal_peak_liters", "peak_to_median_ratio",
    "seasonal_spike_flag", "return_ratio_liters", "return_ratio_value", "billing_anomaly_count",
    "avg_holiday_intensity_score", "avg_seasonality_adjusted_holiday_score",
    "avg_distributor_month_context_score", "avg_seasonality_multiplier_calibrated",
    "favorable_holiday_month_count", "unfavorable_holiday_month_count", "festive_favorable_month_count",
    "avg_monthly_density", "max_monthly_density", "avg_january_density", "max_january_density",
    "avg_base_population", "avg_mobility_factor", "avg_tourism_factor",
    "jan_2026_adjusted_holiday_score_proxy", "jan_2026_seasonality_multiplier_used",
    "jan_2026_monthly_density", "jan_2026_base_population", "jan_2026_mobility_factor",
    "jan_2026_tourism_factor",
)
CLUSTER_CATEGORICAL = ("Outlet_Size", "Outlet_Type", "Distributor_ID", "province", "jan_2026_seasonality_index")
PROFILE_COLUMNS = (
    "avg_monthly_liters", "median_monthly_liters", "p90_monthly_liters", "max_monthly_liters",
    "avg_january_liters", "max_january_liters", "Cooler_Count", "avg_sku_count",
    "total_unique_skus", "return_ratio_liters", "billing_anomaly_count",
    "avg_holiday_intensity_score", "avg_seasonality_adjusted_holiday_score",
    "avg_distributor_month_context_score", "avg_monthly_density", "avg_january_density",
)

# --------------------------------------------------------------------------
# Choices of this library.
# --------------------------------------------------------------------------

# Category columns without a closed list of values. They are always hashed to so many buckets, so that the
# features do not depend on how many values there are; all other categories are one-hot as they are.
OPEN_CATEGORIES = ("Distributor_ID",)
HASH_WIDTH = 1024


@dataclass(frozen=True)
class PipelineConfig:
    """Settings of one run; the defaults are the published ones."""

    lat_range: tuple[float, float] = (5.0, 10.5)
    lon_range: tuple[float, float] = (79.0, 82.5)
    transaction_years: tuple[int, ...] = (2023, 2024, 2025)
    seasonality_years: tuple[int, ...] = (2023, 2024, 2025, 2026)
    min_records_per_sku: int = 20
    price_iqr_factor: float = 3.0
    price_tolerance: float = 0.25
    spike_ratio: float = 1.5
    target_year: int = 2026
    target_month: int = 1
    audit_year: int = 2023
    audit_month: int = 1
    # population
    density_years: tuple[int, ...] = (2023, 2024, 2025)
    population_base_year: int = 2020
    annual_growth: float = 0.008
    radius_km: float = 1.0
    # imputation
    confidence_limit: float = 0.80
    max_folds: int = 5
    trees: int = 300
    tree_depth: int = 4
    seed: int = 42
    # clustering
    k_min: int = 3
    k_max: int = 10
    search_restarts: int = 20
    final_restarts: int = 30
    # potential
    min_peer_january_rows: int = 30
    january_ratio_range: tuple[float, float] = (0.75, 1.25)
    seasonality_range: tuple[float, float] = (0.90, 1.10)
    holiday_range: tuple[float, float] = (0.97, 1.03)
    density_range: tuple[float, float] = (0.95, 1.05)
    trend_range: tuple[float, float] = (0.90, 1.10)
    capacity_range: tuple[float, float] = (0.90, 1.10)
    holiday_weight: float = 0.02
    density_weight: float = 0.20
    capacity_weight: float = 0.15
    missing_cap_factor: float = 1.20
    expected_outlets: int | None = 20000
    # driver threads that submit independent fits
    fit_threads: int = 4


DEFAULTS = PipelineConfig()
