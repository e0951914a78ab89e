"""Silver layer: checked and typed tables from the raw ones."""

from __future__ import annotations

from pyspark.sql import DataFrame

from outletry.config import DEFAULTS, PipelineConfig
from outletry.operators import holidays, outlets, seasonality, transactions
from outletry.operators.density import fill_density, monthly_density, yearly_population
from outletry.operators.repeats import ROW_ID
from outletry.operators.rules import BROKEN_LINE, valid_rows, with_broken_lines
from outletry.operators.spatial import map_with_fallback, nearest_region, points_in_regions, sum_in_radius
from outletry.session import stage


def silver_outlets(raw: DataFrame) -> DataFrame:
    return valid_rows(outlets.check_outlet_master(raw)).drop(ROW_ID)


def silver_coordinates(raw: DataFrame, config: PipelineConfig = DEFAULTS) -> DataFrame:
    return valid_rows(outlets.check_coordinates(raw, config)).drop(ROW_ID)


def silver_seasonality(raw: DataFrame, config: PipelineConfig = DEFAULTS) -> DataFrame:
    return valid_rows(seasonality.check_seasonality(raw, config)).drop(ROW_ID)


def labelled_transactions(raw: DataFrame, config: PipelineConfig = DEFAULTS) -> DataFrame:
    """The checked rows are staged with class and price: the price bounds read them before the final labels can."""
    checked = with_broken_lines(transactions.check_transactions(raw, config)).drop(BROKEN_LINE)
    priced = stage(transactions.unit_price(transactions.classify(checked)), "checked_transactions")
    return transactions.label_priced(priced, config)


def holiday_dates(raw: DataFrame) -> DataFrame:
    return holidays.collapse_dates(holidays.holiday_rows(holidays.check_holidays(raw)))


def holiday_months(raw: DataFrame) -> DataFrame:
    return holidays.month_features(holiday_dates(raw))


def located_outlets(coordinates: DataFrame, regions: DataFrame, provinces: DataFrame) -> DataFrame:
    """Outlet positions with district and province, the nearest district where none contains them."""
    points = coordinates.selectExpr(
        "Outlet_ID AS location_name", "Latitude AS latitude", "Longitude AS longitude"
    )
    inside = nearest_region(points_in_regions(points, regions), regions)
    named = inside.withColumnRenamed("region", "district")
    return map_with_fallback(named, "district", provinces, "province")


def outlet_density(
    coordinates: DataFrame,
    regions: DataFrame,
    provinces: DataFrame,
    grid: DataFrame,
    config: PipelineConfig = DEFAULTS,
) -> DataFrame:
    """Monthly density of every outlet, gaps filled from its province and month."""
    points = located_outlets(coordinates, regions, provinces)
    people = sum_in_radius(points, grid, "people", "population", config.radius_km)
    yearly = stage(yearly_population(people, "population", config), "yearly_population")
    return fill_density(monthly_density(yearly))


def as_gold_density(density: DataFrame) -> DataFrame:
    """Density keyed the way the Gold tables are."""
    return density.selectExpr(
        "location_name AS Outlet_ID", "year AS Year", "month_num AS Month", "base_population",
        "monthly_density", "mobility_factor", "tourism_factor", "province",
    )
