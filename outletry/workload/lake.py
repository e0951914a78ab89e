"""Layer tables over one set of driver tables, each written once and read by later layers."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from outletry.operators.holidays import month_features
from outletry.operators.monthly import monthly_sales, primary_distributor
from outletry.operators.spatial import boxes_as_regions
from outletry.operators.transactions import KIND
from outletry.plans import gold, silver
from outletry.plans.gold import SalesFacts, SilverTables
from outletry.session import stage
from outletry.workload.tables import raw_table


class LakeSilver(SilverTables):
    """The Silver tables of a lake, each built when it is first read, so a query builds only what it uses."""

    def __init__(self, lk: Lake):
        self._lake = lk

    outlets = property(lambda self: self._lake.outlets)
    coordinates = property(lambda self: self._lake.coordinates)
    seasonality = property(lambda self: self._lake.seasonality)
    holiday_months = property(lambda self: self._lake.holiday_months)
    labelled = property(lambda self: self._lake.labelled)
    density = property(lambda self: silver.as_gold_density(self._lake.density))


class Lake:
    """Silver and Gold tables of one data folder.

    A layer is a table: it is written to the shared folder the first time it is needed and read
    from there afterwards, just as a Silver job writes what a Gold job reads. Layers that do not read
    each other are written at the same time, so that the short and uneven jobs of one fill the cores
    that another leaves idle.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._lock = threading.Lock()

    def raw(self, name: str) -> DataFrame:
        """A raw table, landed once as Bronze."""
        return self._layer(f"bronze_{name}", lambda: raw_table(self.spark, self.sf_dir, name))

    def _layer(
        self, name: str, build: Callable[[], DataFrame], by: list[str] | None = None, after: Sequence[str] = ()
    ) -> DataFrame:
        with self._lock:
            own = self._locks.setdefault(name, threading.Lock())
        with own:
            if name not in self._tables:
                if after:
                    self._together(after)
                self._tables[name] = stage(build(), name, by)
        return self._tables[name]

    def _together(self, names: Sequence[str]) -> None:
        """Build these layers at the same time; a layer that two of them read is built once."""
        with ThreadPoolExecutor(len(names)) as pool:
            list(pool.map(lambda name: getattr(self, name), names))

    @property
    def outlets(self) -> DataFrame:
        return self._layer("outlets", lambda: silver.silver_outlets(self.raw("outlet_master")))

    @property
    def coordinates(self) -> DataFrame:
        return self._layer(
            "coordinates", lambda: silver.silver_coordinates(self.raw("outlet_coordinates"))
        )

    @property
    def seasonality(self) -> DataFrame:
        return self._layer("seasonality", lambda: silver.silver_seasonality(self.raw("seasonality")))

    @property
    def holiday_dates(self) -> DataFrame:
        return self._layer("holiday_dates", lambda: silver.holiday_dates(self.raw("holidays")))

    @property
    def holiday_months(self) -> DataFrame:
        return self._layer("holiday_months", lambda: month_features(self.holiday_dates))

    @property
    def labelled(self) -> DataFrame:
        return self._layer(
            "transactions", lambda: silver.labelled_transactions(self.raw("transactions")), [KIND]
        )

    @cached_property
    def regions(self) -> DataFrame:
        return boxes_as_regions(self.raw("districts"), "district")

    @property
    def density(self) -> DataFrame:
        return self._layer(
            "density",
            lambda: silver.outlet_density(
                self.coordinates, self.regions, self.raw("district_map"), self.raw("population_grid")
            ),
        )

    @property
    def silver(self) -> SilverTables:
        return LakeSilver(self)

    @property
    def monthly(self) -> DataFrame:
        return self._layer("monthly", lambda: monthly_sales(self.silver.sales))

    @property
    def main_distributor(self) -> DataFrame:
        return self._layer("main_distributor", lambda: primary_distributor(self.silver.sales))

    @property
    def facts(self) -> SalesFacts:
        return SalesFacts(self.monthly, self.main_distributor)

    @property
    def multipliers(self) -> DataFrame:
        return self._layer(
            "multipliers", lambda: gold.multipliers(self.silver),
            after=("labelled", "seasonality"),
        )

    @property
    def context(self) -> DataFrame:
        return self._layer(
            "context", lambda: gold.demand_context(self.silver, self.multipliers),
            after=("multipliers", "holiday_months"),
        )

    @property
    def monthly_gold(self) -> DataFrame:
        return self._layer(
            "monthly_gold", lambda: gold.monthly_gold(self.silver, self.facts, self.context),
            after=("monthly", "main_distributor", "context", "density"),
        )

    @property
    def features(self) -> DataFrame:
        return self._layer(
            "features", lambda: gold.outlet_features(self.silver, self.facts, self.monthly_gold)
        )

    @property
    def outlet_gold(self) -> DataFrame:
        return self._layer(
            "outlet_gold", lambda: gold.outlet_table(self.silver, self.features, self.context),
            after=("features", "outlets"),
        )

    @property
    def imputer_features(self) -> DataFrame:
        return self._layer(
            "imputer_features", lambda: gold.imputer_features(self.silver, self.facts),
            after=("outlets", "coordinates", "monthly", "main_distributor", "holiday_months", "seasonality"),
        )


_LAKES: dict[tuple[str, str], Lake] = {}


def lake(spark: SparkSession, sf_dir: str) -> Lake:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LAKES:
        _LAKES[key] = Lake(spark, sf_dir)
    return _LAKES[key]
