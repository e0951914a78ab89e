"""Gold layer: monthly sales, outlet features and the outlet table for modelling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from outletry.config import DEFAULTS, PipelineConfig
from outletry.operators import features, gold, monthly, seasonality, transactions


@dataclass
class SilverTables:
    """Inputs of the Gold layer."""

    outlets: DataFrame
    coordinates: DataFrame
    seasonality: DataFrame
    holiday_months: DataFrame
    labelled: DataFrame
    density: DataFrame

    @property
    def sales(self) -> DataFrame:
        return transactions.sales_rows(self.labelled)

    @property
    def returns(self) -> DataFrame:
        return transactions.return_rows(self.labelled)

    @property
    def anomalies(self) -> DataFrame:
        return transactions.billing_anomalies(self.labelled)


@dataclass
class SalesFacts:
    """Two aggregates of the sales rows that several Gold steps read."""

    monthly: DataFrame
    main_distributor: DataFrame


def multipliers(silver: SilverTables) -> DataFrame:
    return seasonality.calibrated_multipliers(silver.sales, silver.seasonality)


def demand_context(silver: SilverTables, calibrated: DataFrame) -> DataFrame:
    return seasonality.context_score(silver.seasonality, silver.holiday_months, calibrated)


def monthly_gold(silver: SilverTables, facts: SalesFacts, context: DataFrame) -> DataFrame:
    return monthly.monthly_sales_gold(
        facts.monthly, facts.main_distributor, silver.holiday_months, silver.seasonality, context,
        silver.density,
    )


def outlet_features(
    silver: SilverTables, facts: SalesFacts, monthly_table: DataFrame, config: PipelineConfig = DEFAULTS
) -> DataFrame:
    return features.outlet_features(monthly_table, silver.sales, facts.main_distributor, config)


def outlet_table(
    silver: SilverTables,
    feature_table: DataFrame,
    context: DataFrame,
    master: DataFrame | None = None,
    config: PipelineConfig = DEFAULTS,
) -> DataFrame:
    """One finished row per outlet; ``master`` may be the imputed outlet master."""
    assembled = gold.outlet_gold(
        silver.outlets if master is None else master,
        silver.coordinates,
        feature_table,
        transactions.return_features(silver.returns),
        transactions.anomaly_features(silver.anomalies),
    )
    return gold.finish_outlet_gold(
        gold.add_target_context(
            assembled, silver.holiday_months, silver.seasonality, context, silver.density, config
        )
    )


def imputer_features(silver: SilverTables, facts: SalesFacts) -> DataFrame:
    return gold.imputation_features(
        silver.outlets,
        silver.coordinates,
        facts.monthly,
        silver.sales,
        facts.main_distributor,
        transactions.return_features(silver.returns),
        silver.holiday_months,
        silver.seasonality,
    )
