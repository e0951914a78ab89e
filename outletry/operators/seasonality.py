"""Distributor seasonality: Silver table, calibrated multipliers, monthly demand context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletry.config import (
    DEFAULTS,
    HOLIDAY_MONTH_COLUMNS,
    SEASONALITY_LABELS,
    SEASONALITY_MULTIPLIER,
    SEASONALITY_MULTIPLIER_LIMITS,
    SEASONALITY_SCORE,
    PipelineConfig,
)
from outletry.functions import labels
from outletry.functions.numeric import clip, half_even, ratio, to_number
from outletry.functions.text import flag, lookup
from outletry.operators.outlets import clean_strings
from outletry.operators.repeats import REPEAT, mark_repeats
from outletry.operators.rules import Rule, mandatory, require_columns, with_reasons

KEYS = ["Distributor_ID", "Year", "Month"]
LABEL = "Seasonality_Index"


def check_seasonality(raw: DataFrame, config: PipelineConfig = DEFAULTS) -> DataFrame:
    """Seasonality labels per distributor and month with the reasons against each row."""
    df = clean_strings(require_columns(raw, [*KEYS, LABEL]))
    required = mandatory([*KEYS, LABEL])
    lost = {f"_lost{i}": rule.broken for i, rule in enumerate(required)}
    df = df.withColumns(lost).withColumns(
        {
            "Year": to_number(F.col("Year").cast("string")),
            "Month": to_number(F.col("Month").cast("string")),
            LABEL: labels.seasonality(F.col(LABEL)),
        }
    )
    df = mark_repeats(df, KEYS)
    rules = [Rule(rule.reason, F.col(name)) for name, rule in zip(lost, required)] + [
        Rule("Invalid numeric value in Year", F.col("Year").isNull()),
        Rule("Invalid numeric value in Month", F.col("Month").isNull()),
        Rule("Year outside expected seasonality range", ~F.col("Year").isin(*config.seasonality_years)),
        Rule("Month outside range 1-12", ~F.col("Month").between(1, 12)),
        Rule("Invalid Seasonality_Index category", ~F.col(LABEL).isin(*SEASONALITY_LABELS)),
        Rule("Duplicate business key: Distributor_ID-Year-Month", F.col(REPEAT)),
    ]
    df = with_reasons(df, rules).drop(*lost, REPEAT)
    return df.withColumns(
        {
            "Year": F.col("Year").cast("int"),
            "Month": F.col("Month").cast("int"),
            "seasonality_score": label_score(F.col(LABEL)),
            "seasonality_multiplier": label_multiplier(F.col(LABEL)),
        }
    )


def label_score(label: Column, default: int | None = None) -> Column:
    return lookup(label, SEASONALITY_SCORE, default)


def label_multiplier(label: Column, default: float | None = None) -> Column:
    return lookup(label, SEASONALITY_MULTIPLIER, default)


def capped_multiplier(label: Column, value: Column) -> Column:
    """Keep a measured multiplier inside the limits of its label; unknown labels give 1."""
    chain = F
    for name, (low, high) in SEASONALITY_MULTIPLIER_LIMITS.items():
        chain = chain.when(label == name, clip(value, low, high) if low < high else F.lit(low))
    return chain.otherwise(F.lit(1.0))


def calibrated_multipliers(sales: DataFrame, seasonality: DataFrame) -> DataFrame:
    """Multiplier per distributor and label: its average month against its Moderate average.

    Falls back to the ratio over all distributors, then to the default of the label. Each
    distributor's totals per label stand in one row, so neither the comparison with its Moderate
    months nor the totals over all distributors needs a join.
    """
    monthly = (
        sales.where(F.col("Distributor_ID").isNotNull())
        .groupBy(*KEYS)
        .agg(F.sum("Volume_Liters").alias("_liters"))
        .join(seasonality.select(*KEYS, LABEL), KEYS)
    )

    def of_label(name: str, column: str) -> Column:
        return F.when(F.col(LABEL) == name, F.col(column))

    places = {name: i for i, name in enumerate(SEASONALITY_LABELS)}
    totals = monthly.groupBy("Distributor_ID").agg(
        *[F.sum(of_label(name, "_liters")).alias(f"_s{i}") for name, i in places.items()],
        *[F.count(of_label(name, "_liters")).alias(f"_n{i}") for name, i in places.items()],
    )
    world = totals.agg(
        F.struct(
            *[ratio(F.sum(f"_s{i}"), F.sum(f"_n{i}")).alias(f"a{i}") for i in places.values()]
        )
    ).scalar()
    moderate = ratio(F.col(f"_s{places['Moderate']}"), F.col(f"_n{places['Moderate']}"))
    world_moderate = F.col("_world")[f"a{places['Moderate']}"]
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias(LABEL),
                ratio(F.col(f"_s{i}"), F.col(f"_n{i}")).alias("avg_liters_by_label"),
                F.when(world_moderate > 0, ratio(F.col("_world")[f"a{i}"], world_moderate))
                .otherwise(F.lit(SEASONALITY_MULTIPLIER[name]))
                .alias("_global"),
            )
            for name, i in places.items()
        ]
    )
    rows = (
        totals.withColumn("_world", world)
        .select("Distributor_ID", moderate.alias("moderate_avg_liters"), F.explode(entries).alias("_e"))
        .select("Distributor_ID", "moderate_avg_liters", "_e.*")
        .where(F.col("avg_liters_by_label").isNotNull())
    )
    own = ratio(F.col("avg_liters_by_label"), F.col("moderate_avg_liters"))
    return rows.select(
        "Distributor_ID",
        LABEL,
        "avg_liters_by_label",
        "moderate_avg_liters",
        capped_multiplier(
            F.col(LABEL), F.coalesce(own, F.col("_global"), label_multiplier(F.col(LABEL)))
        ).alias("seasonality_multiplier_calibrated"),
        F.when(own.isNotNull(), "distributor_calculated")
        .otherwise("global_calculated")
        .alias("seasonality_multiplier_source"),
    )


def minmax_score(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scale a column to 0-100 over the whole table, 0 where it is constant."""
    value = F.col(column)
    limits = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    low, high = F.col("_limits.low"), F.col("_limits.high")
    scaled = half_even(ratio(value - low, high - low) * 100, 2)
    return (
        df.withColumn("_limits", limits)
        .withColumn(out, F.when(high > low, scaled).otherwise(F.lit(0.0)))
        .drop("_limits")
    )


def context_score(
    seasonality: DataFrame, holiday_months: DataFrame, multipliers: DataFrame | None
) -> DataFrame:
    """Demand context of every distributor month: holiday intensity times calibrated multiplier."""
    columns = [c for c in HOLIDAY_MONTH_COLUMNS if c in holiday_months.columns]
    # One row per calendar month: bounded by the calendar, not by the data.
    months = F.broadcast(holiday_months.select("Year", "Month", *columns))
    context = (
        seasonality.select(*KEYS, labels.seasonality(F.col(LABEL)).alias(LABEL))
        .join(months, ["Year", "Month"], "left")
        .withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
        .withColumns(
            {
                "seasonality_score": label_score(F.col(LABEL), 0),
                "seasonality_multiplier_default": label_multiplier(F.col(LABEL), 1.0),
            }
        )
    )
    if multipliers is None:
        context = context.withColumns(
            {
                "seasonality_multiplier_calibrated": F.col("seasonality_multiplier_default"),
                "seasonality_multiplier_source": F.lit("fallback_default"),
            }
        )
    else:
        found = multipliers.select(
            "Distributor_ID", LABEL, "seasonality_multiplier_calibrated", "seasonality_multiplier_source"
        )
        context = context.join(found, ["Distributor_ID", LABEL], "left").withColumns(
            {
                "seasonality_multiplier_calibrated": F.coalesce(
                    "seasonality_multiplier_calibrated", "seasonality_multiplier_default"
                ),
                "seasonality_multiplier_source": F.coalesce(
                    "seasonality_multiplier_source", F.lit("fallback_default")
                ),
            }
        )
    context = context.withColumns(
        {
            "distributor_month_demand_context_score": F.col("holiday_intensity_score")
            * F.col("seasonality_multiplier_calibrated"),
            **context_flags(),
        }
    )
    return minmax_score(
        context, "distributor_month_demand_context_score", "distributor_month_context_score_0_100"
    )


def context_flags() -> dict[str, Column]:
    holiday, festive, label = (
        F.col("holiday_intensity_score"), F.col("festive_holiday_date_count"), F.col(LABEL),
    )
    return {
        "is_favorable_holiday_month": flag((holiday > 0) & (label == "Favorable")),
        "is_unfavorable_holiday_month": flag((holiday > 0) & (label == "Un-Favorable")),
        "is_festive_favorable_month": flag((festive > 0) & (label == "Favorable")),
    }


def context_summary(context: DataFrame) -> DataFrame:
    score = "distributor_month_demand_context_score"
    return (
        context.where(F.col("Distributor_ID").isNotNull() & F.col(LABEL).isNotNull())
        .groupBy("Distributor_ID", LABEL)
        .agg(
            F.avg(score).alias("avg_context_score"),
            F.max(score).alias("max_context_score"),
            F.count("Month").alias("month_count"),
        )
    )


def series_by_year(seasonality: DataFrame) -> DataFrame:
    """Twelve monthly scores in order for every distributor and year.

    At most one row per month is collected: the Silver key is (distributor, year, month).
    """
    ordered = F.array_sort(F.collect_list(F.struct("Month", label_score(F.col(LABEL)).alias("score"))))
    return seasonality.groupBy("Distributor_ID", "Year").agg(ordered.alias("_points")).select(
        "Distributor_ID",
        "Year",
        F.size("_points").alias("month_count"),
        F.array_join(F.transform("_points", lambda p: p["Month"].cast("string")), ",").alias("months"),
        F.array_join(F.transform("_points", lambda p: p["score"].cast("string")), ",").alias("scores"),
    )
