"""Holiday calendar: row checks, collapse to unique dates, monthly features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletry.config import (
    DEFAULTS,
    FESTIVE_KEYWORDS,
    HOLIDAY_INTENSITY_WEIGHTS,
    HOLIDAY_MONTH_COLUMNS,
    HOLIDAY_TYPES,
    LEGACY_HOLIDAY_COLUMNS,
    POYA_KEYWORDS,
    PipelineConfig,
)
from outletry.functions import labels
from outletry.functions.dates import calendar_columns, parse_month_first
from outletry.functions.numeric import to_number
from outletry.functions.text import flag, mentions, squash
from outletry.operators.outlets import clean_strings
from outletry.operators.repeats import REPEAT, mark_repeats
from outletry.operators.rules import REASONS, Rule, mandatory, require_columns, with_reasons

_COLUMNS = ["Date", "Holiday_Name", "Holiday_Type"]
_DATE_KEYS = ["Date", "Year", "Month", "Year_Month", "Day_Name", "Day_Of_Week"]


def holiday_flags(name: Column, kind: Column) -> dict[str, Column]:
    return {
        "row_has_public_holiday": flag(kind == "Public"),
        "row_has_bank_holiday": flag(kind == "Bank"),
        "row_has_mercantile_holiday": flag(kind == "Mercantile"),
        "row_has_poya_day": flag((kind == "Poya Day") | mentions(name, POYA_KEYWORDS)),
        "row_is_festive_holiday": flag(mentions(name, FESTIVE_KEYWORDS)),
    }


def intensity(counts: dict[str, Column]) -> Column:
    """Weighted sum of the monthly counts."""
    total = F.lit(0.0)
    for name, weight in HOLIDAY_INTENSITY_WEIGHTS.items():
        total = total + counts[name] * F.lit(weight)
    return total


def check_holidays(raw: DataFrame) -> DataFrame:
    """Corrected cleaning: only rows that pass every rule compete as exact repeats."""
    # Squashed in a step of its own, as labels and dates read the text many times.
    df = require_columns(raw, _COLUMNS).withColumns({c: squash(F.col(c)) for c in _COLUMNS}).withColumns(
        {
            "Holiday_Type": labels.holiday_type(F.col("Holiday_Type")),
            "Date": parse_month_first(F.col("Date")),
        }
    )
    kind = F.col("Holiday_Type")
    df = with_reasons(
        df,
        [
            Rule("Invalid Date value", F.col("Date").isNull()),
            Rule("Missing Holiday_Name", F.col("Holiday_Name").isNull()),
            Rule("Missing Holiday_Type", kind.isNull()),
            Rule("Invalid Holiday_Type", ~kind.isin(*HOLIDAY_TYPES)),
        ],
    )
    df = mark_repeats(df, _COLUMNS, among=F.size(REASONS) == 0)
    rule = Rule("Exact duplicate holiday classification record", F.col(REPEAT))
    return with_reasons(df, [rule]).drop(REPEAT)


def holiday_rows(checked: DataFrame) -> DataFrame:
    """Valid row-level calendar with calendar parts and row flags."""
    return checked.where(F.size(REASONS) == 0).select(
        *_COLUMNS,
        *[c.alias(n) for n, c in calendar_columns(F.col("Date")).items()],
        *[c.alias(n) for n, c in holiday_flags(F.col("Holiday_Name"), F.col("Holiday_Type")).items()],
    )


def collapse_dates(rows: DataFrame) -> DataFrame:
    """One row per date, so a date filed under four types counts once.

    Rows are first reduced to distinct (date, name, type) with their counts. What is collected per
    date is then the distinct names themselves, which is the result, not the rows behind it.
    """
    flags = {
        "has_public_holiday": "row_has_public_holiday",
        "has_bank_holiday": "row_has_bank_holiday",
        "has_mercantile_holiday": "row_has_mercantile_holiday",
        "has_poya_day": "row_has_poya_day",
        "is_weekend_holiday": "is_weekend_holiday",
        "is_long_weekend_proxy": "is_long_weekend_proxy",
        "is_festive_holiday": "row_is_festive_holiday",
    }
    pairs = rows.groupBy(*_DATE_KEYS, "Holiday_Name", "Holiday_Type").agg(
        F.count("Holiday_Type").alias("_n"),
        *[F.max(src).alias(out) for out, src in flags.items()],
    )

    def joined(column: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.trim(column))), " | ")

    return pairs.groupBy(*_DATE_KEYS).agg(
        joined("Holiday_Name").alias("holiday_names_combined"),
        joined("Holiday_Type").alias("holiday_types_combined"),
        F.sum("_n").alias("holiday_classification_count"),
        *[F.max(out).alias(out) for out in flags],
    )


def month_features(dates: DataFrame) -> DataFrame:
    """Monthly counts over unique dates and the intensity score."""
    counts = {
        "holiday_classification_count": "holiday_classification_count",
        "public_holiday_date_count": "has_public_holiday",
        "bank_holiday_date_count": "has_bank_holiday",
        "mercantile_holiday_date_count": "has_mercantile_holiday",
        "poya_day_date_count": "has_poya_day",
        "weekend_holiday_date_count": "is_weekend_holiday",
        "long_weekend_holiday_date_count": "is_long_weekend_proxy",
        "festive_holiday_date_count": "is_festive_holiday",
    }
    return (
        dates.groupBy("Year", "Month", "Year_Month")
        .agg(
            F.count_distinct("Date").alias("holiday_date_count"),
            *[F.sum(src).alias(out) for out, src in counts.items()],
        )
        .withColumn(
            "holiday_intensity_score",
            intensity(
                {
                    "public": F.col("public_holiday_date_count"),
                    "mercantile": F.col("mercantile_holiday_date_count"),
                    "bank": F.col("bank_holiday_date_count"),
                    "poya": F.col("poya_day_date_count"),
                    "long_weekend": F.col("long_weekend_holiday_date_count"),
                    "festive": F.col("festive_holiday_date_count"),
                }
            ),
        )
    )


def with_legacy_names(months: DataFrame) -> DataFrame:
    """Also offer the monthly counts under their older names."""
    return months.withColumns({old: F.col(new) for old, new in LEGACY_HOLIDAY_COLUMNS.items()})


def legacy_alias_fill(months: DataFrame) -> DataFrame:
    """Bring an older or partial monthly table to the current columns, numbers defaulting to 0."""
    out = {}
    for old, new in LEGACY_HOLIDAY_COLUMNS.items():
        if new not in months.columns and old in months.columns:
            out[new] = F.col(old)
    for name in HOLIDAY_MONTH_COLUMNS:
        source = out.get(name, F.col(name) if name in months.columns else F.lit(None))
        out[name] = F.coalesce(to_number(source.cast("string")), F.lit(0.0))
    return months.withColumns(out)


def check_holidays_by_row(raw: DataFrame) -> DataFrame:
    """First cleaning variant: null words, mandatory fields, repeats over all rows by raw date."""
    df = clean_strings(require_columns(raw, _COLUMNS))
    df = df.withColumns(
        {
            "Holiday_Type": labels.holiday_type(F.col("Holiday_Type")),
            "_day": parse_month_first(F.col("Date")),
            "_kind_lost": F.col("Holiday_Type").isNull(),
        }
    )
    kind = F.col("Holiday_Type")
    df = mark_repeats(df, _COLUMNS)
    rules = mandatory(["Date", "Holiday_Name"]) + [
        Rule("Missing mandatory field: Holiday_Type", F.col("_kind_lost")),
        Rule("Invalid Date value", F.col("_day").isNull()),
        Rule("Invalid Holiday_Type category", ~kind.isin(*HOLIDAY_TYPES)),
        Rule("Exact duplicate holiday record", F.col(REPEAT)),
    ]
    return with_reasons(df, rules).withColumn("Date", F.col("_day")).drop("_day", "_kind_lost", REPEAT)


def month_features_by_row(checked: DataFrame) -> DataFrame:
    """Monthly counts over rows (a date filed twice counts twice) and their intensity score."""
    rows = holiday_rows(checked)
    counts = {
        "public_holiday_count": "row_has_public_holiday",
        "bank_holiday_count": "row_has_bank_holiday",
        "mercantile_holiday_count": "row_has_mercantile_holiday",
        "poya_day_count": "row_has_poya_day",
        "weekend_holiday_count": "is_weekend_holiday",
        "long_weekend_holiday_count": "is_long_weekend_proxy",
        "festive_holiday_count": "row_is_festive_holiday",
    }
    return (
        rows.groupBy("Year", "Month", "Year_Month")
        .agg(
            F.count_distinct("Date").alias("holiday_date_count"),
            F.count("Holiday_Name").alias("holiday_record_count"),
            *[F.sum(src).alias(out) for out, src in counts.items()],
        )
        .withColumn(
            "holiday_intensity_score",
            intensity(
                {
                    "public": F.col("public_holiday_count"),
                    "mercantile": F.col("mercantile_holiday_count"),
                    "bank": F.col("bank_holiday_count"),
                    "poya": F.col("poya_day_count"),
                    "long_weekend": F.col("long_weekend_holiday_count"),
                    "festive": F.col("festive_holiday_count"),
                }
            ),
        )
    )


def type_counts_by_month(rows: DataFrame) -> DataFrame:
    """Records per month with one column per lower-cased type."""
    kinds = {t.lower(): t.lower().replace(" ", "_") + "_records" for t in HOLIDAY_TYPES}
    pivoted = (
        rows.withColumn("_type", F.lower("Holiday_Type"))
        .groupBy("Year", "Month")
        .pivot("_type", list(kinds))
        .agg(F.count("Holiday_Name"))
    )
    return pivoted.select(
        "Year", "Month", *[F.coalesce(F.col(k), F.lit(0)).alias(v) for k, v in kinds.items()]
    )


def audit_month(df: DataFrame, config: PipelineConfig = DEFAULTS) -> DataFrame:
    """Extract of the one month used for the manual check."""
    return df.where((F.col("Year") == config.audit_year) & (F.col("Month") == config.audit_month))
