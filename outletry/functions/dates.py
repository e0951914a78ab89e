"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outletry.functions.text import flag


# Day layouts, tried in this order; month comes before day where both are numbers. Each has the shape that a text
# must have at least, as trying a layout in vain costs far more than the test.
_NUMBER, _YEAR = r"[+-]?\d+", r"[+-]?\d{4,}"
DAY_LAYOUTS = {
    "M/d/yyyy": f"^{_NUMBER}/{_NUMBER}/{_YEAR}$",
    "yyyy-M-d": f"^{_YEAR}-{_NUMBER}-{_NUMBER}$",
    "yyyy/M/d": f"^{_YEAR}/{_NUMBER}/{_NUMBER}$",
    "M-d-yyyy": f"^{_NUMBER}-{_NUMBER}-{_YEAR}$",
    "d-MMM-yyyy": rf"^{_NUMBER}-\D+-{_YEAR}$",
    "d MMM yyyy": rf"^{_NUMBER} \D+ {_YEAR}$",
    "MMM d, yyyy": rf"^\D+ {_NUMBER}, {_YEAR}$",
}
_ZONE = r"(Z|[+-]\d{2}:?\d{2})$"
_TIMED = r"^(\d{4}-\d{1,2}-\d{1,2})[T ](\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?) ?"


def parse_month_first(text: Column) -> Column:
    """Date from one of the day layouts or from an ISO timestamp, null when it is none.

    A timestamp with a zone counts in UTC, one without as it stands.
    """
    zoned = F.when(text.rlike(_TIMED + _ZONE), utc_day(text))
    timed = F.when(text.rlike(_TIMED + "$"), F.try_to_date(F.regexp_extract(text, _TIMED, 1), "yyyy-M-d"))
    days = [F.when(text.rlike(shape), F.try_to_date(text, layout)) for layout, shape in DAY_LAYOUTS.items()]
    return F.coalesce(*days, timed, zoned)


def utc_day(text: Column) -> Column:
    """Day in UTC of an ISO timestamp with a zone, whatever the zone of the session."""
    at = F.regexp_replace(text, r"([+-]\d{2}):?(\d{2})$", "$1:$2").try_cast("timestamp")
    return F.to_date(F.to_utc_timestamp(at, F.current_timezone()))


def calendar_columns(day: Column) -> dict[str, Column]:
    """Calendar parts with Monday as weekday 0."""
    weekday = F.weekday(day)
    return {
        "Year": F.year(day),
        "Month": F.month(day),
        "Year_Month": F.date_format(day, "yyyy-MM"),
        "Day_Name": F.date_format(day, "EEEE"),
        "Day_Of_Week": weekday,
        "is_weekend_holiday": flag(weekday.isin(5, 6)),
        "is_long_weekend_proxy": flag(weekday.isin(0, 4)),
    }


def month_index(year: Column, month: Column) -> Column:
    return year * 12 + month


def month_spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per calendar month between two dates, both included."""
    return months_between(
        spark.range(1).select(F.to_date(F.lit(first)).alias("first"), F.to_date(F.lit(last)).alias("last"))
    )


def months_of(df: DataFrame, day: Column) -> DataFrame:
    """One row per calendar month from the first to the last ``day`` of ``df``, none for an empty table."""
    return months_between(df.agg(F.min(F.to_date(day)).alias("first"), F.max(F.to_date(day)).alias("last")))


def months_between(span: DataFrame) -> DataFrame:
    months = F.explode(
        F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("interval 1 month"))
    )
    return span.select(months.alias("month_start")).select(
        "month_start",
        F.year("month_start").alias("year"),
        F.month("month_start").alias("month_num"),
        F.date_format("month_start", "yyyy-MM").alias("month"),
    )
