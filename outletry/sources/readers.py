"""Scans of delimited files and the header repairs that go with them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outletry.config import LOCATION_ALIASES
from outletry.functions.numeric import to_number
from outletry.operators.repeats import ROW_ID
from outletry.operators.rules import BROKEN_LINE

CORRUPT = BROKEN_LINE


def text_schema(columns: list[str]) -> T.StructType:
    """Every column as text: types are given later, by casts that record what fails."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All-text scan of a CSV file or folder with a header.

    Malformed lines do not stop the scan; they are kept whole in ``_corrupt_record``. Without given columns
    the header names them.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if columns is None:
        columns = reader.csv(path).columns
    schema = text_schema(columns).add(CORRUPT, T.StringType())
    return reader.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def clean_columns(df: DataFrame) -> DataFrame:
    """Trim the headers and join their words with underscores."""
    return df.toDF(*[re.sub(r"\s+", "_", c.strip()) for c in df.columns])


def with_lineage(df: DataFrame) -> DataFrame:
    """Add the source file and a row id that follows the order of the scan.

    It must be called on the bare scan: after a shuffle the order of the file is gone.
    """
    return df.withColumns(
        {
            "_source_file": F.col("_metadata.file_name"),
            ROW_ID: F.monotonically_increasing_id(),
        }
    )


def optional_table(spark: SparkSession, path: str | None, schema: T.StructType | str) -> DataFrame:
    """The Parquet table at ``path``, or an empty table of the schema when there is none."""
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def resolve_locations(df: DataFrame) -> DataFrame:
    """Bring a location table to (location_name, latitude, longitude) whatever its headers.

    Rows without both coordinates are left out. Without a name column, names are numbered by
    scan order; ids are unique but not consecutive, since consecutive ones need a single task.
    """
    lower = {c.lower(): c for c in df.columns}
    found = {}
    for name, variants in LOCATION_ALIASES.items():
        match = next((lower[v] for v in variants if v in lower), None)
        if match is not None:
            found[name] = F.col(match)
    if not {"latitude", "longitude"} <= set(found):
        raise ValueError(f"need latitude and longitude columns, found {df.columns}")
    name = found.get("location_name", F.concat(F.lit("loc_"), (F.monotonically_increasing_id() + 1).cast("string")))
    return df.select(
        name.cast("string").alias("location_name"),
        to_number(found["latitude"].cast("string")).alias("latitude"),
        to_number(found["longitude"].cast("string")).alias("longitude"),
    ).where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def unify_period(df: DataFrame) -> DataFrame:
    """Give a table ``Outlet_ID``, ``Year`` and ``Month`` from any of the known period layouts.

    Accepted: Year/year, Month/month_num, or a month as ``yyyy-MM`` or date text.
    """
    columns = set(df.columns)
    if "Outlet_ID" not in columns and "location_name" in columns:
        df = df.withColumnRenamed("location_name", "Outlet_ID")
    if "Outlet_ID" not in df.columns:
        raise ValueError("need Outlet_ID or location_name")
    # Names differing only in case cannot be told apart by name, so the layout is read once here.
    year = next((c for c in ("Year", "year") if c in columns), None)
    month = next((c for c in ("Month", "month_num") if c in columns), None)
    period = "month" if month is None and "month" in columns else None
    new_year = F.lit(None).cast("int") if year is None else F.col(year).try_cast("int")
    new_month = F.lit(None).cast("int") if month is None else F.col(month).try_cast("int")
    if period is not None:
        start = F.coalesce(F.try_to_date(period, "yyyy-MM-dd"), F.try_to_date(period, "yyyy-MM"))
        new_year, new_month = F.year(start), F.month(start)
    out = df.withColumns({"_year": new_year, "_month": new_month})
    drop = [c for c in (year, month, period, "month" if "month" in columns else None) if c]
    return out.drop(*drop).withColumnsRenamed({"_year": "Year", "_month": "Month"})
