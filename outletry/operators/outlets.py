"""Silver outlet master and outlet coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletry.config import DEFAULTS, OUTLET_SIZES, PipelineConfig
from outletry.functions import labels
from outletry.functions.numeric import bad_number, to_number
from outletry.functions.text import flag, is_token, squash
from outletry.operators.repeats import REPEAT, mark_repeats
from outletry.operators.rules import Rule, mandatory, require_columns, with_reasons


def clean_strings(df: DataFrame) -> DataFrame:
    """Squash every string column and null the words that stand for a missing value.

    As two steps, so that no text is squashed once for the test and again for the value.
    """
    text = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    squashed = df.withColumns({c: squash(F.col(c)) for c in text})
    return squashed.withColumns({c: F.when(~is_token(F.col(c)), F.col(c)) for c in text})


def soft_category(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Null an unknown category and flag it instead of refusing the row."""
    invalid = F.col(column).isNotNull() & ~F.col(column).isin(*allowed)
    kept = F.when(F.col(column).isin(*allowed), F.col(column))
    return df.withColumns(
        {
            f"{column}_Invalid_Flag": flag(invalid),
            f"{column}_Missing_Flag": flag(kept.isNull()),
            column: kept,
        }
    )


def check_outlet_master(raw: DataFrame) -> DataFrame:
    """Standardised outlet master with the reasons against each row."""
    df = clean_strings(require_columns(raw, ["Outlet_ID"]))
    if "Outlet_Size" not in df.columns:
        df = df.withColumn("Outlet_Size", F.lit(None).cast("string"))
    df = soft_category(
        df.withColumn("Outlet_Size", labels.outlet_size(F.col("Outlet_Size"))), "Outlet_Size", OUTLET_SIZES
    )
    if "Outlet_Type" in df.columns:
        df = df.withColumn("Outlet_Type", labels.outlet_type(F.col("Outlet_Type")))
    if "Cooler_Count" not in df.columns:
        df = df.withColumn("Cooler_Count", F.lit(None).cast("string"))
    coolers = F.col("Cooler_Count").cast("string")
    # Worked out before the rows are staged: a filter on the reasons would repeat it for every rule.
    df = df.withColumn("_bad_coolers", bad_number(coolers)).withColumn("Cooler_Count", to_number(coolers))
    df = mark_repeats(df, ["Outlet_ID"])
    df = with_reasons(
        df,
        mandatory(["Outlet_ID"])
        + [
            Rule("Invalid numeric value in Cooler_Count", F.col("_bad_coolers")),
            Rule("Negative Cooler_Count", F.col("Cooler_Count") < 0),
            Rule("Duplicate business key: Outlet_ID", F.col(REPEAT)),
        ],
    )
    return df.drop("_bad_coolers", REPEAT)


def inside_box(lat: Column, lon: Column, config: PipelineConfig) -> Column:
    return F.coalesce(lat.between(*config.lat_range) & lon.between(*config.lon_range), F.lit(False))


def check_coordinates(raw: DataFrame, config: PipelineConfig = DEFAULTS) -> DataFrame:
    """Coordinates with swapped pairs put right, and the reasons against each row."""
    df = clean_strings(require_columns(raw, ["Outlet_ID", "Latitude", "Longitude"]))
    lat, lon = to_number(F.col("Latitude")), to_number(F.col("Longitude"))
    df = df.withColumns(
        {
            "Latitude_Original": F.col("Latitude"),
            "Longitude_Original": F.col("Longitude"),
            "_lat": lat,
            "_lon": lon,
        }
    )
    lat, lon = F.col("_lat"), F.col("_lon")
    swap = ~inside_box(lat, lon, config) & inside_box(lon, lat, config)
    df = df.withColumn("coordinate_corrected_flag", flag(swap))
    corrected = F.col("coordinate_corrected_flag") == 1
    df = df.withColumns(
        {
            "coordinate_correction_type": F.when(corrected, "lat_lon_swapped").otherwise("none"),
            "Latitude": F.when(corrected, lon).otherwise(lat),
            "Longitude": F.when(corrected, lat).otherwise(lon),
        }
    )
    # Staged with its coordinates put right: a filter on the reasons would repeat all of the above for every rule.
    df = mark_repeats(df, ["Outlet_ID"])
    lat, lon = F.col("_lat"), F.col("_lon")
    new_lat, new_lon = F.col("Latitude"), F.col("Longitude")
    df = with_reasons(
        df,
        mandatory(["Outlet_ID"])
        + [
            Rule("Missing or invalid Latitude", lat.isNull()),
            Rule("Missing or invalid Longitude", lon.isNull()),
            Rule(
                "Invalid coordinates after swap check",
                new_lat.isNotNull() & new_lon.isNotNull() & ~inside_box(new_lat, new_lon, config),
            ),
            Rule("Duplicate business key: Outlet_ID", F.col(REPEAT)),
        ],
    )
    return df.drop("_lat", "_lon", REPEAT)


def correction_log(silver_coordinates: DataFrame) -> DataFrame:
    return silver_coordinates.where("coordinate_corrected_flag = 1")
