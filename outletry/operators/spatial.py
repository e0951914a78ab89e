"""Spatial joins built on equi-joins over grid cells; nothing pairs every row with every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletry.functions.geo import KM_PER_DEGREE, cell, haversine_km, inside_polygon, squared_degrees
from outletry.session import stage

# Raster cells per side of a block: larger blocks file each cell less often but test more per point.
_BLOCK = 4


def boxes_as_regions(boxes: DataFrame, name: str) -> DataFrame:
    """Regions (name, closed ring of vertices, centroid) from axis-aligned boxes."""
    corners = [
        ("lon_low", "lat_low"), ("lon_high", "lat_low"), ("lon_high", "lat_high"),
        ("lon_low", "lat_high"), ("lon_low", "lat_low"),
    ]
    ring = F.array(
        *[F.struct(F.col(x).cast("double").alias("lon"), F.col(y).cast("double").alias("lat"))
          for x, y in corners]
    )
    return boxes.select(
        F.col(name).alias("region"),
        ring.alias("polygon"),
        ((F.col("lon_low") + F.col("lon_high")) / 2).cast("double").alias("centroid_lon"),
        ((F.col("lat_low") + F.col("lat_high")) / 2).cast("double").alias("centroid_lat"),
    )


def points_in_regions(points: DataFrame, regions: DataFrame, size: float = 0.5) -> DataFrame:
    """Left join: add ``region`` of the polygon a point lies in, the smallest name if several.

    Each polygon is filed under the cells of its bounding box, and the polygons of a cell become
    one array. A point then meets exactly one row, so the points are neither multiplied nor
    regrouped, and the join is a plain equi-join that can be broadcast or split on a hot cell.
    """
    lats, lons = (
        F.transform("polygon", lambda p: p["lat"]),
        F.transform("polygon", lambda p: p["lon"]),
    )
    filed = (
        regions.select(
            "region", "polygon",
            F.explode(F.sequence(cell(F.array_min(lats), size), cell(F.array_max(lats), size))).alias("_ci"),
            cell(F.array_min(lons), size).alias("_from"),
            cell(F.array_max(lons), size).alias("_to"),
        )
        .select("region", "polygon", "_ci", F.explode(F.sequence("_from", "_to")).alias("_cj"))
        .groupBy("_ci", "_cj")
        .agg(F.collect_list(F.struct("region", "polygon")).alias("_filed"))
    )
    lat, lon = F.col("latitude"), F.col("longitude")
    inside = F.filter("_filed", lambda r: inside_polygon(lat, lon, r["polygon"]))
    return (
        points.withColumns({"_ci": cell(lat, size), "_cj": cell(lon, size)})
        .join(filed, ["_ci", "_cj"], "left")
        .withColumn("region", F.array_min(F.transform(inside, lambda r: r["region"])))
        .drop("_ci", "_cj", "_filed")
    )


def nearest_region(points: DataFrame, regions: DataFrame, column: str = "region") -> DataFrame:
    """Fill a missing region with the one whose centroid is nearest in degrees (then by name).

    Only points without a region are searched for; one without coordinates keeps none.
    """
    points = stage(points, "points")
    targets = regions.select(
        F.col("centroid_lat").alias("latitude"),
        F.col("centroid_lon").alias("longitude"),
        F.col("region").alias("target"),
    )
    open_points = points.where(F.col(column).isNull()).drop(column)
    filled = nearest_targets(open_points, targets, column)
    return points.where(F.col(column).isNotNull()).unionByName(filled)


def sum_in_radius(
    points: DataFrame,
    cells: DataFrame,
    value: str,
    out: str,
    radius_km: float,
    step: float = 0.01,
) -> DataFrame:
    """Add the sum of the raster cells whose centre lies within ``radius_km`` of each point.

    ``cells`` is a raster of spacing ``step``: (row_no, col_no, value) with centres at
    ``row_no * step`` and ``col_no * step``. Rows of one cell are summed first. Every cell is then
    filed under its block and those blocks it can be reached from, so the array of a block is as
    short as the block and its margin, and a point needs one equi-join on its own block and no
    regrouping. A crowded block only means many probes of the same short array.
    """
    reach_lat = int(radius_km / (KM_PER_DEGREE * step)) + 1
    # Degrees of longitude shrink with latitude: every row of the raster has its own reach, taken at the
    # farthest latitude it can serve and all around the globe next to a pole.
    farthest = F.least((F.abs(F.col("row_no")) + reach_lat) * F.lit(step), F.lit(90.0))
    per_degree = F.cos(F.radians(farthest)) * F.lit(KM_PER_DEGREE * step)
    around_globe = int(180 / step) + 1
    reach_lon = F.when(farthest >= 89.5, around_globe).otherwise(
        F.floor(F.lit(radius_km) / per_degree).cast("int") + 1
    )

    def around_block(index: str, reach: Column | int) -> tuple[Column, Column]:
        return cell(F.col(index) - reach, _BLOCK), cell(F.col(index) + reach, _BLOCK)

    raster = cells.groupBy("row_no", "col_no").agg(F.sum(value).alias("_value"))
    around = (
        raster.select(
            "row_no", "col_no", "_value",
            F.explode(F.sequence(*around_block("row_no", reach_lat))).alias("_ri"),
        )
        .select(
            "*",
            F.explode(F.sequence(*around_block("col_no", reach_lon))).alias("_rj"),
        )
        .groupBy("_ri", "_rj")
        .agg(
            F.collect_list(
                F.struct(
                    "row_no",
                    "col_no",
                    (F.col("row_no") * F.lit(step)).alias("lat"),
                    (F.col("col_no") * F.lit(step)).alias("lon"),
                    F.col("_value").alias("value"),
                )
            ).alias("_near")
        )
    )
    lat, lon = F.col("latitude"), F.col("longitude")
    near = F.filter(
        "_near",
        lambda c: (F.abs(c["row_no"] - F.col("_row")) <= reach_lat)
        & (haversine_km(lat, lon, c["lat"], c["lon"]) <= radius_km),
    )
    total = F.aggregate(near, F.lit(0.0), lambda acc, c: acc + c["value"].cast("double"))
    return (
        points.withColumns(
            {
                "_row": F.round(lat / F.lit(step)).cast("int"),
                "_col": F.round(lon / F.lit(step)).cast("int"),
            }
        )
        .withColumns({"_ri": cell(F.col("_row"), _BLOCK), "_rj": cell(F.col("_col"), _BLOCK)})
        .join(around, ["_ri", "_rj"], "left")
        .withColumn(out, F.coalesce(total, F.lit(0.0)))
        .drop("_row", "_col", "_ri", "_rj", "_near")
    )


_BRANCH = 8
_ROOT = 8.0
_SMALLEST = 1e-6


def _box_bounds(lat: Column, lon: Column, box: Column) -> tuple[Column, Column]:
    """Smallest and largest squared distance from a point to a box."""
    def gap(x: Column, low: Column, high: Column) -> Column:
        return F.greatest(low - x, x - high, F.lit(0.0))

    def far(x: Column, low: Column, high: Column) -> Column:
        return F.greatest(F.abs(x - low), F.abs(x - high))

    near_lat, near_lon = gap(lat, box["y0"], box["y1"]), gap(lon, box["x0"], box["x1"])
    far_lat, far_lon = far(lat, box["y0"], box["y1"]), far(lon, box["x0"], box["x1"])
    return near_lat * near_lat + near_lon * near_lon, far_lat * far_lat + far_lon * far_lon


def _closest_boxes(lat: Column, lon: Column, boxes: Column) -> Column:
    """Those boxes that may still hold the nearest target.

    The shortest reach is bound to the variable of the finishing step, so it is worked out once per
    array and not once per box.
    """
    return F.aggregate(
        boxes,
        F.lit(float("inf")),
        lambda reach, b: F.least(reach, _box_bounds(lat, lon, b)[1]),
        lambda reach: F.filter(boxes, lambda b: _box_bounds(lat, lon, b)[0] <= reach),
    )


def nearest_targets(points: DataFrame, targets: DataFrame, out: str, leaf_rows: int = 256) -> DataFrame:
    """Add the name of the nearest target (smallest name on a tie) to every point.

    Exact nearest neighbour by descending a tree of cells, eight by eight per level, with an
    equi-join per level. A point keeps only those cells whose nearest edge is closer than the
    farthest edge of another one, a handful at every level. Points and targets are first reduced to
    distinct positions, so copies of one position cost nothing, and levels are added until no cell
    holds more than ``leaf_rows`` positions. The distinct targets are staged, as every level reads
    them.
    """
    spots = stage(
        targets.groupBy(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).agg(
            F.min("target").alias("target")
        ),
        "spots",
    )
    sizes = [_ROOT]
    while sizes[-1] > _SMALLEST:
        crowd = spots.groupBy(cell(F.col("lat"), sizes[-1]), cell(F.col("lon"), sizes[-1])).count()
        if (crowd.agg(F.max("count")).first()[0] or 0) <= leaf_rows:
            break
        sizes.append(sizes[-1] / _BRANCH)

    def boxes(size: float) -> DataFrame:
        return spots.groupBy(
            cell(F.col("lat"), size).alias("ci"), cell(F.col("lon"), size).alias("cj")
        ).agg(
            F.min("lat").alias("y0"), F.max("lat").alias("y1"),
            F.min("lon").alias("x0"), F.max("lon").alias("x1"),
        )

    box = F.struct("ci", "cj", "y0", "y1", "x0", "x1")
    asked = points.select(F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")).distinct()
    lat, lon = F.col("_lat"), F.col("_lon")
    # The roots cover the globe with at most 23 x 46 cells.
    roots = boxes(sizes[0]).agg(F.collect_list(box)).scalar()
    open_cells = asked.withColumn("_roots", roots).select(
        "_lat", "_lon", F.explode(_closest_boxes(lat, lon, F.col("_roots"))).alias("_cell")
    )
    for parent, size in zip(sizes, sizes[1:]):
        children = boxes(size).groupBy(
            cell(F.col("ci") * F.lit(size), parent).alias("_pi"),
            cell(F.col("cj") * F.lit(size), parent).alias("_pj"),
        ).agg(F.collect_list(box).alias("_children"))
        open_cells = (
            open_cells.select(
                "_lat", "_lon", F.col("_cell.ci").alias("_pi"), F.col("_cell.cj").alias("_pj")
            )
            .join(children, ["_pi", "_pj"])
            .select("_lat", "_lon", _closest_boxes(lat, lon, F.col("_children")).alias("_boxes"))
            .groupBy("_lat", "_lon")
            .agg(F.flatten(F.collect_list("_boxes")).alias("_boxes"))
            .withColumn("_cell", F.explode(_closest_boxes(lat, lon, F.col("_boxes"))))
        )
    leaves = spots.groupBy(
        cell(F.col("lat"), sizes[-1]).alias("_pi"), cell(F.col("lon"), sizes[-1]).alias("_pj")
    ).agg(F.collect_list(F.struct("lat", "lon", "target")).alias("_spots"))
    candidates = F.transform(
        "_spots",
        lambda s: F.struct(
            squared_degrees(lat, lon, s["lat"], s["lon"]).alias("d"), s["target"].alias("target")
        ),
    )
    found = (
        open_cells.select(
            "_lat", "_lon", F.col("_cell.ci").alias("_pi"), F.col("_cell.cj").alias("_pj")
        )
        .join(leaves, ["_pi", "_pj"])
        .select("_lat", "_lon", F.array_min(candidates).alias("_best"))
        .groupBy("_lat", "_lon")
        .agg(F.min("_best").alias("_best"))
        .select("_lat", "_lon", F.col("_best.target").alias(out))
    )
    return points.join(
        found, (points["latitude"] == found["_lat"]) & (points["longitude"] == found["_lon"]), "left"
    ).drop("_lat", "_lon")


def density_lookup(requests: DataFrame, density: DataFrame) -> DataFrame:
    """Density of the nearest location in the asked month, for every request (lat, lon, month)."""
    places = density.select("latitude", "longitude", F.col("location_name").alias("target"))
    nearest = nearest_targets(requests, places, "location_name")
    values = density.select(
        "location_name", "month", "base_population", "mobility_factor", "tourism_factor",
        "monthly_density",
    )
    return nearest.join(values, ["location_name", "month"], "left")


def map_with_fallback(df: DataFrame, key: str, mapping: DataFrame, out: str) -> DataFrame:
    """Look ``key`` up in a (key, value) table and keep the key itself where it is not found."""
    source, value = mapping.columns
    pairs = mapping.select(F.col(source).alias("_key"), F.col(value).alias("_value"))
    return (
        df.join(pairs, F.trim(F.col(key)) == F.col("_key"), "left")
        .withColumn(out, F.coalesce("_value", key))
        .drop("_key", "_value")
    )
