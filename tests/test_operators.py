import dataclasses
import random
import re
import threading
import time

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from outletry.config import DEFAULTS
from outletry.operators import (
    clustering, density, gold, holidays, imputer, monthly, outlets, potential, reports, rules, seasonality, spatial, transactions,
)
from outletry.operators.quantiles import group_quantiles, magnitude_bucket, open_group_quantiles
from outletry.operators.repeats import REPEAT, mark_repeats
from outletry.plans import silver
from outletry.session import stage
from outletry.sources import readers, writers
from outletry.workload.lake import Lake


def quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


def test_quantiles_with_a_hot_key_and_ties(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([0.0, 5.0, rng.uniform(-9, 9), rng.uniform(1e6, 1e9)])) for _ in range(3000)]
    rows += [(f"k{i % 40}", rng.uniform(0, 1) * 10 ** rng.randint(-6, 12)) for i in range(800)]
    rows += [("one", 4.0), ("nothing", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in group_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.9}, "n").collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k]["n"] == len(values)
        assert got[k]["a"] == pytest.approx(quantile(values, 0.25), rel=1e-12)
        assert got[k]["b"] == pytest.approx(quantile(values, 0.9), rel=1e-12)


def test_repeats_keep_the_first_and_treat_nulls_as_equal(spark):
    rows = [(i, "hot", None) for i in range(500)] + [(900, "a", 1), (901, "a", 2), (902, None, 1), (903, None, 1)]
    df = spark.createDataFrame(rows, "_row_id long, k string, v int").repartition(5)
    later = {r["_row_id"] for r in mark_repeats(df, ["k", "v"]).where(REPEAT).collect()}
    assert later == set(range(1, 500)) | {903}
    among = mark_repeats(df, ["k"], among=F.col("_row_id") >= 10).where(REPEAT)
    assert min(r["_row_id"] for r in among.collect()) == 11


def test_repeats_with_shared_row_ids_keep_every_row_once(spark):
    """Ids that several rows share neither multiply rows nor mark a first row; equal (key, id) keeps one."""
    rows = [
        (1, "a", 1), (5, "a", 1), (5, "a", 1),  # two later copies share id 5
        (5, "b", 2),  # a first row sharing id 5 with later copies of another key
        (7, "c", 3), (7, "c", 3),  # the first id tied: exactly one stays
        (None, "d", 4), (2, "d", 4),  # a null id comes last
        (None, "e", 5), (None, "e", 5),  # only null ids: one stays
        (9, "f", 6),
    ]
    df = spark.createDataFrame(rows, "_row_id long, k string, v int").repartition(3)
    got = mark_repeats(df, ["k", "v"]).collect()
    assert len(got) == len(rows)
    flags = sorted((r["k"], r["_row_id"] if r["_row_id"] is not None else -1, r[REPEAT]) for r in got)
    assert flags == [
        ("a", 1, False), ("a", 5, True), ("a", 5, True), ("b", 5, False), ("c", 7, False), ("c", 7, True),
        ("d", -1, True), ("d", 2, False), ("e", -1, False), ("e", -1, True), ("f", 9, False),
    ]
    assert mark_repeats(df.limit(0), ["k"]).count() == 0


def test_join_on_a_hot_key_is_split(spark):
    """With small limits, adaptive execution splits the hot partition of the repeat join."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(60000).select(
            F.col("id").alias("_row_id"),
            F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        ).repartition(16)
        marked = mark_repeats(rows, ["k"])
        assert marked.where(REPEAT).count() == 19999
        marked.write.format("noop").mode("overwrite").save()
        plan = marked.select("payload", REPEAT)
        plan.collect()
        assert "skew=true" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def transaction(row_id, volume, bill, outlet="O1", year="2023", month="1", sku="S1", dist="D1"):
    return (outlet, year, month, dist, sku, volume, bill, row_id)


TX = ("Outlet_ID string, Year string, Month string, Distributor_ID string, SKU_ID string, "
      "Volume_Liters string, Total_Bill_Value string, _row_id long")


def test_every_transaction_gets_one_class(spark):
    rows = [
        transaction(0, "2", "10"), transaction(1, "-2", "-10"), transaction(2, "0", "5"),
        transaction(3, "5", "0"), transaction(4, "0", "0"), transaction(5, "-1", "0"),
        transaction(6, "-1", "4"), transaction(7, "3", "-4"), transaction(8, "0", "-3"),
        transaction(9, None, "3"), transaction(10, "abc", "3"), transaction(11, "1", "1", month="13"),
        transaction(12, "1", "1", year="2022"), transaction(13, "2", "10"), transaction(14, "2.0", "10"),
        transaction(15, "1", "1", outlet=" ? ", year="x"),
    ]
    checked = transactions.check_transactions(spark.createDataFrame(rows, TX))
    labelled = {r["_row_id"]: r for r in transactions.label_transactions(checked).collect()}
    kinds = [labelled[i]["kind"] for i in range(16)]
    assert kinds == [
        "sale", "return", "zero_volume_positive_bill", "positive_volume_zero_bill", "zero_volume_zero_bill",
        "sign_mismatch", "sign_mismatch", "sign_mismatch", "unclassified", *["rejected"] * 7,
    ]
    assert labelled[9]["_reasons"] == ["Missing mandatory field: Volume_Liters"]
    assert labelled[13]["_reasons"] == labelled[14]["_reasons"] == ["Exact duplicate row"]
    assert labelled[15]["_reasons"] == [
        "Missing mandatory field: Outlet_ID", "Invalid numeric value in Year"]
    assert labelled[0]["Price_Per_Liter"] == labelled[1]["Price_Per_Liter"] == 5.0


def test_price_bounds(spark):
    rows = [("A", 10.0)] * 20 + [("A", 13.0)] + [("B", float(v)) for v in range(1, 20)] + [("B", 900.0)] + [("C", 5.0), ("C", 500.0)]
    sales = spark.createDataFrame(rows, "SKU_ID string, Price_Per_Liter double")
    bounds = {r["SKU_ID"]: r for r in transactions.price_bounds(sales).collect()}
    assert (bounds["A"]["sku_price_lower_bound"], bounds["A"]["sku_price_upper_bound"]) == (7.5, 12.5)
    assert bounds["B"]["sku_price_lower_bound"] == 0.0
    flagged = transactions.flag_price_outliers(sales, transactions.price_bounds(sales))
    out = {(r["SKU_ID"], r["Price_Per_Liter"]) for r in flagged.where("sku_price_outlier_flag = 1").collect()}
    assert out == {("A", 13.0), ("B", 900.0)}


def test_outlet_master(spark):
    rows = [("O1", "extra  large", "grocry", "2", 0), ("O1", "Small", "x", "1", 1), (None, "Small", "x", "1", 2),
            ("O2", "Huge", "x", "-1", 3), ("O3", None, "x", "abc", 4), ("O4", "N/A", "x", None, 5)]
    checked = outlets.check_outlet_master(spark.createDataFrame(
        rows, "Outlet_ID string, Outlet_Size string, Outlet_Type string, Cooler_Count string, _row_id long"))
    got = {r["_row_id"]: r for r in checked.collect()}
    assert got[0]["_reasons"] == [] and got[0]["Outlet_Size"] == "Extra Large"
    assert got[1]["_reasons"] == ["Duplicate business key: Outlet_ID"]
    assert got[2]["_reasons"] == ["Missing mandatory field: Outlet_ID"]
    assert got[3]["_reasons"] == ["Negative Cooler_Count"] and got[3]["Outlet_Size_Invalid_Flag"] == 1
    assert got[4]["_reasons"] == ["Invalid numeric value in Cooler_Count"]
    assert got[5]["_reasons"] == [] and got[5]["Outlet_Size_Missing_Flag"] == 1
    assert rules.valid_rows(checked).count() + rules.rejected_rows(checked).count() == 6


def test_coordinates(spark):
    rows = [("a", "6.9", "79.9", 0), ("b", "79.9", "6.9", 1), ("c", "60", "10", 2), ("d", None, "80", 3),
            ("e", "x", "80", 4), ("f", "5.0", "82.5", 5)]
    raw = spark.createDataFrame(rows, "Outlet_ID string, Latitude string, Longitude string, _row_id long")
    got = {r["Outlet_ID"]: r for r in outlets.check_coordinates(raw).collect()}
    assert (got["b"]["Latitude"], got["b"]["coordinate_correction_type"]) == (6.9, "lat_lon_swapped")
    assert got["c"]["_reasons"] == ["Invalid coordinates after swap check"]
    assert got["d"]["_reasons"] == got["e"]["_reasons"] == ["Missing or invalid Latitude"]
    assert got["a"]["_reasons"] == got["f"]["_reasons"] == []
    with pytest.raises(ValueError):
        outlets.check_coordinates(raw.drop("Latitude"))


def test_holidays(spark):
    rows = [("1/6/2023", "Duruthu Poya", t, i) for i, t in enumerate(["Public Holiday", "bank", "Mercantile", "poya"])]
    rows += [("2023-01-06", "Duruthu Poya", "Bank", 4), ("not a date", "x", "Bank", 5), ("1/7/2023", None, "Bank", 6),
             ("1/7/2023", "Fair", "Working", 7)]
    raw = spark.createDataFrame(rows, "Date string, Holiday_Name string, Holiday_Type string, _row_id long")
    dates = silver.holiday_dates(raw).collect()
    assert len(dates) == 1 and dates[0]["holiday_classification_count"] == 4
    assert dates[0]["holiday_types_combined"] == "Bank | Mercantile | Poya Day | Public"
    month = silver.holiday_months(raw).first()
    assert month["poya_day_date_count"] == 1
    assert month["holiday_intensity_score"] == pytest.approx(1.0 + 0.8 + 0.5 + 0.7 + 0.6)
    by_row = holidays.month_features_by_row(holidays.check_holidays_by_row(raw)).first()
    # The raw text of the ISO row differs, so the row variant keeps it.
    assert (by_row["holiday_record_count"], by_row["poya_day_count"]) == (5, 5)


def test_calibration_falls_back(spark):
    season = spark.createDataFrame(
        [("A", 2023, 1, "Favorable"), ("A", 2023, 2, "Moderate"), ("B", 2023, 1, "Favorable"),
         ("B", 2023, 2, "Un-Favorable"), ("C", 2023, 1, "Favorable")],
        "Distributor_ID string, Year int, Month int, Seasonality_Index string")
    sales = spark.createDataFrame(
        [("A", 2023, 1, 110.0), ("A", 2023, 2, 100.0), ("B", 2023, 1, 300.0), ("B", 2023, 2, 50.0)],
        "Distributor_ID string, Year int, Month int, Volume_Liters double")
    found = seasonality.calibrated_multipliers(sales, season)
    got = {(r[0], r[1]): r for r in found.collect()}
    assert got["A", "Favorable"]["seasonality_multiplier_calibrated"] == pytest.approx(1.1)
    assert got["A", "Favorable"]["seasonality_multiplier_source"] == "distributor_calculated"
    assert got["B", "Favorable"]["seasonality_multiplier_calibrated"] == 1.2
    assert got["B", "Un-Favorable"]["seasonality_multiplier_calibrated"] == 0.8
    assert got["B", "Favorable"]["seasonality_multiplier_source"] == "global_calculated"
    empty = spark.createDataFrame([], "Year int, Month int, holiday_intensity_score double, festive_holiday_date_count int")
    context = seasonality.context_score(season, empty, found)
    by_key = {(r["Distributor_ID"], r["Month"]): r for r in context.collect()}
    assert by_key["C", 1]["seasonality_multiplier_source"] == "fallback_default"
    assert by_key["C", 1]["distributor_month_context_score_0_100"] == 0.0


def test_primary_key_takes_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "z"), ("b", "z"), ("b", "a")], "Outlet_ID string, d string")
    got = {r[0]: (r[1], r[2]) for r in monthly.primary_key(df, "Outlet_ID", "d", "n").collect()}
    assert got == {"a": ("x", 2), "b": ("z", 2)}


def test_nearest_equals_brute_force(spark):
    rng = random.Random(5)
    targets = [(round(rng.uniform(5, 10), 3), round(rng.uniform(79, 82), 3), f"t{i}") for i in range(700)]
    targets += [(7.0, 80.0, f"same{i}") for i in range(300)]
    points = [(rng.uniform(-20, 20), rng.uniform(60, 100)) for _ in range(80)] + [(7.0001, 80.0)] * 60
    got = spatial.nearest_targets(
        spark.createDataFrame(points, "latitude double, longitude double"),
        spark.createDataFrame(targets, "latitude double, longitude double, target string"), "found", leaf_rows=8)
    rows = got.collect()
    assert len(rows) == len(points)
    for r in rows:
        best = min(((r["latitude"] - a) * (r["latitude"] - a) + (r["longitude"] - b) * (r["longitude"] - b), n)
                   for a, b, n in targets)
        assert r["found"] == best[1]


def test_radius_sum_equals_brute_force(spark):
    rng = random.Random(7)
    cells = [(rng.randint(690, 700), rng.randint(7990, 8000), float(rng.randint(0, 9))) for _ in range(300)]
    points = [(rng.uniform(6.9, 7.0), rng.uniform(79.9, 80.0)) for _ in range(60)]
    df = spark.createDataFrame(points, "latitude double, longitude double")
    grid = spark.createDataFrame(cells, "row_no int, col_no int, people double")
    from outletry.functions.geo import haversine_km
    pairs = df.crossJoin(grid).where(
        haversine_km(F.col("latitude"), F.col("longitude"), F.col("row_no") * 0.01, F.col("col_no") * 0.01) <= 1.0)
    want = {(r[0], r[1]): r[2] for r in pairs.groupBy("latitude", "longitude").agg(F.sum("people")).collect()}
    got = spatial.sum_in_radius(df, grid, "people", "total", 1.0).collect()
    assert len(got) == 60
    assert all(r["total"] == want.get((r["latitude"], r["longitude"]), 0.0) for r in got)


@pytest.mark.parametrize("n", [30, 1500])
def test_nearest_region_is_the_same_search_at_any_size(spark, n):
    rng = random.Random(1)
    sites = [(f"r{i}", rng.uniform(79, 82), rng.uniform(5, 10)) for i in range(n)]
    regions = spark.createDataFrame(sites, "region string, centroid_lon double, centroid_lat double")
    spots = [(i, rng.uniform(5, 10), rng.uniform(79, 82), "r0" if i % 4 == 0 else None) for i in range(50)]
    spots += [(50, None, 80.0, None), (51, None, None, "r1")]
    points = spark.createDataFrame(spots, "i int, latitude double, longitude double, region string")
    got = {r["i"]: r["region"] for r in spatial.nearest_region(points, regions).collect()}
    for i, lat, lon, region in spots:
        near = None if lat is None else min(sites, key=lambda s: ((s[2] - lat) ** 2 + (s[1] - lon) ** 2, s[0]))[0]
        assert got[i] == (region or near)


def test_radius_sum_at_high_latitudes(spark):
    import math

    points = [(0, 70.0, 20.0), (1, -85.0, 20.0), (2, 0.0, 20.0), (3, None, 20.0)]
    cells = [(lat, 2000 + d, 1.0) for lat in (7000, -8500, 0) for d in range(-60, 61)]
    got = {r["i"]: r["total"] for r in spatial.sum_in_radius(
        spark.createDataFrame(points, "i int, latitude double, longitude double"),
        spark.createDataFrame(cells, "row_no int, col_no int, people double"), "people", "total", 1.5).collect()}
    for i, lat, _ in points[:3]:
        reach = sum(1 for d in range(-60, 61) if math.radians(abs(d) * 0.01) * math.cos(math.radians(lat)) * 6371.0088 <= 1.5)
        assert got[i] == reach
    assert got[3] == 0.0


def test_density_fill(spark):
    rows = [("p", "2023-01", 10), ("p", "2023-01", 0), ("p", "2023-02", None), ("q", "2023-02", 7), ("q", "2023-03", 0),
            ("r", "2023-01", 0), ("r", "2023-09", None), (None, "2023-01", None)]
    df = spark.createDataFrame(rows, "province string, month string, monthly_density bigint").withColumn(
        "i", F.monotonically_increasing_id())
    got = [(r["province"], r["month"], r["monthly_density"]) for r in density.fill_density(df).orderBy("i").collect()]
    # province and month, province, month, everything (mean 8.5 rounds to 8)
    assert [g[2] for g in got] == [10, 10, 10, 7, 7, 10, 8, 10]
    nothing = density.fill_density(df.withColumn("monthly_density", F.lit(0).cast("bigint")))
    assert {r["monthly_density"] for r in nothing.collect()} == {1}


def test_target_period_or_history(spark):
    season = spark.createDataFrame(
        [("A", 2023, 1, "Moderate", 0, 1.0), ("A", 2024, 1, "Favorable", 1, 1.1), ("A", 2025, 1, "Favorable", 1, 1.1)],
        "Distributor_ID string, Year int, Month int, Seasonality_Index string, seasonality_score int, seasonality_multiplier double")
    pick = {"seasonality_multiplier": "m"}
    label = {"Seasonality_Index": "label"}
    history = gold.target_or_history(season, ["Distributor_ID"], pick, DEFAULTS, label).first()
    assert history["m"] == pytest.approx(3.2 / 3) and history["label"] == "Favorable"
    extra = spark.createDataFrame([("A", 2026, 1, "Un-Favorable", -1, 0.9)], season.schema)
    target = gold.target_or_history(season.union(extra), ["Distributor_ID"], pick, DEFAULTS, label).first()
    assert (target["m"], target["label"]) == (0.9, "Un-Favorable")


def test_benchmarks_and_potential(spark):
    people = [(f"a{i}", "big", 100.0, 50.0, 40.0) for i in range(30)] + [(f"b{i}", "few", 10.0, 500.0, 4.0) for i in range(29)]
    table = spark.createDataFrame(
        people, "Outlet_ID string, cluster_id string, p90_monthly_liters double, max_january_liters double, avg_january_liters double")
    months = spark.createDataFrame(
        [(p[0], m, float(10 * (i + 1))) for i, p in enumerate(people) for m in (1, 2)],
        "Outlet_ID string, Month int, monthly_liters double")
    bench = potential.peer_benchmarks(table, months)
    got = {r["cluster_id"]: r for r in bench.collect()}
    assert got["big"]["january_benchmark_source"] == "cluster_january_p90"
    assert got["big"]["cluster_january_ceiling"] == pytest.approx(quantile([10 * (i + 1) for i in range(30)], 0.9))
    assert got["few"]["january_benchmark_source"] == "cluster_overall_p90_adjusted_by_january_ratio"
    result = potential.outlet_potential(table, bench)
    for r in result.collect():
        own, cap = r["own_january_peak_liters"], r["cluster_january_cap"]
        assert own <= r["Maximum_Monthly_Liters"] <= max(cap, own)
        for name, (low, high) in {
            "seasonality_relative_adjustment": DEFAULTS.seasonality_range,
            "holiday_relative_adjustment": DEFAULTS.holiday_range,
            "density_relative_adjustment": DEFAULTS.density_range,
            "recent_trend_adjustment": DEFAULTS.trend_range,
            "capacity_relative_adjustment": DEFAULTS.capacity_range,
        }.items():
            assert low <= r[name] <= high
    lost = potential.outlet_potential(table.withColumn("cluster_id", F.lit("other")), bench)
    assert all(r["Maximum_Monthly_Liters"] == r["own_january_peak_liters"] for r in lost.collect())


def test_reports(spark):
    df = spark.createDataFrame([(0, "b", None), (1, "a", 2), (2, "b", 3)], "_row_id long, s string, n int")
    summary = {r["column"]: r for r in reports.column_summary(df, "t").collect()}
    assert (summary["s"]["unique_count"], summary["n"]["missing_count"], summary["n"]["dtype"]) == (2, 1, "int")
    samples = {r["column"]: r["sample_values"] for r in reports.sample_values(df, "t").collect()}
    assert samples == {"s": '["b","a"]', "n": '["2","3"]'}


def test_folds_are_even_and_stable(spark):
    df = spark.range(1003).select(F.col("id"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("c"))
    split = imputer.stratified_folds(df, "c", "id", 5, 42)
    sizes = [r["n"] for r in split.groupBy("c", "fold").agg(F.count("id").alias("n")).where("c = 'y'").collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    again = imputer.stratified_folds(df.repartition(7), "c", "id", 5, 42)
    assert split.select("id", "fold").exceptAll(again.select("id", "fold")).count() == 0


def test_fold_metrics(spark):
    counts = spark.createDataFrame([(1, "a", "a", 3), (1, "a", "b", 1), (1, "b", "b", 2)],
                                   "fold int, label string, predicted string, n bigint")
    row = imputer.fold_metrics(counts, "label").first()
    assert row["accuracy"] == pytest.approx(5 / 6)
    assert row["macro_f1"] == pytest.approx((6 / 7 + 4 / 5) / 2)


def test_sources(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("Outlet ID , V \nO1,1\nO2,\n")
    df = readers.with_lineage(readers.clean_columns(readers.read_csv(spark, str(folder))))
    assert df.columns == ["Outlet_ID", "V", readers.CORRUPT, "_source_file", "_row_id"]
    assert [r["_source_file"] for r in df.collect()] == ["a.csv", "a.csv"]
    sizes = reports.file_sizes(readers.read_csv(spark, str(folder))).first()
    assert (sizes["file"], sizes["rows"]) == ("a.csv", 2)
    assert readers.optional_table(spark, None, "Outlet_ID string").count() == 0
    path = str(tmp_path / "years")
    years = spark.createDataFrame([("a", 2023), ("b", 2024)], "k string, year int")
    assert writers.years_done(spark, path) is None
    first = writers.add_years(years, path, ["k"])
    assert sorted((r["k"], r["year"]) for r in first.collect()) == [("a", 2023), ("b", 2024)]
    # Running again, or with rows partly written before, gives every row once.
    again = writers.add_years(years, path, ["k"])
    assert sorted((r["k"], r["year"]) for r in again.collect()) == [("a", 2023), ("b", 2024)]
    more = spark.createDataFrame([("b", 2024), ("c", 2025)], years.schema)
    assert sorted((r["k"], r["year"]) for r in writers.add_years(more, path, ["k"]).collect()) == [("b", 2024), ("c", 2025)]
    assert sorted((r["k"], r["year"]) for r in spark.read.parquet(path).collect()) == [("a", 2023), ("b", 2024), ("c", 2025)]


def test_period_layouts(spark):
    layouts = [
        spark.createDataFrame([("a", 2024, 3)], "Outlet_ID string, Year int, Month int"),
        spark.createDataFrame([("a", "2024", "3", "2024-03")], "location_name string, year string, month_num string, month string"),
        spark.createDataFrame([("a", "2024-03")], "location_name string, month string"),
        spark.createDataFrame([("a", "2024-03-01")], "location_name string, month string"),
    ]
    for df in layouts:
        out = readers.unify_period(df)
        assert out.columns == ["Outlet_ID", "Year", "Month"] and tuple(out.first()) == ("a", 2024, 3)
    with pytest.raises(ValueError):
        readers.unify_period(spark.createDataFrame([(1,)], "Year int"))


def test_location_headers(spark):
    df = spark.createDataFrame([("6.9", "79.9"), (None, "80")], "Y string, LNG string")
    row = readers.resolve_locations(df).collect()
    assert len(row) == 1 and row[0]["location_name"].startswith("loc_") and row[0]["latitude"] == 6.9
    with pytest.raises(ValueError):
        readers.resolve_locations(df.drop("Y"))


def test_legacy_holiday_columns(spark):
    older = spark.createDataFrame([(2023, 1, 4, "2.5")], "Year int, Month int, public_holiday_count int, holiday_intensity_score string")
    row = holidays.legacy_alias_fill(older).first()
    assert (row["public_holiday_date_count"], row["holiday_intensity_score"], row["poya_day_date_count"]) == (4.0, 2.5, 0.0)


def test_recency_by_rows_and_by_calendar_differ(spark):
    from outletry.operators import features
    rows = [("a", 2023, m, float(m)) for m in (1, 2, 3, 12)] + [("b", 2023, 5, 7.0)]
    table = spark.createDataFrame(rows, "Outlet_ID string, Year int, Month int, monthly_liters double")
    by_rows = {r["Outlet_ID"]: r for r in features.recent_n_rows(table).collect()}
    dated = monthly.with_recency(table).groupBy("Outlet_ID").agg(*features.recent_months())
    by_date = {r["Outlet_ID"]: r for r in dated.collect()}
    assert by_rows["a"]["recent_3_month_total_liters"] == 17.0
    assert by_date["a"]["recent_3_month_total_liters"] == 12.0
    assert by_rows["b"]["recent_3_month_avg_liters"] == 7.0 and by_date["b"]["recent_3_month_avg_liters"] is None


def test_open_categories_are_hashed_at_any_size(spark):
    for n in (3, 1500):
        df = spark.range(n).select(F.concat(F.lit("D"), "id").alias("Distributor_ID"), F.lit("x").alias("Outlet_Type"))
        out = df.select(imputer.level("Distributor_ID").alias("d"), imputer.level("Outlet_Type").alias("t")).distinct().collect()
        assert all(r["d"].startswith("bucket ") and r["t"] == "x" for r in out)
        assert len(out) == 3 if n == 3 else 600 < len(out) <= 1024


def test_small_values_spread_over_buckets(spark):
    df = spark.range(100_000).select(((F.col("id") + 1) / F.lit(1e8)).alias("v"), F.lit(1).alias("k"))
    most = df.groupBy(magnitude_bucket(F.col("v"))).count().agg(F.max("count")).first()[0]
    assert most <= 11
    got = group_quantiles(df, ["k"], "v", {"a": 0.3, "b": 0.77}).first()
    want = df.agg(F.percentile("v", F.lit(0.3)), F.percentile("v", F.lit(0.77))).first()
    assert (got["a"], got["b"]) == pytest.approx(tuple(want), rel=1e-12)


def test_broken_lines_and_second_run(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4,5\n6,7\n")
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["x", "y", readers.CORRUPT]
    checked = rules.with_broken_lines(rules.with_reasons(rows, []))
    assert [r["_corrupt_record"] for r in rules.rejected_rows(checked).collect()] == ["3,4,5"]
    path = str(tmp_path / "years")
    first = spark.createDataFrame([("a", 1.0, 2023, 5), ("a", 1.0, 2024, 6)], "p string, lat double, year int, v int")
    second = first.unionByName(spark.createDataFrame([("b", 2.0, 2023, 7), ("a", 9.0, 2023, 8)], first.schema))
    assert writers.add_years(first, path, ["p", "lat"]).count() == 2
    changed = second.withColumn("v", F.col("v") + 100)
    got = {(r["p"], r["lat"], r["year"]): r["v"] for r in writers.add_years(changed, path, ["p", "lat"]).collect()}
    assert got == {("a", 1.0, 2023): 5, ("a", 1.0, 2024): 6, ("b", 2.0, 2023): 107, ("a", 9.0, 2023): 108}


def test_empty_table_has_a_row_per_column(spark):
    rows = reports.column_summary(spark.createDataFrame([], "a string, b string, _row_id long"), "t").collect()
    assert {(r["column"], r["missing_count"], r["unique_count"]) for r in rows} == {("a", 0, 0), ("b", 0, 0)}


def test_staged_tables_are_dropped(spark, tmp_path):
    from outletry import session

    before = session._STAGED.pop(spark.sparkContext.applicationId, [])
    df = session.stage(spark.range(5).selectExpr("id", "id % 2 AS k"), "dropped", ["k"])
    assert df.where("k = 1").count() == 2 and df.columns == ["id", "k"]
    session.drop_staged(spark)
    assert not [p for p in __import__("os").listdir(session.shared_folder(spark)) if p.startswith("dropped")]
    session._STAGED[spark.sparkContext.applicationId] = before


def test_group_spread_equals_the_library(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(2)
    df = spark.createDataFrame(
        [(rng.gauss(g * 3, 1), rng.gauss(g, 1), g) for g in range(3) for _ in range(30)] + [(9.0, 9.0, 7)], "a double, b double, g int")
    got = clustering.group_spread(df, ["a", "b"], "g")
    want = ClusteringEvaluator(featuresCol="f", predictionCol="g").evaluate(VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(df))
    total = got.agg((F.sum(F.col("silhouette") * F.col("n")) / F.sum("n")).alias("s"), F.sum("inertia").alias("i")).first()
    assert total["s"] == pytest.approx(want, abs=1e-9) and total["i"] > 0


def test_class_report_equals_sql_on_given_predictions(spark):
    import duckdb

    from outletry.operators.imputer import class_report

    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), ("a", None), (None, "c"), ("a", "a")]
    got = {r["label"]: r for r in class_report(spark.createDataFrame(rows, "y string, p string"), "y", "p").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT * FROM (VALUES " + ", ".join(
        f"({'NULL' if y is None else repr(y)}, {'NULL' if p is None else repr(p)})" for y, p in rows) + ") v(y, p)")
    want = con.execute("""
      WITH r AS (SELECT * FROM t WHERE y IS NOT NULL AND p IS NOT NULL),
      c AS (SELECT label, sum(tp) AS tp, sum(a) AS support, sum(g) AS guessed FROM (
        SELECT y AS label, CAST(y = p AS INT) AS tp, 1 AS a, 0 AS g FROM r UNION ALL SELECT p, 0, 0, 1 FROM r) GROUP BY label),
      s AS (SELECT label, coalesce(tp / nullif(guessed, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS re,
        coalesce(2 * tp / nullif(support + guessed, 0), 0) AS f1, support, tp FROM c)
      SELECT label, pr, re, f1, support FROM s
      UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f1), sum(support) FROM s
      UNION ALL SELECT 'weighted avg', sum(pr * support) / sum(support), sum(re * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support) FROM s
      UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM s
    """).fetchall()
    assert len(got) == len(want) == 6
    for label, pr, re_, f1, support in want:
        row = got[label]
        assert (row["precision"], row["recall"], row["f1_score"], row["support"]) == pytest.approx((pr, re_, f1, support))
    assert class_report(spark.createDataFrame([], "y string, p string"), "y", "p").count() == 0


def test_open_groups_are_sorted_once_and_large_ones_elsewhere(spark):
    rng = random.Random(8)
    rows = [("hot", rng.choice([5.0, rng.uniform(-9, 9)])) for _ in range(900)]
    rows += [(f"k{i % 40}", rng.uniform(0, 1) * 10 ** rng.randint(-6, 12)) for i in range(800)]
    rows += [("one", 4.0), ("nothing", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"a": 0.25, "b": 0.9}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    for limit in (0, 1, 100, 10_000):
        got = {r["k"]: r for r in open_group_quantiles(df, ["k"], "v", wanted, "n", limit).collect()}
        assert set(got) == set(groups)
        for k, values in groups.items():
            assert got[k]["n"] == len(values)
            for name, q in wanted.items():
                assert got[k][name] == pytest.approx(quantile(values, q), rel=1e-12)


def test_price_bounds_need_one_exchange(spark):
    sales = spark.createDataFrame([("S1", 2.0), ("S1", 4.0), ("S2", 3.0)], "SKU_ID string, Price_Per_Liter double")
    plan = transactions.price_bounds(sales)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_each_text_is_squashed_once(spark):
    df = spark.createDataFrame([("a  b", "n/a")], "x string, y string")
    plan = outlets.clean_strings(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2
    assert outlets.clean_strings(df).first() == ("a b", None)


def test_partitioned_stage_keeps_rows_and_setting(spark):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    df = spark.range(40).selectExpr("id", "cast(if(id % 4 = 3, null, id % 4) as string) AS kind")
    back = stage(df, "parts", ["kind"])
    assert sorted(back.collect(), key=lambda r: r["id"]) == df.collect() and spark.conf.get(name) == before


def test_stage_leaves_no_shuffle_files(spark):
    """The shuffle behind a staged table goes with the write; the setting of the session comes back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString(" ")))
    before, setting = files(), spark.conf.get(key)
    df = spark.range(100000).selectExpr("id % 5000 AS k").groupBy("k").count()
    back = stage(df, "counted")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(key) == setting
    assert back.count() == df.count() == 5000


def test_layers_that_do_not_read_each_other_are_built_together(spark):
    """Both sides wait for each other, so they would never end one by one; what both read is built once."""
    met, built = threading.Barrier(2, timeout=60), []
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")

    class Small(Lake):
        base = property(lambda self: self._layer("base", lambda: built.append(1) or spark.range(3)))
        left = property(lambda self: self._layer("left", lambda: self.base if met.wait() >= 0 else None))
        right = property(lambda self: self._layer("right", lambda: self.base if met.wait() >= 0 else None))
        top = property(lambda self: self._layer("top", lambda: self.left.unionAll(self.right), after=("left", "right")))

    small = Small(spark, "none")
    assert small.top.count() == small.top.count() == 6 and built == [1]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_the_forest_splits_one_hot_columns_without_a_look_up_in_sets(spark):
    n = 24_000
    rows = spark.range(n).selectExpr(
        "concat('O', id) Outlet_ID", "cast(id % 97 as double) x",
        "case when id < 12 then 'once' when id % 2 = 0 then 'a' else 'b' end Outlet_Type",
        "array('Small', 'Medium', 'Large')[cast(id % 3 as int)] Outlet_Size",
    )
    config = dataclasses.replace(DEFAULTS, trees=3, tree_depth=2)
    few, many = (imputer.CategoryImputer(numeric=["x"], categorical=["Outlet_Type"], config=config).fit(r) for r in (rows.where("id < 3000"), rows))
    for model, rare in ((few, []), (many, ["once"])):
        prepared = model._features().fit(filled := model._filled(rows))
        known = filled if model is many else filled.where("Outlet_ID in ('O1', 'O2')")
        kinds = model._with_kinds(prepared.transform(known), prepared.stages[0].labelsArray).schema["_features"].metadata
        said = kinds.get("ml_attr", {}).get("attrs", {})
        assert "binary" not in said
        names = ["x", *prepared.stages[0].labelsArray[0], None]
        assert [names[a["idx"]] for a in said.get("nominal", [])] == rare
        assert model.feature_importance(rows).count() == 5


def test_rare_classes_of_a_one_hot_column_still_split(spark):
    rows = spark.range(24_000).selectExpr(
        "concat('O', id) Outlet_ID", "cast(0 as double) x", "if(id < 4, 'rare', 'a') Outlet_Type",
        "case when id < 4 then 'Large' when id % 2 = 0 then 'Small' else 'Medium' end Outlet_Size",
    )
    model = imputer.CategoryImputer(
        numeric=["x"], categorical=["Outlet_Type"], config=dataclasses.replace(DEFAULTS, trees=20, tree_depth=2)).fit(rows)
    assert {r["predicted"] for r in model.predict(rows.where("Outlet_Type = 'rare'")).collect()} == {"Large"}


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    met, real = threading.Barrier(2), imputer.CategoryImputer.fit

    def fit(self, known):
        met.wait(120)  # broken if the second fold waits for the first
        return real(self, known)

    monkeypatch.setattr(imputer.CategoryImputer, "fit", fit)
    rows = spark.range(60).selectExpr(
        "concat('O', id) Outlet_ID", "cast(id as double) x", "if(id % 2 = 0, 'a', 'b') Outlet_Type",
        "if(id % 3 = 0, 'Small', 'Large') Outlet_Size")
    config = dataclasses.replace(DEFAULTS, trees=3, tree_depth=2, max_folds=2)
    held = imputer.CategoryImputer(numeric=["x"], categorical=["Outlet_Type"], config=config).held_out_predictions(rows)
    assert (held.count(), {r["fold"] for r in held.collect()}) == (60, {1, 2})


def test_fits_of_all_group_counts_wait_in_one_queue(spark, monkeypatch):
    met, real = threading.Barrier(2), clustering.KMeans.fit

    def fit(self, rows, params=None):
        met.wait(120)  # broken if the next count waits for the last fit of this one
        return real(self, rows, params)

    monkeypatch.setattr(clustering.KMeans, "fit", fit)
    rows = VectorAssembler(inputCols=["a", "b"], outputCol=clustering.FEATURES).transform(
        spark.range(60).selectExpr("cast(id % 3 * 100 as double) a", "cast(id % 5 as double) b"))
    scores, best = clustering.search_k(rows, dataclasses.replace(DEFAULTS, k_min=2, k_max=3, search_restarts=1))
    assert (best, [r["k"] for r in scores.collect()]) == (3, [3, 2])


def test_fits_of_groups_read_features_decoded_once(spark, monkeypatch):
    seen, real = [], clustering.KMeans.fit

    def fit(self, rows, params=None):
        seen.append((rows.storageLevel.useMemory, "InMemoryRelation" in rows._jdf.queryExecution().withCachedData().toString()))
        return real(self, rows, params)

    monkeypatch.setattr(clustering.KMeans, "fit", fit)
    table = spark.range(60).selectExpr(
        "concat('O', id) Outlet_ID", "cast(id % 3 * 100 as double) Latitude", "cast(id % 5 as double) Longitude",
        "if(id % 2 = 0, 'a', 'b') Outlet_Type")
    config = dataclasses.replace(DEFAULTS, k_min=2, k_max=3, search_restarts=2, final_restarts=2)
    assert clustering.cluster_outlets(table, config).assigned.count() == 60
    # Not held themselves, so that a fit keeps its own vectors, but read from the held features.
    assert set(seen) == {(False, True)} and len(seen) == 6
