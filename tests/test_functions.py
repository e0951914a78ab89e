import math

import pytest
from pyspark.sql import functions as F

from outletry.functions import dates, geo, labels, numeric, text


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_text(spark):
    raw = [" a \t b\n", None, "N/A", "--", "  ", "Missing", "x?"]
    assert column(spark, raw, "string", text.squash) == ["a b", None, "N/A", "--", "", "Missing", "x?"]
    assert column(spark, raw, "string", text.null_if_token) == ["a b", None, None, None, None, None, "x?"]
    titled = column(spark, ["un-favorable x", "n/a", "EXTRA large", None], "string", text.title_case)
    assert titled == ["Un-Favorable X", "N/A", "Extra Large", None]
    assert column(spark, ["Vesak moon", "EID", "x", None], "string", lambda c: text.mentions(c, ["vesak", "eid"])) == [
        True, True, False, False]


def test_labels(spark):
    assert column(spark, ["extra  large", "N/A", "Huge", None], "string", labels.outlet_size) == [
        "Extra Large", None, "Huge", None]
    assert column(spark, ["GROCRY", "backery", "pharmcy", "Bar"], "string", labels.outlet_type) == [
        "Grocery", "Bakery", "Pharmacy", "Bar"]
    assert column(spark, ["un_favorable", "Favourable ", "un  favourable", "odd"], "string", labels.seasonality) == [
        "Un-Favorable", "Favorable", "Un-Favorable", "odd"]
    assert column(spark, ["poya", "bank holiday", "Mercantile"], "string", labels.holiday_type) == [
        "Poya Day", "Bank", "Mercantile"]


def test_numbers(spark):
    raw = ["1.5", " 2 ", "abc", "NaN", "Infinity", "1d", None, "1e3"]
    assert column(spark, raw, "string", numeric.to_number) == [1.5, 2.0, None, None, None, None, None, 1000.0]
    assert column(spark, raw, "string", numeric.bad_number) == [False, False, True, True, True, True, False, False]
    assert column(spark, [4.0, 0.0, None, math.nan], "double", lambda c: numeric.ratio(F.lit(2.0), c, 9.0)) == [
        0.5, 9.0, 9.0, 9.0]
    assert column(spark, [-1.0, 0.5, 3.0, None], "double", lambda c: numeric.clip(c, 0.0, 1.0)) == [0.0, 0.5, 1.0, None]
    assert column(spark, [2.5, 3.5, -2.5], "double", numeric.half_even) == [2.0, 4.0, -2.0]
    assert column(spark, [0.125, 12.375], "double", lambda c: numeric.half_even(c, 2)) == [0.12, 12.38]


def test_fill_numbers(spark):
    df = spark.createDataFrame([(1, None, math.inf, "x"), (None, 2.0, 1.0, "4")], "a int, b double, c double, d string")
    filled = numeric.fill_numbers(df, ["a", "b", "c", "d", "absent"], 7)
    assert [tuple(r) for r in filled.collect()] == [(1, 7.0, 7.0, 7.0), (7, 2.0, 1.0, 4.0)]
    kept = numeric.fill_all_numbers(df, exclude=["a"])
    assert [r["a"] for r in kept.collect()] == [1, None]


def test_dates(spark):
    raw = ["1/6/2023", "2023-01-06", "not a date", None, "13/1/2023"]
    got = column(spark, raw, "string", dates.parse_month_first)
    assert [str(g) for g in got] == ["2023-01-06", "2023-01-06", "None", "None", "None"]
    row = spark.range(1).select(
        *[c.alias(n) for n, c in dates.calendar_columns(F.to_date(F.lit("2023-01-06"))).items()]
    ).first()
    assert (row["Year_Month"], row["Day_Name"], row["Day_Of_Week"]) == ("2023-01", "Friday", 4)
    assert (row["is_weekend_holiday"], row["is_long_weekend_proxy"]) == (0, 1)
    assert dates.month_spine(spark, "2020-01-01", "2025-12-01").count() == 72


def test_geometry(spark):
    triangle = "array(struct(0D as lon, 0D as lat), struct(4D as lon, 0D as lat), struct(0D as lon, 4D as lat), struct(0D as lon, 0D as lat))"
    points = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (-1.0, 1.0)], "lat double, lon double")
    inside = geo.inside_polygon(F.col("lat"), F.col("lon"), F.expr(triangle))
    assert [r[0] for r in points.select(inside).collect()] == [True, False, False]
    km = spark.range(1).select(geo.haversine_km(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])).first()[0]
    assert km == pytest.approx(111.195, abs=0.01)


def test_squash_and_null_words_on_odd_blanks(spark):
    raw = ["a\tb", " a  b ", "\x0bna", "N/A\u2028", "\u0085", "nan1", "\u212a", "  ", "NULL \n"]
    assert column(spark, raw, "string", text.squash) == [
        "a b", "a b", "na", "N/A\u2028", "\u0085", "nan1", "\u212a", "", "NULL"
    ]
    assert column(spark, raw, "string", text.null_if_token) == ["a b", "a b", None, None, None, "nan1", "\u212a", None, None]


def test_day_shapes_refuse_no_text_of_their_layout(spark):
    raw = ["1/6/2023", "001/06/2023", "+1/6/2023", "2023-1-6", "2023/01/06", "1-6-2023", "6-jan-2023",
           "6 Jan 2023", "Jan 6, 2023", "2023-01-06T18:30:00Z", "13/1/2023", "6-January-2023", "1/6/23", ""]
    tried = lambda c: F.coalesce(*[F.try_to_date(c, layout) for layout in dates.DAY_LAYOUTS])
    untimed = [x for x in raw if "T" not in x]
    assert column(spark, untimed, "string", dates.parse_month_first) == column(spark, untimed, "string", tried)
