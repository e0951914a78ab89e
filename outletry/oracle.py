"""The SQL each query is checked against, for DuckDB over the same driver tables.

Shared steps are common table expressions; ``check`` puts those a query needs in front of it and
rounds the listed doubles the way the queries do.
"""

from __future__ import annotations

import re

from outletry import config
from outletry.workload.tables import RAW_SQL, duckdb_text

# Added before rounding on both sides: a mean such as 0.12345 may come out a bit below or above the
# tie, depending on the order of the sum.
NUDGE = 1e-9
CTE: dict[str, str] = {f"raw_{name}": duckdb_text(sql) for name, sql in RAW_SQL.items()}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str, *doubles: str, digits: int = 4) -> None:
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in re.findall(r"(?:FROM|JOIN)\s+([a-z_0-9]+)\b", text):
            if word in CTE and word not in seen:
                seen.add(word)
                visit(CTE[word])
                needed.append(word)

    visit(sql)
    if doubles:
        changes = ", ".join(f"round({d} + {NUDGE}, {digits}) AS {d}" for d in doubles)
        sql = f"SELECT * REPLACE ({changes}) FROM ({sql})"
    steps = ", ".join(f"{n} AS ({CTE[n]})" for n in needed)
    ORACLES[name] = f"WITH {steps} {sql}" if steps else sql


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x0B]+', ' ', 'g'))"


def nt(x: str) -> str:
    return f"(CASE WHEN lower({sq(x)}) IN ({quoted(config.NULL_TOKENS)}) THEN NULL ELSE {sq(x)} END)"


def title(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[a-z]+|[^a-z]+'),"
        " lambda w: upper(w[1]) || w[2:]), '')"
    )


def recode(x: str, mapping: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {quoted([k])} THEN {quoted([v])}" for k, v in mapping.items())
    return f"(CASE {x} {whens} ELSE {default or x} END)"


def values(x: str, mapping: dict, default: str) -> str:
    whens = " ".join(
        f"WHEN {quoted([k]) if isinstance(k, str) else k} THEN {v}" for k, v in mapping.items()
    )
    return f"(CASE {x} {whens} ELSE {default} END)"


def num(x: str) -> str:
    return f"TRY_CAST({x} AS DOUBLE)"


def reasons(*pairs: tuple[str, str]) -> str:
    items = ", ".join(f"CASE WHEN {cond} THEN {quoted([reason])} END" for reason, cond in pairs)
    return f"list_filter([{items}], lambda r: r IS NOT NULL)"


def repeat(*keys: str) -> str:
    return f"(row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY _row_id) > 1)"


def div(a: str, b: str, default: str = "NULL") -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), {default})"


def clip(x: str, low, high) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE least(greatest({x}, {low}), {high}) END)"


TX = list(config.TRANSACTION_COLUMNS)


def size(x: str) -> str:
    t = title(sq(x))
    return f"(CASE WHEN {t} IN ({quoted(config.SIZE_NULL_WORDS)}) THEN NULL ELSE {t} END)"


def kind_of_outlet(x: str) -> str:
    return recode(title(sq(x)), config.OUTLET_TYPE_TYPOS)


def holiday_type(x: str) -> str:
    return recode(title(sq(x)), config.HOLIDAY_TYPE_SYNONYMS)


def season(x: str) -> str:
    return recode(sq(f"replace(lower({x}), '_', '-')"), config.SEASONALITY_SYNONYMS)


def day(x: str) -> str:
    layouts = ("%m/%d/%Y", "%Y-%m-%d", "%Y/%m/%d", "%m-%d-%Y", "%d-%b-%Y")
    days = ", ".join(f"CAST(try_strptime({x}, '{y}') AS DATE)" for y in layouts)
    return f"""coalesce({days}, CASE WHEN regexp_matches({x}, '(Z|[+-]\\d\\d:\\d\\d)$') THEN CAST({utc(x)} AS DATE)
      ELSE CAST(try_cast({x} AS TIMESTAMP) AS DATE) END)"""


def utc(x: str) -> str:
    return f"make_timestamp(epoch_us(try_cast({x} AS TIMESTAMPTZ)))"


def mentions(x: str, words) -> str:
    return f"CAST(coalesce(regexp_matches({x}, '(?i){'|'.join(words)}'), false) AS INTEGER)"


# --- Silver ----------------------------------------------------------------------------------

CTE["master_clean"] = f"""
  SELECT {nt('Outlet_ID')} AS Outlet_ID, {nt('Outlet_Size')} AS Outlet_Size,
    {nt('Outlet_Type')} AS Outlet_Type, {nt('Cooler_Count')} AS Cooler_Count, _row_id
  FROM raw_outlet_master"""
CTE["master_sized"] = f"""
  SELECT * REPLACE ({size('Outlet_Size')} AS Outlet_Size, {kind_of_outlet('Outlet_Type')} AS Outlet_Type),
    {repeat('Outlet_ID')} AS rep FROM master_clean"""
CTE["master_checked"] = f"""
  SELECT Outlet_ID, CASE WHEN Outlet_Size IN ({quoted(config.OUTLET_SIZES)}) THEN Outlet_Size END AS Outlet_Size,
    Outlet_Type, {num('Cooler_Count')} AS Cooler_Count, _row_id,
    CAST(coalesce(Outlet_Size NOT IN ({quoted(config.OUTLET_SIZES)}), false) AS INTEGER) AS Outlet_Size_Invalid_Flag,
    CAST(NOT coalesce(Outlet_Size IN ({quoted(config.OUTLET_SIZES)}), false) AS INTEGER) AS Outlet_Size_Missing_Flag,
    {reasons(
        ('Missing mandatory field: Outlet_ID', 'Outlet_ID IS NULL'),
        ('Invalid numeric value in Cooler_Count', f"Cooler_Count IS NOT NULL AND {num('Cooler_Count')} IS NULL"),
        ('Negative Cooler_Count', f"{num('Cooler_Count')} < 0"),
        ('Duplicate business key: Outlet_ID', 'rep'))} AS reasons
  FROM master_sized"""
CTE["outlets"] = "SELECT * EXCLUDE (_row_id, reasons) FROM master_checked WHERE len(reasons) = 0"

BOX = (
    f"coalesce({{0}} BETWEEN {config.DEFAULTS.lat_range[0]} AND {config.DEFAULTS.lat_range[1]} AND "
    f"{{1}} BETWEEN {config.DEFAULTS.lon_range[0]} AND {config.DEFAULTS.lon_range[1]}, false)"
)
CTE["coords_typed"] = f"""
  SELECT {nt('Outlet_ID')} AS Outlet_ID, {nt('Latitude')} AS Latitude_Original,
    {nt('Longitude')} AS Longitude_Original, {num(nt('Latitude'))} AS lat0, {num(nt('Longitude'))} AS lon0,
    _row_id FROM raw_outlet_coordinates"""
CTE["coords_fixed"] = f"""
  SELECT *, {repeat('Outlet_ID')} AS rep,
    CAST(NOT {BOX.format('lat0', 'lon0')} AND {BOX.format('lon0', 'lat0')} AS INTEGER) AS coordinate_corrected_flag
  FROM coords_typed"""
CTE["coords_checked"] = f"""
  SELECT Outlet_ID, CASE WHEN coordinate_corrected_flag = 1 THEN lon0 ELSE lat0 END AS Latitude,
    CASE WHEN coordinate_corrected_flag = 1 THEN lat0 ELSE lon0 END AS Longitude, _row_id,
    Latitude_Original, Longitude_Original, coordinate_corrected_flag,
    CASE WHEN coordinate_corrected_flag = 1 THEN 'lat_lon_swapped' ELSE 'none' END AS coordinate_correction_type,
    {reasons(
        ('Missing mandatory field: Outlet_ID', 'Outlet_ID IS NULL'),
        ('Missing or invalid Latitude', 'lat0 IS NULL'),
        ('Missing or invalid Longitude', 'lon0 IS NULL'),
        ('Invalid coordinates after swap check',
         "lat0 IS NOT NULL AND lon0 IS NOT NULL AND coordinate_corrected_flag = 0 AND NOT "
         + BOX.format('lat0', 'lon0')),
        ('Duplicate business key: Outlet_ID', 'rep'))} AS reasons
  FROM coords_fixed"""
CTE["coords"] = "SELECT * EXCLUDE (_row_id, reasons) FROM coords_checked WHERE len(reasons) = 0"

CTE["season_typed"] = f"""
  SELECT {nt('Distributor_ID')} AS Distributor_ID, {nt('Year')} AS y0, {nt('Month')} AS m0,
    {nt('Seasonality_Index')} AS label0, {num(nt('Year'))} AS Year, {num(nt('Month'))} AS Month,
    {season(nt('Seasonality_Index'))} AS Seasonality_Index, _row_id FROM raw_seasonality"""
CTE["season_checked"] = f"""
  SELECT Distributor_ID, CAST(Year AS INTEGER) AS Year, CAST(Month AS INTEGER) AS Month, Seasonality_Index,
    _row_id, {values('Seasonality_Index', config.SEASONALITY_SCORE, 'NULL')} AS seasonality_score,
    CAST({values('Seasonality_Index', config.SEASONALITY_MULTIPLIER, 'NULL')} AS DOUBLE) AS seasonality_multiplier,
    {reasons(
        ('Missing mandatory field: Distributor_ID', 'Distributor_ID IS NULL'),
        ('Missing mandatory field: Year', 'y0 IS NULL'),
        ('Missing mandatory field: Month', 'm0 IS NULL'),
        ('Missing mandatory field: Seasonality_Index', 'label0 IS NULL'),
        ('Invalid numeric value in Year', 'Year IS NULL'),
        ('Invalid numeric value in Month', 'Month IS NULL'),
        ('Year outside expected seasonality range', 'Year NOT IN (2023, 2024, 2025, 2026)'),
        ('Month outside range 1-12', 'Month NOT BETWEEN 1 AND 12'),
        ('Invalid Seasonality_Index category', f'Seasonality_Index NOT IN ({quoted(config.SEASONALITY_LABELS)})'),
        ('Duplicate business key: Distributor_ID-Year-Month', 'rep'))} AS reasons
  FROM (SELECT *, {repeat('Distributor_ID', 'Year', 'Month')} AS rep FROM season_typed)"""
CTE["seasons"] = "SELECT * EXCLUDE (_row_id, reasons) FROM season_checked WHERE len(reasons) = 0"

FLAGS = f"""
    CAST(coalesce(Holiday_Type = 'Public', false) AS INTEGER) AS row_has_public_holiday,
    CAST(coalesce(Holiday_Type = 'Bank', false) AS INTEGER) AS row_has_bank_holiday,
    CAST(coalesce(Holiday_Type = 'Mercantile', false) AS INTEGER) AS row_has_mercantile_holiday,
    greatest(CAST(coalesce(Holiday_Type = 'Poya Day', false) AS INTEGER),
      {mentions('Holiday_Name', config.POYA_KEYWORDS)}) AS row_has_poya_day,
    {mentions('Holiday_Name', config.FESTIVE_KEYWORDS)} AS row_is_festive_holiday"""


def parts(d: str) -> str:
    weekday = f"((CAST(dayofweek({d}) AS INTEGER) + 6) % 7)"
    return f"""CAST(year({d}) AS INTEGER) AS Year, CAST(month({d}) AS INTEGER) AS Month,
      strftime({d}, '%Y-%m') AS Year_Month, dayname({d}) AS Day_Name, CAST({weekday} AS INTEGER) AS Day_Of_Week,
      CAST({weekday} IN (5, 6) AS INTEGER) AS is_weekend_holiday,
      CAST({weekday} IN (0, 4) AS INTEGER) AS is_long_weekend_proxy"""


CTE["hol_typed"] = f"""
  SELECT {day(sq('Date'))} AS Date, {sq('Holiday_Name')} AS Holiday_Name,
    {holiday_type('Holiday_Type')} AS Holiday_Type, _row_id FROM raw_holidays"""
CTE["hol_base"] = f"""
  SELECT *, {reasons(
      ('Invalid Date value', 'Date IS NULL'), ('Missing Holiday_Name', 'Holiday_Name IS NULL'),
      ('Missing Holiday_Type', 'Holiday_Type IS NULL'),
      ('Invalid Holiday_Type', f'Holiday_Type NOT IN ({quoted(config.HOLIDAY_TYPES)})'))} AS base
  FROM hol_typed"""
CTE["hol_checked"] = f"""
  SELECT * EXCLUDE (base), CASE WHEN len(base) = 0 AND row_number() OVER (
      PARTITION BY Date, Holiday_Name, Holiday_Type, len(base) = 0 ORDER BY _row_id) > 1
    THEN ['Exact duplicate holiday classification record'] ELSE base END AS reasons FROM hol_base"""
CTE["hol_rows"] = f"""
  SELECT Date, Holiday_Name, Holiday_Type, {parts('Date')}, {FLAGS} FROM hol_checked WHERE len(reasons) = 0"""
CTE["hol_dates"] = """
  SELECT Date, Year, Month, Year_Month, Day_Name, Day_Of_Week,
    array_to_string(list_sort(list(DISTINCT trim(Holiday_Name))), ' | ') AS holiday_names_combined,
    array_to_string(list_sort(list(DISTINCT trim(Holiday_Type))), ' | ') AS holiday_types_combined,
    count(Holiday_Type) AS holiday_classification_count,
    max(row_has_public_holiday) AS has_public_holiday, max(row_has_bank_holiday) AS has_bank_holiday,
    max(row_has_mercantile_holiday) AS has_mercantile_holiday, max(row_has_poya_day) AS has_poya_day,
    max(is_weekend_holiday) AS is_weekend_holiday, max(is_long_weekend_proxy) AS is_long_weekend_proxy,
    max(row_is_festive_holiday) AS is_festive_holiday
  FROM hol_rows GROUP BY ALL"""
INTENSITY = (
    "CAST({0} * 1.00 + {1} * 0.80 + {2} * 0.50 + {3} * 0.70 + {4} * 0.60 + {5} * 1.20 AS DOUBLE)"
    " AS holiday_intensity_score"
)
CTE["hol_months"] = f"""
  SELECT *, {INTENSITY.format('public_holiday_date_count', 'mercantile_holiday_date_count',
      'bank_holiday_date_count', 'poya_day_date_count', 'long_weekend_holiday_date_count',
      'festive_holiday_date_count')}
  FROM (SELECT Year, Month, Year_Month, count(DISTINCT Date) AS holiday_date_count,
    CAST(sum(holiday_classification_count) AS BIGINT) AS holiday_classification_count,
    CAST(sum(has_public_holiday) AS BIGINT) AS public_holiday_date_count,
    CAST(sum(has_bank_holiday) AS BIGINT) AS bank_holiday_date_count,
    CAST(sum(has_mercantile_holiday) AS BIGINT) AS mercantile_holiday_date_count,
    CAST(sum(has_poya_day) AS BIGINT) AS poya_day_date_count,
    CAST(sum(is_weekend_holiday) AS BIGINT) AS weekend_holiday_date_count,
    CAST(sum(is_long_weekend_proxy) AS BIGINT) AS long_weekend_holiday_date_count,
    CAST(sum(is_festive_holiday) AS BIGINT) AS festive_holiday_date_count
  FROM hol_dates GROUP BY Year, Month, Year_Month)"""
CTE["holrow_typed"] = f"""
  SELECT {nt('Date')} AS d0, {day(nt('Date'))} AS Date, {nt('Holiday_Name')} AS Holiday_Name,
    {nt('Holiday_Type')} AS t0, {holiday_type(nt('Holiday_Type'))} AS Holiday_Type, _row_id FROM raw_holidays"""
CTE["holrow_valid"] = f"""
  SELECT Date, Holiday_Name, Holiday_Type FROM (
    SELECT *, {repeat('d0', 'Holiday_Name', 'Holiday_Type')} AS rep FROM holrow_typed)
  WHERE Date IS NOT NULL AND Holiday_Name IS NOT NULL AND t0 IS NOT NULL AND NOT rep
    AND Holiday_Type IN ({quoted(config.HOLIDAY_TYPES)})"""
CTE["holrow_months"] = f"""
  SELECT *, {INTENSITY.format('public_holiday_count', 'mercantile_holiday_count', 'bank_holiday_count',
      'poya_day_count', 'long_weekend_holiday_count', 'festive_holiday_count')}
  FROM (SELECT Year, Month, Year_Month, count(DISTINCT Date) AS holiday_date_count,
    count(Holiday_Name) AS holiday_record_count,
    CAST(sum(row_has_public_holiday) AS BIGINT) AS public_holiday_count,
    CAST(sum(row_has_bank_holiday) AS BIGINT) AS bank_holiday_count,
    CAST(sum(row_has_mercantile_holiday) AS BIGINT) AS mercantile_holiday_count,
    CAST(sum(row_has_poya_day) AS BIGINT) AS poya_day_count,
    CAST(sum(is_weekend_holiday) AS BIGINT) AS weekend_holiday_count,
    CAST(sum(is_long_weekend_proxy) AS BIGINT) AS long_weekend_holiday_count,
    CAST(sum(row_is_festive_holiday) AS BIGINT) AS festive_holiday_count
  FROM (SELECT Date, Holiday_Name, Holiday_Type, {parts('Date')}, {FLAGS} FROM holrow_valid)
  GROUP BY Year, Month, Year_Month)"""

CTE["tx_clean"] = (
    "SELECT " + ", ".join(f"{nt(c)} AS {c}_0" for c in TX) + ", _row_id FROM raw_transactions"
)
CTE["tx_typed"] = f"""
  SELECT Outlet_ID_0 AS Outlet_ID, {num('Year_0')} AS Year, {num('Month_0')} AS Month,
    Distributor_ID_0 AS Distributor_ID, SKU_ID_0 AS SKU_ID, {num('Volume_Liters_0')} AS Volume_Liters,
    {num('Total_Bill_Value_0')} AS Total_Bill_Value, * FROM tx_clean"""
CTE["tx_checked"] = f"""
  SELECT Outlet_ID, CAST(Year AS INTEGER) AS Year, CAST(Month AS INTEGER) AS Month, Distributor_ID, SKU_ID,
    Volume_Liters, Total_Bill_Value, _row_id, {reasons(
      *[(f'Missing mandatory field: {c}', f'{c}_0 IS NULL') for c in TX],
      *[(f'Invalid numeric value in {c}', f'{c}_0 IS NOT NULL AND {c} IS NULL')
        for c in ('Year', 'Month', 'Volume_Liters', 'Total_Bill_Value')],
      ('Year outside expected range 2023-2025', 'Year NOT IN (2023, 2024, 2025)'),
      ('Month outside range 1-12', 'Month NOT BETWEEN 1 AND 12'),
      ('Exact duplicate row', 'rep'))} AS reasons
  FROM (SELECT *, {repeat(*TX)} AS rep FROM tx_typed)"""
SIGNS = """CASE
      WHEN Volume_Liters > 0 AND Total_Bill_Value > 0 THEN 'sale'
      WHEN Volume_Liters < 0 AND Total_Bill_Value < 0 THEN 'return'
      WHEN Volume_Liters = 0 AND Total_Bill_Value > 0 THEN 'zero_volume_positive_bill'
      WHEN Volume_Liters > 0 AND Total_Bill_Value = 0 THEN 'positive_volume_zero_bill'
      WHEN Volume_Liters = 0 AND Total_Bill_Value = 0 THEN 'zero_volume_zero_bill'
      WHEN (Volume_Liters < 0 AND Total_Bill_Value >= 0) OR (Volume_Liters > 0 AND Total_Bill_Value < 0)
        THEN 'sign_mismatch' ELSE 'unclassified' END"""
CTE["tx_kind"] = f"""
  SELECT *, CASE WHEN len(reasons) > 0 THEN 'rejected' ELSE {SIGNS} END AS kind FROM tx_checked"""
CTE["tx_priced"] = f"""
  SELECT *, CASE WHEN kind IN ('sale', 'return') THEN {div('abs(Total_Bill_Value)', 'abs(Volume_Liters)')} END
    AS Price_Per_Liter FROM tx_kind"""
CTE["bounds"] = """
  SELECT *, greatest(CASE WHEN sku_price_iqr > 0 THEN sku_price_q1 - 3 * sku_price_iqr
      ELSE sku_price_median * 0.75 END, 0.0) AS sku_price_lower_bound,
    CASE WHEN sku_price_iqr > 0 THEN sku_price_q3 + 3 * sku_price_iqr
      ELSE sku_price_median * 1.25 END AS sku_price_upper_bound
  FROM (SELECT *, sku_price_q3 - sku_price_q1 AS sku_price_iqr FROM (
    SELECT SKU_ID, count(Price_Per_Liter) AS sku_price_count, median(Price_Per_Liter) AS sku_price_median,
      quantile_cont(Price_Per_Liter, 0.25) AS sku_price_q1, quantile_cont(Price_Per_Liter, 0.75) AS sku_price_q3
    FROM tx_priced WHERE kind = 'sale' GROUP BY SKU_ID))"""
CTE["sales_flagged"] = """
  SELECT t.Outlet_ID, Year, Month, Distributor_ID, SKU_ID, Volume_Liters, Total_Bill_Value, _row_id,
    Price_Per_Liter, b.* EXCLUDE (SKU_ID), CAST(coalesce(sku_price_count >= 20 AND
      (Price_Per_Liter < sku_price_lower_bound OR Price_Per_Liter > sku_price_upper_bound), false) AS INTEGER)
      AS sku_price_outlier_flag
  FROM tx_priced t JOIN bounds b USING (SKU_ID) WHERE kind = 'sale'"""
CTE["sales"] = "SELECT * FROM sales_flagged WHERE sku_price_outlier_flag = 0"
CTE["returned"] = f"SELECT {', '.join(TX)}, Price_Per_Liter FROM tx_priced WHERE kind = 'return'"
CTE["anomalies"] = f"""
  SELECT {', '.join(TX)}, kind AS anomaly_type FROM tx_kind
  WHERE kind IN ('zero_volume_positive_bill', 'positive_volume_zero_bill', 'zero_volume_zero_bill')"""
CTE["tx_rejected"] = f"""
  SELECT {', '.join(TX)}, CASE WHEN kind = 'sign_mismatch'
    THEN ['Sign mismatch between Volume_Liters and Total_Bill_Value'] ELSE reasons END AS reasons
  FROM tx_kind WHERE kind IN ('rejected', 'sign_mismatch')"""
CTE["return_features"] = """
  SELECT Outlet_ID, count(*) AS return_record_count, sum(abs(Volume_Liters)) AS return_liters_abs,
    sum(abs(Total_Bill_Value)) AS return_value_abs, count(DISTINCT Month) AS return_month_count,
    count(DISTINCT SKU_ID) AS return_sku_count
  FROM returned WHERE Outlet_ID IS NOT NULL GROUP BY Outlet_ID"""
CTE["anomaly_features"] = """
  SELECT Outlet_ID, count(*) AS billing_anomaly_count,
    count(*) FILTER (anomaly_type = 'zero_volume_positive_bill') AS zero_volume_positive_bill_count,
    count(*) FILTER (anomaly_type = 'positive_volume_zero_bill') AS positive_volume_zero_bill_count,
    count(*) FILTER (anomaly_type = 'zero_volume_zero_bill') AS zero_volume_zero_bill_count
  FROM anomalies WHERE Outlet_ID IS NOT NULL GROUP BY Outlet_ID"""

# --- seasonality and context -----------------------------------------------------------------

CTE["label_avg"] = """
  SELECT Distributor_ID, Seasonality_Index, avg(l) AS avg_liters_by_label, sum(l) AS s, count(l) AS n
  FROM (SELECT Distributor_ID, Year, Month, sum(Volume_Liters) AS l FROM sales GROUP BY ALL)
  JOIN seasons USING (Distributor_ID, Year, Month) GROUP BY ALL"""
CTE["world_avg"] = """
  SELECT Seasonality_Index, sum(s) / sum(n) AS a FROM label_avg GROUP BY Seasonality_Index"""
CTE["multipliers"] = f"""
  SELECT Distributor_ID, Seasonality_Index, avg_liters_by_label, moderate_avg_liters,
    CASE Seasonality_Index WHEN 'Favorable' THEN least(greatest(v, 1.0), 1.2) WHEN 'Moderate' THEN 1.0
      ELSE least(greatest(v, 0.8), 1.0) END AS seasonality_multiplier_calibrated,
    CASE WHEN own IS NOT NULL THEN 'distributor_calculated' ELSE 'global_calculated' END
      AS seasonality_multiplier_source
  FROM (SELECT *, CAST(coalesce(own, world / (SELECT a FROM world_avg WHERE Seasonality_Index = 'Moderate'))
      AS DOUBLE) AS v
    FROM (SELECT l.*, m.avg_liters_by_label AS moderate_avg_liters, w.a AS world,
        {div('l.avg_liters_by_label', 'm.avg_liters_by_label')} AS own
      FROM label_avg l LEFT JOIN (SELECT * FROM label_avg WHERE Seasonality_Index = 'Moderate') m
        ON l.Distributor_ID = m.Distributor_ID
      JOIN world_avg w ON l.Seasonality_Index = w.Seasonality_Index))"""
HOLIDAY_COLUMNS = list(config.HOLIDAY_MONTH_COLUMNS)
CTE["context_base"] = f"""
  SELECT Distributor_ID, Seasonality_Index, Year, Month,
    {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}' for c in HOLIDAY_COLUMNS)}, seasonality_score,
    seasonality_multiplier AS seasonality_multiplier_default,
    coalesce(seasonality_multiplier_calibrated, seasonality_multiplier) AS seasonality_multiplier_calibrated,
    coalesce(seasonality_multiplier_source, 'fallback_default') AS seasonality_multiplier_source
  FROM seasons LEFT JOIN hol_months USING (Year, Month)
    LEFT JOIN multipliers USING (Distributor_ID, Seasonality_Index)"""
CTE["context_scored"] = """
  SELECT *, holiday_intensity_score * seasonality_multiplier_calibrated AS distributor_month_demand_context_score,
    CAST(holiday_intensity_score > 0 AND Seasonality_Index = 'Favorable' AS INTEGER) AS is_favorable_holiday_month,
    CAST(holiday_intensity_score > 0 AND Seasonality_Index = 'Un-Favorable' AS INTEGER)
      AS is_unfavorable_holiday_month,
    CAST(festive_holiday_date_count > 0 AND Seasonality_Index = 'Favorable' AS INTEGER)
      AS is_festive_favorable_month
  FROM context_base"""
CTE["context"] = """
  SELECT *, coalesce(round_even((distributor_month_demand_context_score - lo) / nullif(hi - lo, 0) * 100, 2), 0.0)
    AS distributor_month_context_score_0_100
  FROM context_scored, (SELECT min(distributor_month_demand_context_score) AS lo,
    max(distributor_month_demand_context_score) AS hi FROM context_scored)"""

# --- density ---------------------------------------------------------------------------------

CTE["points"] = "SELECT Outlet_ID AS location_name, Latitude AS latitude, Longitude AS longitude FROM coords"
CTE["within_points"] = """
  SELECT p.*, min(district) AS region FROM points p LEFT JOIN raw_districts
    ON latitude > lat_low AND latitude < lat_high AND longitude > lon_low AND longitude < lon_high
  GROUP BY ALL"""
CTE["nearest_points"] = """
  SELECT p.* REPLACE (coalesce(region, (SELECT min(struct_pack(d :=
      (latitude - (lat_low + lat_high) / 2) ** 2 + (longitude - (lon_low + lon_high) / 2) ** 2, n := district))
      FROM raw_districts).n) AS region) FROM within_points p"""
CTE["located"] = """
  SELECT location_name, latitude, longitude, p.region AS district, coalesce(m.province, p.region) AS province
  FROM nearest_points p LEFT JOIN raw_district_map m ON p.region = m.district"""
CTE["raster"] = "SELECT row_no, col_no, sum(people) AS people FROM raw_population_grid GROUP BY ALL"
CTE["people_near"] = """
  SELECT location_name, latitude, longitude, coalesce(sum(people), 0.0) AS population
  FROM (SELECT *, unnest([-1, 0, 1]) AS di FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS dj FROM points)) p
  LEFT JOIN raster ON row_no = CAST(round(latitude / 0.01) AS INTEGER) + di
    AND col_no = CAST(round(longitude / 0.01) AS INTEGER) + dj
    AND 2 * 6371.0088 * asin(sqrt(sin((radians(row_no * 0.01) - radians(latitude)) / 2) ** 2
      + cos(radians(latitude)) * cos(radians(row_no * 0.01))
      * sin((radians(col_no * 0.01) - radians(longitude)) / 2) ** 2)) <= 1.0
  GROUP BY ALL"""
GROWN = "CAST(round_even(greatest({0} * pow(1.008, year - 2020), 0.0), 0) AS BIGINT) AS base_population"
TOURISM = values("month_num", config.MONTHLY_TOURISM_FACTOR, "NULL")
MOBILITY = values("year", config.YEARLY_MOBILITY_FACTOR, "NULL")


def monthly_from(source: str) -> str:
    return f"""
  SELECT *, CAST(round_even(base_population * mobility_factor * tourism_factor, 0) AS BIGINT) AS monthly_density
  FROM (SELECT *, CAST({TOURISM} AS DOUBLE) AS tourism_factor, CAST({MOBILITY} AS DOUBLE) AS mobility_factor,
      concat(year, '-', lpad(CAST(month_num AS VARCHAR), 2, '0')) AS month
    FROM (SELECT *, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]) AS month_num FROM {source}))"""


def filled_from(source: str) -> str:
    positive = f"(SELECT * FROM {source} WHERE monthly_density > 0)"
    return f"""
  SELECT * EXCLUDE (f, g) REPLACE (CASE WHEN monthly_density > 0 THEN monthly_density
      WHEN coalesce(f, 0) > 0 THEN f ELSE CAST(round_even(g, 0) AS BIGINT) END AS monthly_density)
  FROM (SELECT s.*, coalesce(o.g, 1.0) AS g, CAST(round_even(coalesce(a.v, b.v, c.v, o.g, 1.0), 0) AS BIGINT) AS f
    FROM {source} s
    LEFT JOIN (SELECT province, month, avg(monthly_density) AS v FROM {positive} GROUP BY ALL) a
      ON s.province = a.province AND s.month = a.month
    LEFT JOIN (SELECT province, avg(monthly_density) AS v FROM {positive} GROUP BY ALL) b ON s.province = b.province
    LEFT JOIN (SELECT month, avg(monthly_density) AS v FROM {positive} GROUP BY ALL) c ON s.month = c.month
    CROSS JOIN (SELECT avg(monthly_density) AS g FROM {positive}) o)"""


CTE["outlet_years"] = f"""
  SELECT * EXCLUDE (population), {GROWN.format('population')} FROM (
    SELECT l.*, n.population, unnest([2023, 2024, 2025]) AS year
    FROM located l JOIN people_near n USING (location_name))"""
CTE["outlet_months"] = monthly_from("outlet_years")
CTE["density"] = filled_from("outlet_months")
CTE["customer_years"] = f"""
  SELECT * EXCLUDE (population), {GROWN.format('population')} FROM (
    SELECT concat('O', c_custkey) AS location_name, concat('P', c_nationkey) AS province,
      CAST(greatest(floor(c_acctbal), 0) AS DOUBLE) AS population, unnest([2023, 2024, 2025]) AS year
    FROM customer)"""
CTE["customer_months"] = monthly_from("customer_years")

# --- monthly and outlet features -------------------------------------------------------------

CTE["monthly"] = """
  SELECT Outlet_ID, Year, Month, sum(Volume_Liters) AS monthly_liters, sum(Total_Bill_Value) AS monthly_bill_value,
    count(DISTINCT SKU_ID) AS monthly_sku_count, avg(Price_Per_Liter) AS monthly_avg_price_per_liter,
    count(*) AS monthly_transaction_count FROM sales GROUP BY Outlet_ID, Year, Month"""
CTE["main_dist"] = """
  SELECT Outlet_ID, Distributor_ID, distributor_count FROM (
    SELECT Outlet_ID, Distributor_ID, count(*) OVER (PARTITION BY Outlet_ID) AS distributor_count,
      row_number() OVER (PARTITION BY Outlet_ID ORDER BY n DESC, Distributor_ID) AS rn
    FROM (SELECT Outlet_ID, Distributor_ID, count(*) AS n FROM sales GROUP BY ALL)) WHERE rn = 1"""
CTE["latest"] = "SELECT max(Year * 12 + Month) AS latest FROM monthly"
CTE["mgold"] = f"""
  SELECT m.Distributor_ID, m.Year, m.Month, m.Outlet_ID, monthly_liters, monthly_bill_value, monthly_sku_count,
    monthly_avg_price_per_liter, monthly_transaction_count, m.Year * 12 + m.Month AS Month_Index,
    CAST(m.Year * 12 + m.Month >= latest - 2 AS INTEGER) AS is_recent_3_months,
    CAST(m.Year * 12 + m.Month >= latest - 5 AS INTEGER) AS is_recent_6_months, distributor_count,
    h.Year_Month, {', '.join(f'coalesce(CAST(h.{c} AS DOUBLE), 0.0) AS {c}' for c in HOLIDAY_COLUMNS)},
    coalesce(s.Seasonality_Index, 'Moderate') AS Seasonality_Index,
    coalesce(s.seasonality_score, 0) AS seasonality_score,
    coalesce(s.seasonality_multiplier, 1.0) AS seasonality_multiplier,
    coalesce(c.seasonality_multiplier_calibrated, s.seasonality_multiplier, 1.0)
      AS seasonality_multiplier_calibrated,
    c.seasonality_multiplier_source,
    coalesce(c.distributor_month_demand_context_score, coalesce(h.holiday_intensity_score, 0.0)
      * coalesce(c.seasonality_multiplier_calibrated, s.seasonality_multiplier, 1.0))
      AS distributor_month_demand_context_score,
    c.distributor_month_context_score_0_100, c.is_favorable_holiday_month, c.is_unfavorable_holiday_month,
    c.is_festive_favorable_month,
    coalesce(h.holiday_intensity_score, 0.0) * coalesce(c.seasonality_multiplier_calibrated,
      s.seasonality_multiplier, 1.0) AS seasonality_adjusted_holiday_score,
    CAST(d.base_population AS DOUBLE) AS base_population, CAST(d.monthly_density AS DOUBLE) AS monthly_density,
    d.mobility_factor, d.tourism_factor, d.province
  FROM (SELECT * FROM monthly JOIN main_dist USING (Outlet_ID)) m CROSS JOIN latest
  LEFT JOIN hol_months h ON m.Year = h.Year AND m.Month = h.Month
  LEFT JOIN seasons s ON m.Distributor_ID = s.Distributor_ID AND m.Year = s.Year AND m.Month = s.Month
  LEFT JOIN context c ON m.Distributor_ID = c.Distributor_ID AND m.Year = c.Year AND m.Month = c.Month
  LEFT JOIN density d ON m.Outlet_ID = d.location_name AND m.Year = d.year AND m.Month = d.month_num"""
CTE["prov_mode"] = """
  SELECT Outlet_ID, province FROM (SELECT Outlet_ID, province,
      row_number() OVER (PARTITION BY Outlet_ID ORDER BY count(*) DESC, province) AS rn
    FROM mgold WHERE province IS NOT NULL GROUP BY Outlet_ID, province) WHERE rn = 1"""
PROFILE_SQL = """
    avg(monthly_liters) AS avg_monthly_liters, avg(monthly_bill_value) AS avg_bill_value,
    avg(monthly_sku_count) AS avg_sku_count, avg(monthly_transaction_count) AS avg_transaction_count,
    avg(monthly_avg_price_per_liter) AS avg_price_per_liter, max(monthly_liters) AS max_monthly_liters,
    max(monthly_bill_value) AS max_bill_value, max(monthly_sku_count) AS max_sku_count,
    median(monthly_liters) AS median_monthly_liters, stddev_samp(monthly_liters) AS sales_std,
    sum(monthly_liters) AS total_liters, sum(monthly_bill_value) AS total_bill_value,
    CAST(sum(monthly_transaction_count) AS BIGINT) AS total_transaction_count,
    count(monthly_liters) AS active_months"""
MEANS = {
    "avg_holiday_intensity_score": "holiday_intensity_score",
    "avg_public_holiday_date_count": "public_holiday_date_count",
    "avg_poya_day_date_count": "poya_day_date_count",
    "avg_festive_holiday_date_count": "festive_holiday_date_count",
    "avg_long_weekend_holiday_date_count": "long_weekend_holiday_date_count",
    "avg_seasonality_score": "seasonality_score",
    "avg_seasonality_multiplier": "seasonality_multiplier",
    "avg_seasonality_multiplier_calibrated": "seasonality_multiplier_calibrated",
    "avg_seasonality_adjusted_holiday_score": "seasonality_adjusted_holiday_score",
    "avg_distributor_month_context_score": "distributor_month_demand_context_score",
    "avg_base_population": "base_population", "avg_monthly_density": "monthly_density",
    "avg_mobility_factor": "mobility_factor", "avg_tourism_factor": "tourism_factor",
}
MAXIMA = {
    "max_holiday_intensity_score": "holiday_intensity_score",
    "max_seasonality_adjusted_holiday_score": "seasonality_adjusted_holiday_score",
    "max_distributor_month_context_score": "distributor_month_demand_context_score",
    "max_base_population": "base_population", "max_monthly_density": "monthly_density",
}
RECENT_SQL = ", ".join(
    f"avg(monthly_liters) FILTER (is_recent_{n}_months = 1) AS recent_{n}_month_avg_liters,"
    f"sum(monthly_liters) FILTER (is_recent_{n}_months = 1) AS recent_{n}_month_total_liters"
    for n in (3, 6)
)
SLICE_SQL = """
    avg(monthly_liters) FILTER (Month = 1) AS avg_january_liters,
    max(monthly_liters) FILTER (Month = 1) AS max_january_liters,
    avg(monthly_bill_value) FILTER (Month = 1) AS avg_january_bill_value,
    avg(monthly_sku_count) FILTER (Month = 1) AS avg_january_sku_count,
    avg(monthly_liters) FILTER (Month NOT IN (4, 12)) AS avg_monthly_liters_excluding_apr_dec,
    avg(monthly_liters) FILTER (Month = 4) AS april_avg_liters,
    avg(monthly_liters) FILTER (Month = 12) AS december_avg_liters,
    avg(monthly_density) FILTER (Month = 1) AS avg_january_density,
    max(monthly_density) FILTER (Month = 1) AS max_january_density,
    avg(distributor_month_demand_context_score) FILTER (Month = 1) AS avg_january_context_score,
    avg(seasonality_adjusted_holiday_score) FILTER (Month = 1) AS avg_january_adjusted_holiday_score"""
SPIKE_SQL = f"""
    {div('april_avg_liters', 'median_monthly_liters', '0.0')} AS april_spike_ratio,
    {div('december_avg_liters', 'median_monthly_liters', '0.0')} AS december_spike_ratio,
    greatest(april_avg_liters, december_avg_liters) AS seasonal_peak_liters,
    {div('greatest(april_avg_liters, december_avg_liters)', 'median_monthly_liters', '0.0')} AS peak_to_median_ratio,
    CAST({div('greatest(april_avg_liters, december_avg_liters)', 'median_monthly_liters', '0.0')} >= 1.5 AS INTEGER)
      AS seasonal_spike_flag"""
CTE["skus"] = "SELECT Outlet_ID, count(DISTINCT SKU_ID) AS total_unique_skus FROM sales GROUP BY Outlet_ID"
CTE["ofeat"] = f"""
  SELECT a.*, p.province, {div('sales_std', 'avg_monthly_liters')} AS sales_cv, {SPIKE_SQL},
    total_unique_skus, Distributor_ID, distributor_count
  FROM (SELECT Outlet_ID, {PROFILE_SQL}, quantile_cont(monthly_liters, 0.75) AS p75_monthly_liters,
      quantile_cont(monthly_liters, 0.9) AS p90_monthly_liters,
      {', '.join(f'avg({s}) AS {o}' for o, s in MEANS.items())},
      {', '.join(f'max({s}) AS {o}' for o, s in MAXIMA.items())},
      CAST(sum(is_favorable_holiday_month) AS BIGINT) AS favorable_holiday_month_count,
      CAST(sum(is_unfavorable_holiday_month) AS BIGINT) AS unfavorable_holiday_month_count,
      CAST(sum(is_festive_favorable_month) AS BIGINT) AS festive_favorable_month_count,
      {RECENT_SQL}, {SLICE_SQL} FROM mgold GROUP BY Outlet_ID) a
  LEFT JOIN prov_mode p USING (Outlet_ID) LEFT JOIN skus USING (Outlet_ID) LEFT JOIN main_dist USING (Outlet_ID)"""
FEATURE_DOUBLES = [
    "avg_monthly_liters", "avg_bill_value", "avg_sku_count", "avg_transaction_count", "avg_price_per_liter",
    "max_monthly_liters", "max_bill_value", "median_monthly_liters", "sales_std", "total_liters",
    "total_bill_value", "p75_monthly_liters", "p90_monthly_liters", *MEANS, *MAXIMA,
    "recent_3_month_avg_liters", "recent_3_month_total_liters", "recent_6_month_avg_liters",
    "recent_6_month_total_liters", "avg_january_liters", "max_january_liters", "avg_january_bill_value",
    "avg_january_sku_count", "avg_monthly_liters_excluding_apr_dec", "april_avg_liters", "december_avg_liters",
    "avg_january_density", "max_january_density", "avg_january_context_score",
    "avg_january_adjusted_holiday_score", "sales_cv", "april_spike_ratio", "december_spike_ratio",
    "seasonal_peak_liters", "peak_to_median_ratio",
]
FEATURE_INTEGERS = [
    "max_sku_count", "total_transaction_count", "active_months", "favorable_holiday_month_count",
    "unfavorable_holiday_month_count", "festive_favorable_month_count", "seasonal_spike_flag",
    "total_unique_skus", "distributor_count",
]
MGOLD_DOUBLES = [
    "monthly_liters", "monthly_bill_value", "monthly_avg_price_per_liter", *HOLIDAY_COLUMNS,
    "seasonality_multiplier", "seasonality_multiplier_calibrated", "distributor_month_demand_context_score",
    "distributor_month_context_score_0_100", "seasonality_adjusted_holiday_score", "base_population",
    "monthly_density", "mobility_factor", "tourism_factor",
]

# --- Gold ------------------------------------------------------------------------------------

PROXIES = {
    "holiday_intensity_score": "jan_2026_holiday_intensity_proxy",
    "holiday_date_count": "jan_2026_holiday_date_count_proxy",
    "public_holiday_date_count": "jan_2026_public_holiday_date_count_proxy",
    "poya_day_date_count": "jan_2026_poya_day_date_count_proxy",
    "festive_holiday_date_count": "jan_2026_festive_holiday_date_count_proxy",
    "long_weekend_holiday_date_count": "jan_2026_long_weekend_holiday_date_count_proxy",
}


def at_target(table: str, year: str = "Year", month: str = "Month") -> str:
    has = f"EXISTS (SELECT 1 FROM {table} WHERE {year} = 2026 AND {month} = 1)"
    return f"(SELECT * FROM {table} WHERE {month} = 1 AND ({year} = 2026 OR NOT {has}))"


CTE["jan_season"] = f"""
  SELECT Distributor_ID, avg(seasonality_score) AS jan_2026_seasonality_score,
    avg(seasonality_multiplier) AS jan_2026_seasonality_multiplier,
    max(Seasonality_Index) AS jan_2026_seasonality_index FROM {at_target('seasons')} GROUP BY ALL"""
CTE["jan_context"] = f"""
  SELECT Distributor_ID, avg(seasonality_multiplier_calibrated) AS jan_2026_seasonality_multiplier_calibrated,
    avg(distributor_month_demand_context_score) AS jan_2026_distributor_month_context_score
  FROM {at_target('context')} GROUP BY ALL"""
CTE["jan_holidays"] = (
    "SELECT " + ", ".join(f"coalesce(avg({s}), 0.0) AS {o}" for s, o in PROXIES.items())
    + f" FROM {at_target('hol_months')}"
)
CTE["jan_density"] = f"""
  SELECT location_name AS Outlet_ID, avg(monthly_density) AS jan_2026_monthly_density,
    avg(base_population) AS jan_2026_base_population, avg(mobility_factor) AS jan_2026_mobility_factor,
    avg(tourism_factor) AS jan_2026_tourism_factor FROM {at_target('density', 'year', 'month_num')} GROUP BY ALL"""
TARGET_DOUBLES = [
    "jan_2026_seasonality_score", "jan_2026_seasonality_multiplier", "jan_2026_seasonality_multiplier_calibrated",
    "jan_2026_distributor_month_context_score", "jan_2026_seasonality_multiplier_used", *PROXIES.values(),
    "jan_2026_adjusted_holiday_score_proxy", "jan_2026_monthly_density", "jan_2026_base_population",
    "jan_2026_mobility_factor", "jan_2026_tourism_factor",
]


def with_target(source: str) -> str:
    used = "coalesce(jan_2026_seasonality_multiplier_calibrated, jan_2026_seasonality_multiplier, 1.0)"
    return f"""
  SELECT s.*, coalesce(jan_2026_seasonality_score, 0.0) AS jan_2026_seasonality_score,
    coalesce(jan_2026_seasonality_multiplier, 1.0) AS jan_2026_seasonality_multiplier,
    coalesce(jan_2026_seasonality_index, 'Moderate') AS jan_2026_seasonality_index,
    jan_2026_seasonality_multiplier_calibrated, jan_2026_distributor_month_context_score,
    {used} AS jan_2026_seasonality_multiplier_used, h.*,
    jan_2026_holiday_intensity_proxy * {used} AS jan_2026_adjusted_holiday_score_proxy,
    d.* EXCLUDE (Outlet_ID)
  FROM {source} s LEFT JOIN jan_season USING (Distributor_ID) LEFT JOIN jan_context USING (Distributor_ID)
    LEFT JOIN jan_density d ON s.Outlet_ID = d.Outlet_ID CROSS JOIN jan_holidays h"""


CTE["assembled"] = """
  SELECT o.*, c.* EXCLUDE (Outlet_ID), f.* EXCLUDE (Outlet_ID), r.* EXCLUDE (Outlet_ID), a.* EXCLUDE (Outlet_ID)
  FROM outlets o LEFT JOIN coords c ON o.Outlet_ID = c.Outlet_ID LEFT JOIN ofeat f ON o.Outlet_ID = f.Outlet_ID
  LEFT JOIN return_features r ON o.Outlet_ID = r.Outlet_ID
  LEFT JOIN anomaly_features a ON o.Outlet_ID = a.Outlet_ID"""
CTE["targeted"] = with_target("assembled")
COUNTS = [
    "return_record_count", "return_month_count", "return_sku_count", "billing_anomaly_count",
    "zero_volume_positive_bill_count", "positive_volume_zero_bill_count", "zero_volume_zero_bill_count",
]
FILLED = [*FEATURE_DOUBLES, *FEATURE_INTEGERS, *TARGET_DOUBLES, *COUNTS, "return_liters_abs", "return_value_abs"]
CATEGORIES = ["Outlet_Size", "Outlet_Type", "Distributor_ID", "province"]
CTE["ogold"] = f"""
  SELECT *, {div('return_liters_abs', 'total_liters', '0.0')} AS return_ratio_liters,
    {div('return_value_abs', 'total_bill_value', '0.0')} AS return_ratio_value,
    CAST(return_record_count > 0 AS INTEGER) AS has_return_flag,
    CAST(billing_anomaly_count > 0 AS INTEGER) AS has_billing_anomaly_flag,
    CAST(Latitude IS NULL OR Longitude IS NULL AS INTEGER) AS missing_coordinate_flag
  FROM (SELECT * REPLACE ({', '.join(f'coalesce({c}, 0) AS {c}' for c in FILLED)},
    {', '.join(f"coalesce({c}, 'Unknown') AS {c}" for c in CATEGORIES)}) FROM targeted)"""
GOLD_DOUBLES = [
    "Cooler_Count", "Latitude", "Longitude", *FEATURE_DOUBLES, *TARGET_DOUBLES, "return_liters_abs",
    "return_value_abs", "return_ratio_liters", "return_ratio_value",
]
CTE["imp_features"] = f"""
  SELECT * REPLACE ({{fills}}), {div('coalesce(return_liters_abs, 0)', 'total_liters', '0.0')} AS return_ratio_liters,
    {div('coalesce(return_value_abs, 0)', 'total_bill_value', '0.0')} AS return_ratio_value
  FROM (SELECT o.*, c.Latitude, c.Longitude, p.* EXCLUDE (Outlet_ID),
      {div('p.sales_std', 'p.avg_monthly_liters')} AS sales_cv, n.* EXCLUDE (Outlet_ID), k.total_unique_skus,
      d.Distributor_ID, d.distributor_count, r.return_record_count, r.return_liters_abs, r.return_value_abs,
      h.* EXCLUDE (Outlet_ID), s.avg_seasonality_score
    FROM outlets o LEFT JOIN coords c ON o.Outlet_ID = c.Outlet_ID
    LEFT JOIN (SELECT Outlet_ID, {PROFILE_SQL}, avg(monthly_liters) FILTER (Month = 1) AS avg_january_liters,
      max(monthly_liters) FILTER (Month = 1) AS max_january_liters FROM monthly GROUP BY Outlet_ID) p
      ON o.Outlet_ID = p.Outlet_ID
    LEFT JOIN last_rows n ON o.Outlet_ID = n.Outlet_ID LEFT JOIN skus k ON o.Outlet_ID = k.Outlet_ID
    LEFT JOIN main_dist d ON o.Outlet_ID = d.Outlet_ID LEFT JOIN return_features r ON o.Outlet_ID = r.Outlet_ID
    LEFT JOIN calendar_avg h ON o.Outlet_ID = h.Outlet_ID
    LEFT JOIN (SELECT Outlet_ID, avg(seasonality_score) AS avg_seasonality_score FROM monthly
      JOIN main_dist USING (Outlet_ID) LEFT JOIN seasons USING (Distributor_ID, Year, Month) GROUP BY Outlet_ID) s
      ON o.Outlet_ID = s.Outlet_ID)"""
CTE["last_rows"] = """
  SELECT Outlet_ID, avg(monthly_liters) FILTER (rk <= 3) AS recent_3_month_avg_liters,
    sum(monthly_liters) FILTER (rk <= 3) AS recent_3_month_total_liters,
    avg(monthly_liters) AS recent_6_month_avg_liters, sum(monthly_liters) AS recent_6_month_total_liters
  FROM (SELECT *, row_number() OVER (PARTITION BY Outlet_ID ORDER BY Year DESC, Month DESC) AS rk FROM monthly)
  WHERE rk <= 6 GROUP BY Outlet_ID"""
CTE["calendar_avg"] = f"""
  SELECT Outlet_ID, {', '.join(f'avg({c}) AS {c}' for c in HOLIDAY_COLUMNS)}
  FROM monthly LEFT JOIN hol_months USING (Year, Month) GROUP BY Outlet_ID"""
IMP_DOUBLES = [
    "avg_monthly_liters", "avg_bill_value", "avg_sku_count", "avg_transaction_count", "avg_price_per_liter",
    "max_monthly_liters", "max_bill_value", "median_monthly_liters", "sales_std", "total_liters",
    "total_bill_value", "avg_january_liters", "max_january_liters", "sales_cv", "recent_3_month_avg_liters",
    "recent_3_month_total_liters", "recent_6_month_avg_liters", "recent_6_month_total_liters",
    "return_liters_abs", "return_value_abs", *HOLIDAY_COLUMNS, "avg_seasonality_score",
]
IMP_FILLED = [
    "Cooler_Count", *IMP_DOUBLES, "max_sku_count", "total_transaction_count", "active_months",
    "total_unique_skus", "distributor_count", "return_record_count",
]
CTE["imp_features"] = CTE["imp_features"].replace(
    "{fills}", ", ".join(f"coalesce({c}, 0) AS {c}" for c in IMP_FILLED)
)

# --- potential -------------------------------------------------------------------------------

_MARKS = {"p75": 0.75, "p90": 0.9, "p95": 0.95, "p98": 0.98}
CTE["peer_rows"] = "SELECT m.*, o.Outlet_Type FROM mgold m JOIN ogold o USING (Outlet_ID)"
CTE["peer_base"] = f"""
  SELECT Outlet_Type, count(monthly_liters) AS cluster_overall_obs, avg(monthly_liters) AS cluster_overall_mean,
    max(monthly_liters) AS cluster_overall_max, count(monthly_liters) FILTER (Month = 1) AS cluster_jan_obs,
    avg(monthly_liters) FILTER (Month = 1) AS cluster_jan_mean,
    max(monthly_liters) FILTER (Month = 1) AS cluster_jan_max,
    avg(seasonality_multiplier_calibrated) FILTER (Month = 1) AS cluster_hist_jan_seasonality_multiplier,
    avg(seasonality_adjusted_holiday_score) FILTER (Month = 1) AS cluster_hist_jan_adjusted_holiday_score,
    avg(monthly_density) FILTER (Month = 1) AS cluster_hist_jan_density,
    {', '.join(f'quantile_cont(monthly_liters, {q}) AS cluster_overall_{k}' for k, q in _MARKS.items())},
    {', '.join(f'quantile_cont(monthly_liters, {q}) FILTER (Month = 1) AS cluster_jan_{k}' for k, q in _MARKS.items())}
  FROM peer_rows GROUP BY Outlet_Type"""
CTE["peers"] = f"""
  SELECT *, CASE WHEN cluster_jan_obs >= 30 THEN cluster_jan_p90 ELSE cluster_overall_p90 * cluster_jan_ratio END
      AS cluster_january_ceiling,
    CASE WHEN cluster_jan_obs >= 30 THEN cluster_jan_p98 ELSE cluster_overall_p98 * cluster_jan_ratio END
      AS cluster_january_cap,
    CASE WHEN cluster_jan_obs >= 30 THEN 'cluster_january_p90'
      ELSE 'cluster_overall_p90_adjusted_by_january_ratio' END AS january_benchmark_source
  FROM (SELECT b.* REPLACE (coalesce(cluster_hist_jan_seasonality_multiplier, 1.0)
        AS cluster_hist_jan_seasonality_multiplier,
      coalesce(cluster_hist_jan_adjusted_holiday_score, 0.0) AS cluster_hist_jan_adjusted_holiday_score,
      coalesce(cluster_hist_jan_density, (SELECT median(cluster_hist_jan_density) FROM peer_base))
        AS cluster_hist_jan_density), cluster_median_outlet_p90,
    {clip(div('cluster_jan_mean', 'cluster_overall_mean', '1.0'), 0.75, 1.25)} AS cluster_jan_ratio
  FROM peer_base b JOIN (SELECT Outlet_Type, median(p90_monthly_liters) AS cluster_median_outlet_p90
    FROM ogold GROUP BY Outlet_Type) USING (Outlet_Type))"""
PEER_DOUBLES = [
    "cluster_overall_mean", "cluster_overall_max", "cluster_jan_mean", "cluster_jan_max",
    "cluster_hist_jan_seasonality_multiplier", "cluster_hist_jan_adjusted_holiday_score",
    "cluster_hist_jan_density", *[f"cluster_overall_{k}" for k in _MARKS], *[f"cluster_jan_{k}" for k in _MARKS],
    "cluster_january_ceiling", "cluster_january_cap", "cluster_median_outlet_p90", "cluster_jan_ratio",
]
CTE["adjusted"] = f"""
  SELECT o.Outlet_ID, o.Outlet_Type, jan_2026_seasonality_multiplier_used AS jan_2026_multiplier_used,
    jan_2026_adjusted_holiday_score_proxy AS jan_2026_adjusted_holiday_score_used,
    jan_2026_monthly_density AS jan_2026_density_used,
    {clip(div('jan_2026_seasonality_multiplier_used', 'cluster_hist_jan_seasonality_multiplier', '1.0'), 0.9, 1.1)}
      AS seasonality_relative_adjustment,
    {clip('coalesce(1 + (jan_2026_adjusted_holiday_score_proxy - cluster_hist_jan_adjusted_holiday_score)'
          ' / 10.0 * 0.02, 1.0)', 0.97, 1.03)} AS holiday_relative_adjustment,
    {clip('1 + (' + div('jan_2026_monthly_density', 'cluster_hist_jan_density', '1.0') + ' - 1) * 0.2', 0.95, 1.05)}
      AS density_relative_adjustment,
    {clip(div('recent_3_month_avg_liters', 'recent_6_month_avg_liters', '1.0'), 0.9, 1.1)} AS recent_trend_adjustment,
    {clip('1 + (' + div('p90_monthly_liters', 'cluster_median_outlet_p90', '1.0') + ' - 1) * 0.15', 0.9, 1.1)}
      AS capacity_relative_adjustment,
    cluster_jan_obs, cluster_january_ceiling, cluster_january_cap, january_benchmark_source,
    greatest(max_january_liters, avg_january_liters) AS own_january_peak_liters,
    avg_january_liters AS current_january_baseline_liters
  FROM ogold o LEFT JOIN peers USING (Outlet_Type)"""
CTE["estimated"] = """
  SELECT *, coalesce(round_even(CASE WHEN raw_jan_2026_potential IS NOT NULL AND cluster_january_cap IS NOT NULL
      THEN least(greatest(raw_jan_2026_potential, own_january_peak_liters),
        greatest(cluster_january_cap, own_january_peak_liters)) END, 2),
      round_even(own_january_peak_liters, 2)) AS Maximum_Monthly_Liters
  FROM (SELECT *, cluster_january_ceiling * seasonality_relative_adjustment * holiday_relative_adjustment
    * density_relative_adjustment * recent_trend_adjustment * capacity_relative_adjustment
    AS raw_jan_2026_potential FROM adjusted)"""
CTE["gapped"] = """
  SELECT *, coalesce(round_even(potential_gap_liters / nullif(current_january_baseline_liters, 0), 4), 0.0)
      AS potential_gap_ratio
  FROM (SELECT *, round_even(greatest(Maximum_Monthly_Liters - current_january_baseline_liters, 0.0), 2)
    AS potential_gap_liters FROM estimated)"""

# --- the checks ------------------------------------------------------------------------------

check("scan_csv_roundtrip", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer", "c_acctbal")
_RAW_COLUMNS = {
    "transactions": config.TRANSACTION_COLUMNS,
    "outlet_master": ("Outlet_ID", "Outlet_Size", "Outlet_Type", "Cooler_Count"),
    "outlet_coordinates": ("Outlet_ID", "Latitude", "Longitude"),
    "seasonality": ("Distributor_ID", "Year", "Month", "Seasonality_Index"),
    "holidays": ("Date", "Holiday_Name", "Holiday_Type"),
}
check("bronze_landing", " UNION ALL ".join(
    f"""SELECT '{n}' AS dataset, count(*) AS rows, count(*) AS row_ids, CAST(0 AS BIGINT) AS no_source,
      CAST(0 AS BIGINT) AS broken_lines FROM raw_{n}""" for n in _RAW_COLUMNS))
check("checkpoint_resume", """SELECT o_custkey AS place, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders
    FROM orders GROUP BY ALL""")
check("optional_table", "SELECT s_suppkey, s_name FROM supplier")
check("clean_columns", "SELECT p_partkey, p_name, p_size FROM part")
check("resolve_aliases", f"""SELECT Outlet_ID AS location_name, {num('Latitude')} AS latitude,
    {num('Longitude')} AS longitude FROM raw_outlet_coordinates
    WHERE {num('Latitude')} IS NOT NULL AND {num('Longitude')} IS NOT NULL""", "latitude", "longitude")
check("unify_period_columns", """SELECT concat('O', o_custkey) AS Outlet_ID, CAST(year(o_orderdate) AS INTEGER) AS Year,
    CAST(month(o_orderdate) AS INTEGER) AS Month, count(*) AS order_count FROM orders GROUP BY ALL""")
check("legacy_alias_fill", "SELECT Year, Month, CAST(holiday_date_count AS DOUBLE) AS holiday_date_count, "
      + ", ".join(f"CAST({o} AS DOUBLE) AS {n}" for o, n in config.LEGACY_HOLIDAY_COLUMNS.items())
      + ", holiday_intensity_score FROM holrow_months", "holiday_intensity_score")

check("profile_dataset", " UNION ALL ".join(
    f"SELECT '{n}' AS file, count(*) AS rows, {k} AS cols FROM raw_{n}"
    for n, k in (("transactions", 7), ("outlet_master", 4), ("outlet_coordinates", 3), ("seasonality", 4),
                 ("holidays", 3))))
check("profile_columns", " UNION ALL ".join(f"""
    SELECT '{n}' AS file, '{c}' AS "column", 'string' AS dtype, count(*) - count({c}) AS missing_count,
      round_even((count(*) - count({c})) / count(*), 4) AS missing_ratio, count(DISTINCT {c}) AS unique_count,
      round_even(count(DISTINCT {c}) / count(*), 4) AS unique_ratio FROM raw_{n}""" for n, cs in _RAW_COLUMNS.items() for c in cs))
check("profile_samples", " UNION ALL ".join(f"""
    SELECT '{n}' AS file, '{c}' AS "column", CAST(to_json(list(v ORDER BY f, v)) AS VARCHAR) AS sample_values
    FROM (SELECT {c} AS v, min(_row_id) AS f FROM raw_{n} WHERE {c} IS NOT NULL GROUP BY {c}
      ORDER BY f, v LIMIT 5)""" for n, cs in _RAW_COLUMNS.items() for c in cs))
_CHECKED = {"outlet_master": "master_checked", "outlet_coordinates": "coords_checked",
            "distributor_seasonality": "season_checked", "holiday_list": "hol_checked",
            "transactions": "tx_rejected"}
check("rejection_reason_counts", "SELECT file, reason, count(*) AS count FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS file, unnest(reasons) AS reason FROM {t}" for n, t in _CHECKED.items()) + ") GROUP BY ALL")
check("union_rejected", """
    SELECT 'outlet_master' AS dataset, _row_id, Outlet_ID, CAST(NULL AS VARCHAR) AS Distributor_ID,
      CAST(NULL AS INTEGER) AS Year, CAST(NULL AS INTEGER) AS Month,
      array_to_string(reasons, ' | ') AS _dq_rejection_reason FROM master_checked WHERE len(reasons) > 0
    UNION ALL SELECT 'outlet_coordinates', _row_id, Outlet_ID, NULL, NULL, NULL, array_to_string(reasons, ' | ')
      FROM coords_checked WHERE len(reasons) > 0
    UNION ALL SELECT 'distributor_seasonality', _row_id, NULL, Distributor_ID, Year, Month,
      array_to_string(reasons, ' | ') FROM season_checked WHERE len(reasons) > 0
    UNION ALL SELECT 'holiday_list', _row_id, NULL, NULL, NULL, NULL, array_to_string(reasons, ' | ')
      FROM hol_checked WHERE len(reasons) > 0
    UNION ALL SELECT 'transactions', NULL, Outlet_ID, Distributor_ID, Year, Month,
      array_to_string(reasons, ' | ') FROM tx_rejected""")
_LOAD = "count(*) AS raw_rows, count(*) FILTER (len(reasons) = 0) AS silver_rows, count(*) FILTER (len(reasons) > 0) AS rejected_rows"
check("silver_quality_summary", f"""
    SELECT 'outlet_master' AS dataset, {_LOAD},
      count(*) FILTER (len(reasons) = 0 AND Outlet_Size IS NULL) AS missing_outlet_size_rows_kept_for_imputation,
      count(*) FILTER (len(reasons) = 0 AND Outlet_Size_Invalid_Flag = 1) AS invalid_outlet_size_rows_set_to_missing,
      CAST(NULL AS BIGINT) AS lat_lon_swapped_corrected_rows FROM master_checked
    UNION ALL SELECT 'outlet_coordinates', {_LOAD}, NULL, NULL,
      count(*) FILTER (len(reasons) = 0 AND coordinate_corrected_flag = 1) FROM coords_checked
    UNION ALL SELECT 'distributor_seasonality', {_LOAD}, NULL, NULL, NULL FROM season_checked
    UNION ALL SELECT 'holiday_list', {_LOAD}, NULL, NULL, NULL FROM hol_checked""")
check("transaction_quality_summary", """
    SELECT 'transactions' AS dataset, *, round_even(returns_silver_rows / raw_rows, 5) AS negative_return_share_of_raw,
      round_even(billing_anomaly_rows / raw_rows, 5) AS zero_volume_billing_anomaly_share_of_raw,
      round_even(price_outlier_rows / (positive_sales_silver_rows + price_outlier_rows), 5)
        AS sku_price_outlier_share_of_positive_sales
    FROM (SELECT (SELECT count(*) FROM tx_kind) AS raw_rows, (SELECT count(*) FROM sales) AS positive_sales_silver_rows,
      (SELECT count(*) FROM returned) AS returns_silver_rows, (SELECT count(*) FROM anomalies) AS billing_anomaly_rows,
      (SELECT count(*) FROM sales_flagged WHERE sku_price_outlier_flag = 1) AS price_outlier_rows,
      (SELECT count(*) FROM tx_rejected) AS rejected_rows)""",
      "negative_return_share_of_raw", "zero_volume_billing_anomaly_share_of_raw",
      "sku_price_outlier_share_of_positive_sales")
check("duplicate_key_report", """SELECT Outlet_ID, Year, Month, Distributor_ID, SKU_ID, count(*) AS row_count
    FROM sales GROUP BY ALL HAVING count(*) > 1""")
check("reject_share_by_key", """
    SELECT coalesce(a.Distributor_ID, b.Distributor_ID) AS Distributor_ID, coalesce(s, 0) AS silver_count,
      coalesce(r, 0) AS rejected_count, coalesce(r / nullif(s, 0) * 100, 0.0) AS percentage
    FROM (SELECT Distributor_ID, count(*) AS s FROM sales WHERE Distributor_ID IS NOT NULL GROUP BY ALL) a
    FULL JOIN (SELECT Distributor_ID, count(*) AS r FROM tx_rejected WHERE Distributor_ID IS NOT NULL GROUP BY ALL) b
      ON a.Distributor_ID = b.Distributor_ID""", "percentage")
_GOLD_COLUMNS = [
    "Outlet_ID", "Distributor_ID", "Outlet_Size", "Outlet_Size_Invalid_Flag", "Outlet_Size_Missing_Flag",
    "Outlet_Type", "Latitude_Original", "Longitude_Original", "coordinate_corrected_flag",
    "coordinate_correction_type", "province", "jan_2026_seasonality_index", "has_return_flag",
    "has_billing_anomaly_flag", "missing_coordinate_flag", *GOLD_DOUBLES, *FEATURE_INTEGERS, *COUNTS,
]
check("gold_missing_report", "SELECT u.column, u.missing_count, u.missing_count / n AS missing_ratio FROM (SELECT count(*) AS n, unnest(["
      + ", ".join(f"{{'column': '{c}', 'missing_count': count(*) - count({c})}}" for c in _GOLD_COLUMNS)
      + "]) AS u FROM ogold)", "missing_ratio")
check("gold_readiness", """
    SELECT count(*) AS outlet_gold_rows, count(DISTINCT Outlet_ID) AS unique_outlet_count,
      count(*) - count(DISTINCT Outlet_ID) AS duplicate_outlet_rows,
      count(*) - count(Outlet_Size) AS missing_outlet_size_rows,
      CAST(sum(missing_coordinate_flag) AS BIGINT) AS missing_coordinate_rows,
      count(*) FILTER (avg_monthly_density > 0) AS population_density_available_rows,
      count(*) FILTER (jan_2026_monthly_density > 0) AS jan_2026_density_available_rows,
      count(*) FILTER (avg_distributor_month_context_score > 0) AS context_score_available_rows,
      CAST(count(*) = count(DISTINCT Outlet_ID) AS INTEGER) AS gold_ready_one_row_per_outlet,
      (SELECT count(*) FROM mgold) AS monthly_sales_gold_rows FROM ogold""")
check("month_audit", "SELECT * FROM hol_dates WHERE Year = 2023 AND Month = 1")

check("clean_text", f"SELECT doc_id, md5({sq('text')}) AS text_md5, length({sq('text')}) AS n_clean FROM documents")
check("null_tokens", "SELECT * FROM master_clean")
check("standardize_category", f"SELECT _row_id, {size('Outlet_Size')} AS Outlet_Size FROM raw_outlet_master")
check("typo_map", f"SELECT _row_id, {kind_of_outlet('Outlet_Type')} AS Outlet_Type FROM raw_outlet_master")
check("standardize_label", f"SELECT _row_id, {season('Seasonality_Index')} AS Seasonality_Index FROM raw_seasonality")
check("standardize_holiday_type", f"SELECT _row_id, {holiday_type('Holiday_Type')} AS Holiday_Type FROM raw_holidays")
check("keyword_flags", f"""SELECT _row_id, {FLAGS} FROM (SELECT _row_id, {sq('Holiday_Name')} AS Holiday_Name,
    {holiday_type('Holiday_Type')} AS Holiday_Type FROM raw_holidays)""")
check("coerce_numeric", f"""SELECT _row_id, Outlet_ID, SKU_ID, {num(nt('Volume_Liters'))} AS Volume_Liters,
    CAST({nt('Volume_Liters')} IS NOT NULL AND {num(nt('Volume_Liters'))} IS NULL AS INTEGER) AS invalid_flag
    FROM raw_transactions""")
check("fill_numeric", "SELECT _row_id, coalesce(Cooler_Count, 0.0) AS Cooler_Count, Outlet_Size FROM master_checked")
check("safe_ratio", f"""SELECT _row_id, Outlet_ID, SKU_ID, {div('Total_Bill_Value', 'Volume_Liters', '0.0')}
    AS bill_per_liter FROM tx_kind""", "bill_per_liter")
check("clip_values", """SELECT c_custkey, least(greatest(c_acctbal, 0.0), 5000.0) AS clipped,
    round_even(least(greatest(c_acctbal, 0.0), 5000.0), 0) AS whole FROM customer""", "clipped", "whole")
check("unit_price", f"""SELECT _row_id, Outlet_ID, SKU_ID, {SIGNS} AS kind,
    {div('abs(Total_Bill_Value)', 'abs(Volume_Liters)')} AS Price_Per_Liter FROM tx_kind
    WHERE kind IN ('sale', 'return')""", "Price_Per_Liter")
check("minmax_score", """SELECT c_custkey, c_acctbal, round_even((c_acctbal - lo) / (hi - lo) * 100, 2) AS score_0_100
    FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""", "c_acctbal", "score_0_100")
check("label_score", f"""SELECT _row_id, {values(season('Seasonality_Index'), config.SEASONALITY_SCORE, '0')}
    AS seasonality_score, CAST({values(season('Seasonality_Index'), config.SEASONALITY_MULTIPLIER, '1.0')} AS DOUBLE)
    AS seasonality_multiplier FROM raw_seasonality""")
check("parse_dates", f"SELECT _row_id, {day(sq('Date'))} AS holiday_date FROM raw_holidays")
_ZONED = """concat(strftime(o_orderdate, '%Y-%m-%d'), 'T', lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0'), ':30:00',
    CASE o_orderkey % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '-05:00' ELSE '+05:30' END)"""
check("zoned_dates", f"""SELECT o_orderkey, CAST({utc(_ZONED)} AS DATE) AS utc_day,
    strftime({utc(_ZONED)}, '%Y-%m') AS month FROM orders""")
check("calendar_parts", f"SELECT o_orderkey, {parts('CAST(o_orderdate AS DATE)')} FROM orders")
check("month_spine", """
    SELECT strftime(d, '%Y-%m') AS month, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month_num,
      CAST(year(d) * 12 + month(d) AS INTEGER) AS month_index, coalesce(n, 0) AS order_count
    FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders),
      (SELECT max(o_orderdate) FROM orders), INTERVAL 1 MONTH)) AS d)
    LEFT JOIN (SELECT strftime(o_orderdate, '%Y-%m') AS om, count(*) AS n FROM orders GROUP BY ALL)
      ON strftime(d, '%Y-%m') = om""")

check("dq_rules", """SELECT _row_id, SKU_ID, Volume_Liters, Total_Bill_Value,
    array_to_string(reasons, ' | ') AS reasons FROM tx_checked""")
check("dq_split", """SELECT _row_id, Outlet_ID, CASE WHEN len(reasons) = 0 THEN 'silver' ELSE 'rejected' END AS side
    FROM master_checked""")
_OK = quoted(config.OUTLET_SIZES)
check("soft_invalid_category", f"""SELECT _row_id, CASE WHEN s IN ({_OK}) THEN s END AS Outlet_Size,
    CAST(coalesce(s NOT IN ({_OK}), false) AS INTEGER) AS Outlet_Size_Invalid_Flag,
    CAST(NOT coalesce(s IN ({_OK}), false) AS INTEGER) AS Outlet_Size_Missing_Flag
    FROM (SELECT _row_id, {size('Outlet_Size')} AS s FROM raw_outlet_master)""")
check("dedupe_business_key", "SELECT _row_id, Outlet_ID, CAST(rep AS INTEGER) AS is_repeat FROM coords_fixed")
check("dedupe_exact", f"""SELECT _row_id, Outlet_ID, SKU_ID, Volume_Liters, CAST({repeat(*TX)} AS INTEGER) AS is_repeat
    FROM raw_transactions""")
check("coord_swap_fix", "SELECT * FROM coords", "Latitude", "Longitude")
check("coordinate_corrections", "SELECT * FROM coords WHERE coordinate_corrected_flag = 1", "Latitude", "Longitude")
check("classify_transactions", "SELECT _row_id, Outlet_ID, SKU_ID, Volume_Liters, kind FROM tx_kind")
_BOUND = ["sku_price_median", "sku_price_q1", "sku_price_q3", "sku_price_iqr", "sku_price_lower_bound",
          "sku_price_upper_bound"]
check("price_bounds", "SELECT * FROM bounds", *_BOUND)
check("price_outliers", """SELECT _row_id, Outlet_ID, SKU_ID, Price_Per_Liter, 'sku_level_price_outlier' AS anomaly_type
    FROM sales_flagged WHERE sku_price_outlier_flag = 1""", "Price_Per_Liter")
check("silver_entity", "SELECT * FROM outlets")
check("silver_seasonality", "SELECT * FROM seasons")
check("silver_calendar_rowcount", "SELECT * FROM holrow_months", "holiday_intensity_score")
check("silver_transactions", "SELECT * FROM sales", "Price_Per_Liter", *_BOUND)
check("silver_rejected_transactions", f"""SELECT {', '.join(TX)}, array_to_string(reasons, ' | ')
    AS _dq_rejection_reason FROM tx_rejected""")
check("silver_billing_anomalies", "SELECT * FROM anomalies")
check("returns_features", "SELECT * FROM return_features")
check("anomaly_features", "SELECT * FROM anomaly_features")

check("calendar_collapse", "SELECT * FROM hol_dates")
check("calendar_month_features", "SELECT *, "
      + ", ".join(f"{n} AS {o}" for o, n in config.LEGACY_HOLIDAY_COLUMNS.items())
      + " FROM hol_months", "holiday_intensity_score")
check("pivot_counts", "SELECT Year, Month, " + ", ".join(
    f"count(Holiday_Name) FILTER (lower(Holiday_Type) = '{t.lower()}') AS {t.lower().replace(' ', '_')}_records"
    for t in config.HOLIDAY_TYPES) + " FROM hol_rows GROUP BY Year, Month")
check("calibrated_multiplier", "SELECT * FROM multipliers", "avg_liters_by_label", "moderate_avg_liters",
      "seasonality_multiplier_calibrated")
check("context_score", "SELECT * EXCLUDE (lo, hi) FROM context", *HOLIDAY_COLUMNS, "seasonality_multiplier_default",
      "seasonality_multiplier_calibrated", "distributor_month_demand_context_score",
      "distributor_month_context_score_0_100")
check("context_summary", """SELECT Distributor_ID, Seasonality_Index,
    avg(distributor_month_demand_context_score) AS avg_context_score,
    max(distributor_month_demand_context_score) AS max_context_score, count(Month) AS month_count
    FROM context_scored GROUP BY ALL""", "avg_context_score", "max_context_score")
check("series_by_year", """SELECT Distributor_ID, Year, CAST(count(*) AS INTEGER) AS month_count,
    string_agg(CAST(Month AS VARCHAR), ',' ORDER BY Month) AS months,
    string_agg(CAST(seasonality_score AS VARCHAR), ',' ORDER BY Month) AS scores FROM seasons GROUP BY ALL""")

check("monthly_sales", "SELECT * FROM monthly", "monthly_avg_price_per_liter")
check("primary_key_mode", "SELECT * FROM main_dist")
check("monthly_sales_gold", "SELECT * FROM mgold", *MGOLD_DOUBLES)
check("outlet_features", "SELECT * FROM ofeat", *FEATURE_DOUBLES)
_SLICE = re.findall(r"AS (\w+)", SLICE_SQL)
check("month_slice_features", f"SELECT Outlet_ID, {SLICE_SQL} FROM mgold GROUP BY Outlet_ID", *_SLICE)
_RECENT = [f"recent_{n}_month_{k}_liters" for n in (3, 6) for k in ("avg", "total")]
check("recent_n_rows", "SELECT * FROM last_rows", *_RECENT)
check("recent_n_months", f"""SELECT Outlet_ID, {RECENT_SQL} FROM (SELECT Outlet_ID, monthly_liters,
    CAST(Year * 12 + Month >= latest - 2 AS INTEGER) AS is_recent_3_months,
    CAST(Year * 12 + Month >= latest - 5 AS INTEGER) AS is_recent_6_months FROM monthly CROSS JOIN latest)
    GROUP BY Outlet_ID""", *_RECENT)
check("seasonal_spike", f"""SELECT Outlet_ID, median_monthly_liters, april_avg_liters, december_avg_liters, {SPIKE_SQL}
    FROM (SELECT Outlet_ID, median(monthly_liters) AS median_monthly_liters,
      avg(monthly_liters) FILTER (Month = 4) AS april_avg_liters,
      avg(monthly_liters) FILTER (Month = 12) AS december_avg_liters FROM monthly GROUP BY Outlet_ID)""",
      "median_monthly_liters", "april_avg_liters", "december_avg_liters", "april_spike_ratio",
      "december_spike_ratio", "seasonal_peak_liters", "peak_to_median_ratio")
check("outlet_context_avg", "SELECT * FROM calendar_avg", *HOLIDAY_COLUMNS)
check("imputation_features", "SELECT * FROM imp_features", "Cooler_Count", "Latitude", "Longitude", *IMP_DOUBLES,
      "return_ratio_liters", "return_ratio_value")

check("spatial_within", "SELECT * FROM within_points", "latitude", "longitude")
check("spatial_nearest", "SELECT * FROM nearest_points", "latitude", "longitude")
check("dim_map_fallback", "SELECT * FROM located", "latitude", "longitude")
check("radius_sum", "SELECT * FROM people_near", "latitude", "longitude")
check("nearest_lookup", """
    SELECT r.*, v.base_population, v.mobility_factor, v.tourism_factor, v.monthly_density
    FROM (SELECT d.*, (SELECT min(struct_pack(g := (d.latitude - p.latitude) ** 2 + (d.longitude - p.longitude) ** 2,
        n := p.location_name)) FROM points p).n AS location_name FROM raw_depots d) r
    LEFT JOIN density v ON r.location_name = v.location_name AND r.month = v.month""", "latitude", "longitude")
check("growth_extrapolate", "SELECT * FROM customer_years")
check("zero_audit", """SELECT year, count(*) AS location_count,
    count(*) FILTER (base_population <= 0) AS zero_population_count FROM customer_years GROUP BY year""")
check("expand_year_to_month", "SELECT * FROM customer_months")
check("hierarchical_fill", filled_from("customer_months"))
check("percentile_bands", "SELECT month, " + ", ".join(
    f"quantile_cont(CAST(monthly_density AS DOUBLE), {q}) AS {n}" for n, q in
    (("p5", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95)))
      + " FROM density GROUP BY month", "p5", "p25", "median", "p75", "p95")
check("topk_entities", """SELECT location_name, month, monthly_density FROM density WHERE location_name IN (
    SELECT location_name FROM density GROUP BY location_name
    ORDER BY median(monthly_density) DESC, location_name LIMIT 10)""")

CTE["target_base"] = "SELECT Outlet_ID, Distributor_ID FROM main_dist"
check("target_month_context", with_target("target_base"), *TARGET_DOUBLES)
check("outlet_gold", "SELECT * FROM ogold", *GOLD_DOUBLES)

_PROFILED = ["avg_monthly_liters", "median_monthly_liters", "p90_monthly_liters", "max_monthly_liters",
             "avg_january_liters", "max_january_liters", "Cooler_Count", "avg_sku_count", "total_unique_skus",
             "return_ratio_liters", "billing_anomaly_count", "avg_holiday_intensity_score",
             "avg_seasonality_adjusted_holiday_score", "avg_distributor_month_context_score",
             "avg_monthly_density", "avg_january_density"]
check("cluster_profiles", "SELECT Outlet_Type, count(Outlet_ID) AS outlet_count, "
      + ", ".join(f"avg({c}) AS {c}_mean" for c in _PROFILED) + " FROM ogold GROUP BY Outlet_Type",
      *[f"{c}_mean" for c in _PROFILED])
check("cluster_benchmarks", "SELECT * FROM peers", *PEER_DOUBLES)
_ADJUSTED = ["jan_2026_multiplier_used", "jan_2026_adjusted_holiday_score_used", "jan_2026_density_used",
             "seasonality_relative_adjustment", "holiday_relative_adjustment", "density_relative_adjustment",
             "recent_trend_adjustment", "capacity_relative_adjustment"]
check("adjustments", f"SELECT Outlet_ID, {', '.join(_ADJUSTED)} FROM adjusted", *_ADJUSTED)
_POTENTIAL = ["Maximum_Monthly_Liters", "current_january_baseline_liters", "potential_gap_liters",
              "potential_gap_ratio", "cluster_january_ceiling", "cluster_january_cap", "own_january_peak_liters",
              *_ADJUSTED, "raw_jan_2026_potential"]
check("potential", "SELECT * FROM gapped", *_POTENTIAL)
check("potential_gap", """SELECT Outlet_ID, Maximum_Monthly_Liters, current_january_baseline_liters AS avg_january_liters,
    current_january_baseline_liters, potential_gap_liters, potential_gap_ratio FROM gapped""",
      "Maximum_Monthly_Liters", "avg_january_liters", "current_january_baseline_liters", "potential_gap_liters",
      "potential_gap_ratio")
check("submission", "SELECT Outlet_ID, Maximum_Monthly_Liters FROM gapped", "Maximum_Monthly_Liters")
check("validate_output", """SELECT count(*) AS submission_rows, count(*) - count(DISTINCT Outlet_ID) AS duplicate_outlet_ids,
    count(*) FILTER (Maximum_Monthly_Liters IS NULL) AS missing_predictions,
    'Outlet_ID, Maximum_Monthly_Liters' AS submission_columns,
    CAST(count(*) = count(DISTINCT Outlet_ID) AND count(*) = count(Maximum_Monthly_Liters)
      AND count(*) = (SELECT count(*) FROM outlets) AS INTEGER) AS official_format_valid FROM gapped""")
check("potential_summary", """SELECT count(*) AS total_outlets, count(DISTINCT Outlet_ID) AS unique_outlets,
    count(*) - count(DISTINCT Outlet_ID) AS duplicate_outlet_rows, count(DISTINCT Outlet_Type) AS cluster_count,
    min(Maximum_Monthly_Liters) AS min_prediction, avg(Maximum_Monthly_Liters) AS mean_prediction,
    max(Maximum_Monthly_Liters) AS max_prediction,
    count(*) FILTER (Maximum_Monthly_Liters IS NULL) AS missing_predictions,
    avg(potential_gap_liters) AS mean_potential_gap,
    count(*) FILTER (potential_gap_liters > 0) AS outlets_with_positive_gap,
    median(Maximum_Monthly_Liters) AS median_prediction FROM gapped""",
      "min_prediction", "mean_prediction", "max_prediction", "mean_potential_gap", "median_prediction")
check("cluster_prediction_summary", """SELECT Outlet_Type, count(Outlet_ID) AS outlet_count,
    avg(Maximum_Monthly_Liters) AS avg_prediction, max(Maximum_Monthly_Liters) AS max_prediction,
    avg(potential_gap_liters) AS avg_gap, median(Maximum_Monthly_Liters) AS median_prediction
    FROM gapped GROUP BY Outlet_Type""", "avg_prediction", "max_prediction", "avg_gap", "median_prediction")

check("class_balance", "SELECT quality, count(*) AS class_count FROM labels WHERE quality IS NOT NULL GROUP BY quality")
check("class_weights", """SELECT quality, n AS class_count,
    sum(n) OVER () / (count(*) OVER () * CAST(n AS DOUBLE)) AS class_weight
    FROM (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality)""", "class_weight")
check("stratified_folds", """SELECT quality, fold, count(*) AS fold_rows
    FROM (SELECT quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 + 1 AS INTEGER) AS fold
      FROM labels) GROUP BY ALL""")
check("confusion_matrix", """SELECT quality AS actual, count(*) FILTER (toxic = 0) AS pred_0,
    count(*) FILTER (toxic = 1) AS pred_1 FROM labels GROUP BY quality""")
