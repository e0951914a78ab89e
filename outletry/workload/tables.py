"""Raw outlet tables derived from the driver tables.

Every raw table is one SQL text over whole driver tables, with marked defects (typos, bad numbers,
repeats, swapped coordinates) spread by key. The same text serves Spark and the SQL check; ``@name``
stands for a driver table, ``<list>`` for the array constructor and ``<each>`` for row expansion.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels",
)

# Years of the driver data are folded onto the three years of the workload.
_YEAR = "CAST(2023 + (year({0}) - 1995) % 3 AS INT)"

RAW_SQL: dict[str, str] = {
    "transactions": f"""
        SELECT
          CASE WHEN (l_orderkey + 5 * l_partkey) % 613 = 4 THEN ' ? '
               ELSE concat(' O', CAST(o_custkey AS STRING)) END AS Outlet_ID,
          CASE WHEN (l_orderkey + l_partkey) % 509 = 2 THEN '2022'
               ELSE CAST({_YEAR.format('l_shipdate')} AS STRING) END AS Year,
          CASE WHEN (l_orderkey + l_partkey) % 503 = 1 THEN '13'
               ELSE CAST(month(l_shipdate) AS STRING) END AS Month,
          concat('D', CAST(l_suppkey AS STRING)) AS Distributor_ID,
          CASE WHEN (l_orderkey + l_partkey) % 521 = 3 THEN 'n/a'
               ELSE concat('S', CAST(l_partkey AS STRING)) END AS SKU_ID,
          CASE WHEN (3 * l_orderkey + l_partkey) % 499 = 0 THEN 'abc'
               ELSE CAST(CASE
                 WHEN sign_case IN (0, 2, 4) THEN 0
                 WHEN sign_case = 3 THEN -(quantity + extra)
                 WHEN l_returnflag = 'R' THEN -(quantity + extra)
                 ELSE quantity + extra END AS STRING) END AS Volume_Liters,
          CAST(CASE
                 WHEN sign_case IN (1, 2) THEN 0
                 WHEN sign_case IN (4, 5) THEN -bill
                 WHEN sign_case IN (0, 3) THEN bill
                 WHEN l_returnflag = 'R' THEN -bill
                 WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN bill * 50
                 ELSE bill END AS STRING) AS Total_Bill_Value,
          (l_orderkey * 8 + l_linenumber) * 4 + copy_no AS _row_id
        FROM (
          SELECT *,
            CASE WHEN copy_no = 2 THEN 1 ELSE 0 END AS extra,
            CAST(l_quantity AS BIGINT) AS quantity,
            CAST(floor(l_extendedprice) AS BIGINT) AS bill,
            (l_orderkey * 7 + l_linenumber) % 101 AS sign_case
          FROM (
            SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
              l_quantity, l_extendedprice, l_returnflag,
              <each>(CASE
                WHEN (l_orderkey + l_partkey) % 211 = 0 THEN <list>(0, 1)
                WHEN (l_orderkey + l_partkey) % 223 = 0 THEN <list>(0, 2)
                ELSE <list>(0) END) AS copy_no
            FROM @lineitem JOIN @orders ON l_orderkey = o_orderkey
          ) copies
        ) cases
    """,
    "outlet_master": """
        SELECT
          CASE WHEN c_custkey % 101 = 7 THEN 'N/A'
               ELSE concat('O', CAST(c_custkey AS STRING), ' ') END AS Outlet_ID,
          CASE c_custkey % 11
            WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN 'weird' WHEN 3 THEN 'small'
            WHEN 4 THEN 'Small' WHEN 5 THEN ' MEDIUM ' WHEN 6 THEN 'Medium' WHEN 7 THEN 'large'
            WHEN 8 THEN 'Large' WHEN 9 THEN 'extra  large' ELSE 'Extra Large' END AS Outlet_Size,
          CASE WHEN c_custkey % 3 = 0 THEN upper(kind) ELSE kind END AS Outlet_Type,
          CASE WHEN c_custkey % 41 = 5 THEN 'abc' WHEN c_custkey % 43 = 6 THEN NULL
               ELSE CAST(c_custkey % 7 - CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS STRING)
               END AS Cooler_Count,
          c_custkey * 4 + copy_no AS _row_id
        FROM (
          SELECT c_custkey,
            CASE c_mktsegment WHEN 'BUILDING' THEN 'grocry' WHEN 'AUTOMOBILE' THEN 'Bakry'
              WHEN 'HOUSEHOLD' THEN 'pharmcy' WHEN 'MACHINERY' THEN 'Eatery'
              ELSE ' hotel  bar' END AS kind,
            <each>(CASE WHEN c_custkey % 31 = 3 THEN <list>(0, 1) ELSE <list>(0) END) AS copy_no
          FROM @customer
        ) copies
    """,
    "outlet_coordinates": """
        SELECT
          concat('O', CAST(c_custkey AS STRING)) AS Outlet_ID,
          CASE WHEN c_custkey % 59 = 1 THEN 'unknown'
               WHEN c_custkey % 17 = 0 THEN CAST(lon AS STRING)
               WHEN c_custkey % 53 = 0 THEN '60.5'
               ELSE CAST(lat AS STRING) END AS Latitude,
          CASE WHEN c_custkey % 61 = 2 THEN NULL
               WHEN c_custkey % 17 = 0 THEN CAST(lat AS STRING)
               ELSE CAST(lon AS STRING) END AS Longitude,
          c_custkey * 4 + copy_no AS _row_id
        FROM (
          SELECT c_custkey,
            CAST(51000 + (c_custkey % 500) * 100 + c_custkey % 83 AS DOUBLE) / 10000 AS lat,
            CAST(791000 + (c_custkey * 7 % 330) * 100 + c_custkey % 71 AS DOUBLE) / 10000 AS lon,
            <each>(CASE WHEN c_custkey % 37 = 2 THEN <list>(0, 1) ELSE <list>(0) END) AS copy_no
          FROM @customer
        ) copies
    """,
    "seasonality": f"""
        SELECT
          concat('D', CAST(supplier_key AS STRING)) AS Distributor_ID,
          CASE WHEN (supplier_key + m) % 89 = 1 THEN 'year' ELSE CAST(y AS STRING) END AS Year,
          CASE WHEN (supplier_key + m) % 97 = 2 THEN '14' ELSE CAST(m AS STRING) END AS Month,
          CASE (supplier_key + m + copy_no) % 3
            WHEN 0 THEN CASE (supplier_key + y) % 3 WHEN 0 THEN 'favourable' WHEN 1 THEN ' FAVORABLE'
              ELSE 'Favorable' END
            WHEN 1 THEN CASE WHEN (supplier_key + y) % 5 = 0 THEN 'average' ELSE 'moderate ' END
            ELSE CASE (supplier_key + y) % 4 WHEN 0 THEN 'un_favorable' WHEN 1 THEN 'Un favourable'
              WHEN 2 THEN 'unfavorable' ELSE NULL END
            END AS Seasonality_Index,
          ((supplier_key * 10000 + y) * 100 + m) * 4 + copy_no AS _row_id
        FROM (
          SELECT supplier_key, y, m,
            <each>(CASE WHEN (supplier_key + m) % 19 = 0 THEN <list>(0, 1) ELSE <list>(0) END) AS copy_no
          FROM (
            SELECT DISTINCT l_suppkey AS supplier_key, {_YEAR.format('l_shipdate')} AS y,
              CAST(month(l_shipdate) AS INT) AS m
            FROM @lineitem
            UNION ALL
            SELECT s_suppkey, 2026, 1 FROM @supplier
          ) months
        ) copies
    """,
    "holidays": f"""
        SELECT
          CASE WHEN o_orderkey % 113 = 5 THEN 'not a date'
               WHEN o_orderkey % 7 = 3 THEN iso
               WHEN o_orderkey % 7 = 4 THEN concat(iso, 'T18:30:00.000Z')
               WHEN o_orderkey % 7 = 5 THEN concat(iso, ' 00:00:00')
               WHEN o_orderkey % 11 = 6 THEN concat(iso, 'T22:30:00-05:00')
               WHEN o_orderkey % 11 = 7 THEN replace(iso, '-', '/')
               WHEN o_orderkey % 11 = 8 THEN concat(CAST(d AS STRING), '-',
                 substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * m - 2, 3), '-', CAST(y AS STRING))
               ELSE concat(CAST(m AS STRING), '/', CAST(d AS STRING), '/', CAST(y AS STRING))
               END AS Date,
          CASE o_custkey % 12
            WHEN 0 THEN 'New Year Day' WHEN 1 THEN ' vesak full  moon poya' WHEN 2 THEN 'Christmas Day'
            WHEN 3 THEN 'Thai Pongal' WHEN 4 THEN 'Deepavali' WHEN 5 THEN 'Duruthu Poya'
            WHEN 6 THEN 'Independence Day' WHEN 7 THEN 'labour day' WHEN 8 THEN 'National Day Parade'
            WHEN 9 THEN 'Medin  POYA ' WHEN 10 THEN 'Good Friday' ELSE NULL END AS Holiday_Name,
          CASE o_orderkey % 29
            WHEN 0 THEN 'public holiday' WHEN 1 THEN 'Bank' WHEN 2 THEN ' MERCANTILE  HOLIDAY'
            WHEN 3 THEN 'poya' WHEN 4 THEN 'Poya Day' WHEN 5 THEN NULL
            ELSE 'Working Day' END AS Holiday_Type,
          o_orderkey * 4 + copy_no AS _row_id
        FROM (
          SELECT *, concat(CAST(y AS STRING), '-', lpad(CAST(m AS STRING), 2, '0'), '-',
            lpad(CAST(d AS STRING), 2, '0')) AS iso
        FROM (
          SELECT o_orderkey, o_custkey,
            {_YEAR.format('o_orderdate')} AS y,
            CAST(month(o_orderdate) AS INT) AS m,
            CAST(least(day(o_orderdate), 28) AS INT) AS d,
            <each>(CASE WHEN o_orderkey % 29 = 0 AND o_orderkey % 3 = 0 THEN <list>(0, 1)
              ELSE <list>(0) END) AS copy_no
          FROM @orders
        ) copies
        ) days
    """,
    # A raster of 0.01 degree cells: every line adds people to one cell.
    "population_grid": """
        SELECT
          CAST(500 + (l_orderkey * 31 + l_partkey * 17) % 551 AS INT) AS row_no,
          CAST(7900 + (l_suppkey * 37 + l_orderkey * 13 + l_linenumber) % 351 AS INT) AS col_no,
          CAST(l_quantity AS DOUBLE) * 7 AS people
        FROM @lineitem
    """,
    # One box per nation on a 5 x 5 lattice; the gaps between boxes force the nearest fallback.
    "districts": """
        SELECT n_name AS district,
          CAST(500005 + 110000 * floor(n_nationkey / 5) AS DOUBLE) / 100000 AS lat_low,
          CAST(595005 + 110000 * floor(n_nationkey / 5) AS DOUBLE) / 100000 AS lat_high,
          CAST(7900005 + 70000 * (n_nationkey % 5) AS DOUBLE) / 100000 AS lon_low,
          CAST(7960005 + 70000 * (n_nationkey % 5) AS DOUBLE) / 100000 AS lon_high
        FROM @nation
    """,
    # Some districts have no province in the map, so their own name is kept.
    "district_map": """
        SELECT n_name AS district,
          CASE WHEN n_name IN ('NATION_7', 'NATION_18') THEN NULL ELSE r_name END AS province
        FROM @nation JOIN @region ON n_regionkey = r_regionkey
    """,
    # Depots asking for the density around them in one month.
    "depots": """
        SELECT concat('D', CAST(s_suppkey AS STRING)) AS depot_id,
          CAST(50000 + (s_suppkey * 331) % 55000 AS DOUBLE) / 10000 AS latitude,
          CAST(790000 + (s_suppkey * 577) % 35000 AS DOUBLE) / 10000 AS longitude,
          concat(CAST(2023 + s_suppkey % 3 AS STRING), '-',
            lpad(CAST(1 + s_suppkey % 12 AS STRING), 2, '0')) AS month
        FROM @supplier
    """,
}


def spark_text(sql: str) -> str:
    return re.sub(r"@(\w+)", r"{\1}", sql).replace("<each>", "explode").replace("<list>", "array")


def duckdb_text(sql: str) -> str:
    return re.sub(r"@(\w+)", r"\1", sql).replace("<each>", "unnest").replace("<list>", "list_value")


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the raw tables of ``RAW_SQL`` as a lazy Spark plan."""
    text = RAW_SQL[name]
    needed = {t: driver_table(spark, sf_dir, t) for t in re.findall(r"@(\w+)", text)}
    return spark.sql(spark_text(text), **needed)
