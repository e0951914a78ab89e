"""Run queries and their SQL side by side: same columns, types, rows and values in any order."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SAME_TYPE = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value):
    return value + 0.0 if isinstance(value, float) else value


def sorted_rows(rows, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, name: str, sf_dir: str) -> list[str]:
    df = queries()[name](spark, sf_dir)
    got = df.collect()
    result = con.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    kinds = dict(zip(columns, map(str, [d[1] for d in result.description])))
    want = result.fetchall()
    if sorted(df.columns) != sorted(columns):
        return [f"columns {sorted(set(df.columns) ^ set(columns))}"]
    out = [
        f"type {c}: {t} / {kinds[c]}" for c, t in df.dtypes
        if SAME_TYPE.get(t, t) != kinds[c] and not kinds[c].startswith("DuckDBPyType")
    ]
    if len(got) != len(want):
        return out + [f"rows {len(got)} / {len(want)}"]
    names = sorted(columns)
    a = sorted_rows(got, [df.columns.index(c) for c in names])
    b = sorted_rows(want, [columns.index(c) for c in names])
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        bad = sorted({names[i] for x, y in wrong for i in range(len(names)) if x[i] != y[i]})
        x, y = wrong[0]
        first = [(n, x[i], y[i]) for i, n in enumerate(names) if x[i] != y[i]][:4]
        out.append(f"{len(wrong)}/{len(a)} rows differ in {bad[:8]}: {first}")
    return out


if __name__ == "__main__":
    from outletry.session import build_session

    folder = sys.argv[1]
    chosen = sys.argv[2:] or list(queries())
    session = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    session.sparkContext.setLogLevel("ERROR")
    database = connect(folder)
    for key in chosen:
        start = time.time()
        try:
            if key in oracle_sql():
                problems = differences(session, database, key, folder)
            else:
                problems = [] if queries()[key](session, folder).collect() else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"ERROR {str(error)[:500]}"]
        print("ok " if not problems else "BAD", key, round(time.time() - start, 2), problems or "", flush=True)
