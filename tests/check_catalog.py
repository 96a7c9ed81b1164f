"""Compare every catalogue query with its check SQL: ``python tests/check_catalog.py [sf] [names...]``."""

from __future__ import annotations

import glob
import os
import sys
import threading
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402
from lexloom.session import local_session  # noqa: E402


SQL_SECONDS = 60  # check SQL that runs longer counts as failed


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """What differs between the query and its SQL, or None."""
    got = entry.queries()[name](spark, sf_dir)
    rows = got.toArrow()
    if name not in entry.oracle_sql():
        return None if rows.num_rows else "no rows"
    alarm = threading.Timer(SQL_SECONDS, con.interrupt)
    alarm.start()
    try:
        want = con.execute(entry.oracle_sql()[name]).to_arrow_table()
    finally:
        alarm.cancel()
    names = sorted(want.column_names)
    if sorted(rows.column_names) != names:
        return f"columns {sorted(rows.column_names)} instead of {names}"
    if rows.num_rows != want.num_rows:
        return f"{rows.num_rows} rows instead of {want.num_rows}"
    types = [(n, str(rows.schema.field(n).type), str(want.schema.field(n).type)) for n in names]
    odd = [t for t in types if t[1] != t[2]]
    con.register("got", rows)
    con.register("want", want)
    columns = ", ".join(f'"{n}"' for n in names)
    extra = con.execute(
        f"SELECT * FROM (SELECT {columns} FROM got EXCEPT ALL SELECT {columns} FROM want) LIMIT 3"
    ).fetchall()
    missing = con.execute(
        f"SELECT * FROM (SELECT {columns} FROM want EXCEPT ALL SELECT {columns} FROM got) LIMIT 3"
    ).fetchall()
    con.unregister("got")
    con.unregister("want")
    if extra or missing:
        return f"values differ in {names}: {extra} / {missing}"
    return f"(types {odd})" if odd else None


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            found = difference(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            found = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'ok ' if found is None else 'BAD'} {name} [{kind}] {time.time() - start:.1f}s {found or ''}", flush=True)


if __name__ == "__main__":
    main()
