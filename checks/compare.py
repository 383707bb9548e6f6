"""Run registered queries beside their comparison SQL.

``python -m checks.compare DIR [name ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(table: pa.Table) -> tuple[list[str], list[str], list[tuple]]:
    names = sorted(table.column_names)
    kinds = []
    for n in names:
        k = str(table.schema.field(n).type)
        kinds.append({"large_string": "string", "timestamp[us, tz=UTC]": "timestamp[us]", "int32": "int32"}.get(k, k))
    columns = [table.column(n).to_pylist() for n in names]
    return names, kinds, sorted(zip(*columns), key=repr) if columns else []


def difference(spark_table: pa.Table, duck_table: pa.Table) -> str | None:
    """Null when both hold the same columns, types and rows."""
    a, b = _rows(spark_table), _rows(duck_table)
    if a[0] != b[0]:
        return f"columns {a[0]} / {b[0]}"
    kinds = [(n, x, y) for n, x, y in zip(a[0], a[1], b[1]) if x != y and "null" not in (x, y)]
    if kinds:
        return f"types {kinds}"
    if len(a[2]) != len(b[2]):
        return f"rows {len(a[2])} / {len(b[2])}"
    wrong = [(x, y) for x, y in zip(a[2], b[2]) if repr(x) != repr(y)]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main() -> int:
    from pyspark.sql import SparkSession

    from checks.queries import ORACLES, QUERIES

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            table = QUERIES[name](spark, sf_dir).toArrow()
            took = time.time() - start
            result = "rows only" if name not in ORACLES else difference(table, con.execute(ORACLES[name]).to_arrow_table())
        except Exception as error:  # report and go on with the next query
            table, took, result = None, time.time() - start, f"{type(error).__name__}: {str(error)[:600]}"
        ok = result in (None, "rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} rows={table.num_rows if table else '-'} {took:.2f}s {result or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
