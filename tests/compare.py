"""Run a named query in Spark and its SQL twin in DuckDB, and compare the rows."""

from __future__ import annotations

import glob
import os

import duckdb


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _rows(arrow_table) -> list[tuple]:
    names = sorted(arrow_table.column_names)
    columns = [arrow_table.column(n).to_pylist() for n in names]
    return sorted(zip(*columns), key=repr)


def _kinds(arrow_table) -> dict[str, str]:
    alias = {"large_string": "string", "string_view": "string"}
    return {f.name: alias.get(str(f.type), str(f.type)) for f in arrow_table.schema}


def differences(spark, con, sf_dir: str, run, sql: str) -> list[str]:
    """Empty when both sides agree on column names, types and all rows."""
    ours = run(spark, sf_dir).toArrow()
    theirs = con.execute(sql).to_arrow_table()
    found = []
    if _kinds(ours) != _kinds(theirs):
        found.append(f"types {_kinds(ours)} against {_kinds(theirs)}")
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return found
    a, b = _rows(ours), _rows(theirs)
    if len(a) != len(b):
        found.append(f"{len(a)} rows against {len(b)}")
    unequal = [(x, y) for x, y in zip(a, b) if x != y]
    if unequal:
        found.append(f"{len(unequal)} rows differ, first: {unequal[0]}"[:1500])
    return found
