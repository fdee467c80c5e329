"""Run registered queries against DuckDB on the same Parquet and report differences."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{root}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


# Spark type -> DuckDB type
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _cell(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else round(value, 9)
    return value


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None if columns, types and rows agree."""
    described = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    expected = con.execute(sql).fetchall()
    types = {f.name: TYPES.get(f.dataType.simpleString(), "?") for f in spark_df.schema.fields}
    if set(types) != set(described):
        return f"columns {sorted(types)} != {sorted(described)}"
    for name, kind in types.items():
        if described[name] != kind:
            return f"type of {name}: {kind} != {described[name]}"
    got = _rows([tuple(r) for r in spark_df.collect()], spark_df.columns)
    want = _rows(expected, list(described))
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return None
