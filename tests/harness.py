"""Runs a query and its SQL twin and compares rows, types and values."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "tinyint": "TINYINT", "double": "DOUBLE",
    "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def _sorted(rows):
    return sorted((tuple(_cell(v) for v in r) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    names = sorted(df.columns)
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if names != sorted(described):
        return f"columns {names} != {sorted(described)}"
    for f in df.schema.fields:
        ours = TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
        if ours != described[f.name]:
            return f"type of {f.name}: {ours} != {described[f.name]}"
    got = _sorted(df.select(*names).collect())
    listed = ", ".join(f'"{n}"' for n in names)
    want = _sorted(con.execute(f"SELECT {listed} FROM ({sql})").fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"row {a} != {b} (columns {names})"
    return None
