"""Runs a query beside its DuckDB oracle and compares all rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v) if hasattr(v, "isoformat") else v


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Asserts that names and rows agree; returns the number of rows."""
    names = sorted(df.columns)
    cur = con.execute(sql)
    theirs_names = [d[0] for d in cur.description]
    assert sorted(theirs_names) == names, (sorted(theirs_names), names)
    theirs = sorted(repr([plain(r[theirs_names.index(n)]) for n in names]) for r in cur.fetchall())
    ours = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not different, (len(different), different[:3])
    return len(ours)
