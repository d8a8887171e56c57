"""A query's rows against those of its SQL in DuckDB, over the same Parquet files."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def tables(folder=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return str(v) if hasattr(v, "isoformat") else v


def same_rows(df, con, sql):
    """Names of the columns and all rows, whatever the order of either."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted((tuple(_plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    assert [x for x in zip(got, want, strict=True) if x[0] != x[1]][:3] == []
