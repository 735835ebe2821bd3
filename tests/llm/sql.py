from __future__ import annotations

from pathlib import Path

import duckdb


def same_as_sql(df, sql, sf_dir):
    """Compare rows and column names, columns in the order of their names."""
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    oracle = con.sql(sql)
    names = sorted(oracle.columns)
    assert names == sorted(df.columns)
    want = sorted(oracle.select(", ".join(f'"{n}"' for n in names)).fetchall(), key=repr)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    assert got == want
    return got
