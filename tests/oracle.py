"""Runs a query beside its DuckDB text and compares the rows as bags."""

from collections import Counter
from pathlib import Path


def norm(v):
    return round(float(v), 8) if isinstance(v, float) else v


def compare(spark, query, sql: str, folder: str) -> None:
    import duckdb

    con = duckdb.connect()
    for p in Path(folder).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = query(spark, folder)
    names = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in names) for r in df.collect())
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == names
    want = Counter(tuple(norm(r[cols.index(c)]) for c in names) for r in rel.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    assert got
