"""Rows of a query and of its DuckDB SQL over the same Parquet files, in a common form."""

from pathlib import Path

DATA = "/root/testdata/sf0.001"


def views(data=DATA):
    import duckdb

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def norm(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(repr(tuple(r[k] for k in order)) for r in rows)


def same(spark, con, f, sql, data=DATA):
    df = f(spark, data)
    got = norm(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = norm([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    assert got[1] == want[1], next((a, b) for a, b in zip(got[1], want[1]) if a != b)
