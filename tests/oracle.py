"""Run a query's DuckDB SQL over the same tables and compare whole results."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    return None if v is None or v != v else float(v) if type(v).__name__ == "Decimal" else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql, sf_dir):
    got = rows_of(df.columns, df.collect())
    out = connect(sf_dir).execute(sql)
    expected = rows_of([c[0] for c in out.description], out.fetchall())
    assert got[0] == expected[0], (got[0], expected[0])
    assert len(got[1]) == len(expected[1]), (len(got[1]), len(expected[1]))
    wrong = [(a, b) for a, b in zip(got[1], expected[1], strict=True) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
    kinds = {(i, type(v).__name__) for r in got[1] for i, v in enumerate(r) if v is not None}
    assert kinds == {(i, type(v).__name__) for r in expected[1] for i, v in enumerate(r) if v is not None}
    return len(got[1])
