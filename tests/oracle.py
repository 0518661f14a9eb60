"""Compare a Spark result with its SQL oracle, order-insensitive."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return names, [dict(zip(names, r)) for r in got.fetchall()]


def norm(rows, names):
    return sorted(tuple(str(r[n]) for n in sorted(names)) for r in rows)


def assert_same(df, sql, sf_dir):
    names, want = oracle_rows(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    got = [r.asDict() for r in df.collect()]
    assert norm(got, names) == norm(want, names)
