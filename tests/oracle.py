"""Compare a query with its SQL."""

from __future__ import annotations

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v) -> str:
    if isinstance(v, (list, tuple)):
        return str([shown(x) for x in v])
    return repr(v) if isinstance(v, float) else str(v)


def differences(spark, sf_dir: str, f, sql: str) -> list:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = f(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert len(got) == len(want)
    return [x for x in zip(got, want, strict=True) if x[0] != x[1]]
