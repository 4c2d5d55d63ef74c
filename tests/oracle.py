"""Compare a Spark result with DuckDB SQL as multisets."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return round(v, 9) if isinstance(v, float) else v


def duck(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in got.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def assert_same(df, sf_dir: str, sql: str) -> None:
    names, rows = spark_rows(df)
    want_names, want = duck(sf_dir, sql)
    assert names == want_names
    assert rows == want
