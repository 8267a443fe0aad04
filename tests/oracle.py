"""Running a query's SQL in DuckDB and comparing rows by value."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str) -> list[dict]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return [dict(zip(names, row)) for row in cursor.fetchall()]


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value.is_integer() else float(f"{value:.9g}"))
    return str(value) if value is not None and not isinstance(value, (int, bool, str)) else value


def canonical(rows: list[dict]) -> list[tuple]:
    return sorted((tuple((k, _plain(r[k])) for k in sorted(r)) for r in rows), key=repr)


def assert_same(df, sql: str, sf_dir: str) -> None:
    assert canonical([r.asDict() for r in df.collect()]) == canonical(sql_rows(sql, sf_dir))
