"""Row-exact comparison of a Spark result with its DuckDB twin."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(value) + 0.0
    return str(value) if value is not None else None


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN",
}


def compare(df, con, sql: str) -> tuple[int, list[str]]:
    """(row count, differences); no difference means equal columns, types and rows."""
    out = con.sql(sql)
    problems = []
    spark_types = {c: TYPE_NAMES.get(t, t) for c, t in df.dtypes}
    duck_types = {c: str(t) for c, t in zip(out.columns, out.types, strict=True)}
    if spark_types != duck_types:
        odd = set(spark_types.items()) ^ set(duck_types.items())
        problems.append(f"columns or types differ: {sorted(odd)}")
        if set(spark_types) != set(duck_types):
            return 0, problems
    mine = _rows(df.columns, df.collect())
    other = _rows(out.columns, out.fetchall())
    if mine != other:
        extra, missing = mine - other, other - mine
        problems.append(
            f"rows: {sum(mine.values())} vs {sum(other.values())}; only Spark "
            f"{sum(extra.values())} {list(extra)[:3]}; only DuckDB "
            f"{sum(missing.values())} {list(missing)[:3]}"
        )
    return sum(mine.values()), problems
