"""Comparing a Spark result with the same result computed by SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = [str(d[1]) for d in cursor.description]
    rows = cursor.fetchall()
    con.close()
    return names, types, rows


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def normalized(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(df, sf_dir: str, sql: str) -> str | None:
    """None if names, types and all values agree."""
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}
    names, types, expected = sql_rows(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    by_name = dict(zip(names, types))
    for column, kind in df.dtypes:
        if kinds.get(kind, kind) != by_name[column]:
            return f"type of {column}: {kind} != {by_name[column]}"
    actual = normalized(df.columns, df.collect())
    wanted = normalized(names, expected)
    if len(actual) != len(wanted):
        return f"{len(actual)} rows != {len(wanted)}"
    for left, right in zip(actual, wanted):
        if left != right:
            return f"first difference: spark {left} != sql {right}"
    return None
