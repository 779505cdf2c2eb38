"""Run a query in Spark and its SQL in DuckDB and list the differences."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

_KIND = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(root).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def _bag(rows) -> Counter:
    return Counter(tuple(_plain(v) for v in row) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    relation = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(relation.columns):
        return [f"columns {names} != {sorted(relation.columns)}"]
    found = []
    types = dict(zip(relation.columns, [str(x) for x in relation.types]))
    for name, kind in df.dtypes:
        if _KIND.get(kind, kind) != types[name]:
            found.append(f"type of {name}: {kind} / {types[name]}")
    order = ", ".join(f'"{n}"' for n in names)
    ours = _bag([[row[n] for n in names] for row in df.collect()])
    theirs = _bag(con.sql(f"select {order} from ({sql}) t").fetchall())
    if sum(ours.values()) != sum(theirs.values()):
        found.append(f"rows {sum(ours.values())} != {sum(theirs.values())}")
    if ours != theirs:
        found.append(f"only ours {list((ours - theirs).items())[:3]}; only theirs {list((theirs - ours).items())[:3]}")
    return found
