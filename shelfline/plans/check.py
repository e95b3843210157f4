"""Side-by-side comparison of a registered query and its SQL check."""

from __future__ import annotations

import math
import os
import time

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
DUCK_TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan" if math.isnan(value) else repr(value + 0.0))
    return (1, str(value))


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows), sorted(columns)


def compare_all(queries, spark, folder: str, at_once: int = 8) -> dict[str, dict]:
    """``compare`` for many queries; most of their time is planning, so several run at once."""
    from concurrent.futures import ThreadPoolExecutor

    con = connect(folder)
    with ThreadPoolExecutor(at_once) as pool:
        results = pool.map(lambda q: compare(q, spark, con, folder), queries)
        return {r["name"]: r for r in results}


def compare(query, spark, con, folder: str) -> dict:
    """Rows, types and values of both sides; ``problem`` is None when equal."""
    started = time.time()
    df = query.run(spark, folder)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    result = {"name": query.name, "rows": len(rows), "seconds": round(seconds, 2), "problem": None}
    if query.sql is None:
        return result
    cursor = con.cursor()
    cursor.execute(query.sql)
    names = [d[0] for d in cursor.description]
    duck_types = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    left, left_names = _sorted(rows, df.columns)
    right, right_names = _sorted(expected, names)
    if left_names != right_names:
        result["problem"] = f"columns {left_names} != {right_names}"
    elif [f"{n}:{types[n]}/{duck_types[n]}" for n in left_names if DUCK_TYPES.get(types[n]) != duck_types[n]]:
        bad = [f"{n}:{types[n]}/{duck_types[n]}" for n in left_names if DUCK_TYPES.get(types[n]) != duck_types[n]]
        result["problem"] = f"types {bad}"
    if result["problem"] is None and left != right:
        a, b = set(left), set(right)
        only_a, only_b = sorted(a - b)[:2], sorted(b - a)[:2]
        result["problem"] = (
            f"values rows {len(left)}/{len(right)} cols {left_names}\n   spark {only_a}\n   duck  {only_b}"
        )
    return result
