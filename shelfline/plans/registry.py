"""Query registry used by the driver entry point, the tests and the benchmark."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfline.functions.columns import half_up
from shelfline.plans.role_sql import ROLE_SQL
from shelfline.sources.roles import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, rounded: Sequence[str] = (), digits: int = 6):
    """Register ``build(tables) -> DataFrame`` under ``name``.

    ``sql`` is the check query; the input roles it names are prefixed as CTEs.
    ``rounded`` columns are means, deviations or slopes whose last digits depend on
    the order of addition; both sides round them.
    """

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def stable(tables: Tables) -> DataFrame:
            df = build(tables)
            return df.withColumns({c: half_up(c, digits) for c in rounded}) if rounded else df

        QUERIES[name] = Query(name, stable, _check_sql(sql, rounded, digits) if sql else None)
        return build

    return register


def _check_sql(sql: str, rounded: Sequence[str], digits: int) -> str:
    if rounded:
        exact = 'CAST(round(TRY_CAST("{0}" AS DECIMAL(38,{1})), {2}) AS DOUBLE) AS "{0}"'
        replaced = ", ".join(exact.format(c, digits + 3, digits) for c in rounded)
        sql = f"SELECT * REPLACE ({replaced}) FROM ({sql.strip()})"
    return with_roles(sql)


def _roles_in(sql: str) -> list[str]:
    return [r for r in ROLE_SQL if re.search(rf"\b(?:FROM|JOIN)\s+{r}\b", sql, re.IGNORECASE)]


def with_roles(sql: str) -> str:
    """Prefix the CTEs of every role the SQL reads, directly or through a role."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for role in _roles_in(text):
            if role not in needed:
                visit(ROLE_SQL[role])
                if role not in needed:
                    needed.append(role)

    visit(sql)
    body = sql.strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{r} AS ({ROLE_SQL[r].strip()})" for r in needed)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
