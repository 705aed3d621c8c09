"""The registered queries over the driver's tables, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _named(sql: str, name: Callable[[str], str]) -> str:
    return re.sub(r"\{(%s)\}" % "|".join(TABLES), lambda m: name(m[1]), sql)


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows that SQL, which Spark and DuckDB read alike, makes of the driver's tables, named as ``{table}`` in it."""
    return spark.sql(_named(sql, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def derived_sql(**parts: str) -> str:
    """The same rows as common table expressions."""
    return ", ".join(f"{name} AS ({_named(sql, str)})" for name, sql in parts.items())


def inline(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table that a query brings along, where the driver's tables lack the operator's columns."""
    return spark.createDataFrame(rows, schema)


def inline_sql(name: str, schema: str, rows: list[tuple]) -> str:
    """The same table as a common table expression."""
    kinds = {"int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "array<int>": "INTEGER[]"}
    columns = [c.strip().split(" ", 1) for c in schema.split(", ")]

    def value(v, kind: str) -> str:
        text = "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
        return f"{text}::{kinds[kind]}"

    body = ", ".join("(" + ", ".join(value(v, k) for v, (_, k) in zip(r, columns, strict=True)) + ")" for r in rows)
    return f"{name}({', '.join(c for c, _ in columns)}) AS (VALUES {body})"


def queries() -> dict[str, Query]:
    from lexiforge.plans import library  # noqa: F401  registers

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
