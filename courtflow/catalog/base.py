"""Registry of queries, each with its check SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtflow.fixtures import TABLES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, tuple[str, str, dict[str, str]]] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Round doubles to six digits, with one zero, so sums of any order agree."""
    return df.select(
        *[(F.round(F.col(f.name), 6) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields]
    )


def query(name: str, sql: str | None = None, doubles: str = "", with_: dict[str, str] | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` may use fixture tables by name."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: rounded(fn(Tables(spark, folder)))
        if sql is not None:
            CHECKS[name] = (sql, doubles, with_ or {})
        return fn

    return register


def check_sql(sql: str, doubles: str, extra: dict[str, str]) -> str:
    parts: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for table in dict.fromkeys(re.findall(r"\b(fx_\w+|ck_\w+)\b", text)):
            if table in seen:
                continue
            seen.add(table)
            body = TABLES[table][0] if table in TABLES else extra.get(table, SHARED.get(table))
            if body is None:
                raise KeyError(table)
            need(body)
            parts.append(f"{table} AS MATERIALIZED ({body})")

    need(sql)
    head = f"WITH RECURSIVE {', '.join(parts)} " if parts else ""
    fix = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split())
    star = f"* REPLACE ({fix})" if fix else "*"
    return f"{head}SELECT {star} FROM ({sql}) q"


# Intermediate tables that several checks share.
class _Once(dict):
    def __setitem__(self, key: str, value: str) -> None:
        if key in self:
            raise KeyError(f"{key} is defined twice")
        super().__setitem__(key, value)


SHARED: dict[str, str] = _Once()
