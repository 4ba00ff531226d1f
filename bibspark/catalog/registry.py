"""Registration of queries and assembly of their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bibspark.catalog.bindings import CTES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def sql_with(views: str, body: str) -> str:
    """`body` preceded by the named views and, in order, all views they rest on."""
    wanted: list[str] = []

    def add(name: str) -> None:
        needs, _ = CTES[name]
        for n in needs.split():
            add(n)
        if name not in wanted:
            wanted.append(name)

    for v in views.split():
        add(v)
    if not wanted:
        return body
    ctes = ",\n".join(f"{v} AS ({CTES[v][1].strip()})" for v in wanted)
    return f"WITH RECURSIVE {ctes}\n{body.strip()}"


def query(name: str, views: str = "", sql: str | None = None):
    """Register `fn(tables)` under `name`; `sql` may use the named views."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql_with(views, sql)
        return fn

    return register
