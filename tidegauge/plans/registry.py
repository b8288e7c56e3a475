"""All queries of the engine by name, with their SQL oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function (spark, sf_dir) -> DataFrame, with its SQL oracle if it has one."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query in Spark SQL; {events} stands for that table. The oracle is the same text unless it is given."""

    def f(spark, sf_dir):
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})

    query(name, re.sub(r"\{(\w+)\}", r"\1", oracle or text))(f)


def load_all() -> None:
    from tidegauge.plans import admin, basics, candles, incremental, joined, series, tables  # noqa: F401


load_all()
