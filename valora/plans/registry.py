"""Registered queries and their SQL counterparts.

Modules of this package register with ``query``; importing them here fills the
tables. Doubles are rounded on both sides, as sums differ in their last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["valuation"](spark, sf_dir)


from valora.plans import cleaning, comparing, evidence, joining, measuring, modelling, releasing, reporting, streaming  # noqa: E402, F401
