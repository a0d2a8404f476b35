"""Registration of queries and the number format both engines share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


# moves exact decimal ties off the rounding edge, where the last bit of a sum would decide
NUDGE = 1.000000000001

REGISTRY: dict[str, Query] = {}


def rounded(value: Column) -> Column:
    """Six decimals, fewer for large magnitudes, and no negative zero."""
    value = value * F.lit(NUDGE)
    size = F.abs(value)
    return (
        F.when(size < 1e3, F.round(value, 6)).when(size < 1e7, F.round(value, 2)).otherwise(F.round(value, 0)) + F.lit(0.0)
    )


def rounded_sql(name: str) -> str:
    value = f'("{name}" * {NUDGE!r}::DOUBLE)'
    return (
        f"CASE WHEN abs({value}) < 1e3 THEN round({value}, 6) WHEN abs({value}) < 1e7 THEN round({value}, 2) "
        f'ELSE round({value}, 0) END + 0.0 AS "{name}"'
    )


def polished(df: DataFrame) -> DataFrame:
    """Round every DOUBLE column; NaN and infinity become NULL."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            finite = F.when(~F.isnan(column) & (F.abs(column) < F.lit(float("inf"))), column)
            column = rounded(finite).alias(field.name)
        columns.append(column)
    return df.select(*columns)


def query(sql: str | None = None, floats: str = "", name: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``floats`` names the DOUBLE columns of the SQL twin."""

    def register(fn):
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key} is registered twice")
        text = sql
        if text is not None and floats:
            body = ", ".join(rounded_sql(c) for c in floats.split())
            text = f"SELECT * REPLACE ({body}) FROM ({text}) AS result"
        REGISTRY[key] = Query(key, lambda spark, sf_dir: polished(fn(spark, sf_dir)), text)
        return fn

    return register
