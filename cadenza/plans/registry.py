"""The registry of queries: each names the operators of the blueprint that it exercises, and its SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(ids: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = Query(ids, f, sql)
        return f
    return add


def r(column, digits: int = 6):
    return F.round(column, digits)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    return df.select(*[F.round(c, special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
