"""Registry of named queries: a Spark builder plus, where SQL can say it,
the equivalent DuckDB SQL used as a correctness oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str  # SURVEY operator ids served


_QUERIES: dict[str, Query] = {}


def register(name: str, ops: str, sql: str | None = None):
    def deco(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = Query(name, fn, sql, ops)
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    from . import load_all  # noqa: F401  (imports modules that register)
    load_all()
    return dict(_QUERIES)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column so both engines agree on printed values."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
