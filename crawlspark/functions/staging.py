"""Naming intermediate values, so that a value used many times is computed once.

Columns are trees: using a sub-expression five times copies it five times, and nesting
multiplies the copies. `let` binds a value inside one expression; `stage` binds columns of a
table and keeps later filters from pulling their expressions down.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def record(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a generator: a filter on them stays above it."""
    return df.select("*", F.inline(F.array(record(**columns))))


def built_once(build: Callable) -> Callable:
    """Cache for functions of column names that return columns: long expressions take the
    driver about a second to put together, and jobs are often started many times."""
    cache: dict = {}

    @wraps(build)
    def cached(*names: str):
        session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        key = (session.sparkContext.applicationId, *names)
        if key not in cache:
            cache[key] = build(*names)
        return cache[key]

    return cached
