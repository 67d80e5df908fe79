"""Unions, intersections and what is left to do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union(*frames: DataFrame) -> DataFrame:
    """Rows of all tables; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that aren't written yet."""
    return df.join(done.select(key), key, "left_anti")
