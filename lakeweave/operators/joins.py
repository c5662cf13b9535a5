"""Joins of facts with versioned dimensions, upserts and evolving unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.operators.history import DELETED, END, START


def as_of_join(fact: DataFrame, dimension: DataFrame, fact_key: str, dimension_key: str, moment: str, columns: dict[str, str], include_deleted: bool = False) -> DataFrame:
    """Each fact with the attributes that were valid at its moment; null where there are none.

    columns maps dimension columns to names in the result. The equal key decides the strategy, so Spark broadcasts a
    dimension whose size allows it and shuffles by key beyond that; the interval is checked on the matches. With at
    most one valid version per key and moment no fact is repeated.
    """
    versions = dimension.where(~F.col(DELETED)) if not include_deleted and DELETED in dimension.columns else dimension
    right = versions.select(F.col(dimension_key).alias("_key"), F.col(START).alias("_start"), F.col(END).alias("_end"), *(F.col(a).alias(b) for a, b in columns.items()))
    condition = (F.col(fact_key) == F.col("_key")) & (F.col("_start") <= F.col(moment)) & (F.col("_end").isNull() | (F.col("_end") > F.col(moment)))
    return fact.join(right, condition, "left").drop("_key", "_start", "_end")


def evolving_union(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that a frame lacks are null in its rows."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def upserted(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows whose key isn't in the source, and all source rows."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source, allowMissingColumns=True)


def absent(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows whose key isn't in the target."""
    return source.join(target.select(*keys), keys, "left_anti")
