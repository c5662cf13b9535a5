"""Total orders, and the one row of each key that is first in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def comparable(df: DataFrame, names: list[str]) -> list[Column]:
    """Columns that have an order; maps and what holds them as their JSON."""
    return [F.to_json(F.struct(F.col(f.name))).alias(f.name) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else F.col(f.name) for f in df.schema.fields if f.name in names]


def latest(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key: the greatest by the order (nulls last), which the whole row completes, so that ties have one winner.

    Spark keeps the best row of each key in every task before it shuffles (WindowGroupLimit), so a hot key is one row a task.
    """
    rest = [c for c in df.columns if c not in keys and c not in [o for o in order if isinstance(o, str)]]
    total = [(F.col(o) if isinstance(o, str) else o).desc() for o in order] + [c.desc() for c in comparable(df, rest)]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*total))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
