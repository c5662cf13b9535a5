"""Positions, tiles and running totals over a whole table without bringing it into one task.

Rows are dealt by range of the order and written, so that every use sees the same ranges; they are numbered within each
range, and shifted by what the ranges before hold: a summary of one row per range. The order must be total, so append a key to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.sources.scratch import written


def numbered(df: DataFrame, order: list[Column], name: str = "posicao", running: dict[str, str] | None = None) -> DataFrame:
    """With the global position by the order, the number of rows, and running totals of columns (running: column -> name) with their ends."""
    running = running or {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = {f"_sum_{c}": F.sum(c) for c in running}
    by_range = dealt.groupBy("_range").agg(F.count("*").alias("_rows"), *(v.alias(k) for k, v in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = by_range.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("_total"), *(F.sum(k).over(before).alias(f"{k}_before") for k in sums), *(F.sum(k).over(whole).alias(f"{k}_whole") for k in sums))
    within = Window.partitionBy("_range").orderBy(*order)
    out = dealt.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.row_number().over(within)).withColumn(f"{name}_total", F.col("_total"))
    for c, alias in running.items():
        own = F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = out.withColumn(alias, own + F.coalesce(F.col(f"_sum_{c}_before"), F.lit(0))).withColumn(f"{alias}_total", F.col(f"_sum_{c}_whole"))
    return out.select(*df.columns, name, f"{name}_total", *(x for alias in running.values() for x in (alias, f"{alias}_total")))


def tied(placed: DataFrame, value: str, position: str, running: str | None = None) -> DataFrame:
    """With the first and the last position of each row's equals in a column that leads the order, and the running total up to the last of them.

    Names are position_first, position_last and position_sum. What equals share is one pre-aggregated row a value, so a
    value that most rows have is no group in any task.
    """
    same = {f"{position}_first": F.min(position), f"{position}_last": F.max(position)}
    if running:
        same[f"{position}_sum"] = F.max_by(running, position)
    of_value = placed.groupBy(F.col(value).alias("_value")).agg(*(v.alias(k) for k, v in same.items()))
    return placed.join(of_value, F.col(value).eqNullSafe(F.col("_value")), "left").drop("_value")


def tile(position: Column, total: Column, n: int) -> Column:
    """NTILE(n) from a position: the first total % n tiles have one row more."""
    size, more = F.floor(total / n), total % n
    big = more * (size + 1)
    return F.when(position <= big, F.ceil(position / (size + 1))).otherwise(more + F.ceil((position - big) / F.greatest(size, F.lit(1)))).cast("long")
