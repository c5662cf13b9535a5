"""Data products as data: a table of measures by group, run by one generic aggregator.

Distinct counts are kept out of Spark's Expand, which would repeat every input row once for each of them. Columns of a
bounded domain (days of a month, channels, codes) are counted as sets beside the other measures; unbounded ones are
counted together from the distinct pairs of group and value, narrow rows that are pre-aggregated before they move.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "sum0": lambda c: F.coalesce(F.sum(c), F.lit(0).cast("decimal(18,2)")),
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "median": lambda c: F.percentile_approx(c, 0.5),
    "spread": F.stddev,
    "set": lambda c: F.size(F.collect_set(c)).cast("long"),
}


@dataclass(frozen=True)
class Measure:
    """A named aggregate of a column (or of the rows) over the rows that a condition holds for.

    Kinds: rows, distinct (values of any number), set (distinct values of a bounded domain), sum (null without rows),
    sum0 (0 without rows), mean, min, max, median, spread.
    """

    name: str
    kind: str
    column: str | None = None
    where: str | None = None

    def aggregate(self) -> Column:
        condition = F.expr(self.where) if self.where else None
        if self.kind == "rows":
            found = F.count("*") if condition is None else F.count_if(condition)
        else:
            value = F.col(self.column) if condition is None else F.when(condition, F.col(self.column))
            found = KINDS[self.kind](value)
        return found.alias(self.name)


def measures(table: str) -> tuple[Measure, ...]:
    """Measures from lines of name, kind, column (- for the rows) and, after a bar, a condition."""
    out = []
    for line in table.strip().splitlines():
        what, _, where = line.partition("|")
        name, kind, column = what.split()
        out.append(Measure(name, kind, None if column == "-" else column, where.strip() or None))
    return tuple(out)


def aggregated(df: DataFrame, keys: list[str], table: tuple[Measure, ...]) -> DataFrame:
    """One row per group with all measures; null keys are a group like any other. Distinct counts of any number of columns take one more pass."""
    out = df.groupBy(*keys).agg(*(m.aggregate() for m in table if m.kind != "distinct"))
    distinct = [m for m in table if m.kind == "distinct"]
    if distinct:
        values = [F.struct(F.lit(k).alias("m"), (F.when(F.expr(m.where), F.col(m.column)) if m.where else F.col(m.column)).cast("string").alias("v")) for k, m in enumerate(distinct)]
        pairs = df.select(*(F.col(k).alias(f"_{k}") for k in keys), F.explode(F.array(*values)).alias("_pair")).where("_pair.v IS NOT NULL").distinct()
        counts = pairs.groupBy(*(f"_{k}" for k in keys)).agg(*(F.count_if(F.col("_pair.m") == k).alias(m.name) for k, m in enumerate(distinct)))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        out = out.join(counts, same, "left").drop(*(f"_{k}" for k in keys)).withColumns({m.name: F.coalesce(m.name, F.lit(0)).cast("long") for m in distinct})
    return out.select(*keys, *(m.name for m in table))
