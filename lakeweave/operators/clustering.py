"""Clustering of files by several columns: rows near in all of them get near places on a Z-order curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 8


def ordinal(df: DataFrame, name: str) -> Column:
    """A column as a number of the same order; of texts by their first six bytes."""
    kind = dict(df.dtypes)[name]
    if kind in ("string", "binary"):
        return F.conv(F.hex(F.substring(name, 1, 6).cast("binary")), 16, 10).cast("double") * F.pow(F.lit(256.0), F.lit(6) - F.least(F.octet_length(F.substring(name, 1, 6)), F.lit(6)))
    if kind == "date":
        return F.unix_date(name).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("double")


def z_value(df: DataFrame, names: list[str], bits: int = BITS, error: float = 0.01) -> Column:
    """The place of a row on the curve: the bits of its quantile numbers by each column, interleaved. Nulls come first.

    The quantiles bring at most 2**bits numbers of each column to the driver.
    """
    numbers = df.select(*(ordinal(df, n).alias(f"_{k}") for k, n in enumerate(names)))
    edges = numbers.approxQuantile(numbers.columns, [k / 2**bits for k in range(1, 2**bits)], error)
    out = F.lit(0).cast("long")
    for k, (name, own) in enumerate(zip(names, edges, strict=True)):
        cuts = F.array(*(F.lit(float(x)) for x in sorted(set(own)))) if own else F.array().cast("array<double>")
        value = ordinal(df, name)
        rank = F.coalesce(F.size(F.filter(cuts, lambda x: x < value)), F.lit(0))  # noqa: B023
        for b in range(bits):
            out = out + F.shiftleft(F.shiftright(rank, b).bitwiseAND(F.lit(1)).cast("long"), b * len(names) + k)
    return out
