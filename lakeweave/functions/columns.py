"""Column expressions: tolerant casts, normalisers, hashes, flags and guarded arithmetic. All of them stay in codegen."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_MARK = "<null>"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tolerant_cast(c: str | Column, kind: str) -> Column:
    """The value as another type; null where it can't be one, also in ANSI mode."""
    return col(c).try_cast(kind)


def trimmed(c: str | Column) -> Column:
    return F.trim(col(c))


def normalized(c: str | Column) -> Column:
    """Trimmed and upper case, for values of a domain."""
    return F.upper(F.trim(col(c)))


def row_hash(names: Iterable[str]) -> Column:
    """A digest of columns as a JSON array of their texts: no value can forge a separator, and null isn't any text."""
    return F.sha2(F.to_json(F.array(*(F.col(n).cast("string") for n in names))), 256)


def delimited_hash(names: Iterable[str], separator: str = "||") -> Column:
    """The digest of values joined by a separator, for parity with other engines; see row_hash for a safe one."""
    return F.sha2(F.concat_ws(separator, *(F.coalesce(F.col(n).cast("string"), F.lit(NULL_MARK)) for n in names)), 256)


def layout_fingerprint(names: Iterable[str]) -> str:
    """Twelve hex digits for a set of column names, whatever their order."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()[:12]


def delete_flag(operation: str | None) -> Column:
    """Whether a change row deletes its key; without an operation column none does."""
    return F.upper(F.coalesce(F.col(operation), F.lit(""))) == "DELETE" if operation else F.lit(False)


def guarded_ratio(numerator: Column, denominator: Column, otherwise: float | None = None) -> Column:
    """numerator / denominator where the latter is positive, else null or a constant."""
    found = F.when(denominator > 0, numerator / denominator)
    return found if otherwise is None else found.otherwise(F.lit(otherwise))


def rounded(c: Column, digits: int = 2) -> Column:
    """A double rounded half away from zero as the decimal that it stands for: eight digits first, so that noise of binary fractions can't tip a half."""
    return F.round(c.cast("decimal(30,8)"), digits).cast("double")


def percent(part: Column, whole: Column, digits: int = 2, otherwise: float | None = None) -> Column:
    """part / whole x 100, rounded; null or a constant where the whole isn't positive."""
    return rounded(guarded_ratio(part.cast("double") * 100, whole.cast("double"), otherwise), digits)


def money(c: str | Column) -> Column:
    return col(c).cast("decimal(18,2)")


def differs(a: str | Column, b: str | Column) -> Column:
    """Null-safe inequality."""
    return ~col(a).eqNullSafe(col(b))


def month_of(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def since(c: str | Column, reference: str, days: int) -> Column:
    """Within so many days before a reference date."""
    return col(c) >= F.date_sub(F.lit(reference).cast("date"), days)


def classify(*cases: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The label of the first case that holds."""
    out = F.when(*cases[0])
    for condition, label in cases[1:]:
        out = out.when(condition, label)
    return out.otherwise(otherwise) if otherwise is not None else out
