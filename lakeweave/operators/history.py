"""Versioned history (slowly changing dimensions of type 2) with half-open validity [start, end).

A timeline is rebuilt from versions rather than patched: stored and new versions of a key are ordered, new ones that
repeat the version before them are dropped, and each version ends where the next starts. Closing the current version,
values that return (A, B, A), deletions and any number of versions in one load all follow from that one rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.columns import delete_flag, row_hash
from lakeweave.operators.ordering import latest

HASH, START, END, ACTIVE, DELETED = "dw_hash_atributos", "dw_inicio_vigencia", "dw_fim_vigencia", "dw_versao_ativa", "dw_excluido"
TECHNICAL = (HASH, START, END, ACTIVE, DELETED)


@dataclass(frozen=True)
class Versioning:
    """What identifies a key, orders its versions and makes them differ."""

    keys: tuple[str, ...]
    version: str
    tracked: tuple[str, ...]
    operation: str | None = None


def prepared(events: DataFrame, v: Versioning) -> DataFrame:
    """One row per key and version: exact repeats are one, and of conflicting ones that of the greatest hash stays. A null version is no version."""
    marked = events.where(F.col(v.version).isNotNull()).withColumns({HASH: row_hash(v.tracked), DELETED: delete_flag(v.operation)})
    best = latest(marked, [*v.keys, v.version], [HASH, DELETED])
    return best.withColumn(START, F.col(v.version)).select(*events.columns, HASH, START, DELETED)


def _by(v: Versioning):
    return Window.partitionBy(*v.keys).orderBy(START)


def collapsed(versions: DataFrame, v: Versioning, stored: Column | None = None) -> DataFrame:
    """Without the rows that repeat the version before them; stored ones always stay."""
    w = _by(v)
    repeats = F.lag(HASH).over(w).eqNullSafe(F.col(HASH)) & F.lag(DELETED).over(w).eqNullSafe(F.col(DELETED))
    kept = ~repeats if stored is None else stored | ~repeats
    return versions.withColumn("_kept", kept).where("_kept").drop("_kept")


def chained(versions: DataFrame, v: Versioning) -> DataFrame:
    """With the end of each version and whether it is the active one."""
    out = versions.withColumn(END, F.lead(START).over(_by(v)))
    return out.withColumn(ACTIVE, F.col(END).isNull() & ~F.col(DELETED))


def timeline(events: DataFrame, v: Versioning) -> DataFrame:
    """The history that a set of events tells, whatever their order."""
    return chained(collapsed(prepared(events, v), v), v)


def classified(existing: DataFrame, events: DataFrame, v: Versioning) -> DataFrame:
    """Prepared events with `_status`: applicable (newer than all that is stored of the key), unchanged (a re-sent latest version) or late."""
    latest = existing.groupBy(*v.keys).agg(F.max(START).alias("_start"), F.max_by(F.struct(HASH, DELETED), START).alias("_latest"))
    fresh = prepared(events, v).join(latest, list(v.keys), "left")
    same = (F.col(HASH) == F.col("_latest")[HASH]) & (F.col(DELETED) == F.col("_latest")[DELETED])
    status = F.when(F.col("_start").isNull() | (F.col(START) > F.col("_start")), "applicable").when(same, "unchanged").otherwise("late")
    return fresh.withColumn("_status", status).drop("_start", "_latest")


def applied(existing: DataFrame, events: DataFrame, v: Versioning) -> DataFrame:
    """The timeline after a load, with `_new` on versions that it brought. Late events are left out, as in every load."""
    new = classified(existing, events, v).where("_status = 'applicable'").drop("_status").withColumn("_new", F.lit(True))
    base = existing.drop(END, ACTIVE).withColumn("_new", F.lit(False))
    together = base.unionByName(new, allowMissingColumns=True)
    return chained(collapsed(together, v, ~F.col("_new")), v)


def as_of(df: DataFrame, moment: Column, include_deleted: bool = False) -> DataFrame:
    """The versions valid at a moment."""
    valid = (F.col(START) <= moment) & (F.col(END).isNull() | (F.col(END) > moment))
    return df.where(valid if include_deleted else valid & ~F.col(DELETED))


def current(df: DataFrame) -> DataFrame:
    return df.where(F.col(ACTIVE) & ~F.col(DELETED))


def changes(df: DataFrame, v: Versioning) -> DataFrame:
    """Each version with its number, the values before it, whether it changed each tracked column, and whether it begins where the last one ends."""
    w, whole = _by(v), _by(v).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumns({"numero_versao": F.row_number().over(w), "primeira_vigencia": F.first(START).over(whole), "ultima_vigencia": F.last(START).over(whole), "proxima_vigencia": F.lead(START).over(w), "fim_anterior": F.lag(END).over(w)})
    out = out.withColumns({f"{c}_anterior": F.lag(c).over(w) for c in v.tracked})
    out = out.withColumns({f"mudou_{c}": (F.col("numero_versao") > 1) & ~F.col(c).eqNullSafe(F.col(f"{c}_anterior")) for c in v.tracked})
    return out.withColumn("consistente", (F.col("numero_versao") == 1) | F.col("fim_anterior").eqNullSafe(F.col(START)))


def many_active(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Violations: keys with more than one active version."""
    return df.where(ACTIVE).groupBy(*keys).agg(F.count("*").alias("versoes_ativas")).where("versoes_ativas > 1")


def inverted(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Violations: versions that end before or when they start."""
    return df.where(F.col(END) <= F.col(START)).select(*keys, START, END)


def gaps(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Violations: versions whose end isn't the start of the next."""
    following = F.lead(START).over(Window.partitionBy(*keys).orderBy(START))
    return df.withColumn("proxima_vigencia", following).where(F.col("proxima_vigencia").isNotNull() & ~F.col(END).eqNullSafe(F.col("proxima_vigencia"))).select(*keys, START, END, "proxima_vigencia")
