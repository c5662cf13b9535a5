"""Declarative rules, reference checks and quarantine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lakeweave.functions.columns import row_hash
from lakeweave.operators.ordering import latest

REASONS = "motivos_rejeicao"
BLOCK, WARN = "REJEITA", "ALERTA"


@dataclass(frozen=True)
class Rule:
    """A named predicate as SQL text, so that it can be kept and compared without a session. Null counts as a violation."""

    name: str
    description: str
    predicate: str
    severity: str = BLOCK

    def violated(self) -> Column:
        return ~F.coalesce(F.expr(self.predicate), F.lit(False))


def reasons(rules: list[Rule]) -> Column:
    """The names of the violated blocking rules, in the order of the rules."""
    found = [F.when(r.violated(), F.lit(r.name)) for r in rules if r.severity == BLOCK]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def judged(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """All rows with their reasons, in one projection."""
    return df.withColumn(REASONS, reasons(rules))


def split(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and those that don't with their reasons. Both come from the same projection: persist the input of a costly one."""
    all_rows = judged(df, rules)
    return all_rows.where(F.size(REASONS) == 0).drop(REASONS), all_rows.where(F.size(REASONS) > 0)


def observed(df: DataFrame, rules: list[Rule], name: str = "quality") -> tuple[DataFrame, Observation]:
    """The same rows, and an observation of how many there are and violate each rule, warnings too; filled by the next action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(r.violated()).alias(r.name) for r in rules)), seen


def references(child: DataFrame, parent: DataFrame, foreign_key: str, parent_key: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in the parent, and orphans with one reason; a null key is an orphan. Repeated parents don't repeat rows."""
    keys = parent.select(F.col(parent_key).alias("_parent")).where("_parent is not null").distinct()
    condition = F.col(foreign_key) == F.col("_parent")
    return child.join(keys, condition, "left_semi"), child.join(keys, condition, "left_anti").withColumn(REASONS, F.array(F.lit(reason)))


def quarantine(rejected: DataFrame, entity: str, audit: list[str], layer: str, batch_id: str, reference: str) -> DataFrame:
    """Distinct rejections. Their hash covers the entity, the business columns and the reasons, so the same bad record is one rejection however often it is sent."""
    if REASONS not in rejected.columns:
        raise ValueError(f"rejected rows of {entity} have no column {REASONS}")
    business = [c for c in rejected.columns if c not in (*audit, REASONS)]
    order = [c for c in audit if c in rejected.columns]
    identity = F.sha2(F.concat_ws("|", F.lit(entity), row_hash(business), F.array_join(F.array_sort(REASONS), ",")), 256)
    original = F.to_json(F.struct(*(F.col(c) for c in rejected.columns if c != REASONS)))
    found = rejected.select(
        *(F.col(c).alias(f"_{c}") for c in order),
        F.lit(entity).alias("entidade"),
        F.lit(layer).alias("camada_origem"),
        F.lit(batch_id).alias("batch_id"),
        F.lit(reference).alias("data_referencia"),
        F.current_timestamp().alias("quarentenado_em"),
        F.col(REASONS),
        original.alias("registro_original"),
        identity.alias("hash_rejeicao"),
    )
    return latest(found, ["hash_rejeicao"], [f"_{c}" for c in order]).drop(*(f"_{c}" for c in order))


def sample(rejected: DataFrame, n: int = 3, longest: int = 300) -> DataFrame:
    """A few rejections as an example for a report: the records as far as they fit, those of smallest hash."""
    few = rejected.orderBy("hash_rejeicao").limit(n)
    return few.select("entidade", REASONS, F.substring("registro_original", 1, longest).alias("registro_original"))


def tallied(rows: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many judged rows there are, are rejected, and violate each warning, in one pass."""
    warnings = [r for r in rules if r.severity == WARN]
    found = rows.agg(F.count(F.lit(1)).alias("read"), F.count_if(F.size(REASONS) > 0).alias("rejected"), *(F.count_if(r.violated()).alias(f"warning_{r.name}") for r in warnings)).first()
    return found.asDict()


def histogram(rejected: DataFrame) -> DataFrame:
    """How often each reason occurs."""
    return rejected.select(F.explode(REASONS).alias("motivo")).groupBy("motivo").agg(F.count("*").alias("qtd"))
