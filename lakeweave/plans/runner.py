"""One generic runner for every entity: cast, check, refer, then history or keyed upsert. And the order in which entities run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions.columns import normalized, tolerant_cast, trimmed
from lakeweave.operators import history, joins, ordering, quality
from lakeweave.plans.spec import Entity, Settings
from lakeweave.sources.store import SnapshotTable

AUDIT = ["arquivo_origem", "batch_id", "timestamp_ingestao"]


def typed(df: DataFrame, entity: Entity) -> DataFrame:
    """The entity's columns from text, in one projection: cleaned, cast tolerantly, and null where an optional one is absent."""
    clean = {"trim": trimmed, "upper": normalized, "none": F.col}
    direct = [f for f in entity.fields if f.expression is None]
    out = df.select(*((F.lit(None) if f.optional and f.name not in df.columns else tolerant_cast(clean[f.clean](f.name) if dict(df.dtypes)[f.name] == "string" else F.col(f.name), f.kind)).cast(f.kind).alias(f.name) for f in direct))
    derived = {f.name: F.expr(f.expression) for f in entity.fields if f.expression is not None}
    return out.withColumns(derived).select(*(f.name for f in entity.fields)) if derived else out


def ordered(entities: dict[str, Entity]) -> list[Entity]:
    """Parents before children."""
    done: dict[str, Entity] = {}

    def visit(e: Entity, path: tuple[str, ...] = ()):
        if e.name in path:
            raise ValueError(f"entities refer to one another in a circle: {path}")
        for r in e.references:
            visit(entities[r.parent], (*path, e.name))
        done.setdefault(e.name, e)

    for e in entities.values():
        visit(e)
    return list(done.values())


def run_entity(spark: SparkSession, entity: Entity, entities: dict[str, Entity], settings: Settings) -> dict[str, int]:
    """Process the raw rows that haven't been yet, and the orphans of earlier runs; the counters of the run.

    The typed table's manifest notes which directories of the raw table went into it, in the commit that brings their
    rows; so a run that failed is made up for by the next one, and one without new files reads nothing. Orphans are
    kept aside and tried again, as their parents may come later. With settings.again all raw rows are read.
    """
    raw = SnapshotTable(spark, settings.table("bronze", entity.name))
    if not raw.exists():
        return {"read": 0, "written": 0, "rejected": 0}
    target = SnapshotTable(spark, settings.table("silver", entity.table), entity.partition_by)
    waiting = SnapshotTable(spark, settings.table("silver", f"{entity.table}__orfaos"))
    held, parts = raw.manifest(), raw.manifest()["parts"]
    consumed = [] if settings.again or not target.exists() else target.manifest().get("consumed", [])
    fresh = [p for p in parts if p not in consumed]
    parents = _parents(spark, entity, entities, settings)
    basis = [SnapshotTable(spark, settings.table("silver", entities[r.parent].table)).rows_of() for r in entity.references]
    retry = waiting.exists() and not settings.again and waiting.manifest().get("basis") != basis
    if not fresh and not retry:
        return {"read": 0, "written": 0, "rejected": 0}
    retried = waiting.read() if waiting.exists() and not settings.again else None
    rows = typed(raw.read_parts(fresh, held.get("removed")), entity) if fresh else None
    if retried is not None:
        rows = retried if rows is None else joins.evolving_union(rows, retried)
    rules = list(entity.rules)
    rows = quality.judged(rows.select(*(f.name for f in entity.fields)), rules).persist()
    try:
        counters = quality.tallied(rows, rules)
        passed, failed = rows.where(F.size(quality.REASONS) == 0).drop(quality.REASONS), rows.where(F.size(quality.REASONS) > 0)
        orphans = []
        for ref, known in parents:
            passed, lost = quality.references(passed, known, ref.key, ref.parent_key, ref.reason)
            orphans.append(lost)
        counters["rejected"] += _aside(waiting, orphans, basis)
        if counters["rejected"]:
            every = joins.evolving_union(failed, *orphans)
            rejected = quality.quarantine(every, entity.name, AUDIT, "silver", settings.batch_id, settings.reference)
            SnapshotTable(spark, settings.table("quarentena", "registros_rejeitados")).insert_new(rejected, ["hash_rejeicao"])
        if entity.history:
            return counters | _versions(target, passed, entity, settings, parts)
        return counters | _facts(target, passed, list(entity.keys), parts)
    finally:
        rows.unpersist()


def _parents(spark: SparkSession, entity: Entity, entities: dict[str, Entity], settings: Settings) -> list:
    """The references of an entity with the rows that they may refer to."""
    out = []
    for ref in entity.references:
        parent = SnapshotTable(spark, settings.table("silver", entities[ref.parent].table))
        if not parent.exists():
            raise ValueError(f"{entity.name} refers to {ref.parent}, which has no table yet")
        known = parent.read()
        out.append((ref, known if ref.ever or not entities[ref.parent].history else history.current(known)))
    return out


def _aside(waiting: SnapshotTable, orphans: list[DataFrame], basis: list) -> int:
    """Keep the orphans of a run for one that finds their parents changed; how many there are."""
    if not orphans:
        return 0
    found = joins.evolving_union(*orphans).drop(quality.REASONS)
    if not waiting.exists() and found.isEmpty():
        return 0
    waiting.replace(found, basis=basis)
    return waiting.read().count()


def _versions(target: SnapshotTable, events: DataFrame, entity: Entity, settings: Settings, parts: list[str]) -> dict[str, int]:
    """Bring events into a history: only the timelines of the keys that get a version are built again, and only the files that hold them written."""
    lineage = {"dw_batch_id": F.lit(settings.batch_id), "dw_atualizado_em": F.current_timestamp()}
    keys = list(entity.history.keys)
    if not target.exists():
        target.replace(history.timeline(events, entity.history).withColumns(lineage), consumed=parts)
        return {"written": target.read().count(), "unchanged": 0, "late": 0}
    existing = target.read()
    judged = history.classified(existing, events, entity.history).persist()
    try:
        status = {r["_status"]: r["count"] for r in judged.groupBy("_status").count().collect()}
        changed = judged.where("_status = 'applicable'").select(*keys).distinct()
        found = history.applied(existing.join(changed, keys, "left_semi"), events.join(changed, keys, "left_semi"), entity.history)
        new = found.where("_new").count() if status.get("applicable") else 0
        if new:
            stamped = found.withColumns({k: F.when(F.col("_new"), v).otherwise(F.col(k)) for k, v in lineage.items()}).drop("_new")
            target.rewrite(changed, stamped, keys, consumed=parts)
        else:
            target.mark(consumed=parts)
    finally:
        judged.unpersist()
    return {"written": new, "unchanged": status.get("unchanged", 0) + status.get("applicable", 0) - new, "late": status.get("late", 0)}


def _facts(target: SnapshotTable, rows: DataFrame, keys: list[str], parts: list[str]) -> dict[str, int]:
    """Of each key the row that came last, stored ones among them; rows as they are stored already are not written."""
    order = ["timestamp_ingestao", "arquivo_origem"]
    if not target.exists():
        target.replace(ordering.latest(rows, keys, order), consumed=parts)
        return {"written": target.read().count()}
    known = target.read().select(*rows.columns)
    beside = known.join(rows.select(*keys).distinct(), keys, "left_semi")
    best = ordering.latest(rows.withColumn("_stored", F.lit(False)).unionByName(beside.withColumn("_stored", F.lit(True))), keys, [*order, *(c for c in rows.columns if c not in (*keys, *order)), "_stored"])
    found = best.where("NOT _stored").drop("_stored").persist()
    try:
        n = found.count()
        if n:
            target.upsert(found, keys, consumed=parts)
        else:
            target.mark(consumed=parts)
    finally:
        found.unpersist()
    return {"written": n}
