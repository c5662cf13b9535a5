"""The pipeline: raw ingestion, typed and checked tables, data products; by layer or whole, and from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from lakeweave.operators import history
from lakeweave.plans import cards, marts
from lakeweave.plans.runlog import RunLog, configure_logging
from lakeweave.plans.runner import ordered, run_entity
from lakeweave.plans.spec import MODES, Entity, Settings
from lakeweave.sources.generator import generate
from lakeweave.sources.landing import ingest
from lakeweave.sources.store import SnapshotTable

QUARANTINE, RUNS = ("quarentena", "registros_rejeitados"), ("observabilidade", "execucao_pipeline")


def session(name: str = "lakeweave") -> SparkSession:
    """The active session, or a local one."""
    found = SparkSession.getActiveSession()
    if found:
        return found
    return SparkSession.builder.master("local[*]").appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()


def run_bronze(spark: SparkSession, entities: dict[str, Entity], settings: Settings, log: RunLog) -> None:
    for e in entities.values():
        with log.stage("bronze", "ingest", e.name) as counters:
            raw = SnapshotTable(spark, settings.table("bronze", e.name))
            before = raw.manifest()["parts"] if raw.exists() else []
            if ingest(spark, settings.landing(e.folder), e.kind, raw, settings.batch_id, settings.reference) is not None:
                counters["read"] = counters["written"] = raw.read_parts([p for p in raw.manifest()["parts"] if p not in before]).count()


def run_silver(spark: SparkSession, entities: dict[str, Entity], settings: Settings, log: RunLog) -> None:
    for e in ordered(entities):
        with log.stage("silver", "entity", e.name) as counters:
            counters.update(run_entity(spark, e, entities, settings))
    for e in entities.values():
        table = SnapshotTable(spark, settings.table("silver", e.table), e.partition_by)
        if table.exists() and e.cluster_by and len(table.manifest()["parts"]) > 1:
            table.compact(list(e.cluster_by), settings.compact_files)


def silver(spark: SparkSession, entities: dict[str, Entity], settings: Settings) -> dict[str, DataFrame]:
    return {e.table: SnapshotTable(spark, settings.table("silver", e.table)).read() for e in entities.values()}


def run_gold(spark: SparkSession, entities: dict[str, Entity], settings: Settings, log: RunLog) -> None:
    """The enriched fact is written first; the products build on what is stored of it, each counted from its files.

    With the same typed tables and the same reference date the products would be the same, and are left as they are.
    """
    tables, fact = silver(spark, entities, settings), None
    basis = {e.table: SnapshotTable(spark, settings.table("silver", e.table)).rows_of() for e in entities.values()} | {"reference": settings.reference}
    for name in marts.NAMES:
        with log.stage("gold", "product", name) as counters:
            store = SnapshotTable(spark, settings.table("gold", name), ("data_particao",) if name == "gold_fato_transacao" else ())
            if settings.again or not store.exists() or store.manifest().get("basis") != basis:
                store.replace(marts.products(tables, settings.reference, fact)[name], basis=basis)
                counters["written"] = store.read().count()
            fact = store.read() if name == "gold_fato_transacao" else fact


def run(settings: Settings, spark: SparkSession | None = None, entities: dict[str, Entity] | None = None) -> dict[str, int]:
    """Run the layers of the mode in order; the first failure ends the run. The run log is written in any case."""
    spark, entities = spark or session(), entities or cards.entities(settings.reference)
    log = RunLog(settings)
    try:
        for layer, step in (("bronze", run_bronze), ("silver", run_silver), ("gold", run_gold)):
            if settings.mode in ("completa", layer):
                step(spark, entities, settings, log)
    finally:
        log.persist(spark)
    return log.summary()


def register_views(spark: SparkSession, settings: Settings, entities: dict[str, Entity] | None = None) -> list[str]:
    """Every table there is as a temporary view of its own name, for SQL."""
    names = [("silver", e.table) for e in (entities or cards.entities(settings.reference)).values()]
    names += [("gold", n) for n in ("gold_fato_transacao", "gold_cliente_mes", "gold_indicadores_risco", "gold_features_cliente", "gold_dim_estabelecimento", *marts.DIMENSIONS)] + [QUARANTINE, RUNS]
    out = []
    for layer, name in names:
        table = SnapshotTable(spark, settings.table(layer, name))
        if table.exists():
            table.read().createOrReplaceTempView(name)
            out.append(name)
    return out


def explain(spark: SparkSession, settings: Settings) -> str:
    """The formatted plans of the enriched fact and of a query on one of its partitions."""
    tables = silver(spark, cards.entities(settings.reference), settings)
    fact = marts.products(tables, settings.reference)["gold_fato_transacao"]
    stored = SnapshotTable(spark, settings.table("gold", "gold_fato_transacao")).read().where(f"data_particao = DATE'{settings.reference}'").select("id_transacao", "valor_liquido")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return "\n\n".join(df._jdf.queryExecution().explainString(mode) for df in (fact, stored))


def violations(tables: dict[str, DataFrame], fact: DataFrame) -> DataFrame:
    """(invariant, n) of every broken invariant: one active version, valid and chained intervals, one row per transaction, net = gross - refunded."""
    from pyspark.sql import functions as F

    found = []
    for name, key in (("dim_cliente", "id_cliente"), ("dim_conta", "id_conta"), ("dim_cartao", "id_cartao")):
        for kind, check in (("many_active", history.many_active), ("inverted", history.inverted), ("gaps", history.gaps)):
            found.append(check(tables[name], (key,)).agg(F.count("*").alias("n")).select(F.lit(f"{name}.{kind}").alias("invariant"), "n"))
    found.append(fact.groupBy("id_transacao").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("fact.repeated").alias("invariant"), "n"))
    found.append(fact.where("valor_liquido <> valor_bruto - valor_estornado").agg(F.count("*").alias("n")).select(F.lit("fact.net").alias("invariant"), "n"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("n > 0")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--ambiente", default=None)
    parser.add_argument("--modo", choices=MODES, default=None)
    parser.add_argument("--data-referencia", default=None)
    parser.add_argument("--batch-id", default=None)
    parser.add_argument("--raiz", default=None)
    parser.add_argument("--gerar-massa", action="store_true")
    parser.add_argument("--reprocessar", action="store_true", help="read all raw rows again, not only the new ones")
    parser.add_argument("--log", default="INFO")
    a = parser.parse_args(args)
    configure_logging(a.log)
    given = {"environment": a.ambiente, "mode": a.modo, "reference": a.data_referencia, "batch_id": a.batch_id, "root": a.raiz, "again": a.reprocessar}
    settings = Settings(**{k: v for k, v in given.items() if v is not None})
    if a.gerar_massa:
        generate(settings.root, settings.reference)
    print(run(settings))


if __name__ == "__main__":
    main()
