import pytest
from pyspark.sql import functions as F

from helpers import rows
from lakeweave.operators import joins, ordering
from lakeweave.plans import cards, flow, insight, runner
from lakeweave.plans.runlog import RunLog
from lakeweave.plans.spec import Settings
from lakeweave.sources.generator import generate
from lakeweave.sources.landing import ingest, landed
from lakeweave.sources.store import SnapshotTable
from lakeweave.streaming.landing_stream import ingest_stream


def test_snapshots(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    assert not t.exists()
    with pytest.raises(FileNotFoundError):
        t.read()
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    t.replace(df)
    t.upsert(spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), ["k"])
    assert rows(t.read()) == [(1, "a"), (2, "B"), (3, "c")] and rows(t.read(1)) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="repeated key"):
        t.upsert(df.union(df), ["k"])
    n = t.insert_new(df, ["k"])
    assert n == t.versions()[-1] == 2
    t.append(spark.createDataFrame([(4, "d", True)], "k int, v string, extra boolean"))
    assert rows(t.read().where("k >= 3")) == [(3, "c", None), (4, "d", True)]
    t.compact(["k"], 1)
    assert t.read().count() == 4 and len(t.manifest()["parts"]) == 1
    t.vacuum(1)
    assert t.versions() == [4] and t.read().count() == 4


def test_latest_breaks_ties_totally(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (2, None, "x"), (2, 1, "y")], "k int, o int, v string")
    assert rows(ordering.latest(df, ["k"], ["o"])) == rows(ordering.latest(df.orderBy("v"), ["k"], ["o"])) == [(1, 5, "b"), (2, 1, "y")]


def test_landing(spark, tmp_path):
    assert landed(spark, str(tmp_path / "none"), "csv") == []
    d = tmp_path / "in"
    d.mkdir()
    (d / "a b.csv").write_text("x,y\n1,\n2,z\n")
    (d / "_skip.csv").write_text("x\n9\n")
    (d / "c.csv").write_text("w,x\nq,3\n")
    raw = SnapshotTable(spark, str(tmp_path / "raw"))
    assert ingest(spark, str(d), "csv", raw, "b1", "2024-01-01") == 1
    assert ingest(spark, str(d), "csv", raw, "b2", "2024-01-01") is None
    assert rows(raw.read(), "x", "y", "w") == [("1", None, None), ("2", "z", None), ("3", None, "q")]
    assert raw.read().select("schema_version").distinct().count() == 2
    (d / "e.csv").write_text("x,y,n\n5,6,7\n")
    assert ingest(spark, str(d), "csv", raw, "b3", "2024-01-02") == 2
    assert rows(raw.read().where("batch_id = 'b3'"), "x", "n") == [("5", "7")]


def test_json_primitives_stay_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": 7, "v": 1.50, "s": null}\n{"id": 8, "t": "x"}\n')
    raw = SnapshotTable(spark, str(tmp_path / "raw"))
    ingest(spark, str(tmp_path / "in"), "json", raw, "b", "2024-01-01")
    assert rows(raw.read(), "id", "v", "t") == [("7", "1.50", None), ("8", None, "x")]


def test_stream_agrees_with_batch(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.csv").write_text("x,y\n1,2\n")
    raw = SnapshotTable(spark, str(tmp_path / "raw"))
    args = (spark, str(d), raw, str(tmp_path / "cp"), "b", "2024-01-01")
    ingest_stream(*args)
    (d / "b.csv").write_text("x,y,z\n3,4,5\n")
    ingest_stream(*args)
    ingest_stream(*args)
    assert rows(raw.read(), "x", "y", "z") == [("1", "2", None), ("3", "4", "5")]
    both = SnapshotTable(spark, str(tmp_path / "both"))
    ingest(spark, str(d), "csv", both, "b", "2024-01-01")
    assert rows(both.read(), "x", "arquivo_origem") == rows(raw.read(), "x", "arquivo_origem")


def test_typing(spark):
    e = cards.entities("2024-06-30")["transacao"]
    raw = spark.createDataFrame([(" 1 ", "2", "2024-01-05 10:00:00", "1.239", "x", " loja ", "pos", "br", "brl", "f", "b", None), ("a", "2", "bad", "", "5411", None, None, None, None, "f", "b", None)], "id_transacao string, id_cartao string, data_transacao string, valor string, mcc string, estabelecimento string, canal string, pais string, moeda string, arquivo_origem string, batch_id string, timestamp_ingestao timestamp")
    good, bad = runner.typed(raw, e).orderBy(F.col("id_transacao").isNull()).collect()
    assert (good["id_transacao"], str(good["valor"]), good["mcc"], good["estabelecimento"], good["canal"], good["dispositivo"], str(good["data_particao"])) == (1, "1.24", None, "loja", "POS", None, "2024-01-05")
    assert (bad["id_transacao"], bad["data_transacao"], bad["valor"], bad["mcc"]) == (None, None, None, 5411)


def test_settings():
    s = Settings(root="/r", environment="dev")
    assert s.table("silver", "t") == "/r/silver_dev/t" and Settings(root="/r", environment="prod").table("silver", "t") == "/r/silver/t"
    for bad in ({"environment": "x"}, {"mode": "x"}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_run_log_records_failures(spark, tmp_path):
    log = RunLog(Settings(root=str(tmp_path)))
    with pytest.raises(RuntimeError), log.stage("silver", "s", "e") as c:
        c["read"] = 3
        raise RuntimeError("no")
    log.persist(spark)
    row = SnapshotTable(spark, log.settings.table("observabilidade", "execucao_pipeline")).read().first()
    assert (row["status"], row["detalhe_erro"], row["linhas_lidas"]) == ("FALHA", "RuntimeError: no", 3)


def test_generator_is_deterministic(tmp_path):
    a, b = generate(str(tmp_path / "a"), clients=20, days=2), generate(str(tmp_path / "b"), clients=20, days=2)
    assert a == b
    for f in (tmp_path / "a").rglob("*.csv"):
        assert f.read_text() == (tmp_path / "b" / f.relative_to(tmp_path / "a")).read_text()


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    generate(root, clients=24, days=3)
    first = flow.run(Settings(root=root, batch_id="b1"), spark)
    before = contents(spark, root)
    second = flow.run(Settings(root=root, batch_id="b2"), spark)
    return root, first, before, second


def contents(spark, root):
    s, out = Settings(root=root), {}
    for e in cards.entities(s.reference).values():
        out[e.table] = rows(SnapshotTable(spark, s.table("silver", e.table)).read().drop("dw_atualizado_em"))
    for name in ("gold_fato_transacao", "gold_cliente_mes", "gold_features_cliente", "gold_indicadores_risco", "gold_dim_estabelecimento", "gold_dim_cliente"):
        out[name] = rows(SnapshotTable(spark, s.table("gold", name)).read())
    out["bin"] = rows(SnapshotTable(spark, s.table(*flow.QUARANTINE)).read())
    return out


def test_flow_runs_twice_alike(spark, lake):
    root, first, before, second = lake
    assert first["failures"] == second["failures"] == 0
    assert contents(spark, root) == before


def test_every_defect_lands_where_it_should(spark, lake):
    s = Settings(root=lake[0])
    bin_ = SnapshotTable(spark, s.table(*flow.QUARANTINE)).read()
    found = {(r["entidade"], r["motivo"]): r["ocorrencias"] for r in insight.rejection_reasons(bin_).collect()}
    assert found == {
        ("cliente", "cpf_obrigatorio"): 1, ("cliente", "cpf_11_digitos"): 2, ("cliente", "renda_negativa"): 1, ("cliente", "estado_invalido"): 1, ("conta", "cliente_inexistente"): 1, ("cartao", "conta_inexistente"): 1,
        ("transacao", "valor_nao_positivo"): 2, ("transacao", "cartao_inexistente"): 1, ("estorno", "transacao_inexistente"): 1, ("evento_risco", "transacao_inexistente"): 1,
    }


def test_invariants_and_grain(spark, lake):
    s = Settings(root=lake[0])
    fact = SnapshotTable(spark, s.table("gold", "gold_fato_transacao")).read()
    assert flow.violations(flow.silver(spark, cards.entities(s.reference), s), fact).count() == 0
    assert fact.count() == fact.select("id_transacao").distinct().count() == 3 * 9
    assert fact.where("dispositivo is not null").count() > 0 and len(fact.columns) == 32


def test_views_and_plans(spark, lake):
    s = Settings(root=lake[0])
    assert len(flow.register_views(spark, s)) == 16
    assert spark.sql("SELECT count(*) FROM gold_fato_transacao WHERE elegivel_metrica").first()[0] > 0
    assert spark.sql("SELECT count(*) FROM execucao_pipeline WHERE status = 'SUCESSO'").first()[0] >= 20
    plan = flow.explain(spark, s)
    assert "LeftOuter" in plan and "PartitionFilters: [isnotnull(data_particao" in plan and "ReadSchema: struct<id_transacao:bigint,valor_liquido:decimal(18,2)>" in plan


def test_modes_and_missing_parents(spark, tmp_path):
    generate(str(tmp_path), clients=8, days=1)
    out = flow.run(Settings(root=str(tmp_path), mode="bronze"), spark)
    assert out["stages"] == 6 and out["failures"] == 0
    entities = cards.entities("2024-01-31")
    with pytest.raises(ValueError, match="no table yet"):
        runner.run_entity(spark, entities["conta"], entities, Settings(root=str(tmp_path)))
    assert [e.name for e in runner.ordered(dict(reversed(entities.items())))].index("cliente") == 0


def test_a_change_rewrites_only_the_files_that_hold_its_keys(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), ("day",))
    t.replace(spark.createDataFrame([(1, "a", "x y"), (2, "b", "m"), (3, "c", None)], "k int, v string, day string"))
    before = {f for p in t.manifest()["parts"] for f in t._listed(p)}
    t.upsert(spark.createDataFrame([(1, "A", "x y"), (9, "n", "z")], "k int, v string, day string"), ["k"])
    gone = {f for own in t.manifest()["removed"].values() for f in own}
    assert len(gone) == 1 and gone < before
    assert rows(t.read(), "k", "v", "day") == [(1, "A", "x y"), (2, "b", "m"), (3, "c", None), (9, "n", "z")]
    assert rows(t.read(1), "k", "v") == [(1, "a"), (2, "b"), (3, "c")]


def test_commits_do_not_overwrite_one_another(spark, tmp_path, monkeypatch):
    df = spark.range(1)
    a, b = SnapshotTable(spark, str(tmp_path / "t")), SnapshotTable(spark, str(tmp_path / "t"))
    a.replace(df)
    known = b.versions()
    a.append(df)
    monkeypatch.setattr(b, "versions", lambda: known)
    with pytest.raises(Exception, match="already exists|AlreadyExists|exist"):
        b.append(df)
    assert a.read().count() == 2 and a.versions() == [1, 2]


def test_late_parents_heal_orphans_and_idle_runs_read_nothing(spark, tmp_path):
    generate(str(tmp_path), clients=8, days=1)
    clients = tmp_path / "landing/clientes/clientes_cdc.json"
    lines = clients.read_text().splitlines(keepends=True)
    own = [line for line in lines if '"id_cliente": 3,' in line]
    clients.write_text("".join(line for line in lines if line not in own))
    settings = Settings(root=str(tmp_path))

    def run(**more):
        return [flow.run(Settings(root=str(tmp_path), mode=mode, **more), spark)["read"] for mode in ("bronze", "silver")]

    run()
    accounts = SnapshotTable(spark, settings.table("silver", "dim_conta"))
    assert accounts.read().where("id_cliente = 3").count() == 0
    (clients.parent / "late.json").write_text("".join(own))
    run()
    healed = accounts.read().where("id_cliente = 3").count()
    assert healed > 0
    assert run() == [0, 0]
    assert run(again=True)[1] > 0 and accounts.read().where("id_cliente = 3").count() == healed


def test_stream_takes_up_columns_within_a_run_and_keeps_odd_lines(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.csv").write_text("x,y\n1,2\n7,8,9\n")
    (d / "b.csv").write_text("z,x\n3,4\n")
    raw = SnapshotTable(spark, str(tmp_path / "raw"))
    ingest_stream(spark, str(d), raw, str(tmp_path / "cp"), "b", "2024-01-01", max_files=1)
    assert rows(raw.read(), "x", "y", "z", "_rescued_data") == [("1", "2", None, None), ("4", None, "3", None), ("7", "8", None, "7,8,9")]


def test_files_are_clustered_by_several_columns(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    df = spark.range(4096).select((F.col("id") % 64).alias("a"), F.floor(F.col("id") / 64).alias("b"), F.concat(F.lit("n"), F.lpad((F.col("id") % 64).cast("string"), 2, "0")).alias("s"), F.when(F.col("id") > 9, F.expr("date_add(DATE'2024-01-01', CAST(id % 64 AS INT))")).alias("d"))
    for columns in (["a", "b"], ["s", "b"], ["d", "b"]):
        t.replace(df.repartition(3))
        t.compact(columns, 16)
        spans = t.read().groupBy(F.col("_metadata.file_path")).agg(*(F.countDistinct(c).alias(c) for c in columns)).collect()
        assert len(spans) > 8 and t.read().count() == 4096
        assert sum(r[columns[0]] for r in spans) / len(spans) < 32 and sum(r[columns[1]] for r in spans) / len(spans) < 32


def test_examples_of_rejections_and_tallies(spark):
    from lakeweave.operators import quality

    rules = [quality.Rule("a", "", "x > 0"), quality.Rule("w", "", "x < 5", quality.WARN)]
    rows_ = quality.judged(spark.createDataFrame([(1,), (None,), (9,), (-1,)], "x int"), rules)
    assert quality.tallied(rows_, rules) == {"read": 4, "rejected": 2, "warning_w": 2}
    bin_ = quality.quarantine(rows_.where(F.size(quality.REASONS) > 0), "e", [], "silver", "b", "2024-01-01")
    assert quality.sample(bin_, 1).count() == 1 and set(quality.sample(bin_, 9).columns) == {"entidade", quality.REASONS, "registro_original"}


def test_tables_in_the_catalog(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.replace(spark.createDataFrame([(1, "a")], "k int, v string"))
    assert spark.sql(f"SELECT * FROM {t.register('held', 'lake_test')}").count() == 1
    t.append(spark.createDataFrame([(2, "b")], "k int, v string"))
    t.register("held_now", "lake_test")
    assert spark.sql("SELECT * FROM held_now").count() == 2
    spark.sql("DROP DATABASE lake_test CASCADE")
