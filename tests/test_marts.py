from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakeweave.operators.ranking import numbered, tied, tile
from lakeweave.plans import marts


def dim(spark, schema, *given):
    return spark.createDataFrame(list(given), schema + ", dw_inicio_vigencia string, dw_fim_vigencia string, dw_versao_ativa boolean, dw_excluido boolean").withColumns({c: F.col(c).cast("timestamp") for c in ("dw_inicio_vigencia", "dw_fim_vigencia")})


@pytest.fixture(scope="module")
def fact(spark):
    t = spark.createDataFrame([(k, c, t, Decimal("100.00"), 5411, "L", "POS", "BR", "BRL", None, t[:10]) for k, c, t in ((1, 1, "2024-01-10 10:00:00"), (2, 1, "2024-02-10 10:00:00"), (3, 9, "2024-01-10 10:00:00"), (4, 1, "2024-03-05 10:00:00"))], "id_transacao long, id_cartao long, data_transacao string, valor decimal(18,2), mcc int, estabelecimento string, canal string, pais string, moeda string, dispositivo string, data_particao string")
    t = t.withColumns({"data_transacao": F.col("data_transacao").cast("timestamp"), "data_particao": F.col("data_particao").cast("date")})
    r = spark.createDataFrame([(1, 1, "2024-01-11", Decimal("30.00"), "B"), (2, 1, "2024-01-12", Decimal("70.00"), "A"), (3, 2, "2024-02-12", Decimal("10.00"), "C")], "id_estorno long, id_transacao long, data_estorno string, valor_estorno decimal(18,2), motivo string").withColumn("data_estorno", F.col("data_estorno").cast("date"))
    cards = dim(spark, "id_cartao long, id_conta long, tipo_cartao string, limite decimal(18,2), status_cartao string", (1, 1, "CREDITO", Decimal(10), "ATIVO", "2024-01-01", "2024-03-01", False, False), (1, 1, "CREDITO", Decimal(10), "CANCELADO", "2024-03-01", None, True, False))
    accounts = dim(spark, "id_conta long, id_cliente long, tipo_conta string, status_conta string", (1, 7, "CORRENTE", "ATIVA", "2024-01-01", None, True, False))
    clients = dim(spark, "id_cliente long, nome string, cidade string, estado string, segmento string, renda decimal(18,2)", (7, "n", "SP", "SP", "OLD", Decimal(1000), "2024-01-01", "2024-02-01", False, False), (7, "n", "SP", "SP", "NEW", Decimal(2000), "2024-02-01", None, True, False))
    return marts.enriched_fact(t, r, cards, accounts, clients), clients, spark


def test_fact(fact):
    found = {r["id_transacao"]: r for r in fact[0].collect()}
    assert len(found) == 4
    assert (found[1]["valor_estornado"], found[1]["valor_liquido"], found[1]["estorno_total"], found[1]["qtd_estornos"], found[1]["motivo_estorno"]) == (Decimal("100.00"), Decimal("0.00"), True, 2, "B")
    assert (found[2]["valor_liquido"], found[2]["foi_estornada"], found[2]["estorno_total"]) == (Decimal("90.00"), True, False)
    assert found[1]["segmento_na_data"] == "OLD" and found[2]["segmento_na_data"] == "NEW"
    assert [found[k]["elegivel_metrica"] for k in (1, 2, 3, 4)] == [True, True, False, False]
    assert found[3]["id_cliente"] is None and dict(fact[0].dtypes)["valor_liquido"] == "decimal(18,2)"


def test_products(fact):
    f, clients, spark = fact
    month = marts.client_month(f, clients)
    assert {r["ano_mes"]: (r["qtd_transacoes"], r["percentual_estornado"], r["segmento"]) for r in month.collect()} == {"2024-01": (1, 100.0, "NEW"), "2024-02": (1, 10.0, "NEW")}
    events = spark.createDataFrame([(1, 1, "CHARGEBACK", "ALTA"), (2, 1, "FRAUDE_CONFIRMADA", "BAIXA")], "id_evento long, id_transacao long, tipo_evento string, severidade string")
    day = {str(r["data_particao"]): r for r in marts.risk_by_day(f, events).collect()}
    assert (day["2024-01-10"]["qtd_transacoes"], day["2024-01-10"]["qtd_chargeback"], day["2024-01-10"]["taxa_risco_pct"], day["2024-01-10"]["valor_em_fraude"]) == (2, 1, 50.0, Decimal("100.00"))
    one = marts.client_features(month, f, clients, "2024-02-20").first()
    assert (one["f_qtd_transacoes_total"], one["f_qtd_transacoes_30d"], one["f_recencia_dias"], one["f_qtd_meses_ativos"]) == (2, 1, 10, 2)
    assert marts.merchants(f).first()["qtd_transacoes"] == 4
    assert [r["segmento"] for r in marts.current_dimension(clients, ["id_cliente", "segmento"]).collect()] == ["NEW"]


@pytest.mark.parametrize("n", [1, 3, 10, 23])
def test_tiles_are_those_of_ntile(spark, n):
    df = spark.range(n).select(F.col("id"), (F.col("id") % 3).alias("v"))
    placed = numbered(df, [F.col("v"), F.col("id")], "p", {"v": "up_to"})
    found = placed.select("id", tile(F.col("p"), F.col("p_total"), 4).alias("t"), "p", "up_to", "up_to_total")
    df.createOrReplaceTempView("tiled")
    want = spark.sql("SELECT id, CAST(ntile(4) OVER (ORDER BY v, id) AS BIGINT) AS t, row_number() OVER (ORDER BY v, id) AS p, sum(v) OVER (ORDER BY v, id) AS up_to, sum(v) OVER () AS up_to_total FROM tiled")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_refund_of_any_amount_counts_and_ratios_follow_the_contract(fact):
    f, clients, spark = fact
    month = {r["ano_mes"]: r for r in marts.client_month(f, clients).collect()}
    assert month["2024-02"]["comprometimento_renda"] == 4.5 and month["2024-01"]["qtd_cartoes_usados"] == 1
    one = marts.client_features(marts.client_month(f, clients), f, clients, "2024-02-20").first()
    assert one["f_frequencia_mensal"] == pytest.approx(2 / (41 / 30)) and one["f_perc_ecommerce"] == 0.0 and one["f_qtd_exterior"] == 0
    assert one["f_dias_ativos"] == 2 and one["f_comprometimento_renda"] == pytest.approx(45 / 2000)


def test_ties_share_ranks(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, None)], "id int, v int")
    placed = tied(numbered(df, [F.col("v"), F.col("id")], "p"), "v", "p")
    assert sorted((r["id"], r["p_first"], r["p_last"]) for r in placed.collect()) == [(1, 2, 3), (2, 2, 3), (3, 4, 4), (4, 1, 1)]


@pytest.mark.parametrize(("x", "want"), [(0.12499995, 0.12), (-2.345, -2.35), (2.345, 2.35), (0.125, 0.13), (None, None)])
def test_rounding_is_that_of_decimals(spark, x, want):
    from lakeweave.functions.columns import rounded

    assert spark.createDataFrame([(x,)], "x double").select(rounded(F.col("x"))).first()[0] == want
