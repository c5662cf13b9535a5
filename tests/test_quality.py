import json

import pytest
from pyspark.sql import functions as F

from helpers import rows
from lakeweave.operators import quality
from lakeweave.operators.quality import REASONS, WARN, Rule
from lakeweave.plans import cards

RULES = [Rule("a", "", "x > 0"), Rule("b", "", "y IS NOT NULL"), Rule("w", "", "x < 5", WARN)]


def frame(spark):
    return spark.createDataFrame([(1, "p"), (-1, None), (None, "q"), (9, "r")], "x int, y string")


def test_reasons_keep_order_and_null_is_a_violation(spark):
    passed, failed = quality.split(frame(spark), RULES)
    assert rows(passed) == [(1, "p"), (9, "r")]
    assert rows(failed, REASONS) == [(["a", "b"],), (["a"],)]


def test_without_blocking_rules_all_pass(spark):
    for rules in ([], RULES[2:]):
        passed, failed = quality.split(frame(spark), rules)
        assert passed.count() == 4 and failed.count() == 0 and failed.schema[REASONS].dataType.simpleString() == "array<string>"


def test_warnings_are_counted(spark):
    df, seen = quality.observed(frame(spark), RULES)
    df.collect()
    assert seen.get == {"rows": 4, "a": 2, "b": 1, "w": 2}


def test_references(spark):
    child = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, fk int")
    parent = spark.createDataFrame([(10,), (10,), (None,)], "pk int")
    kept, orphans = quality.references(child, parent, "fk", "pk", "gone")
    assert rows(kept) == [(1, 10)] and rows(orphans) == [(2, 20, ["gone"]), (3, None, ["gone"])]


def test_quarantine_is_by_business_columns_and_reasons(spark):
    failed = quality.split(frame(spark), RULES)[1].withColumn("arquivo_origem", F.monotonically_increasing_id().cast("string"))
    q = quality.quarantine(failed.union(failed), "e", ["arquivo_origem"], "silver", "b", "2024-01-01")
    assert q.count() == 2
    other = quality.quarantine(failed.withColumn(REASONS, F.array(F.lit("z"))), "e", ["arquivo_origem"], "silver", "b", "2024-01-01")
    assert other.join(q, "hash_rejeicao").count() == 0
    assert json.loads(q.where(F.size(REASONS) == 1).first()["registro_original"])["y"] == "q"
    with pytest.raises(ValueError):
        quality.quarantine(frame(spark), "e", [], "silver", "b", "2024-01-01")


@pytest.mark.parametrize(
    ("entity", "good", "bad"),
    [
        ("cliente", {"id_cliente": "1", "cpf": "'00000000001'", "estado": "'SP'", "renda": "1", "data_atualizacao": "current_timestamp()"}, {"cpf": "'123'", "estado": "'ZZ'", "renda": "-1", "id_cliente": "null"}),
        ("conta", {"id_conta": "1", "id_cliente": "1", "status_conta": "'ATIVA'", "data_abertura": "DATE'2024-01-01'", "data_atualizacao": "current_timestamp()"}, {"status_conta": "'X'", "data_abertura": "DATE'2030-01-01'"}),
        ("cartao", {"id_cartao": "1", "id_conta": "1", "status_cartao": "'ATIVO'", "limite": "null", "data_atualizacao": "current_timestamp()"}, {"status_cartao": "'X'", "limite": "-5"}),
        ("transacao", {"id_transacao": "1", "id_cartao": "1", "valor": "1", "data_transacao": "TIMESTAMP'2024-01-01'", "moeda": "'BRL'"}, {"valor": "0", "moeda": "'XXX'", "data_transacao": "TIMESTAMP'2030-01-01'"}),
        ("estorno", {"id_estorno": "1", "id_transacao": "1", "valor_estorno": "1"}, {"valor_estorno": "0", "id_transacao": "null"}),
        ("evento_risco", {"id_evento": "1", "id_transacao": "1", "severidade": "'ALTA'"}, {"severidade": "'X'"}),
    ],
)
def test_domain_rules(spark, entity, good, bad):
    rules = list(cards.entities("2024-06-30")[entity].rules)
    make = lambda v: spark.range(1).select(*(F.expr(x).alias(c) for c, x in v.items()))
    assert quality.split(make(good), rules)[1].count() == 0
    for c, x in bad.items():
        assert quality.split(make(good | {c: x}), rules)[1].count() == 1, c
