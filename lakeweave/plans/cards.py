"""The card-transaction domain as entities: columns, rules, references and histories. Names of columns and values are its data contract."""

from __future__ import annotations

from lakeweave.operators.history import Versioning
from lakeweave.operators.quality import Rule
from lakeweave.plans.spec import Entity, Field, Reference

# Fixed values of the data contract.
STATES = "AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO".split()
ACCOUNT_STATUS = ("ATIVA", "ENCERRADA", "SUSPENSA", "BLOQUEADA")
CARD_STATUS = ("ATIVO", "CANCELADO", "BLOQUEADO")
CURRENCIES = ("BRL", "USD", "EUR")
SEVERITIES = ("BAIXA", "MEDIA", "ALTA", "CRITICA")


def required(name: str) -> Rule:
    return Rule(f"{name}_obrigatorio", f"{name} is there", f"{name} IS NOT NULL")


def one_of(name: str, values) -> Rule:
    return Rule(f"{name}_invalido", f"{name} is in its domain", f"{name} IN ({', '.join(repr(v) for v in values)})")


def audit_fields() -> tuple[Field, ...]:
    return Field("arquivo_origem", "string", "none"), Field("batch_id", "string", "none")


def versioned() -> tuple[Field, ...]:
    return Field("data_atualizacao", "timestamp"), Field("operacao", "string", "upper"), *audit_fields()


def entities(reference: str) -> dict[str, Entity]:
    """The entities in the order of their references; rules on dates use the run's reference date, never the clock."""
    today = f"DATE'{reference}'"
    stamped = (*audit_fields(), Field("timestamp_ingestao", "timestamp", "none"))
    all_entities = (
        Entity(
            "cliente", "clientes", "dim_cliente",
            (Field("id_cliente", "bigint"), Field("cpf", "string"), Field("nome", "string"), Field("cidade", "string"), Field("estado", "string", "upper"), Field("renda", "decimal(18,2)"), Field("segmento", "string", "upper"), *versioned()),
            (required("id_cliente"), required("cpf"), Rule("cpf_11_digitos", "cpf has eleven digits", r"cpf RLIKE '^[0-9]{11}$'"), Rule("renda_negativa", "income isn't negative", "renda IS NULL OR renda >= 0"), one_of("estado", STATES), required("data_atualizacao")),
            ("id_cliente",), kind="json",
            history=Versioning(("id_cliente",), "data_atualizacao", ("cpf", "nome", "cidade", "estado", "renda", "segmento"), "operacao"), cluster_by=("id_cliente",),
        ),
        Entity(
            "conta", "contas", "dim_conta",
            (Field("id_conta", "bigint"), Field("id_cliente", "bigint"), Field("tipo_conta", "string", "upper"), Field("status_conta", "string", "upper"), Field("data_abertura", "date"), *versioned()),
            (required("id_conta"), required("id_cliente"), one_of("status_conta", ACCOUNT_STATUS), Rule("data_abertura_futura", "not opened in the future", f"data_abertura <= {today}"), required("data_atualizacao")),
            ("id_conta",), references=(Reference("id_cliente", "cliente", "id_cliente", "cliente_inexistente"),),
            history=Versioning(("id_conta",), "data_atualizacao", ("id_cliente", "tipo_conta", "status_conta", "data_abertura"), "operacao"), cluster_by=("id_conta",),
        ),
        Entity(
            "cartao", "cartoes", "dim_cartao",
            (Field("id_cartao", "bigint"), Field("id_conta", "bigint"), Field("tipo_cartao", "string", "upper"), Field("limite", "decimal(18,2)"), Field("status_cartao", "string", "upper"), *versioned()),
            (required("id_cartao"), required("id_conta"), one_of("status_cartao", CARD_STATUS), Rule("limite_negativo", "limit isn't negative", "limite IS NULL OR limite >= 0"), required("data_atualizacao")),
            ("id_cartao",), references=(Reference("id_conta", "conta", "id_conta", "conta_inexistente"),),
            history=Versioning(("id_cartao",), "data_atualizacao", ("id_conta", "tipo_cartao", "limite", "status_cartao"), "operacao"), cluster_by=("id_cartao",),
        ),
        Entity(
            "transacao", "transacoes", "fato_transacao",
            (Field("id_transacao", "bigint"), Field("id_cartao", "bigint"), Field("data_transacao", "timestamp"), Field("valor", "decimal(18,2)"), Field("mcc", "int"), Field("estabelecimento", "string"), Field("canal", "string", "upper"), Field("pais", "string", "upper"), Field("moeda", "string", "upper"), Field("dispositivo", "string", "upper", optional=True), Field("data_particao", "date", expression="CAST(data_transacao AS DATE)"), *stamped),
            (required("id_transacao"), required("id_cartao"), Rule("valor_nao_positivo", "amount above zero", "valor > 0"), required("data_transacao"), Rule("data_futura", "not in the future", f"CAST(data_transacao AS DATE) <= {today}"), one_of("moeda", CURRENCIES)),
            ("id_transacao",), references=(Reference("id_cartao", "cartao", "id_cartao", "cartao_inexistente"),), partition_by=("data_particao",), cluster_by=("id_transacao",),
        ),
        Entity(
            "estorno", "estornos", "fato_estorno",
            (Field("id_estorno", "bigint"), Field("id_transacao", "bigint"), Field("data_estorno", "date"), Field("valor_estorno", "decimal(18,2)"), Field("motivo", "string", "upper"), *stamped),
            (required("id_estorno"), required("id_transacao"), Rule("valor_nao_positivo", "amount above zero", "valor_estorno > 0")),
            ("id_estorno",), references=(Reference("id_transacao", "transacao", "id_transacao", "transacao_inexistente"),), cluster_by=("id_transacao",),
        ),
        Entity(
            "evento_risco", "eventos_risco", "fato_evento_risco",
            (Field("id_evento", "bigint"), Field("id_transacao", "bigint"), Field("tipo_evento", "string", "upper"), Field("severidade", "string", "upper"), Field("data_evento", "date"), *stamped),
            (required("id_evento"), required("id_transacao"), one_of("severidade", SEVERITIES)),
            ("id_evento",), references=(Reference("id_transacao", "transacao", "id_transacao", "transacao_inexistente"),), cluster_by=("id_transacao",),
        ),
    )
    return {e.name: e for e in all_entities}
