"""The registered queries: every operator applied to the driver's tables, each with the SQL of an independent engine.

The domain is mapped onto the tables: a sale is an order line (one per order and line number), a refund a returned
line, a card a customer whose orders are its change feed, a risk event an event on an order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions.columns import classify, delimited_hash, differs, guarded_ratio, layout_fingerprint, money, month_of, normalized, rounded, row_hash, tolerant_cast, trimmed
from lakeweave.operators import history, joins, ordering, quality
from lakeweave.operators.history import Versioning
from lakeweave.operators.quality import Rule
from lakeweave.plans import insight, marts
from lakeweave.sources.scratch import application_dir
from lakeweave.sources.store import SnapshotTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
REFERENCE = "2001-08-01"
INSTANT = "1998-06-15 00:00:00"


def registered(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The domain over the tables, as DataFrames and as SQL.

LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
LINES_SQL = f"lines AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in LINE_ORDER)}) = 1)"


def lines(spark, sf):
    return ordering.latest(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER)


def sales(spark, sf):
    """The enriched fact's columns over order lines."""
    o, c, n, p = (read(spark, sf, t) for t in ("orders", "customer", "nation", "part"))
    d = lines(spark, sf).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    gross = money("l_extendedprice")
    back = F.when(F.col("l_returnflag") == "R", gross).otherwise(F.lit(0).cast("decimal(18,2)"))
    return d.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id_transacao"), F.col("l_suppkey").alias("id_cartao"), F.col("o_custkey").alias("id_cliente"), F.col("l_shipdate").alias("data_transacao"), F.col("l_shipdate").cast("date").alias("data_particao"), month_of("l_shipdate").alias("ano_mes"),
        gross.alias("valor_bruto"), back.alias("valor_estornado"), money(gross - back).alias("valor_liquido"), (F.col("l_returnflag") == "R").alias("foi_estornada"), F.col("p_size").alias("mcc"), F.concat(F.lit("LOJA "), F.col("l_suppkey").cast("string")).alias("estabelecimento"),
        F.when(F.col("l_linestatus") == "O", "ECOMMERCE").otherwise("POS").alias("canal"), F.when(F.col("n_regionkey") == 1, "BR").otherwise("US").alias("pais"), F.col("c_mktsegment").alias("segmento_na_data"), F.col("n_name").alias("cidade_na_data"), F.substring("n_name", 1, 2).alias("estado_na_data"), (F.col("o_orderstatus") != "P").alias("elegivel_metrica"),
    )


SALES_SQL = LINES_SQL + """,
sales AS (
  SELECT l_orderkey * 10 + l_linenumber AS id_transacao, l_suppkey AS id_cartao, o_custkey AS id_cliente, l_shipdate AS data_transacao,
    l_shipdate::date AS data_particao, strftime(l_shipdate, '%Y-%m') AS ano_mes, l_extendedprice::decimal(18,2) AS valor_bruto,
    CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END::decimal(18,2) AS valor_estornado,
    CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice END::decimal(18,2) AS valor_liquido,
    l_returnflag = 'R' AS foi_estornada, p_size AS mcc, 'LOJA ' || l_suppkey::varchar AS estabelecimento,
    CASE WHEN l_linestatus = 'O' THEN 'ECOMMERCE' ELSE 'POS' END AS canal, CASE WHEN n_regionkey = 1 THEN 'BR' ELSE 'US' END AS pais,
    c_mktsegment AS segmento_na_data, n_name AS cidade_na_data, left(n_name, 2) AS estado_na_data, o_orderstatus <> 'P' AS elegivel_metrica
  FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey
)"""

CARD = Versioning(("id_cartao",), "data_atualizacao", ("status_cartao", "tipo_cartao"), "operacao")


def feed(spark, sf, where="true"):
    """Orders as the change feed of their customers."""
    deleted = F.when(F.col("o_orderstatus") == "P", "DELETE").otherwise("UPDATE")
    return read(spark, sf, "orders").where(where).select(F.col("o_custkey").alias("id_cartao"), F.col("o_orderdate").alias("data_atualizacao"), F.col("o_orderstatus").alias("status_cartao"), F.col("o_orderpriority").alias("tipo_cartao"), deleted.alias("operacao"))


def cards(spark, sf):
    return history.timeline(feed(spark, sf), CARD)


def timeline_sql(where: str = "true", name: str = "tl") -> str:
    return f"""{name}_e AS (SELECT o_custkey AS id_cartao, o_orderdate AS v, o_orderstatus AS status_cartao, o_orderpriority AS tipo_cartao, o_orderstatus = 'P' AS dw_excluido, sha256(to_json([o_orderstatus, o_orderpriority])::varchar) AS hash FROM orders WHERE {where}),
{name}_p AS (SELECT * FROM {name}_e QUALIFY row_number() OVER (PARTITION BY id_cartao, v ORDER BY hash DESC, dw_excluido DESC) = 1),
{name}_c AS (SELECT * FROM {name}_p QUALIFY NOT (lag(hash) OVER (PARTITION BY id_cartao ORDER BY v) IS NOT DISTINCT FROM hash AND lag(dw_excluido) OVER (PARTITION BY id_cartao ORDER BY v) IS NOT DISTINCT FROM dw_excluido)),
{name} AS (SELECT *, v AS dw_inicio_vigencia, lead(v) OVER (PARTITION BY id_cartao ORDER BY v) AS dw_fim_vigencia, lead(v) OVER (PARTITION BY id_cartao ORDER BY v) IS NULL AND NOT dw_excluido AS dw_versao_ativa FROM {name}_c)"""


TL_COLUMNS = ["id_cartao", "status_cartao", "tipo_cartao", "dw_inicio_vigencia", "dw_fim_vigencia", "dw_versao_ativa", "dw_excluido"]
TL = ", ".join(TL_COLUMNS)


def run_log(spark, sf):
    e = read(spark, sf, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.select(F.concat(F.lit("b"), day).alias("batch_id"), day.alias("data_referencia"), F.when(F.col("user_id") % 2 == 0, "silver").otherwise("gold").alias("camada"), F.col("event_type").alias("etapa"), F.concat(F.lit("e"), (F.col("user_id") % 5).cast("string")).alias("entidade"), (F.col("event_id") % 100).alias("linhas_lidas"), (F.col("event_id") % 97).alias("linhas_gravadas"), (F.col("event_id") % 7).alias("linhas_rejeitadas"), F.round("value", 1).alias("duracao_segundos"), F.when(F.col("event_type") == "error", "FALHA").otherwise("SUCESSO").alias("status"), F.col("props").alias("detalhe_erro"), F.col("ts").alias("iniciado_em"))


LOG_SQL = """log AS (SELECT 'b' || strftime(ts, '%Y-%m-%d') AS batch_id, strftime(ts, '%Y-%m-%d') AS data_referencia, CASE WHEN user_id % 2 = 0 THEN 'silver' ELSE 'gold' END AS camada, event_type AS etapa, 'e' || (user_id % 5)::varchar AS entidade, event_id % 100 AS linhas_lidas, event_id % 97 AS linhas_gravadas, event_id % 7 AS linhas_rejeitadas, round(value, 1) AS duracao_segundos, CASE WHEN event_type = 'error' THEN 'FALHA' ELSE 'SUCESSO' END AS status, props AS detalhe_erro, ts AS iniciado_em FROM events)"""

RULES = [
    Rule("saldo_negativo", "balance isn't negative", "c_acctbal >= 0"),
    Rule("segmento_invalido", "segment in its domain", "c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')"),
    Rule("nome_invalido", "name ends in a digit that isn't 7", "c_name RLIKE '[0-689]$'"),
    Rule("saldo_alto", "a warning", "c_acctbal < 9000", quality.WARN),
]
REASONS_SQL = "list_filter([CASE WHEN NOT coalesce(c_acctbal >= 0, false) THEN 'saldo_negativo' END, CASE WHEN NOT coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'), false) THEN 'segmento_invalido' END, CASE WHEN NOT coalesce(regexp_matches(c_name, '[0-689]$'), false) THEN 'nome_invalido' END], lambda x: x IS NOT NULL)"


def r2(x: str, digits: int = 2) -> str:
    """Rounded half away from zero as a decimal."""
    return f"round(({x})::double::decimal(30,8), {digits})::double"


def over(value: str, base: str) -> str:
    return f"CASE WHEN {base} > 0 THEN {r2(f'({value} - {base}) * 100.0::double / {base}')} END"


def pct(part: str, whole: str, digits: int = 2, otherwise: str = "NULL") -> str:
    """part / whole x 100, rounded, where the whole is positive."""
    return f"CASE WHEN {whole} > 0 THEN {r2(f'({part})::double * 100::double / ({whole})::double', digits)} ELSE {otherwise} END"


def mean(x: str, kind: str = "decimal(22,6)") -> str:
    """The exact mean of amounts in cents, rounded to six digits."""
    total = f"(sum({x}) * 100)::hugeint"
    return f"(sign({total}) * ((2 * abs({total}) * 10000 + count({x})) // (2 * count({x})))::double / 1000000)::{kind}"


def store(spark, name) -> SnapshotTable:
    return SnapshotTable(spark, f"{application_dir(spark)}/store/{name}-{uuid.uuid4().hex}")


# Columns and rows.


@registered("SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 3 = 0 THEN 'x' || o_totalprice::varchar ELSE round(o_totalprice)::bigint::varchar END AS decimal(18,2)) AS valor, try_cast(CASE WHEN o_orderkey % 5 = 0 THEN 'never' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date) AS dia, try_cast(o_orderpriority AS integer) AS numero FROM orders")
def tolerant_casts(spark, sf):
    o = read(spark, sf, "orders")
    value = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), F.col("o_totalprice").cast("string"))).otherwise(F.round("o_totalprice").cast("long").cast("string"))
    day = F.when(F.col("o_orderkey") % 5 == 0, "never").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", tolerant_cast(value, "decimal(18,2)").alias("valor"), tolerant_cast(day, "date").alias("dia"), tolerant_cast("o_orderpriority", "int").alias("numero"))


@registered("SELECT c_custkey, trim('  ' || c_name || ' ') AS nome, upper(trim(' ' || lower(c_mktsegment) || '  ')) AS segmento FROM customer")
def text_normalize(spark, sf):
    c = read(spark, sf, "customer")
    return c.select("c_custkey", trimmed(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("nome"), normalized(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("  "))).alias("segmento"))


@registered("SELECT o_orderkey, sha256(to_json([o_orderkey::varchar, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END])::varchar) AS hash_linha, sha256(o_orderkey::varchar || '||' || o_orderstatus || '||' || coalesce(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END, '<null>')) AS hash_unido FROM orders")
def row_hashes(spark, sf):
    o = read(spark, sf, "orders").withColumn("p", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")))
    names = ["o_orderkey", "o_orderstatus", "p"]
    return o.select("o_orderkey", row_hash(names).alias("hash_linha"), delimited_hash(names).alias("hash_unido"))


@registered("SELECT left(sha256('c_acctbal,c_custkey,c_mktsegment,c_name,c_nationkey'), 12) AS layout, count(*) AS linhas FROM customer")
def layout_version(spark, sf):
    c = read(spark, sf, "customer")
    return c.agg(F.lit(layout_fingerprint(c.columns)).alias("layout"), F.count("*").alias("linhas"))


@registered(f"SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN {r2('c_custkey / c_acctbal', 4)} END AS razao, CASE WHEN c_acctbal > 0 THEN {r2('c_custkey / c_acctbal', 4)} ELSE 0.0::double END AS razao_zero, CASE WHEN c_acctbal < 0 THEN 'NEGATIVO' WHEN c_acctbal < 5000 THEN 'BAIXO' ELSE 'ALTO' END AS faixa, nullif(c_mktsegment, 'BUILDING') IS DISTINCT FROM c_mktsegment AS mudou FROM customer")
def guarded_columns(spark, sf):
    ratio = F.col("c_custkey") / F.col("c_acctbal")
    return read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, rounded(guarded_ratio(F.col("c_custkey").cast("double"), F.col("c_acctbal")), 4)).alias("razao"), F.when(F.col("c_acctbal") > 0, rounded(ratio, 4)).otherwise(F.lit(0.0)).alias("razao_zero"), classify((F.col("c_acctbal") < 0, "NEGATIVO"), (F.col("c_acctbal") < 5000, "BAIXO"), otherwise="ALTO").alias("faixa"), differs(F.nullif("c_mktsegment", F.lit("BUILDING")), "c_mktsegment").alias("mudou"))


@registered("SELECT event_id, (props::json->>'k')::bigint AS k, to_json({'event_id': event_id, 'event_type': event_type})::varchar AS registro FROM events")
def json_roundtrip(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("registro"))


@registered("SELECT o_orderkey, o_orderpriority, NULL::varchar AS dispositivo FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' UNION ALL SELECT o_orderkey, o_orderpriority, 'MOBILE' AS dispositivo FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def evolving_union(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    old, new = o.where("o_orderdate < timestamp_ntz'1998-01-01'"), o.where("o_orderdate >= timestamp_ntz'1998-01-01'").withColumn("dispositivo", F.lit("MOBILE"))
    return joins.evolving_union(old, new).drop("o_orderdate")


@registered("SELECT o_orderkey, o_orderdate::date AS dia, datediff('day', o_orderdate::date, DATE '2001-08-01') AS recencia FROM orders WHERE o_orderdate::date >= DATE '2001-08-01' - 30")
def trailing_days(spark, sf):
    from lakeweave.functions.columns import since

    o = read(spark, sf, "orders").withColumn("dia", F.col("o_orderdate").cast("date"))
    return o.where(since("dia", REFERENCE, 30)).select("o_orderkey", "dia", F.datediff(F.lit(REFERENCE).cast("date"), "dia").cast("long").alias("recencia"))


# Quality.


@registered(f"SELECT c_custkey, {REASONS_SQL} AS motivos_rejeicao FROM customer")
def rule_reasons(spark, sf):
    return quality.judged(read(spark, sf, "customer"), RULES).select("c_custkey", quality.REASONS)


@registered(f"SELECT c_custkey, c_name FROM customer WHERE len({REASONS_SQL}) = 0")
def rule_pass(spark, sf):
    return quality.split(read(spark, sf, "customer"), RULES)[0].select("c_custkey", "c_name")


@registered(f"SELECT c_custkey, {REASONS_SQL} AS motivos_rejeicao FROM customer WHERE len({REASONS_SQL}) > 0")
def rule_fail(spark, sf):
    return quality.split(read(spark, sf, "customer"), RULES)[1].select("c_custkey", quality.REASONS)


@registered("SELECT count(*) AS linhas, count(*) FILTER (WHERE c_custkey % 2 = 0 OR c_acctbal < 0) AS violacoes FROM customer")
def null_is_violation(spark, sf):
    c = read(spark, sf, "customer").withColumn("saldo", F.when(F.col("c_custkey") % 2 == 1, F.col("c_acctbal")))
    return c.agg(F.count("*").alias("linhas"), F.count_if(Rule("r", "", "saldo >= 0").violated()).alias("violacoes"))


@registered("SELECT s_suppkey, s_acctbal < 0 AS negativo FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)")
def fk_intact(spark, sf):
    parent = read(spark, sf, "nation").where("n_regionkey <> 2")
    return quality.references(read(spark, sf, "supplier"), parent.union(parent), "s_nationkey", "n_nationkey", "nacao_inexistente")[0].select("s_suppkey", (F.col("s_acctbal") < 0).alias("negativo"))


ORPHAN_SQL = "SELECT c_custkey, ['nacao_inexistente'] AS motivos_rejeicao FROM (SELECT *, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS fk FROM customer) WHERE fk IS NULL OR fk NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)"


@registered(ORPHAN_SQL)
def fk_orphans(spark, sf):
    child = read(spark, sf, "customer").withColumn("fk", F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey")))
    return quality.references(child, read(spark, sf, "nation").where("n_regionkey <> 2"), "fk", "n_nationkey", "nacao_inexistente")[1].select("c_custkey", quality.REASONS)


def rejected(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    failed = quality.split(c, RULES)[1].drop("c_acctbal")
    return quality.quarantine(failed.union(failed), "cliente", [], "silver", "b1", REFERENCE)


@registered(f"""WITH r AS (SELECT c_custkey, c_name, c_mktsegment, {REASONS_SQL} AS motivos_rejeicao FROM customer WHERE len({REASONS_SQL}) > 0)
SELECT 'cliente' AS entidade, 'silver' AS camada_origem, motivos_rejeicao, to_json({{'c_custkey': c_custkey, 'c_name': c_name, 'c_mktsegment': c_mktsegment}})::varchar AS registro_original,
sha256('cliente|' || sha256(to_json([c_custkey::varchar, c_name, c_mktsegment])::varchar) || '|' || array_to_string(list_sort(motivos_rejeicao), ',')) AS hash_rejeicao FROM r""")
def quarantine_rows(spark, sf):
    return rejected(spark, sf).select("entidade", "camada_origem", quality.REASONS, "registro_original", "hash_rejeicao")


@registered(f"SELECT motivo, count(*) AS qtd FROM (SELECT unnest({REASONS_SQL}) AS motivo FROM customer) GROUP BY motivo")
def reason_histogram(spark, sf):
    return quality.histogram(quality.split(read(spark, sf, "customer"), RULES)[1])


# De-duplication, upserts, storage.


@registered(f"WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_extendedprice FROM lines")
def dedup_latest(spark, sf):
    return lines(spark, sf).select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice")


@registered("SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert_latest(spark, sf):
    """All orders; those since 1999 come as changes, half of them of known keys."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    recent = "o_orderdate >= timestamp_ntz'1999-01-01'"
    t = store(spark, "upsert")
    t.replace(o.where(f"o_orderkey % 2 = 0 OR NOT {recent}").select("o_orderkey", "o_orderstatus"))
    t.upsert(o.where(recent).select("o_orderkey", F.lit("X").alias("o_orderstatus")), ["o_orderkey"])
    return t.read()


@registered("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS lote FROM orders")
def insert_if_absent(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey")
    t = store(spark, "insert")
    t.replace(o.where("o_orderkey % 2 = 0").withColumn("lote", F.lit("old")))
    for _ in range(2):
        t.insert_new(o.withColumn("lote", F.lit("new")), ["o_orderkey"])
    return t.read()


@registered("SELECT l_returnflag, count(*) AS linhas, sum(l_extendedprice::decimal(18,2))::decimal(38,2) AS valor FROM lineitem GROUP BY l_returnflag")
def compacted_scan(spark, sf):
    t = store(spark, "compact")
    t.append(read(spark, sf, "lineitem").where("l_linenumber <= 3"))
    t.append(read(spark, sf, "lineitem").where("l_linenumber > 3"))
    t.compact(["l_orderkey", "l_shipdate"], 4)
    return t.read().groupBy("l_returnflag").agg(F.count("*").alias("linhas"), F.sum(money("l_extendedprice")).cast("decimal(38,2)").alias("valor"))


@registered("SELECT o_orderkey::varchar AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def stream_ingest(spark, sf):
    from lakeweave.streaming.landing_stream import ingest_stream

    raw = store(spark, "stream")
    read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").write.option("header", True).csv(f"{raw.path}-landing")
    for _ in range(2):
        ingest_stream(spark, f"{raw.path}-landing", raw, f"{raw.path}-checkpoint", "b1", REFERENCE)
    return raw.read().select("o_orderkey", "o_orderstatus", "o_orderpriority")


@registered("SELECT o_orderkey::varchar AS o_orderkey, o_orderstatus, o_orderpriority, '2001-08-01'::date AS data_ingestao, 'b1' AS batch_id, left(sha256('o_orderkey,o_orderpriority,o_orderstatus'), 12) AS schema_version, sha256(to_json([o_orderkey::varchar, o_orderstatus, o_orderpriority])::varchar) AS hash_linha FROM orders")
def batch_ingest(spark, sf):
    from lakeweave.sources.landing import ingest

    raw = store(spark, "batch")
    read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").write.option("header", True).csv(f"{raw.path}-landing")
    for k in range(2):
        ingest(spark, f"{raw.path}-landing", "csv", raw, f"b{k + 1}", REFERENCE)
    return raw.read().drop("arquivo_origem", "timestamp_ingestao")


# History.


@registered(f"WITH {timeline_sql()} SELECT {TL} FROM tl")
def timeline(spark, sf):
    return cards(spark, sf).select(*TL_COLUMNS)


@registered(f"WITH {timeline_sql()} SELECT id_cartao, v AS data_atualizacao, hash AS dw_hash_atributos FROM tl_p")
def timeline_conflict(spark, sf):
    return history.prepared(feed(spark, sf), CARD).select("id_cartao", "data_atualizacao", history.HASH)


EARLY, REST = "o_orderdate < TIMESTAMP '1997-01-01'", "o_orderdate >= TIMESTAMP '1996-07-01'"


@registered(f"""WITH {timeline_sql(EARLY)}, {timeline_sql(REST, 'nw')}, latest AS (SELECT id_cartao, v AS start, hash, dw_excluido AS gone FROM tl QUALIFY row_number() OVER (PARTITION BY id_cartao ORDER BY v DESC) = 1)
SELECT status, count(*) AS qtd FROM (SELECT CASE WHEN start IS NULL OR v > start THEN 'applicable' WHEN l.hash = p.hash AND gone = dw_excluido THEN 'unchanged' ELSE 'late' END AS status FROM nw_p p LEFT JOIN latest l USING (id_cartao)) GROUP BY status""")
def scd_classify(spark, sf):
    existing = history.timeline(feed(spark, sf, EARLY), CARD)
    return history.classified(existing, feed(spark, sf, REST), CARD).groupBy(F.col("_status").alias("status")).agg(F.count("*").alias("qtd"))


@registered(f"WITH {timeline_sql()} SELECT {TL} FROM tl")
def scd_apply(spark, sf):
    """Two loads without late events make the history of one."""
    existing = history.timeline(feed(spark, sf, EARLY), CARD)
    return history.applied(existing, feed(spark, sf), CARD).select(*TL_COLUMNS)


@registered(f"WITH {timeline_sql()} SELECT {TL} FROM tl WHERE dw_inicio_vigencia <= TIMESTAMP '{INSTANT}' AND (dw_fim_vigencia IS NULL OR dw_fim_vigencia > TIMESTAMP '{INSTANT}') AND NOT dw_excluido")
def as_of_instant(spark, sf):
    return insight.at_instant(cards(spark, sf), INSTANT).select(*TL_COLUMNS)


@registered(f"WITH {timeline_sql()} SELECT id_cartao, status_cartao, tipo_cartao, dw_inicio_vigencia AS vigente_desde FROM tl WHERE dw_versao_ativa AND NOT dw_excluido")
def current_dims(spark, sf):
    return marts.current_dimension(cards(spark, sf), ["id_cartao", "status_cartao", "tipo_cartao"])


@registered(f"""
WITH {timeline_sql()},
priced AS (SELECT *, (id_cartao % 50 + 100 * (1 + month(dw_inicio_vigencia) % 5))::decimal(18,2) AS renda FROM tl)
SELECT id_cartao, dw_inicio_vigencia, dw_fim_vigencia, dw_versao_ativa, dw_excluido, status_cartao, tipo_cartao, renda,
  row_number() OVER w AS versao,
  datediff('day', dw_inicio_vigencia::date, coalesce(dw_fim_vigencia::date, DATE '{REFERENCE}')) AS dias_de_vigencia,
  first_value(dw_inicio_vigencia) OVER w AS primeira_vigencia, lead(dw_inicio_vigencia) OVER w AS inicio_da_proxima,
  lag(status_cartao) OVER w AS status_cartao_anterior, lag(tipo_cartao) OVER w AS tipo_cartao_anterior,
  CASE WHEN status_cartao IS DISTINCT FROM lag(status_cartao) OVER w THEN 'SIM' ELSE 'NAO' END AS mudou_status_cartao,
  CASE WHEN tipo_cartao IS DISTINCT FROM lag(tipo_cartao) OVER w THEN 'SIM' ELSE 'NAO' END AS mudou_tipo_cartao,
  last_value(status_cartao) OVER a AS status_cartao_atual, last_value(tipo_cartao) OVER a AS tipo_cartao_atual,
  CASE WHEN lag(renda) OVER w > 0 THEN {r2('(renda - lag(renda) OVER w)::double * 100.0::double / (lag(renda) OVER w)::double')} END AS variacao_renda_pct,
  CASE WHEN dw_fim_vigencia IS DISTINCT FROM lead(dw_inicio_vigencia) OVER w THEN 'INCONSISTENTE' ELSE 'OK' END AS consistencia_da_linha_do_tempo
FROM priced
WINDOW w AS (PARTITION BY id_cartao ORDER BY dw_inicio_vigencia), a AS (PARTITION BY id_cartao ORDER BY dw_inicio_vigencia ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def timeline_diff(spark, sf):
    income = (F.col("id_cartao") % 50 + 100 * (1 + F.month(history.START) % 5)).cast("decimal(18,2)")
    return insight.timeline_report(cards(spark, sf).withColumn("renda", income), "id_cartao", ("status_cartao", "tipo_cartao"), REFERENCE, ("renda",))


@registered(f"""WITH {timeline_sql()} SELECT id_cartao, dw_inicio_vigencia, (row_number() OVER w)::bigint AS numero_versao, row_number() OVER w > 1 AND status_cartao IS DISTINCT FROM lag(status_cartao) OVER w AS mudou_status_cartao, row_number() OVER w = 1 OR lag(dw_fim_vigencia) OVER w IS NOT DISTINCT FROM dw_inicio_vigencia AS consistente FROM tl WINDOW w AS (PARTITION BY id_cartao ORDER BY dw_inicio_vigencia)""")
def version_changes(spark, sf):
    return history.changes(cards(spark, sf), CARD).select("id_cartao", "dw_inicio_vigencia", F.col("numero_versao").cast("long").alias("numero_versao"), "mudou_status_cartao", "consistente")


def broken(spark, sf):
    """The timeline with seeded faults: active versions reopened, ends before starts, ends that leave gaps."""
    k = F.col("id_cartao")
    start = F.col(history.START)
    ends = F.when(k % 11 == 0, start - F.expr("INTERVAL 1 DAY")).when(k % 13 == 0, F.col(history.END) - F.expr("INTERVAL 1 HOUR")).otherwise(F.col(history.END))
    return cards(spark, sf).withColumns({history.END: ends, history.ACTIVE: F.col(history.ACTIVE) | (k % 7 == 0)})


BROKEN_SQL = timeline_sql() + ", bad AS (SELECT id_cartao, dw_inicio_vigencia, CASE WHEN id_cartao % 11 = 0 THEN dw_inicio_vigencia - INTERVAL 1 DAY WHEN id_cartao % 13 = 0 THEN dw_fim_vigencia - INTERVAL 1 HOUR ELSE dw_fim_vigencia END AS dw_fim_vigencia, dw_versao_ativa OR id_cartao % 7 = 0 AS dw_versao_ativa FROM tl)"
ACTIVE_SQL, INVERTED_SQL = "SELECT id_cartao, count(*) AS versoes_ativas FROM {0} WHERE dw_versao_ativa GROUP BY id_cartao HAVING count(*) > 1", "SELECT id_cartao, dw_inicio_vigencia, dw_fim_vigencia FROM {0} WHERE dw_fim_vigencia <= dw_inicio_vigencia"
GAP_SQL = "SELECT * FROM (SELECT id_cartao, dw_inicio_vigencia, dw_fim_vigencia, lead(dw_inicio_vigencia) OVER (PARTITION BY id_cartao ORDER BY dw_inicio_vigencia) AS proxima_vigencia FROM {0}) WHERE proxima_vigencia IS NOT NULL AND dw_fim_vigencia IS DISTINCT FROM proxima_vigencia"


@registered(f"WITH {timeline_sql()} {ACTIVE_SQL.format('tl')}")
def inv_multi_active(spark, sf):
    return history.many_active(cards(spark, sf), ("id_cartao",))


@registered(f"WITH {timeline_sql()} {INVERTED_SQL.format('tl')}")
def inv_inverted(spark, sf):
    return history.inverted(cards(spark, sf), ("id_cartao",))


@registered(f"WITH {timeline_sql()} {GAP_SQL.format('tl')}")
def inv_gap(spark, sf):
    return history.gaps(cards(spark, sf), ("id_cartao",))


@registered(f"WITH {BROKEN_SQL} {ACTIVE_SQL.format('bad')}")
def inv_multi_active_seeded(spark, sf):
    return history.many_active(broken(spark, sf), ("id_cartao",))


@registered(f"WITH {BROKEN_SQL} {INVERTED_SQL.format('bad')}")
def inv_inverted_seeded(spark, sf):
    return history.inverted(broken(spark, sf), ("id_cartao",))


@registered(f"WITH {BROKEN_SQL} {GAP_SQL.format('bad')}")
def inv_gap_seeded(spark, sf):
    return history.gaps(broken(spark, sf), ("id_cartao",))


# Products.


def refunds(spark, sf):
    return lines(spark, sf).where("l_returnflag = 'R'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id_estorno"), F.col("l_orderkey").alias("id_transacao"), F.col("l_shipdate").cast("date").alias("data_estorno"), money("l_extendedprice").alias("valor_estorno"), F.concat(F.lit("M"), F.col("l_linenumber").cast("string")).alias("motivo"))


REFUND_SQL = LINES_SQL + ", refunds AS (SELECT l_orderkey AS id_transacao, sum(l_extendedprice::decimal(18,2))::decimal(18,2) AS total, count(*) AS qtd, max(l_shipdate::date) AS ultimo, 'M' || min(l_linenumber)::varchar AS motivo FROM lines WHERE l_returnflag = 'R' GROUP BY l_orderkey)"


@registered(f"WITH {REFUND_SQL} SELECT id_transacao, total AS valor_estornado, qtd AS qtd_estornos, ultimo AS data_ultimo_estorno, motivo AS motivo_estorno FROM refunds")
def refund_rollup(spark, sf):
    return marts.refunds_by_transaction(refunds(spark, sf)).withColumnsRenamed({"_refunded": "valor_estornado", "_refunds": "qtd_estornos"})


def transactions(spark, sf):
    o = read(spark, sf, "orders")
    text = lambda name: F.lit(None).cast("string").alias(name)
    return o.select(F.col("o_orderkey").alias("id_transacao"), F.col("o_custkey").alias("id_cartao"), (F.col("o_orderdate") + F.expr("INTERVAL 12 HOUR")).alias("data_transacao"), F.col("o_orderdate").cast("date").alias("data_particao"), money(F.col("o_totalprice") * 10).alias("valor"), F.lit(None).cast("int").alias("mcc"), text("estabelecimento"), F.col("o_orderpriority").alias("canal"), text("pais"), text("moeda"), text("dispositivo"))


def fixed_dimension(df: DataFrame) -> DataFrame:
    ntz = lambda x: F.lit(x).cast("timestamp_ntz")
    return df.withColumns({history.START: ntz("1990-01-01"), history.END: ntz(None), history.ACTIVE: F.lit(True), history.DELETED: F.lit(False)})


def accounts(spark, sf):
    return fixed_dimension(read(spark, sf, "customer").select(F.col("c_custkey").alias("id_conta"), F.col("c_custkey").alias("id_cliente"), F.lit("CORRENTE").alias("tipo_conta"), F.when(F.col("c_acctbal") >= 0, "ATIVA").otherwise("BLOQUEADA").alias("status_conta")))


def clients(spark, sf):
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return fixed_dimension(c.select(F.col("c_custkey").alias("id_cliente"), F.col("c_mktsegment").alias("segmento"), F.col("n_name").alias("cidade"), F.substring("n_name", 1, 2).alias("estado"), money("c_acctbal").alias("renda")))


def fact(spark, sf):
    dims = cards(spark, sf).withColumns({"id_conta": F.col("id_cartao"), "limite": F.lit(None).cast("decimal(18,2)"), "status_cartao": F.when(F.col("status_cartao") == "P", "CANCELADO").otherwise("ATIVO")})
    return marts.enriched_fact(transactions(spark, sf), refunds(spark, sf), dims, accounts(spark, sf), clients(spark, sf))


FACT_SQL = REFUND_SQL + ", " + timeline_sql() + """,
fact AS (
  SELECT o_orderkey AS id_transacao, o_custkey AS id_cartao, t.id_cartao AS id_conta, c_custkey AS id_cliente,
    o_orderdate + INTERVAL 12 HOUR AS data_transacao, o_orderdate::date AS data_particao,
    year(o_orderdate)::integer AS ano, month(o_orderdate)::integer AS mes, strftime(o_orderdate, '%Y-%m') AS ano_mes,
    (o_totalprice * 10)::decimal(18,2) AS valor_bruto, coalesce(total, 0)::decimal(18,2) AS valor_estornado,
    ((o_totalprice * 10)::decimal(18,2) - coalesce(total, 0))::decimal(18,2) AS valor_liquido,
    coalesce(qtd, 0) > 0 AS foi_estornada, coalesce(total, 0) >= (o_totalprice * 10)::decimal(18,2) AS estorno_total,
    coalesce(qtd, 0) AS qtd_estornos, motivo AS motivo_estorno, o_orderpriority AS canal, t.tipo_cartao,
    CASE WHEN t.id_cartao IS NULL THEN NULL WHEN t.status_cartao = 'P' THEN 'CANCELADO' ELSE 'ATIVO' END AS status_cartao_na_data,
    CASE WHEN c_custkey IS NOT NULL THEN 'CORRENTE' END AS tipo_conta,
    CASE WHEN c_custkey IS NULL THEN NULL WHEN c_acctbal >= 0 THEN 'ATIVA' ELSE 'BLOQUEADA' END AS status_conta_na_data,
    c_mktsegment AS segmento_na_data, n_name AS cidade_na_data, left(n_name, 2) AS estado_na_data, c_acctbal::decimal(18,2) AS renda_na_data,
    coalesce(t.status_cartao <> 'P' AND c_acctbal >= 0, false) AS elegivel_metrica
  FROM orders LEFT JOIN refunds r ON r.id_transacao = o_orderkey
    LEFT JOIN tl t ON t.id_cartao = o_custkey AND t.dw_inicio_vigencia <= o_orderdate + INTERVAL 12 HOUR
      AND (t.dw_fim_vigencia IS NULL OR t.dw_fim_vigencia > o_orderdate + INTERVAL 12 HOUR)
    LEFT JOIN customer ON c_custkey = t.id_cartao LEFT JOIN nation ON n_nationkey = c_nationkey
)"""
FACT_COLUMNS = """id_transacao id_cartao id_conta id_cliente data_transacao data_particao ano mes ano_mes valor_bruto valor_estornado valor_liquido
foi_estornada estorno_total qtd_estornos motivo_estorno canal tipo_cartao status_cartao_na_data tipo_conta status_conta_na_data segmento_na_data
cidade_na_data estado_na_data renda_na_data elegivel_metrica""".split()


@registered(f"WITH {FACT_SQL} SELECT {', '.join(FACT_COLUMNS)} FROM fact")
def fact_enriched(spark, sf):
    return fact(spark, sf).select(*FACT_COLUMNS)


@registered(f"WITH {timeline_sql()} SELECT o_orderkey, t.status_cartao, t.tipo_cartao FROM orders LEFT JOIN tl t ON t.id_cartao = o_custkey AND NOT t.dw_excluido AND t.dw_inicio_vigencia <= o_orderdate AND (t.dw_fim_vigencia IS NULL OR t.dw_fim_vigencia > o_orderdate)")
def temporal_join(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return joins.as_of_join(o, cards(spark, sf), "o_custkey", "id_cartao", "o_orderdate", {"status_cartao": "status_cartao", "tipo_cartao": "tipo_cartao"}).select("o_orderkey", "status_cartao", "tipo_cartao")


@registered(f"WITH {FACT_SQL} SELECT id_transacao, tipo_cartao, status_conta_na_data, segmento_na_data, cidade_na_data FROM fact")
def temporal_chain(spark, sf):
    return fact(spark, sf).select("id_transacao", "tipo_cartao", "status_conta_na_data", "segmento_na_data", "cidade_na_data")


@registered(f"""
WITH {SALES_SQL},
m AS (
  SELECT id_cliente, ano_mes, count(*) AS qtd_transacoes, sum(valor_liquido)::decimal(28,2) AS valor_liquido_total, sum(valor_bruto)::decimal(28,2) AS valor_bruto_total,
    sum(valor_estornado)::decimal(28,2) AS valor_estornado_total, {mean('valor_liquido')} AS ticket_medio, max(valor_liquido) AS maior_transacao,
    min(valor_liquido) AS menor_transacao, quantile_disc(valor_liquido, 0.5) AS mediana_transacao, {r2('stddev(valor_liquido::double)')} AS desvio_padrao_valor,
    count(DISTINCT data_particao) AS dias_com_transacao, count(DISTINCT id_cartao) AS qtd_cartoes_usados, count(DISTINCT estabelecimento) AS qtd_estabelecimentos,
    count(DISTINCT mcc) AS qtd_categorias_mcc, count(DISTINCT canal) AS qtd_canais, count(*) FILTER (WHERE foi_estornada) AS qtd_transacoes_estornadas,
    count(*) FILTER (WHERE pais <> 'BR') AS qtd_transacoes_exterior, sum(CASE WHEN canal = 'ECOMMERCE' THEN valor_liquido ELSE 0 END)::decimal(28,2) AS valor_ecommerce,
    max(data_transacao) AS ultima_transacao, min(data_transacao) AS primeira_transacao
  FROM sales WHERE elegivel_metrica GROUP BY id_cliente, ano_mes)
SELECT m.*, c_mktsegment AS segmento, n_name AS cidade, left(n_name, 2) AS estado, c_acctbal::decimal(18,2) AS renda,
  {pct('valor_estornado_total', 'valor_bruto_total', 2, '0.0')} AS percentual_estornado,
  {pct('valor_liquido_total', 'c_acctbal::decimal(18,2)', 2)} AS comprometimento_renda
FROM m JOIN customer ON c_custkey = id_cliente JOIN nation ON c_nationkey = n_nationkey""")
def customer_month(spark, sf):
    return marts.client_month(sales(spark, sf), clients(spark, sf)).withColumn("desvio_padrao_valor", rounded(F.col("desvio_padrao_valor")))


def risk_events(spark, sf):
    kinds = {"error": "FRAUDE_CONFIRMADA", "purchase": "CHARGEBACK"}
    kind = F.coalesce(*(F.when(F.col("event_type") == a, F.lit(b)) for a, b in kinds.items()), F.lit("SUSPEITA"))
    level = F.element_at(F.array(*(F.lit(x) for x in ("BAIXA", "MEDIA", "ALTA", "CRITICA"))), (F.col("user_id") % 4 + 1).cast("int"))
    return read(spark, sf, "events").select(F.col("event_id").alias("id_evento"), (F.col("event_id") * 10 + F.col("user_id") % 7 + 1).alias("id_transacao"), kind.alias("tipo_evento"), level.alias("severidade"), F.col("ts").cast("date").alias("data_evento"))


@registered(f"""
WITH {SALES_SQL},
risk AS (
  SELECT event_id * 10 + user_id % 7 + 1 AS id, count(*) AS n, max(user_id % 4 + 1) AS nivel, bool_or(event_type = 'error') AS fraude, bool_or(event_type = 'purchase') AS cb
  FROM events GROUP BY 1),
d AS (
  SELECT data_particao, count(*) AS qtd_transacoes, sum(valor_bruto)::decimal(28,2) AS valor_bruto_total, sum(valor_liquido)::decimal(28,2) AS valor_liquido_total,
    count(n) AS qtd_com_evento_risco, count(*) FILTER (WHERE fraude) AS qtd_fraude_confirmada, count(*) FILTER (WHERE cb) AS qtd_chargeback,
    count(*) FILTER (WHERE nivel >= 3) AS qtd_severidade_alta, count(*) FILTER (WHERE foi_estornada) AS qtd_estornadas, sum(valor_estornado)::decimal(28,2) AS valor_estornado_total,
    sum(CASE WHEN fraude THEN valor_bruto ELSE 0 END)::decimal(28,2) AS valor_em_fraude, count(DISTINCT id_cliente) AS qtd_clientes_distintos
  FROM sales LEFT JOIN risk ON id = id_transacao GROUP BY data_particao)
SELECT *, {pct('qtd_com_evento_risco', 'qtd_transacoes', 4)} AS taxa_risco_pct, {pct('qtd_estornadas', 'qtd_transacoes', 4)} AS taxa_estorno_pct,
  {pct('qtd_chargeback', 'qtd_transacoes', 4)} AS taxa_chargeback_pct FROM d""")
def risk_daily(spark, sf):
    return marts.risk_by_day(sales(spark, sf), risk_events(spark, sf))


FEATURES_AT = "2001-06-30"


@registered(f"""
WITH {SALES_SQL},
eligible AS (SELECT *, data_particao >= DATE '{FEATURES_AT}' - 30 AS recent FROM sales WHERE elegivel_metrica),
t AS (
  SELECT id_cliente, count(*) AS f_qtd_transacoes_total, sum(valor_liquido)::decimal(28,2) AS f_valor_liquido_total, {mean('valor_liquido')} AS f_ticket_medio,
    {r2('stddev(valor_liquido::double)')} AS f_desvio_ticket, max(valor_liquido) AS f_maior_transacao, quantile_disc(valor_liquido, 0.5) AS f_mediana_transacao,
    count(DISTINCT data_particao) AS f_dias_ativos, count(DISTINCT id_cartao) AS f_qtd_cartoes, count(DISTINCT mcc) AS f_qtd_categorias,
    count(DISTINCT estabelecimento) AS f_qtd_estabelecimentos, count(*) FILTER (WHERE pais <> 'BR') AS exterior, count(*) FILTER (WHERE foi_estornada) AS estornadas,
    count(*) FILTER (WHERE recent) AS n30, (sum(valor_liquido) FILTER (WHERE recent))::decimal(28,2) AS f_valor_30d,
    count(*) FILTER (WHERE canal = 'ECOMMERCE') AS online, min(data_particao) AS primeira, max(data_particao) AS ultima
  FROM eligible GROUP BY id_cliente),
m AS (SELECT id_cliente, ano_mes, sum(valor_liquido)::decimal(28,2) AS v FROM eligible GROUP BY 1, 2),
g AS (SELECT id_cliente, v, lag(v) OVER (PARTITION BY id_cliente ORDER BY ano_mes) AS antes FROM m),
tr AS (
  SELECT id_cliente, avg(CASE WHEN antes > 0 THEN (v::double - antes::double) / antes::double END) AS variacao, count(*) AS meses, {mean('v', 'decimal(32,6)')} AS f_valor_medio_mensal
  FROM g GROUP BY 1)
SELECT c_custkey AS id_cliente, c_mktsegment AS segmento, n_name AS cidade, left(n_name, 2) AS estado, c_acctbal::decimal(18,2) AS renda,
  coalesce(f_qtd_transacoes_total, 0) AS f_qtd_transacoes_total, f_valor_liquido_total, f_ticket_medio, f_desvio_ticket, f_maior_transacao, f_mediana_transacao,
  f_dias_ativos, f_qtd_cartoes, f_qtd_categorias, f_qtd_estabelecimentos, coalesce(exterior, 0) AS f_qtd_exterior, coalesce(estornadas, 0) AS f_qtd_estornadas,
  coalesce(n30, 0) AS f_qtd_transacoes_30d, f_valor_30d, {r2('variacao', 6)} AS f_variacao_media_mensal, coalesce(meses, 0) AS f_qtd_meses_ativos, f_valor_medio_mensal,
  datediff('day', ultima, DATE '{FEATURES_AT}') AS f_recencia_dias, datediff('day', primeira, DATE '{FEATURES_AT}') AS f_tempo_base_dias,
  CASE WHEN datediff('day', primeira, DATE '{FEATURES_AT}') > 0
    THEN {r2("f_qtd_transacoes_total / (datediff('day', primeira, DATE '" + FEATURES_AT + "') / 30.0::double)", 6)} END AS f_frequencia_mensal,
  CASE WHEN f_qtd_transacoes_total > 0 THEN {r2('online::double / f_qtd_transacoes_total', 6)} ELSE 0.0 END AS f_perc_ecommerce,
  CASE WHEN c_acctbal::decimal(18,2) > 0 THEN {r2('f_valor_medio_mensal::double / c_acctbal::decimal(18,2)::double', 6)} END AS f_comprometimento_renda,
  DATE '{FEATURES_AT}' AS f_data_referencia
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN t ON t.id_cliente = c_custkey LEFT JOIN tr ON tr.id_cliente = c_custkey""")
def customer_features(spark, sf):
    s, c = sales(spark, sf), clients(spark, sf)
    out = marts.client_features(marts.client_month(s, c), s, c, FEATURES_AT)
    ratios = {k: rounded(F.col(k), 6) for k in ("f_variacao_media_mensal", "f_frequencia_mensal", "f_perc_ecommerce", "f_comprometimento_renda")}
    return out.withColumns(ratios | {"f_desvio_ticket": rounded(F.col("f_desvio_ticket"))} | {k: F.col(k).cast("long") for k in ("f_recencia_dias", "f_tempo_base_dias")})


@registered(f"""
WITH {SALES_SQL},
b AS (
  SELECT estabelecimento, mcc, count(*) AS qtd_transacoes, sum(valor_liquido)::decimal(28,2) AS valor_liquido_total, {mean('valor_liquido')} AS ticket_medio,
    count(DISTINCT id_cliente) AS qtd_clientes_distintos, count(*) FILTER (WHERE foi_estornada) AS qtd_estornadas, min(data_particao) AS primeira_transacao, max(data_particao) AS ultima_transacao
  FROM sales GROUP BY 1, 2)
SELECT *, {pct('qtd_estornadas', 'qtd_transacoes', 4)} AS taxa_estorno_pct FROM b""")
def merchant_dim(spark, sf):
    return marts.merchants(sales(spark, sf))


@registered(f"WITH {FACT_SQL} SELECT count(*) AS qtd, sum(valor_bruto)::decimal(38,2) AS bruto, sum(valor_estornado)::decimal(38,2) AS estornado, sum(valor_liquido)::decimal(38,2) AS liquido, count(*) FILTER (WHERE NOT elegivel_metrica) AS nao_elegiveis FROM fact")
def totals_reconcile(spark, sf):
    wide = lambda c: F.sum(c).cast("decimal(38,2)")
    return fact(spark, sf).agg(F.count("*").alias("qtd"), wide("valor_bruto").alias("bruto"), wide("valor_estornado").alias("estornado"), wide("valor_liquido").alias("liquido"), F.count_if(~F.col("elegivel_metrica")).alias("nao_elegiveis"))


@registered("SELECT l_orderkey, l_linenumber, count(*) AS qtd FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("qtd")).where("qtd > 1")


# Reports.



@registered(f"""
WITH {SALES_SQL},
movimento AS (SELECT id_cliente, ano_mes, count(*) AS qtd_transacoes, sum(valor_liquido)::double AS valor_mes FROM sales WHERE elegivel_metrica GROUP BY 1, 2),
base AS (
  SELECT *, avg(valor_mes) OVER p AS media_6m, stddev(valor_mes) OVER p AS desvio_6m, count(*) OVER p AS meses, lag(valor_mes) OVER w AS anterior, first_value(ano_mes) OVER w AS primeiro
  FROM movimento
  WINDOW w AS (PARTITION BY id_cliente ORDER BY ano_mes), p AS (PARTITION BY id_cliente ORDER BY ano_mes ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
classificado AS (
  SELECT *, CASE WHEN meses < 3 THEN 'HISTORICO_INSUFICIENTE' WHEN desvio_6m IS NULL OR desvio_6m = 0 THEN 'SEM_VARIACAO_HISTORICA'
    WHEN valor_mes > media_6m + 2 * desvio_6m THEN 'PICO_DE_GASTO' WHEN valor_mes < media_6m - 2 * desvio_6m THEN 'QUEDA_DE_GASTO' ELSE 'DENTRO_DO_PADRAO' END AS classificacao_anomalia
  FROM base)
SELECT id_cliente, ano_mes, qtd_transacoes, {r2('valor_mes')} AS valor_mes, {r2('media_6m')} AS media_6m, {r2('desvio_6m')} AS desvio_6m,
  {over('valor_mes', 'media_6m')} AS variacao_vs_media_pct, {r2('(valor_mes - media_6m) / desvio_6m')} AS desvios_da_media, classificacao_anomalia,
  {r2('anterior')} AS valor_mes_anterior, primeiro AS primeiro_mes_ativo
FROM classificado WHERE classificacao_anomalia IN ('PICO_DE_GASTO', 'QUEDA_DE_GASTO')""")
def spend_anomaly(spark, sf):
    return insight.spending_anomaly(sales(spark, sf))


@registered(f"""
WITH {SALES_SQL},
m AS (
  SELECT id_cliente, ano_mes, segmento_na_data AS segmento, cidade_na_data AS cidade, estado_na_data AS estado, sum(valor_liquido)::double AS valor_mes
  FROM sales WHERE elegivel_metrica GROUP BY ALL),
p AS (
  SELECT *, avg(valor_mes) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS media, lag(valor_mes) OVER w AS anterior, lead(valor_mes) OVER w AS seguinte,
    first_value(valor_mes) OVER w AS primeiro, last_value(valor_mes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ultimo
  FROM m WINDOW w AS (PARTITION BY id_cliente ORDER BY ano_mes, segmento, cidade, estado)),
g AS (
  SELECT ano_mes, segmento, cidade, count(DISTINCT id_cliente) AS k, quantile_cont(valor_mes, 0.5) AS p50, quantile_cont(valor_mes, 0.75) AS p75, quantile_cont(valor_mes, 0.95) AS p95
  FROM m GROUP BY ALL)
SELECT id_cliente, ano_mes, segmento, cidade, {r2('valor_mes')} AS valor_mes, {r2('media')} AS media_propria_12m, {over('valor_mes', 'media')} AS variacao_vs_proprio_pct,
  {over('valor_mes', 'anterior')} AS variacao_vs_mes_anterior_pct, k AS clientes_no_grupo, {r2('p50')} AS mediana_grupo, {r2('p75')} AS p75_grupo, {r2('p95')} AS p95_grupo,
  {over('valor_mes', 'p50')} AS variacao_vs_grupo_pct,
  CASE WHEN k < 5 THEN 'GRUPO_PEQUENO' WHEN valor_mes > p95 THEN 'MUITO_ACIMA_DO_GRUPO' WHEN valor_mes > p75 THEN 'ACIMA_DO_GRUPO'
    WHEN valor_mes < p50 THEN 'ABAIXO_DO_GRUPO' ELSE 'NA_MEDIA_DO_GRUPO' END AS posicao_no_grupo,
  {r2('seguinte')} AS seguinte_mes, {r2('primeiro')} AS primeiro_mes, {r2('ultimo')} AS ultimo_mes
FROM p JOIN g USING (ano_mes, segmento, cidade)""")
def peer_position(spark, sf):
    return insight.peer_position(sales(spark, sf))


@registered(f"""
WITH {SALES_SQL},
c AS (
  SELECT id_cliente, max(segmento_na_data) AS segmento, max(cidade_na_data) AS cidade, count(*) AS qtd_transacoes, sum(valor_liquido)::decimal(38,2) AS valor_total,
    {mean('valor_liquido')} AS ticket, count(DISTINCT ano_mes) AS meses_ativos
  FROM sales WHERE elegivel_metrica GROUP BY 1),
s AS (
  SELECT *, ntile(4) OVER v AS quartil_valor, ntile(4) OVER (ORDER BY qtd_transacoes, id_cliente) AS quartil_frequencia, ntile(10) OVER v AS decil_valor,
    percent_rank() OVER (ORDER BY valor_total) AS pv, percent_rank() OVER (ORDER BY qtd_transacoes) AS pf, cume_dist() OVER (ORDER BY valor_total) AS cd
  FROM c WINDOW v AS (ORDER BY valor_total, id_cliente))
SELECT id_cliente, segmento, cidade, qtd_transacoes, valor_total, {r2('ticket')} AS ticket_medio, meses_ativos, quartil_valor, quartil_frequencia, decil_valor,
  {r2('pv', 4)} AS percentil_valor, {r2('pf', 4)} AS percentil_frequencia, {r2('cd', 4)} AS distribuicao_acumulada,
  CASE WHEN quartil_valor = 4 AND quartil_frequencia = 4 THEN 'ALTO_VALOR_ALTA_FREQUENCIA' WHEN quartil_valor = 4 AND quartil_frequencia <= 2 THEN 'ALTO_VALOR_BAIXA_FREQUENCIA'
    WHEN quartil_valor <= 2 AND quartil_frequencia = 4 THEN 'BAIXO_VALOR_ALTA_FREQUENCIA' WHEN quartil_valor = 1 AND quartil_frequencia = 1 THEN 'BAIXO_ENGAJAMENTO'
    ELSE 'INTERMEDIARIO' END AS perfil_valor_frequencia
FROM s""")
def value_frequency(spark, sf):
    return insight.value_frequency(sales(spark, sf))


@registered(f"""
WITH {SALES_SQL},
b AS (
  SELECT estabelecimento, mcc, count(*) AS qtd_transacoes, count(DISTINCT id_cliente) AS clientes_distintos, sum(valor_liquido)::decimal(38,2) AS valor_total,
    {mean('valor_liquido')} AS ticket, count(*) FILTER (WHERE foi_estornada) AS estornadas
  FROM sales GROUP BY 1, 2),
a AS (
  SELECT *, row_number() OVER (ORDER BY valor_total DESC, estabelecimento, mcc) AS posicao, (sum(valor_total) OVER ())::double AS geral,
    (sum(valor_total) OVER (ORDER BY valor_total DESC))::double AS ate
  FROM b)
SELECT posicao, estabelecimento, mcc, qtd_transacoes, clientes_distintos, valor_total, {r2('ticket')} AS ticket_medio, {r2('valor_total::double * 100 / geral')} AS participacao_pct,
  {r2('ate * 100 / geral')} AS participacao_acumulada_pct, {pct('estornadas', 'qtd_transacoes')} AS taxa_estorno_pct,
  CASE WHEN ate * 100 / geral <= 80 THEN 'A' WHEN ate * 100 / geral <= 95 THEN 'B' ELSE 'C' END AS classe_abc
FROM a""")
def abc_curve(spark, sf):
    return insight.abc_curve(sales(spark, sf))


@registered(f"WITH {LOG_SQL} SELECT batch_id, data_referencia, camada, etapa, entidade, linhas_lidas, linhas_gravadas, linhas_rejeitadas, {pct('linhas_rejeitadas', 'linhas_lidas')} AS taxa_rejeicao_pct, status, iniciado_em FROM log WHERE batch_id = (SELECT batch_id FROM log ORDER BY iniciado_em DESC, batch_id DESC LIMIT 1)")
def last_run_summary(spark, sf):
    return insight.last_run(run_log(spark, sf))


@registered(f"""WITH {LOG_SQL}, v AS (SELECT data_referencia, camada, entidade, sum(linhas_gravadas)::bigint AS linhas_gravadas FROM log WHERE status = 'SUCESSO' GROUP BY ALL), s AS (SELECT *, avg(linhas_gravadas) OVER w AS m, count(*) OVER w AS k FROM v WINDOW w AS (PARTITION BY camada, entidade ORDER BY data_referencia ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT data_referencia, camada, entidade, linhas_gravadas, {r2('m', 0)} AS media_7d, {over('linhas_gravadas', 'm')} AS variacao_pct, CASE WHEN linhas_gravadas = 0 THEN 'CRITICO_SEM_DADO' WHEN linhas_gravadas < m * 0.5 THEN 'CRITICO_QUEDA_ACENTUADA' WHEN linhas_gravadas < m * 0.8 THEN 'ATENCAO_QUEDA' WHEN linhas_gravadas > m * 2 THEN 'ATENCAO_PICO' ELSE 'NORMAL' END AS alerta FROM s WHERE k >= 3""")
def volume_drop(spark, sf):
    return insight.volume_drop(run_log(spark, sf))


@registered(f"WITH {LOG_SQL}, d AS (SELECT data_referencia, entidade, sum(linhas_lidas)::bigint AS lidas, sum(linhas_rejeitadas)::bigint AS rejeitadas FROM log WHERE camada = 'silver' GROUP BY ALL), r AS (SELECT *, CASE WHEN lidas > 0 THEN {r2('rejeitadas * 100.0::double / lidas')} END AS taxa_pct FROM d) SELECT *, lag(taxa_pct) OVER (PARTITION BY entidade ORDER BY data_referencia) AS taxa_dia_anterior FROM r")
def rejection_trend(spark, sf):
    return insight.rejection_trend(run_log(spark, sf))


@registered(f"WITH e AS (SELECT c_mktsegment AS entidade, c_custkey % 30 AS data_referencia, unnest({REASONS_SQL}) AS motivo FROM customer) SELECT entidade, motivo, count(*) AS ocorrencias, count(DISTINCT data_referencia) AS dias_com_ocorrencia, min(data_referencia) AS primeira_ocorrencia, max(data_referencia) AS ultima_ocorrencia, {r2('count(*) * 100.0::double / sum(count(*)) OVER (PARTITION BY entidade)')} AS pct_da_entidade FROM e GROUP BY 1, 2")
def rejection_reasons(spark, sf):
    failed = quality.split(read(spark, sf, "customer"), RULES)[1]
    return insight.rejection_reasons(failed.select(F.col("c_mktsegment").alias("entidade"), (F.col("c_custkey") % 30).alias("data_referencia"), quality.REASONS))


@registered(f"""WITH {LOG_SQL}, d AS (SELECT * FROM log WHERE status = 'SUCESSO'), m AS (SELECT camada, etapa, entidade, quantile_cont(duracao_segundos, 0.5) AS m FROM d GROUP BY ALL) SELECT camada, etapa, entidade, data_referencia, batch_id, duracao_segundos, {r2('m', 1)} AS mediana_historica, CASE WHEN m > 0 THEN {r2('duracao_segundos / m')} END AS razao_vs_mediana, CASE WHEN duracao_segundos > m * 3 THEN 'DEGRADACAO_SEVERA' WHEN duracao_segundos > m * 2 THEN 'DEGRADACAO' ELSE 'NORMAL' END AS alerta_performance FROM d JOIN m USING (camada, etapa, entidade)""")
def duration_drift(spark, sf):
    return insight.duration_drift(run_log(spark, sf))


@registered(f"WITH {SALES_SQL} SELECT 'gold_fato_transacao' AS tabela, max(data_particao) AS ultima_particao, datediff('day', max(data_particao), DATE '{REFERENCE}') AS dias_de_atraso, count(*) AS linhas, CASE WHEN datediff('day', max(data_particao), DATE '{REFERENCE}') > 2 THEN 'CRITICO' WHEN datediff('day', max(data_particao), DATE '{REFERENCE}') > 1 THEN 'ATENCAO' ELSE 'OK' END AS status_frescor FROM sales")
def freshness(spark, sf):
    return insight.freshness(sales(spark, sf), REFERENCE)


@registered(f"WITH {LOG_SQL} SELECT batch_id, data_referencia, camada, etapa, entidade, detalhe_erro, iniciado_em FROM log WHERE status = 'FALHA'")
def failed_stages(spark, sf):
    return insight.failures(run_log(spark, sf))
