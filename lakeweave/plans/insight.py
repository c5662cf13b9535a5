"""Analytical and monitoring reports over the data products, the histories, the quarantine and the run log.

Comparisons are of unrounded values; what is shown is rounded as a decimal. Reports take the run's reference date where
others would look at the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.columns import classify, differs, guarded_ratio, percent, rounded
from lakeweave.operators.history import ACTIVE, DELETED, END, START, as_of
from lakeweave.operators.measures import aggregated, measures
from lakeweave.operators.ranking import numbered, tied, tile


def percent_over(value: Column, base: Column) -> Column:
    """By how many percent a value is over a positive base."""
    return rounded(guarded_ratio((value - base) * 100.0, base))


def spending_anomaly(fact: DataFrame, deviations: float = 2.0, least: int = 3) -> DataFrame:
    """Months of a client that lie more than two deviations off the mean of up to six months before."""
    month = fact.where("elegivel_metrica").groupBy("id_cliente", "ano_mes").agg(F.count("*").alias("qtd_transacoes"), F.sum("valor_liquido").cast("double").alias("valor_mes"))
    months = Window.partitionBy("id_cliente").orderBy("ano_mes")
    past = months.rowsBetween(-6, -1)
    seen = month.withColumns({
        "media": F.avg("valor_mes").over(past), "desvio": F.stddev("valor_mes").over(past), "meses": F.count("*").over(past),
        "valor_mes_anterior": F.lag("valor_mes").over(months), "primeiro_mes_ativo": F.first("ano_mes").over(months),
    })
    value, mean, spread = F.col("valor_mes"), F.col("media"), F.col("desvio")
    label = classify((value > mean + deviations * spread, "PICO_DE_GASTO"), (value < mean - deviations * spread, "QUEDA_DE_GASTO"))
    found = seen.where((F.col("meses") >= least) & (spread > 0)).withColumn("classificacao_anomalia", label).where("classificacao_anomalia IS NOT NULL")
    return found.select(
        "id_cliente", "ano_mes", "qtd_transacoes", rounded(value).alias("valor_mes"), rounded(mean).alias("media_6m"), rounded(spread).alias("desvio_6m"),
        percent_over(value, mean).alias("variacao_vs_media_pct"), rounded((value - mean) / spread).alias("desvios_da_media"), "classificacao_anomalia",
        rounded(F.col("valor_mes_anterior")).alias("valor_mes_anterior"), "primeiro_mes_ativo",
    ).orderBy(F.abs("desvios_da_media").desc(), F.desc("ano_mes"), "id_cliente")


def peer_position(fact: DataFrame, least: int = 5) -> DataFrame:
    """Each client's month against their own last twelve months, the months beside it, and their group (month, segment, city)."""
    keys = ["id_cliente", "ano_mes", F.col("segmento_na_data").alias("segmento"), F.col("cidade_na_data").alias("cidade"), F.col("estado_na_data").alias("estado")]
    month = fact.where("elegivel_metrica").groupBy(*keys).agg(F.sum("valor_liquido").cast("double").alias("valor_mes"))
    own = Window.partitionBy("id_cliente").orderBy("ano_mes", "segmento", "cidade", "estado")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mine = month.withColumns({
        "media_propria": F.avg("valor_mes").over(own.rowsBetween(-12, -1)), "anterior": F.lag("valor_mes").over(own), "seguinte": F.lead("valor_mes").over(own),
        "primeiro": F.first("valor_mes").over(own), "ultimo": F.last("valor_mes").over(whole),
    })
    quantile = lambda p: F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY valor_mes)")
    group = month.groupBy("ano_mes", "segmento", "cidade").agg(F.countDistinct("id_cliente").alias("clientes_no_grupo"), quantile(0.5).alias("p50"), quantile(0.75).alias("p75"), quantile(0.95).alias("p95"))
    value, mean, before, p50, p75, p95 = map(F.col, ("valor_mes", "media_propria", "anterior", "p50", "p75", "p95"))
    place = classify((F.col("clientes_no_grupo") < least, "GRUPO_PEQUENO"), (value > p95, "MUITO_ACIMA_DO_GRUPO"), (value > p75, "ACIMA_DO_GRUPO"), (value < p50, "ABAIXO_DO_GRUPO"), otherwise="NA_MEDIA_DO_GRUPO")
    return mine.join(group, ["ano_mes", "segmento", "cidade"]).select(
        "id_cliente", "ano_mes", "segmento", "cidade", rounded(value).alias("valor_mes"),
        rounded(mean).alias("media_propria_12m"), percent_over(value, mean).alias("variacao_vs_proprio_pct"), percent_over(value, before).alias("variacao_vs_mes_anterior_pct"),
        "clientes_no_grupo", rounded(p50).alias("mediana_grupo"), rounded(p75).alias("p75_grupo"), rounded(p95).alias("p95_grupo"), percent_over(value, p50).alias("variacao_vs_grupo_pct"), place.alias("posicao_no_grupo"),
        *(rounded(F.col(c)).alias(f"{c}_mes") for c in ("seguinte", "primeiro", "ultimo")),
    )


def value_frequency(fact: DataFrame) -> DataFrame:
    """Clients by quarter of value and of frequency, and the profile that both make.

    Tiles break ties by id; relative ranks and cumulative shares are the same for equal values.
    """
    client = fact.where("elegivel_metrica").groupBy("id_cliente").agg(
        F.max("segmento_na_data").alias("segmento"), F.max("cidade_na_data").alias("cidade"), F.count("*").alias("qtd_transacoes"), F.sum("valor_liquido").cast("decimal(38,2)").alias("valor_total"),
        F.avg("valor_liquido").alias("ticket"), F.size(F.collect_set("ano_mes")).cast("long").alias("meses_ativos"),
    )
    by_value = tied(numbered(client, [F.col("valor_total"), F.col("id_cliente")], "_v"), "valor_total", "_v")
    both = tied(numbered(by_value, [F.col("qtd_transacoes"), F.col("id_cliente")], "_f"), "qtd_transacoes", "_f")
    total = F.col("_v_total")
    value, often = tile(F.col("_v"), total, 4), tile(F.col("_f"), total, 4)
    profile = classify(
        ((value == 4) & (often == 4), "ALTO_VALOR_ALTA_FREQUENCIA"), ((value == 4) & (often <= 2), "ALTO_VALOR_BAIXA_FREQUENCIA"), ((value <= 2) & (often == 4), "BAIXO_VALOR_ALTA_FREQUENCIA"), ((value == 1) & (often == 1), "BAIXO_ENGAJAMENTO"), otherwise="INTERMEDIARIO"
    )
    rank = lambda c: rounded(F.when(total > 1, (F.col(f"{c}_first") - 1) / (total - 1)).otherwise(0.0), 4)
    return both.select(
        "id_cliente", "segmento", "cidade", "qtd_transacoes", "valor_total", rounded(F.col("ticket")).alias("ticket_medio"), "meses_ativos", value.alias("quartil_valor"), often.alias("quartil_frequencia"), tile(F.col("_v"), total, 10).alias("decil_valor"),
        rank("_v").alias("percentil_valor"), rank("_f").alias("percentil_frequencia"), rounded(F.col("_v_last") / total, 4).alias("distribuicao_acumulada"), profile.alias("perfil_valor_frequencia"),
    )


def abc_curve(fact: DataFrame, keys: tuple[str, ...] = ("estabelecimento", "mcc"), a: float = 80, b: float = 95) -> DataFrame:
    """Merchants by value with their share, the share up to them, and class A, B or C.

    Positions break ties by key; the share up to a merchant covers all those of equal value, as a running sum by value
    does, and it is the unrounded share that decides the class.
    """
    table = measures("""
        qtd_transacoes      rows      -
        clientes_distintos  distinct  id_cliente
        valor_total         sum       valor_liquido
        ticket              mean      valor_liquido
        qtd_estornadas      rows      -                | foi_estornada
    """)
    by = aggregated(fact, list(keys), table).withColumn("valor_total", F.col("valor_total").cast("decimal(28,2)"))
    placed = tied(numbered(by, [F.desc("valor_total"), *(F.col(k) for k in keys)], "posicao", {"valor_total": "_sum"}), "valor_total", "posicao", "_sum")
    up_to, whole = F.col("posicao_sum"), F.col("_sum_total").cast("double")
    share = up_to.cast("double") * 100 / whole
    label = classify((share <= a, "A"), (share <= b, "B"), otherwise="C")
    return placed.select(
        "posicao", *keys, "qtd_transacoes", "clientes_distintos", F.col("valor_total").cast("decimal(38,2)").alias("valor_total"), rounded(F.col("ticket")).alias("ticket_medio"),
        rounded(F.col("valor_total").cast("double") * 100 / whole).alias("participacao_pct"), rounded(share).alias("participacao_acumulada_pct"), percent(F.col("qtd_estornadas"), F.col("qtd_transacoes")).alias("taxa_estorno_pct"), label.alias("classe_abc"),
    )


def at_instant(dimension: DataFrame, moment: str) -> DataFrame:
    """A dimension as it was at an instant, without deleted keys."""
    return as_of(dimension, F.lit(moment).cast(dimension.schema[START].dataType))


def timeline_report(dimension: DataFrame, key: str, flagged: tuple[str, ...], reference: str, measured: tuple[str, ...] = ()) -> DataFrame:
    """Every version with its number, what it changed, how long it held, the ends of the chain, and whether the chain is whole.

    Of flagged columns the value before, whether it changed and the value of the last version come; of measured ones
    the change in percent. Days run up to the reference date for the version that still holds.
    """
    w = Window.partitionBy(key).orderBy(START)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = {
        "versao": F.row_number().over(w).cast("long"),
        "dias_de_vigencia": F.datediff(F.coalesce(F.col(END).cast("date"), F.lit(reference).cast("date")), F.col(START).cast("date")).cast("long"),
        "primeira_vigencia": F.first(START).over(w),
        "inicio_da_proxima": F.lead(START).over(w),
    }
    for c in flagged:
        out[f"{c}_anterior"] = F.lag(c).over(w)
        out[f"mudou_{c}"] = F.when(differs(F.col(c), F.lag(c).over(w)), "SIM").otherwise("NAO")
        out[f"{c}_atual"] = F.last(c).over(whole)
    for c in measured:
        out[f"variacao_{c}_pct"] = percent_over(F.col(c).cast("double"), F.lag(c).over(w).cast("double"))
    out["consistencia_da_linha_do_tempo"] = F.when(differs(F.col(END), F.lead(START).over(w)), "INCONSISTENTE").otherwise("OK")
    return dimension.select(key, START, END, ACTIVE, DELETED, *flagged, *measured, *(v.alias(k) for k, v in out.items()))


def last_run(log: DataFrame) -> DataFrame:
    """The stages of the batch that started last, with the share of rejected rows."""
    newest = log.agg(F.max_by("batch_id", F.struct("iniciado_em", "batch_id")).alias("batch_id"))
    return log.join(F.broadcast(newest), "batch_id").select("batch_id", "data_referencia", "camada", "etapa", "entidade", "linhas_lidas", "linhas_gravadas", "linhas_rejeitadas", percent(F.col("linhas_rejeitadas"), F.col("linhas_lidas")).alias("taxa_rejeicao_pct"), "status", "iniciado_em")


def volume_drop(log: DataFrame, least: int = 3) -> DataFrame:
    """Rows written by day, layer and entity against the mean of up to seven days before."""
    day = log.where("status = 'SUCESSO'").groupBy("data_referencia", "camada", "entidade").agg(F.sum("linhas_gravadas").alias("linhas_gravadas"))
    past = Window.partitionBy("camada", "entidade").orderBy("data_referencia").rowsBetween(-7, -1)
    seen = day.withColumns({"media": F.avg("linhas_gravadas").over(past), "dias": F.count("*").over(past)}).where(F.col("dias") >= least)
    n, mean = F.col("linhas_gravadas"), F.col("media")
    alert = classify((n == 0, "CRITICO_SEM_DADO"), (n < mean * 0.5, "CRITICO_QUEDA_ACENTUADA"), (n < mean * 0.8, "ATENCAO_QUEDA"), (n > mean * 2, "ATENCAO_PICO"), otherwise="NORMAL")
    return seen.select("data_referencia", "camada", "entidade", "linhas_gravadas", rounded(mean, 0).alias("media_7d"), percent_over(n, mean).alias("variacao_pct"), alert.alias("alerta"))


def rejection_trend(log: DataFrame) -> DataFrame:
    """The share of rejected rows by day and entity, beside that of the entity's day before."""
    day = log.where("camada = 'silver'").groupBy("data_referencia", "entidade").agg(F.sum("linhas_lidas").alias("lidas"), F.sum("linhas_rejeitadas").alias("rejeitadas"))
    rate = day.withColumn("taxa_pct", percent(F.col("rejeitadas"), F.col("lidas")))
    return rate.withColumn("taxa_dia_anterior", F.lag("taxa_pct").over(Window.partitionBy("entidade").orderBy("data_referencia")))


def rejection_reasons(bin_: DataFrame, reasons: str = "motivos_rejeicao") -> DataFrame:
    """How often each reason occurs, on how many days, and its share of the entity's rejections."""
    each = bin_.select("entidade", "data_referencia", F.explode(reasons).alias("motivo"))
    by = each.groupBy("entidade", "motivo").agg(F.count("*").alias("ocorrencias"), F.countDistinct("data_referencia").alias("dias_com_ocorrencia"), F.min("data_referencia").alias("primeira_ocorrencia"), F.max("data_referencia").alias("ultima_ocorrencia"))
    return by.withColumn("pct_da_entidade", rounded(F.col("ocorrencias") * 100.0 / F.sum("ocorrencias").over(Window.partitionBy("entidade"))))


def duration_drift(log: DataFrame) -> DataFrame:
    """Stage durations against the median of the stage."""
    done = log.where("status = 'SUCESSO'")
    keys = ["camada", "etapa", "entidade"]
    median = done.groupBy(*keys).agg(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY duracao_segundos)").alias("mediana"))
    d, m = F.col("duracao_segundos"), F.col("mediana")
    return done.join(median, keys).select(*keys, "data_referencia", "batch_id", "duracao_segundos", rounded(m, 1).alias("mediana_historica"), rounded(guarded_ratio(d, m)).alias("razao_vs_mediana"), classify((d > m * 3, "DEGRADACAO_SEVERA"), (d > m * 2, "DEGRADACAO"), otherwise="NORMAL").alias("alerta_performance"))


def freshness(fact: DataFrame, reference: str, name: str = "gold_fato_transacao") -> DataFrame:
    """The newest partition of a table and how many days it is behind the reference date."""
    late = F.datediff(F.lit(reference).cast("date"), "ultima_particao")
    one = fact.agg(F.max("data_particao").alias("ultima_particao"), F.count("*").alias("linhas"))
    return one.select(F.lit(name).alias("tabela"), "ultima_particao", late.cast("long").alias("dias_de_atraso"), "linhas", classify((late > 2, "CRITICO"), (late > 1, "ATENCAO"), otherwise="OK").alias("status_frescor"))


def failures(log: DataFrame) -> DataFrame:
    return log.where("status = 'FALHA'").select("batch_id", "data_referencia", "camada", "etapa", "entidade", "detalhe_erro", "iniciado_em").orderBy(F.desc("iniciado_em"), "entidade")
