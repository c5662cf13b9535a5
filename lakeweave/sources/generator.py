"""A seeded set of landing files of the card domain for tests and trials, with defects that each have an expected end."""

from __future__ import annotations

import csv
import json
import random
from datetime import date, datetime, timedelta
from pathlib import Path

# Fixed values of the data contract.
CITIES = (("São Paulo", "SP"), ("Rio de Janeiro", "RJ"), ("Belo Horizonte", "MG"), ("Curitiba", "PR"), ("Salvador", "BA"), ("Recife", "PE"))
SEGMENTS = ("VAREJO", "ALTA_RENDA", "PREMIUM", "UNIVERSITARIO")
CHANNELS = ("POS", "ECOMMERCE", "APP", "CONTACTLESS")
MCCS = (5411, 5812, 5541, 5912, 5311, 4121, 7011, 5732)


def _csv(path: Path, rows: list[dict]) -> int:
    path.parent.mkdir(parents=True, exist_ok=True)
    names = list(dict.fromkeys(k for r in rows for k in r))
    with path.open("w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, names)
        out.writeheader()
        out.writerows(rows)
    return len(rows)


def generate(root: str, reference: str = "2024-01-31", clients: int = 200, days: int = 5, seed: int = 42) -> dict[str, int]:
    """Write all files below root/landing; the rows of each source."""
    rng, top, end = random.Random(seed), Path(root.removeprefix("file://")) / "landing", date.fromisoformat(reference)
    first, changed = (end - timedelta(days=90)).isoformat(), (end - timedelta(days=20)).isoformat()
    people = []
    for k in range(1, clients + 1):
        city, state = rng.choice(CITIES)
        people.append({"id_cliente": k, "cpf": f"{rng.randrange(10**11):011d}", "nome": f"Cliente {k}", "cidade": city, "estado": state, "renda": round(rng.uniform(1500, 30000), 2), "segmento": rng.choice(SEGMENTS), "data_atualizacao": first, "operacao": "INSERT"})
    cdc = people + [p | {"segmento": "PREMIUM", "renda": round(p["renda"] * 1.1, 2), "data_atualizacao": changed, "operacao": "UPDATE"} for p in people[::7]]
    bad = [{"cpf": None}, {"cpf": "123"}, {"renda": -10.0}, {"estado": "ZZ"}]
    cdc += [people[0]] + [people[0] | {"id_cliente": clients + 1 + k} | b for k, b in enumerate(bad)]
    (top / "clientes").mkdir(parents=True, exist_ok=True)
    (top / "clientes/clientes_cdc.json").write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in cdc), encoding="utf-8")

    owners = [k for k in range(1, clients + 1) for _ in range(rng.randint(1, 3))]
    accounts = [{"id_conta": 10_000 + n, "id_cliente": k, "tipo_conta": rng.choice(("CORRENTE", "POUPANCA")), "status_conta": "ATIVA", "data_abertura": first, "data_atualizacao": first, "operacao": "INSERT"} for n, k in enumerate(owners)]
    closed = [a | {"status_conta": "ENCERRADA", "data_atualizacao": changed, "operacao": "UPDATE"} for a in accounts[::10]]
    orphan = accounts[0] | {"id_conta": 999_999, "id_cliente": 999_999}
    holders = [a["id_conta"] for a in accounts for _ in range(rng.randint(1, 2))]
    cards = [{"id_cartao": 50_000 + n, "id_conta": k, "tipo_cartao": rng.choice(("CREDITO", "DEBITO")), "limite": round(rng.uniform(500, 20000), 2), "status_cartao": "ATIVO", "data_atualizacao": first, "operacao": "INSERT"} for n, k in enumerate(holders)]
    raised = [c | {"limite": round(c["limite"] * 1.2, 2), "data_atualizacao": changed, "operacao": "UPDATE"} for c in cards[::5]]
    cancelled = [c | {"status_cartao": "CANCELADO", "data_atualizacao": (end - timedelta(days=3)).isoformat(), "operacao": "UPDATE"} for c in cards[3::12]]
    lost = cards[0] | {"id_cartao": 888_888, "id_conta": 888_888}
    out = {"clientes": len(cdc), "contas": _csv(top / "contas/contas_cdc.csv", [*accounts, *closed, orphan]), "cartoes": _csv(top / "cartoes/cartoes_cdc.csv", [*cards, *raised, *cancelled, lost])}

    number, by_day = 0, []
    for d in range(days):
        day, rows = end - timedelta(days=days - 1 - d), []
        for _ in range(max(5, clients * 3 // 8)):
            number += 1
            code = rng.choice(MCCS)
            moment = datetime(day.year, day.month, day.day) + timedelta(seconds=rng.randrange(86_400))
            rows.append({"id_transacao": number, "id_cartao": rng.choice(cards)["id_cartao"], "data_transacao": moment.strftime("%Y-%m-%d %H:%M:%S"), "valor": round(rng.uniform(5, 3000), 2), "mcc": code, "estabelecimento": f"LOJA {code}-{rng.randint(1, 3)}", "canal": rng.choice(CHANNELS), "pais": "BR" if rng.random() < 0.9 else "US", "moeda": "BRL"})
        by_day.append(rows)
    by_day[-1] += [by_day[-1][0] | {"id_transacao": number + 1, "valor": 0.0}, by_day[-1][0] | {"id_transacao": number + 2, "valor": -250.0}, by_day[-1][0] | {"id_transacao": number + 3, "id_cartao": 777_777}]
    if days > 1:
        by_day[1] += by_day[0][:5]
    by_day[-1] = [r | {"dispositivo": rng.choice(("MOBILE", "DESKTOP"))} for r in by_day[-1]]
    out["transacoes"] = sum(_csv(top / f"transacoes/transacoes_{end - timedelta(days=days - 1 - d)}.csv", rows) for d, rows in enumerate(by_day))
    sold = [r for rows in by_day for r in rows[: max(5, clients * 3 // 8)]]
    refunds = [{"id_estorno": k + 1, "id_transacao": r["id_transacao"], "data_estorno": end.isoformat(), "valor_estorno": r["valor"] if rng.random() < 0.6 else round(r["valor"] / 2, 2), "motivo": rng.choice(("FRAUDE", "DESISTENCIA", "ERRO"))} for k, r in enumerate(sold[::24])]
    out["estornos"] = _csv(top / "estornos/estornos.csv", [*refunds, refunds[0] | {"id_estorno": 9_999, "id_transacao": 9_999_999}])
    events = [{"id_evento": k + 1, "id_transacao": r["id_transacao"], "tipo_evento": rng.choice(("FRAUDE_CONFIRMADA", "CHARGEBACK", "SUSPEITA")), "severidade": rng.choice(("BAIXA", "MEDIA", "ALTA", "CRITICA")), "data_evento": end.isoformat()} for k, r in enumerate(sold[::28])]
    out["eventos_risco"] = _csv(top / "eventos_risco/eventos_risco.csv", [*events, events[0] | {"id_evento": 9_999, "id_transacao": 9_999_999}])
    return out
