"""Measured stages: one row per executed stage, appended to the run log at the end, whatever happens. And JSON log lines."""

from __future__ import annotations

import json
import logging
import time
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from lakeweave.plans.spec import Settings
from lakeweave.sources.store import SnapshotTable

SCHEMA = "batch_id string NOT NULL, data_referencia string NOT NULL, camada string NOT NULL, etapa string NOT NULL, entidade string, linhas_lidas long, linhas_gravadas long, linhas_rejeitadas long, duracao_segundos double, status string NOT NULL, detalhe_erro string, iniciado_em timestamp, finalizado_em timestamp"


class RunLog:
    def __init__(self, settings: Settings):
        self.settings, self.rows = settings, []

    @contextmanager
    def stage(self, layer: str, step: str, entity: str | None = None):
        """Measure a stage; what the body puts into the dictionary are its counters. A failure is recorded and raised on. The duration is fixed when the stage ends."""
        counters: dict[str, int] = {}
        began, clock, status, error = datetime.now(UTC), time.monotonic(), "SUCESSO", None
        try:
            yield counters
        except Exception as e:
            status, error = "FALHA", f"{type(e).__name__}: {e}"[:2000]
            raise
        finally:
            took = round(time.monotonic() - clock, 3)
            row = (self.settings.batch_id, self.settings.reference, layer, step, entity, counters.get("read", 0), counters.get("written", 0), counters.get("rejected", 0), took, status, error, began, datetime.now(UTC))
            self.rows.append(row)
            logging.getLogger("lakeweave").info("stage", extra={"fields": {"layer": layer, "step": step, "entity": entity, "status": status, "seconds": took} | counters})

    def summary(self) -> dict[str, int]:
        return {"stages": len(self.rows), "failures": sum(r[9] == "FALHA" for r in self.rows), "read": sum(r[5] for r in self.rows), "written": sum(r[6] for r in self.rows), "rejected": sum(r[7] for r in self.rows)}

    def persist(self, spark: SparkSession) -> None:
        if self.rows:
            SnapshotTable(spark, self.settings.table("observabilidade", "execucao_pipeline")).append(spark.createDataFrame(self.rows, SCHEMA))


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        line = {"time": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()} | getattr(record, "fields", {})
        if record.exc_info:
            line["error"] = self.formatException(record.exc_info)
        return json.dumps(line, ensure_ascii=False, default=str)


def configure_logging(level: str = "INFO") -> None:
    handler = logging.StreamHandler()
    handler.setFormatter(JsonFormatter())
    logger = logging.getLogger("lakeweave")
    logger.handlers, logger.propagate = [handler], False
    logger.setLevel(level)
