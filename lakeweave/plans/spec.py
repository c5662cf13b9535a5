"""What the engine is told about an entity, and about a run."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from lakeweave.operators.history import Versioning
from lakeweave.operators.quality import Rule

ENVIRONMENTS = ("dev", "hml", "prod")
MODES = ("completa", "bronze", "silver", "gold")


@dataclass(frozen=True)
class Field:
    """A column: its type, how text is cleaned (trim, upper or none), whether it may be absent, and an expression if it isn't a cast of its source."""

    name: str
    kind: str
    clean: str = "trim"
    optional: bool = False
    expression: str | None = None


@dataclass(frozen=True)
class Reference:
    """A foreign key into another entity. With ever, any version of the parent counts, not only its current one."""

    key: str
    parent: str
    parent_key: str
    reason: str
    ever: bool = True


@dataclass(frozen=True)
class Entity:
    """A source and its typed table: versioned if it has a history, else keyed facts."""

    name: str
    folder: str
    table: str
    fields: tuple[Field, ...]
    rules: tuple[Rule, ...]
    keys: tuple[str, ...]
    kind: str = "csv"
    references: tuple[Reference, ...] = ()
    history: Versioning | None = None
    partition_by: tuple[str, ...] = ()
    cluster_by: tuple[str, ...] = ()


def _env(name: str, default: str) -> str:
    return os.environ.get(f"LAKEWEAVE_{name}", default)


@dataclass(frozen=True)
class Settings:
    """An immutable run configuration; defaults come from LAKEWEAVE_* environment variables."""

    root: str = field(default_factory=lambda: _env("ROOT", "lake"))
    environment: str = field(default_factory=lambda: _env("ENVIRONMENT", "dev"))
    mode: str = field(default_factory=lambda: _env("MODE", "completa"))
    reference: str = field(default_factory=lambda: _env("REFERENCE", "2024-01-31"))
    batch_id: str = field(default_factory=lambda: _env("BATCH", "batch-0"))
    compact_files: int = 1
    again: bool = False  # read all raw rows, not only those that are new

    def __post_init__(self):
        if self.environment not in ENVIRONMENTS:
            raise ValueError(f"unknown environment {self.environment!r}, not one of {ENVIRONMENTS}")
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}, not one of {MODES}")

    def schema(self, layer: str) -> str:
        return layer if self.environment == "prod" else f"{layer}_{self.environment}"

    def table(self, layer: str, name: str) -> str:
        return f"{self.root.rstrip('/')}/{self.schema(layer)}/{name}"

    def landing(self, folder: str) -> str:
        return f"{self.root.rstrip('/')}/landing/{folder}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/checkpoints/{self.schema(name)}"
