"""What the parser makes of a statement."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any
    family: str  # int float text bool null, or of a typed literal date time datetime decimal blob json
    typed: bool = False


@dataclass(frozen=True)
class Name:
    column: str
    table: str | None = None


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Unary:
    op: str  # NOT, -, IS NULL, IS NOT NULL
    operand: Any


@dataclass(frozen=True)
class Aggregate:
    func: str
    column: str  # * for all


@dataclass(frozen=True)
class Source:
    table: str
    alias: str


@dataclass(frozen=True)
class Join:
    how: str  # inner, left
    source: Source
    on: Any = None
    using: tuple[str, ...] = ()


@dataclass(frozen=True)
class Select:
    items: tuple | None  # None for *
    source: Source
    joins: tuple[Join, ...] = ()
    where: Any = None
    group: tuple[str, ...] | None = None
    order: tuple[tuple[Name, bool], ...] = ()  # (column, descending)
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Column:
    name: str
    family: str
    not_null: bool = False
    primary_key: bool = False
    unique: bool = False
    size: tuple[int, ...] = ()


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[Column, ...]


@dataclass(frozen=True)
class DropTable:
    table: str
    if_exists: bool


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[Literal, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Any], ...]
    where: Any = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Any = None


@dataclass(frozen=True)
class Control:
    word: str  # BEGIN COMMIT ROLLBACK
