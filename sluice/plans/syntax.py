"""Syntax tree of the pipe language. Nothing here knows Spark."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Span:
    """A width with a unit, such as 5m; without a unit it is a number."""

    width: float
    unit: str | None


@dataclass(frozen=True)
class Name:
    text: str


@dataclass(frozen=True)
class Lambda:
    params: tuple[str, ...]
    body: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Any, ...] = ()
    named: tuple[tuple[str, Any], ...] = ()
    distinct: bool = False


@dataclass(frozen=True)
class SortKey:
    expr: Any
    ascending: bool = True
    nulls_first: bool | None = None


@dataclass(frozen=True)
class Frame:
    kind: str  # rows or range
    low: int | None  # None: unbounded
    high: int | None


@dataclass(frozen=True)
class Over:
    call: Call
    partition: tuple[Any, ...] = ()
    order: tuple[SortKey, ...] = ()
    frame: Frame | None = None


@dataclass(frozen=True)
class Filtered:
    """An aggregate over the rows that meet a condition."""

    call: Any
    condition: Any


@dataclass(frozen=True)
class Case:
    branches: tuple[tuple[Any, Any], ...]
    otherwise: Any = None


@dataclass(frozen=True)
class Cast:
    expr: Any
    type: str


@dataclass(frozen=True)
class Named:
    expr: Any
    name: str


@dataclass(frozen=True)
class Source:
    table: str
    search: Any = None
    alias: str | None = None


@dataclass(frozen=True)
class Where:
    condition: Any


@dataclass(frozen=True)
class Eval:
    assignments: tuple[Named, ...]


@dataclass(frozen=True)
class Fields:
    patterns: tuple[str, ...]
    exclude: bool = False


@dataclass(frozen=True)
class Rename:
    pairs: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Stats:
    aggregates: tuple[Named, ...]
    keys: tuple[Named, ...] = ()
    bucket_nullable: bool = True
    window: bool = False  # eventstats
    grouping: str | None = None  # cube, rollup
    sets: tuple[tuple[str, ...], ...] | None = None  # names of keys, for grouping sets


@dataclass(frozen=True)
class Sort:
    keys: tuple[SortKey, ...]
    count: int | None = None


@dataclass(frozen=True)
class Head:
    count: int
    offset: int = 0


@dataclass(frozen=True)
class Dedup:
    fields: tuple[str, ...]
    count: int = 1
    keep_empty: bool = False


@dataclass(frozen=True)
class Join:
    kind: str
    right: Query
    left_alias: str | None
    right_alias: str | None
    condition: Any
    hint: str | None = None


@dataclass(frozen=True)
class Bin:
    field: str
    span: Any = None
    bins: int | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Rex:
    field: str
    pattern: str


@dataclass(frozen=True)
class SetOp:
    kind: str
    right: Query


@dataclass(frozen=True)
class Expand:
    field: str
    alias: str | None = None


@dataclass(frozen=True)
class Query:
    commands: tuple[Any, ...]
    explain: bool = False
    profile: bool = False
    notes: dict[str, str] = field(default_factory=dict, compare=False, hash=False)
