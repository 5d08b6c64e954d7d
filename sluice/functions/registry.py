"""Names of scalar functions and what they build. Every builder returns a plain column expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import types as T


class UnknownFunction(LookupError):
    """The language has no function of that name."""


@dataclass
class Arg:
    """An argument: its column, the constant behind it if it is one, and its type on demand."""

    column: Column
    literal: Any = None
    is_literal: bool = False
    kind: Callable[[], T.DataType] = lambda: T.NullType()
    name: str | None = None


Builder = Callable[..., Column]
_SCALARS: dict[str, tuple[Builder, int, int | None]] = {}


def scalar(*names: str, least: int | None = None, most: int | None = None) -> Callable[[Builder], Builder]:
    """Register a builder of ``Arg``s under ``names``; the counts of arguments default to those of its signature."""

    def wrap(f: Builder) -> Builder:
        code = f.__code__
        n = code.co_argcount
        low = least if least is not None else n - len(f.__defaults__ or ())
        high = most if most is not None else (None if code.co_flags & 4 else n)
        for name in names:
            _SCALARS[name] = (f, low, high)
        return f

    return wrap


def build(name: str, args: list[Arg]) -> Column:
    if name not in _SCALARS:
        raise UnknownFunction(f"no function named {name!r}")
    f, low, high = _SCALARS[name]
    if len(args) < low or high is not None and len(args) > high:
        raise TypeError(f"{name} takes {low}" + ("" if high == low else f" to {high}" if high is not None else " or more") + f" arguments, not {len(args)}")
    return f(*args)


def supported_functions() -> list[str]:
    return sorted(_SCALARS)


def constant(a: Arg, what: str) -> Any:
    if not a.is_literal:
        raise TypeError(f"{what} must be a constant")
    return a.literal
