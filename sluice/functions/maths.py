"""Arithmetic, mathematical, trigonometric and hash functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.registry import Arg, constant, scalar


def _whole(*args: Arg) -> bool:
    return all(isinstance(a.kind(), T.IntegralType) for a in args)


@scalar("+", "add")
def add(a: Arg, b: Arg) -> Column:
    return a.column + b.column


@scalar("-", "subtract")
def subtract(a: Arg, b: Arg) -> Column:
    return a.column - b.column


@scalar("*", "multiply")
def multiply(a: Arg, b: Arg) -> Column:
    return a.column * b.column


@scalar("/", "divide")
def divide(a: Arg, b: Arg) -> Column:
    """Whole numbers divide to whole numbers, towards zero; by zero gives null."""
    if _whole(a, b):
        return F.call_function("div", a.column, F.nullif(b.column, F.lit(0)))
    return F.try_divide(a.column.cast("double"), b.column.cast("double"))


@scalar("%", "mod", "modulus")
def mod(a: Arg, b: Arg) -> Column:
    return F.try_mod(a.column, b.column)


@scalar("negate")
def negate(a: Arg) -> Column:
    return -a.column


@scalar("ceil", "ceiling")
def ceil(a: Arg) -> Column:
    return F.ceil(a.column).cast("double") if isinstance(a.kind(), T.FractionalType) else a.column


@scalar("floor")
def floor(a: Arg) -> Column:
    return F.floor(a.column).cast("double") if isinstance(a.kind(), T.FractionalType) else a.column


@scalar("round")
def round_(a: Arg, d: Arg | None = None) -> Column:
    """Half away from zero. Of a double the stored value counts, not the decimal it prints as: 1222.745 lies below the half."""
    n = 0 if d is None else int(constant(d, "the digits of round"))
    if n == 0 or not isinstance(a.kind(), (T.DoubleType, T.FloatType)):
        return F.round(a.column, n)
    power = F.lit(10.0 ** abs(n))
    out = F.round(a.column * power) / power if n > 0 else F.round(a.column / power) * power
    return F.when(F.abs(out) < float("inf"), out).otherwise(a.column)


@scalar("truncate")
def truncate(a: Arg, d: Arg) -> Column:
    p = F.pow(F.lit(10.0), d.column)
    x = a.column.cast("double")
    return F.signum(x) * F.floor(F.abs(x) * p) / p


@scalar("rand", least=0, most=1)
def rand(*seed: Arg) -> Column:
    return F.rand(int(constant(seed[0], "the seed"))) if seed else F.rand()


@scalar("log")
def log(a: Arg, b: Arg | None = None) -> Column:
    """Natural logarithm; with two arguments the first is the base."""
    return F.ln(a.column) if b is None else F.ln(b.column) / F.ln(a.column)


@scalar("conv")
def conv(a: Arg, base: Arg, to: Arg) -> Column:
    return F.lower(F.conv(a.column.cast("string"), constant(base, "a base"), constant(to, "a base")))


@scalar("sha2")
def sha2(a: Arg, bits: Arg) -> Column:
    return F.sha2(a.column, int(constant(bits, "the bits of sha2")))


for _names, _f in {
    ("abs",): F.abs, ("sign", "signum"): F.signum, ("cbrt",): F.cbrt, ("exp",): F.exp, ("expm1",): F.expm1, ("ln",): F.ln, ("log10",): F.log10, ("log2",): F.log2, ("sqrt",): F.sqrt,
    ("rint",): F.rint, ("cos",): F.cos, ("sin",): F.sin, ("tan",): F.tan, ("acos",): F.acos, ("asin",): F.asin, ("atan",): F.atan, ("cosh",): F.cosh, ("sinh",): F.sinh, ("cot",): F.cot,
    ("radians",): F.radians, ("degrees",): F.degrees, ("md5",): F.md5, ("sha1",): F.sha1, ("sha256",): lambda c: F.sha2(c, 256), ("crc32",): F.crc32,
}.items():
    scalar(*_names, least=1, most=1)(lambda a, f=_f: f(a.column))
for _names, _f2 in {("pow", "power"): F.pow, ("atan2",): F.atan2}.items():
    scalar(*_names, least=2, most=2)(lambda a, b, f=_f2: f(a.column, b.column))
for _name, _value in {"pi": F.pi, "e": F.e}.items():
    scalar(_name, least=0, most=0)(lambda f=_value: f())
