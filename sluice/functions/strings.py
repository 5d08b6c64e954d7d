"""String functions and pattern predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.registry import Arg, constant, scalar

for _names, _f in {("upper", "ucase"): F.upper, ("lower", "lcase"): F.lower, ("reverse",): F.reverse, ("ascii",): F.ascii}.items():
    scalar(*_names, least=1, most=1)(lambda a, f=_f: f(a.column))


@scalar("length", "char_length", "character_length")
def length(a: Arg) -> Column:
    return F.length(a.column.cast("string"))


@scalar("concat", least=1)
def concat(*args: Arg) -> Column:
    return F.concat(*[a.column.cast("string") for a in args])


@scalar("concat_ws", least=2)
def concat_ws(sep: Arg, *args: Arg) -> Column:
    return F.concat_ws(constant(sep, "the separator"), *[a.column.cast("string") for a in args])


@scalar("substring", "substr")
def substring(a: Arg, start: Arg, n: Arg | None = None) -> Column:
    return F.substr(a.column, start.column) if n is None else F.substr(a.column, start.column, n.column)


@scalar("replace")
def replace(a: Arg, old: Arg, new: Arg) -> Column:
    return F.replace(a.column, old.column, new.column)


@scalar("position", "strpos")
def position(what: Arg, text: Arg) -> Column:
    return F.position(what.column, text.column)


@scalar("locate")
def locate(what: Arg, text: Arg, start: Arg | None = None) -> Column:
    return F.position(what.column, text.column) if start is None else F.position(what.column, text.column, start.column)


@scalar("instr")
def instr(text: Arg, what: Arg) -> Column:
    return F.position(what.column, text.column)


@scalar("lpad")
def lpad(a: Arg, n: Arg, pad: Arg) -> Column:
    return F.lpad(a.column, n.column, pad.column)


@scalar("rpad")
def rpad(a: Arg, n: Arg, pad: Arg) -> Column:
    return F.rpad(a.column, n.column, pad.column)


@scalar("left")
def left(a: Arg, n: Arg) -> Column:
    return F.left(a.column, n.column)


@scalar("right")
def right(a: Arg, n: Arg) -> Column:
    return F.right(a.column, n.column)


@scalar("trim")
def trim(a: Arg, chars: Arg | None = None) -> Column:
    return F.btrim(a.column) if chars is None else F.btrim(a.column, chars.column)


@scalar("ltrim")
def ltrim(a: Arg, chars: Arg | None = None) -> Column:
    return F.ltrim(a.column) if chars is None else F.ltrim(a.column, chars.column)


@scalar("rtrim")
def rtrim(a: Arg, chars: Arg | None = None) -> Column:
    return F.rtrim(a.column) if chars is None else F.rtrim(a.column, chars.column)


@scalar("strcmp")
def strcmp(a: Arg, b: Arg) -> Column:
    return F.when(a.column < b.column, -1).when(a.column > b.column, 1).when(a.column == b.column, 0)


@scalar("like")
def like(a: Arg, pattern: Arg, sensitive: Arg | None = None) -> Column:
    """``%`` and ``_`` patterns; case counts unless the third argument is false."""
    if sensitive is not None and constant(sensitive, "the third argument of like") is False:
        return F.ilike(a.column, pattern.column)
    return F.like(a.column, pattern.column)


@scalar("ilike")
def ilike(a: Arg, pattern: Arg) -> Column:
    return F.ilike(a.column, pattern.column)


@scalar("regexp_like", "regexp_match", "regexp", "rlike")
def regexp_like(a: Arg, pattern: Arg) -> Column:
    return F.rlike(a.column, pattern.column)


@scalar("regexp_replace")
def regexp_replace(a: Arg, pattern: Arg, new: Arg) -> Column:
    """Replaces every match; groups are written as backslash and number, or dollar and number."""
    if new.is_literal:
        return F.regexp_replace(a.column, pattern.column, F.lit(re.sub(r"\\(\d)", r"$\1", new.literal)))
    return F.regexp_replace(a.column, pattern.column, new.column)


@scalar("regexp_extract")
def regexp_extract(a: Arg, pattern: Arg, group: Arg | None = None) -> Column:
    return F.regexp_extract(a.column, constant(pattern, "the pattern"), 1 if group is None else int(constant(group, "the group")))


@scalar("contains")
def contains(a: Arg, b: Arg) -> Column:
    return F.contains(F.lower(a.column), F.lower(b.column))


@scalar("tostring")
def tostring(a: Arg, fmt: Arg | None = None) -> Column:
    if fmt is None:
        return a.column.cast("string")
    how = constant(fmt, "the format of tostring")
    return {
        "hex": lambda: F.lower(F.hex(a.column.cast("bigint"))),
        "binary": lambda: F.bin(a.column.cast("bigint")),
        "commas": lambda: F.format_number(a.column, 2),
        "duration": lambda: F.date_format(F.timestamp_seconds(a.column), "HH:mm:ss"),
    }[how]()


@scalar("tonumber")
def tonumber(a: Arg, base: Arg | None = None) -> Column:
    if base is None or constant(base, "the base") == 10:
        return F.try_cast(a.column, "double") if hasattr(F, "try_cast") else a.column.try_cast("double")
    return F.conv(a.column, constant(base, "the base"), 10).cast("double")


@scalar("typeof")
def typeof(a: Arg) -> Column:
    return F.upper(F.typeof(a.column))


def _in_block6(ip: Column, net: str, bits: int) -> Column:
    import ipaddress

    head = format(int(ipaddress.IPv6Address(net)), "0128b")[:bits]
    # Groups on both sides of the gap, if there is one, which stands for the zero groups that are missing.
    groups = lambda c: F.filter(F.split(c, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(ip, "::", 1)), groups(F.when(ip.contains("::"), F.substring_index(ip, "::", -1)).otherwise(""))
    missing = F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))
    whole = F.concat(left, F.array_repeat(F.lit("0"), missing), right)
    text = F.array_join(F.transform(whole, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    valid = ip.rlike(r"^[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}$") & ~ip.rlike(":::|::.*::") & (ip.contains("::") & (missing > 0) | (~ip.contains("::") & (F.size(left) == 8)))
    return F.when(valid, text.startswith(head))


@scalar("cidrmatch")
def cidrmatch(ip: Arg, block: Arg) -> Column:
    """Whether an address is in a block, by whole-number arithmetic (version 4) or leading bits (version 6); null for what is no address of the block's version."""
    net, bits = constant(block, "the block").split("/")
    if ":" in net:
        return _in_block6(ip.column, net, int(bits))

    def number(text: Column) -> Column:
        parts = F.split(text, r"\.")
        return F.when(text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), sum((parts[i].cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0)))

    size = 1 << (32 - int(bits))
    base = 0
    for p in net.split("."):
        base = base * 256 + int(p)
    low = base // size * size
    return number(ip.column).between(low, low + size - 1)
