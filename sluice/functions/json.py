"""JSON functions over strings; paths are dotted names with optional [n] or {} for elements."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.registry import Arg, constant, scalar


def _path(path: str) -> str:
    return path if path.startswith("$") else "$." + re.sub(r"\{(\d*)\}", lambda m: f"[{m[1] or '*'}]", path)


@scalar("json_extract", "get_json_object", least=2)
def json_extract(text: Arg, *paths: Arg) -> Column:
    found = [F.get_json_object(text.column, _path(constant(p, "a path"))) for p in paths]
    return found[0] if len(found) == 1 else F.to_json(F.array(*found))


@scalar("json_valid")
def json_valid(text: Arg) -> Column:
    return F.coalesce(F.try_parse_json(text.column).isNotNull(), F.lit(False))


@scalar("json")
def json(text: Arg) -> Column:
    return F.when(F.try_parse_json(text.column).isNotNull(), text.column)


@scalar("json_object", least=2)
def json_object(*args: Arg) -> Column:
    return F.to_json(F.struct(*[v.column.alias(constant(k, "a key")) for k, v in zip(args[::2], args[1::2], strict=True)]))


@scalar("json_array", least=1)
def json_array(*args: Arg) -> Column:
    return F.to_json(F.array(*[a.column for a in args]))


@scalar("json_array_length")
def json_array_length(a: Arg) -> Column:
    return F.json_array_length(a.column)


@scalar("json_keys")
def json_keys(a: Arg) -> Column:
    return F.to_json(F.json_object_keys(a.column))


def _entries(text: Column) -> Column:
    """Top-level keys with their values as JSON text, strings quoted again."""
    keys = F.json_object_keys(text)
    as_map = F.from_json(text, "map<string,string>")
    return F.transform(keys, lambda k: F.struct(k.alias("k"), as_map[k].alias("v")))


def _assemble(entries: Column) -> Column:
    """A JSON object from keys and raw values; values that are not JSON themselves are quoted."""
    one = lambda e: F.concat(F.lit('"'), e["k"], F.lit('":'), F.when(e["v"].isNull(), "null").when(F.try_parse_json(e["v"]).isNotNull(), e["v"]).otherwise(F.regexp_extract(F.to_json(F.array(e["v"])), r"^\[(.*)\]$", 1)))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, one), ","), F.lit("}"))


@scalar("json_delete", least=2)
def json_delete(text: Arg, *keys: Arg) -> Column:
    """Without some top-level keys."""
    gone = [constant(k, "a key") for k in keys]
    return _assemble(F.filter(_entries(text.column), lambda e: ~e["k"].isin(gone)))


@scalar("json_set", least=3)
def json_set(text: Arg, *pairs: Arg) -> Column:
    """With new values at top-level keys that it has."""
    new = {constant(k, "a key"): v.column.cast("string") for k, v in zip(pairs[::2], pairs[1::2], strict=True)}

    def one(e: Column) -> Column:
        value = e["v"]
        for k, v in new.items():
            value = F.when(e["k"] == k, v).otherwise(value)
        return F.struct(e["k"].alias("k"), value.alias("v"))

    return _assemble(F.transform(_entries(text.column), one))


def _grown(text: Arg, pairs: tuple[Arg, ...], spread: bool) -> Column:
    new = {constant(k, "a key"): v for k, v in zip(pairs[::2], pairs[1::2], strict=True)}

    def one(e: Column) -> Column:
        value = e["v"]
        for k, v in new.items():
            added = F.regexp_extract(F.to_json(v.column if spread else F.array(v.column)), r"^\[(.*)\]$", 1)
            grown = F.concat(F.regexp_extract(e["v"], r"^(.*)\]$", 1), F.when(e["v"].rlike(r"^\[\s*\]$"), "").otherwise(","), added, F.lit("]"))
            value = F.when(e["k"] == k, grown).otherwise(value)
        return F.struct(e["k"].alias("k"), value.alias("v"))

    return _assemble(F.transform(_entries(text.column), one))


@scalar("json_append", least=3)
def json_append(text: Arg, *pairs: Arg) -> Column:
    """With a value more at the end of arrays at top-level keys."""
    return _grown(text, pairs, False)


@scalar("json_extend", least=3)
def json_extend(text: Arg, *pairs: Arg) -> Column:
    """With all elements of an array more at the end of arrays at top-level keys."""
    return _grown(text, pairs, True)
