"""From syntax tree to DataFrame, a method for each command. Plans stay lazy and unresolved names stay errors."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import sluice.functions as functions
from sluice.functions import relevance, span
from sluice.functions.aggregates import AGGREGATES, aggregate, windowed
from sluice.functions.registry import Arg
from sluice.operators import joins, ops
from sluice.plans import syntax as S
from sluice.plans.explain import plan_text, profile
from sluice.plans.parser import parse
from sluice.sources.catalog import Catalog, ref


class UnknownColumn(LookupError):
    """The rows have no column of that name."""


@dataclass
class Rows:
    """A frame with what names mean in it: aliases of tables, the kind of strings, the last order."""

    df: DataFrame
    qualified: dict[str, str] = field(default_factory=dict)  # alias.column -> column of df
    kinds: dict[str, str] = field(default_factory=dict)
    order: list[Column] = field(default_factory=list)

    def resolve(self, name: str) -> str:
        if name in self.df.columns:
            return name
        if name in self.qualified:
            return self.qualified[name]
        raise UnknownColumn(f"no column named {name!r}; there are {', '.join(self.df.columns)}")


class Lowering:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    # queries
    def query(self, q: S.Query) -> Rows:
        rows: Rows | None = None
        commands = list(q.commands)
        for command in commands:
            name = type(command).__name__.lower()
            rows = self.source(command) if rows is None else getattr(self, name)(rows, command)
        assert rows is not None
        return rows

    def source(self, c: S.Source) -> Rows:
        df = self.catalog.load(c.table)
        rows = Rows(df, {f"{a}.{n}": n for a in {c.table, c.alias} - {None} for n in df.columns}, {n: self.catalog.kind(c.table, n) for n in df.columns})
        if c.search is not None:
            rows.df = df.where(self.search(rows, c.search))
        return rows

    def search(self, rows: Rows, e: Any) -> Column:
        """The shorthand after a source: bare words are looked for in all strings."""
        if isinstance(e, S.Call) and e.name in ("and", "or", "not"):
            return functions.build(e.name, [Arg(self.search(rows, a)) for a in e.args])
        if isinstance(e, (S.Literal, S.Name)):
            text = str(e.value if isinstance(e, S.Literal) else e.text)
            return relevance.multi_match(self.strings(rows), text, {"type": "phrase"})
        return self.expr(rows, e)

    def strings(self, rows: Rows) -> list[relevance.TextField]:
        return [relevance.TextField(ref(f.name), rows.kinds.get(f.name, "keyword")) for f in rows.df.schema.fields if isinstance(f.dataType, T.StringType)]

    # expressions
    def kind(self, rows: Rows, c: Column) -> T.DataType:
        return rows.df.select(c).schema[0].dataType

    def arg(self, rows: Rows, e: Any, bound: dict[str, Column] | None = None) -> Arg:
        c = self.expr(rows, e, bound)
        literal = isinstance(e, S.Literal)
        kind: Callable[[], T.DataType] = (lambda: T.NullType()) if bound else (lambda: self.kind(rows, c))
        return Arg(c, e.value if literal else None, literal, kind, e.text if isinstance(e, S.Name) else None)

    def expr(self, rows: Rows, e: Any, bound: dict[str, Column] | None = None) -> Column:
        if isinstance(e, S.Literal):
            return F.lit(e.value)
        if isinstance(e, S.Name):
            if bound and e.text in bound:
                return bound[e.text]
            return ref(rows.resolve(e.text))
        if isinstance(e, S.Named):
            return self.expr(rows, e.expr, bound)
        if isinstance(e, S.Case):
            out = None
            for cond, value in e.branches:
                a, b = self.expr(rows, cond, bound), self.expr(rows, value, bound)
                out = F.when(a, b) if out is None else out.when(a, b)
            return out if e.otherwise is None else out.otherwise(self.expr(rows, e.otherwise, bound))
        if isinstance(e, S.Cast):
            return self.cast(rows, e, bound)
        if isinstance(e, S.Over):
            return self.over(rows, e)
        if isinstance(e, S.Call):
            return self.call(rows, e, bound)
        raise TypeError(f"{type(e).__name__} is no value here")

    def cast(self, rows: Rows, e: S.Cast, bound: dict[str, Column] | None) -> Column:
        c = self.expr(rows, e.expr, bound)
        kind = {"integer": "int", "long": "bigint", "keyword": "string", "text": "string", "ip": "string", "timestamp": "timestamp_ntz", "datetime": "timestamp_ntz", "short": "smallint", "byte": "tinyint"}.get(e.type, e.type)
        if kind == "time":
            return functions.build("time", [self.arg(rows, e.expr, bound)])
        return c.cast(kind)

    def call(self, rows: Rows, e: S.Call, bound: dict[str, Column] | None) -> Column:
        name = e.name
        if name == "span":
            return self.span(rows, e)
        if name in relevance.OPTIONS:
            return self.relevance(rows, e)
        if name == "search=":
            return self.search_equal(rows, e)
        if name in ("forall", "exists", "filter", "transform", "mvmap", "reduce"):
            return self.higher(rows, e, bound)
        if name == "item":
            return self.expr(rows, e.args[0], bound).getField(e.args[1].value)
        if name == "position" and len(e.args) == 3:
            name = "locate"
        args = [self.arg(rows, a, bound) for a in e.args]
        if name in AGGREGATES and not any(name == n for n in functions.supported_functions()):
            raise TypeError(f"{name} is an aggregate and stands only in stats, eventstats or before over")
        return functions.build(name, self.coerced(name, args))

    def coerced(self, name: str, args: list[Arg]) -> list[Arg]:
        """Text against a time is read as a time; text and numbers side by side become text."""
        if name in ("=", "!=", "<", "<=", ">", ">=", "<=>", "in", "between") and any(a.is_literal and isinstance(a.literal, str) for a in args):
            kinds = [a.kind() for a in args if not a.is_literal]
            if any(isinstance(k, (T.TimestampType, T.TimestampNTZType)) for k in kinds):
                return [replace(a, column=functions.build("timestamp", [replace(a, kind=lambda: T.StringType())])) if a.is_literal and isinstance(a.literal, str) else a for a in args]
            if any(isinstance(k, T.DateType) for k in kinds):
                return [replace(a, column=a.column.cast("date")) if a.is_literal else a for a in args]
        if name in ("coalesce", "ifnull", "nvl", "if", "iff") and len({type(k) for a in args[name in ("if", "iff") :] if not isinstance(k := a.kind(), T.NullType)}) > 1:
            kinds = [a.kind() for a in args]
            if any(isinstance(k, T.StringType) for k in kinds) and not all(isinstance(k, T.StringType) for k in kinds[name in ("if", "iff") :]):
                return [a if name in ("if", "iff") and i == 0 else replace(a, column=a.column.cast("string")) for i, a in enumerate(args)]
        return args

    def search_equal(self, rows: Rows, e: S.Call) -> Column:
        left, right = e.args
        column = rows.resolve(left.text) if isinstance(left, S.Name) else None
        if column and isinstance(right, S.Literal) and isinstance(right.value, str):
            value = right.value
            if rows.kinds.get(column) == "text":
                return relevance.match_phrase(relevance.TextField(ref(column), "text"), value, {})
            if "*" in value or "?" in value:
                return ref(column).rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in value) + "$")
        return self.call(rows, S.Call("=", e.args), None)

    def higher(self, rows: Rows, e: S.Call, bound: dict[str, Column] | None) -> Column:
        array = self.expr(rows, e.args[0], bound)
        outer = bound or {}
        if e.name == "mvmap" and not isinstance(e.args[1], S.Lambda):
            item = e.args[0].text
            return F.transform(array, lambda x: self.expr(rows, e.args[1], {**outer, item: x}))
        if e.name == "reduce":
            start, step = e.args[1], e.args[2]
            merge = lambda a, x: self.expr(rows, step.body, {**outer, step.params[0]: a, step.params[1]: x})
            if len(e.args) == 4:
                last = e.args[3]
                return F.aggregate(array, self.expr(rows, start, bound), merge, lambda a: self.expr(rows, last.body, {**outer, last.params[0]: a}))
            return F.aggregate(array, self.expr(rows, start, bound), merge)
        fn = e.args[1]
        f = {"forall": F.forall, "exists": F.exists, "filter": F.filter, "transform": F.transform, "mvmap": F.transform}[e.name]
        if len(fn.params) == 2:
            return f(array, lambda x, i: self.expr(rows, fn.body, {**outer, fn.params[0]: x, fn.params[1]: i}))
        return f(array, lambda x: self.expr(rows, fn.body, {**outer, fn.params[0]: x}))

    def span(self, rows: Rows, e: S.Call) -> Column:
        c = self.expr(rows, e.args[0])
        width = e.args[1]
        if isinstance(width, S.Span):
            return span.span(c, width.width, width.unit, self.kind(rows, c))
        if not isinstance(width, S.Literal) or not isinstance(width.value, (int, float)):
            raise ValueError("the width of a span must be a number")
        unit = e.args[2].text if len(e.args) > 2 and isinstance(e.args[2], S.Name) else e.args[2].value if len(e.args) > 2 else None
        return span.span(c, width.value, unit, self.kind(rows, c))

    def relevance(self, rows: Rows, e: S.Call) -> Column:
        named = {k: (v.value if isinstance(v, S.Literal) else v) for k, v in e.named}
        many = e.name in ("multi_match", "simple_query_string", "query_string")
        args = list(e.args)
        fields = named.pop("fields" if many else "field", None)
        query = named.pop("query", None)
        if fields is None and args and (len(args) > 1 or not many or query is not None):
            fields = args.pop(0)
        if query is None and args:
            query = args.pop(0)
        if isinstance(query, S.Literal):
            query = query.value
        if query is None or not many and fields is None:
            raise ValueError(f"{e.name} wants a field and a query")
        if args:
            raise ValueError(f"{e.name} has too many arguments")
        for k in named:
            if k not in relevance.OPTIONS[e.name]:
                raise ValueError(f"{e.name} has no option {k!r}")
        lookup = lambda n: relevance.TextField(ref(rows.resolve(n)), rows.kinds.get(rows.resolve(n), "keyword"))
        if not many:
            text = fields.text if isinstance(fields, S.Name) else fields.value if isinstance(fields, S.Literal) else str(fields)
            f = lookup(text)
            if e.name == "match_phrase_prefix":
                return relevance.match_phrase(f, str(query), named, prefix=True)
            return getattr(relevance, e.name)(f, str(query), named)
        if fields is None:
            found = self.strings(rows)
        else:
            items = [i.value for i in fields.args] if isinstance(fields, S.Call) else [fields.text if isinstance(fields, S.Name) else fields.value if isinstance(fields, S.Literal) else str(fields)]
            names = [n for i in items for n in ([i] if "*" not in i else [c for c in rows.df.columns if fnmatch.fnmatchcase(c, i)])]
            found = [lookup(n) for n in names]
        if e.name == "query_string":
            return relevance.query_string(found, str(query), named, lookup)
        return getattr(relevance, e.name)(found, str(query), named)

    def keys(self, rows: Rows, keys: tuple[S.SortKey, ...]) -> list[Column]:
        out = []
        for k in keys:
            c = self.expr(rows, k.expr)
            first = k.nulls_first if k.nulls_first is not None else k.ascending
            out.append((c.asc_nulls_first() if first else c.asc_nulls_last()) if k.ascending else (c.desc_nulls_first() if first else c.desc_nulls_last()))
        return out

    def over(self, rows: Rows, e: S.Over) -> Column:
        w = Window.partitionBy(*[self.expr(rows, p) for p in e.partition])
        if e.order:
            w = w.orderBy(*self.keys(rows, e.order))
        if e.frame:
            low = Window.unboundedPreceding if e.frame.low is None else e.frame.low
            high = Window.unboundedFollowing if e.frame.high is None else e.frame.high
            w = w.rowsBetween(low, high) if e.frame.kind == "rows" else w.rangeBetween(low, high)
        name, distinct = e.call.name, e.call.distinct
        out = windowed(name, [self.arg(rows, a) for a in e.call.args], distinct).over(w)
        if name in ("dc", "distinct_count") or distinct and name == "count":
            out = F.size(out)
        return out.cast("bigint") if name in ("row_number", "rank", "dense_rank", "dc", "distinct_count") or distinct else out

    # commands
    def where(self, rows: Rows, c: S.Where) -> Rows:
        return replace(rows, df=rows.df.where(self.expr(rows, c.condition)))

    def eval(self, rows: Rows, c: S.Eval) -> Rows:
        for a in c.assignments:
            rows = replace(rows, df=rows.df.withColumn(a.name, self.expr(rows, a.expr)), kinds=rows.kinds | {a.name: "keyword"} if a.name not in rows.df.columns else rows.kinds)
        return rows

    def fields(self, rows: Rows, c: S.Fields) -> Rows:
        names: list[tuple[str, str]] = []
        for p in c.patterns:
            quoted = p.startswith("`")
            p = p.strip("`")
            if "*" in p and not quoted:
                found = [(n, n) for n in rows.df.columns if fnmatch.fnmatchcase(n, p.replace("[", "[[]"))]
                if not found and not c.exclude:
                    raise UnknownColumn(f"no column is like {p!r}")
                names += found
            elif not quoted and p not in rows.df.columns and p not in rows.qualified and (inside := [n for n in rows.df.columns if n.startswith(p + ".")]):
                names += [(n, n) for n in inside]  # an object with its fields
            else:
                names.append((rows.resolve(p), p))
        if c.exclude:
            gone = {n for n, _ in names}
            return replace(rows, df=rows.df.select(*[ref(n) for n in rows.df.columns if n not in gone]))
        names = list(dict.fromkeys(names))
        out = rows.df.select(*[ref(n).alias(p) for n, p in names])
        return Rows(out, {k: p for k, v in rows.qualified.items() for n, p in names if n == v}, {p: rows.kinds.get(n, "keyword") for n, p in names}, rows.order)

    def rename(self, rows: Rows, c: S.Rename) -> Rows:
        new = {rows.resolve(a): b for a, b in c.pairs}
        return Rows(rows.df.select(*[ref(n).alias(new.get(n, n)) for n in rows.df.columns]), {k: new.get(v, v) for k, v in rows.qualified.items()}, {new.get(n, n): k for n, k in rows.kinds.items()}, [])

    def aggregates(self, rows: Rows, named: tuple[S.Named, ...]) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for a in named:
            call, condition = (a.expr.call, self.expr(rows, a.expr.condition)) if isinstance(a.expr, S.Filtered) else (a.expr, None)
            if isinstance(call, S.Name) and call.text.lower() in ("count", "c"):
                call = S.Call("count")
            if not isinstance(call, S.Call):
                raise TypeError(f"{a.name} is no aggregate")
            fn, args = call.name, list(call.args)
            if m := re.fullmatch(r"(?:perc|p)(\d+(?:\.\d+)?)", fn):
                fn, args = "percentile_approx", [args[0], S.Literal(float(m[1]))]
            if fn in ("earliest", "latest") and len(args) == 1:
                args.append(S.Name("@timestamp"))
            found = [self.arg(rows, x) for x in args]
            if condition is not None:  # every aggregate leaves nulls out
                found = [replace(x, column=F.when(condition, x.column)) for x in found] or [Arg(F.when(condition, F.lit(1)))]
            out[a.name] = aggregate(fn, found, call.distinct)
        return out

    def stats(self, rows: Rows, c: S.Stats) -> Rows:
        if c.window:
            keys = {k.name: self.expr(rows, k.expr) for k in c.keys}
            return replace(rows, df=ops.eventstats(rows.df, self.aggregates(rows, c.aggregates), keys), order=[])
        keys = {k.name: self.expr(rows, k.expr) for k in c.keys}
        aggregates = self.aggregates(rows, c.aggregates)
        df = rows.df
        # Keys become columns first, so that an aggregate may bear the name of what it is over.
        if not keys:
            out = df.agg(*[a.alias(n) for n, a in aggregates.items()])
        else:
            named = [k.alias(n) for n, k in keys.items()]
            if not c.bucket_nullable:
                for k in keys.values():
                    df = df.where(k.isNotNull())
            made = [a.alias(n) for n, a in aggregates.items()]
            if c.sets is not None:
                names = {k.name: rows.resolve(k.name) for k in c.keys}
                grouped = ops.grouping_sets(df, [[names[k] for k in some] for some in c.sets], made)
                named = [ref(o).alias(n) for n, o in names.items()]
                out = grouped.select(*[ref(n) for n in aggregates], *named)
                return Rows(out, {q: n for q, n in rows.qualified.items() if n in keys}, {n: rows.kinds.get(n, "keyword") for n in out.columns})
            grouped = (df.cube if c.grouping == "cube" else df.rollup if c.grouping == "rollup" else df.groupBy)(*named).agg(*made)
            out = grouped.select(*[ref(n) for n in aggregates], *[ref(n) for n in keys])
        kinds = {n: rows.kinds.get(n, "keyword") for n in out.columns}
        return Rows(out, {q: n for q, n in rows.qualified.items() if n in keys}, kinds)

    def sort(self, rows: Rows, c: S.Sort) -> Rows:
        keys = self.keys(rows, c.keys)
        df = rows.df.orderBy(*keys)
        return replace(rows, df=df.limit(c.count) if c.count else df, order=keys)

    def head(self, rows: Rows, c: S.Head) -> Rows:
        df = rows.df.offset(c.offset) if c.offset else rows.df
        return replace(rows, df=df.limit(c.count))

    def dedup(self, rows: Rows, c: S.Dedup) -> Rows:
        return replace(rows, df=ops.dedup(rows.df, [rows.resolve(f) for f in c.fields], rows.order, c.count, c.keep_empty))

    def bin(self, rows: Rows, c: S.Bin) -> Rows:
        name = rows.resolve(c.field)
        target = c.alias or name
        if c.bins is not None:
            return replace(rows, df=ops.bin_count(rows.df, name, c.bins, target))
        e = c.span
        if isinstance(e, S.Name) and (m := re.fullmatch(r"(?:\d+(?:\.\d+)?)?log(\d+(?:\.\d+)?)?", e.text)):
            new = span.log_bucket(ref(name), float(m[1] or 10))
        elif isinstance(e, (S.Span, S.Literal)):
            new = self.span(rows, S.Call("span", (S.Name(name), e)))
        else:
            raise ValueError("bin wants span= or bins=")
        return replace(rows, df=rows.df.withColumn(target, new))

    def rex(self, rows: Rows, c: S.Rex) -> Rows:
        """A column for each named group; null where the pattern does not match."""
        groups = _groups(c.pattern)
        if not groups:
            raise ValueError("rex wants a pattern with named groups")
        source = ref(rows.resolve(c.field))
        df = rows.df
        new = {n: F.when(source.rlike(c.pattern), F.regexp_extract(source, c.pattern, i)) for n, i in groups.items()}
        return replace(rows, df=df.withColumns(new))

    def setop(self, rows: Rows, c: S.SetOp) -> Rows:
        right = self.query(c.right).df
        f = {"append": ops.union, "union": lambda a, b: ops.union(a, b, True), "intersect": ops.intersect, "except": ops.except_}[c.kind]
        return Rows(f(rows.df, right), rows.qualified, rows.kinds)

    def expand(self, rows: Rows, c: S.Expand) -> Rows:
        name = rows.resolve(c.field)
        alias = c.alias or name
        kept = [ref(n) for n in rows.df.columns if n != alias]
        return replace(rows, df=rows.df.select(*kept, F.explode_outer(ref(name)).alias(alias)), order=[])

    def join(self, rows: Rows, c: S.Join) -> Rows:
        right = self.query(c.right)
        table = c.right.commands[0]
        right_name = c.right_alias or (table.alias or table.table if isinstance(table, S.Source) else "right")
        # Columns of the right that the left has too are named after the right's alias.
        clash = {n: f"{right_name}.{n}" if n in rows.df.columns else n for n in right.df.columns}
        renamed = right.df.select(*[ref(n).alias(clash[n]) for n in right.df.columns])
        qualified = dict(rows.qualified)
        if c.left_alias:
            qualified |= {f"{c.left_alias}.{n}": n for n in rows.df.columns if "." not in n}
        qualified |= {f"{right_name}.{n}": m for n, m in clash.items()}
        both = Rows(rows.df.limit(0).crossJoin(renamed.limit(0)), qualified)
        condition = None if c.condition is None else self.expr(both, c.condition)
        out = joins.join(rows.df, renamed, condition, c.kind, c.hint)
        if c.kind in ("left_semi", "left_anti"):
            return Rows(out, {k: v for k, v in qualified.items() if v in out.columns}, rows.kinds)
        return Rows(out, qualified, rows.kinds | {clash[n]: k for n, k in right.kinds.items()})


def _groups(pattern: str) -> dict[str, int]:
    """Numbers of named groups."""
    out, n, at, inside = {}, 0, 0, False
    while at < len(pattern):
        ch = pattern[at]
        if ch == "\\":
            at += 2
            continue
        if ch == "[":
            inside = True
        elif ch == "]":
            inside = False
        elif ch == "(" and not inside:
            m = re.match(r"\(\?<([A-Za-z]\w*)>", pattern[at:])
            if m or pattern[at : at + 2] != "(?":
                n += 1
                if m:
                    out[m[1]] = n
        at += 1
    return out


def run(catalog: Catalog, text: str, max_rows: int | None = None) -> DataFrame:
    """The DataFrame of a query, with ``max_rows`` rows at most if a limit is set.

    Of ``explain`` a single row with its plan; of ``profile``, which runs it, a row
    for each counter of each node of the executed plan, in the plan's order.
    """
    q = parse(text)
    df = Lowering(catalog).query(q).df
    if max_rows is not None:
        df = df.limit(max_rows)
    if q.explain:
        return catalog.spark.createDataFrame([(plan_text(df),)], "plan string")
    if q.profile:
        node, seconds = profile(df)
        rows = [(0, 0, "query", "milliseconds", int(seconds * 1000)), *((n, *r) for n, r in enumerate(node.rows(), 1))]
        return catalog.spark.createDataFrame(rows, "position int, depth int, node string, metric string, value bigint")
    return df
