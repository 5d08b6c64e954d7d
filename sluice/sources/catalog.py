"""Table names, struct flattening and re-nesting, and the analysis kind of string columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields that an index keeps about a row; scans leave them out.
METADATA = frozenset({"_id", "_index", "_score", "_maxscore", "_sort", "_routing"})


def ref(name: str) -> Column:
    """Column of that very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, Column]]:
    """Leaf fields of nested structs under dotted names; arrays and maps are leaves."""
    out: list[tuple[str, Column]] = []
    for f in schema.fields:
        path = f"{prefix}.`{f.name}`" if prefix else f"`{f.name}`"
        if isinstance(f.dataType, T.StructType):
            out += leaves(f.dataType, path)
        else:
            out.append((path.replace("`", ""), F.col(path)))
    return out


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields as top-level columns with dotted names, metadata fields left out. Only columns that are used are read."""
    return df.select(*[c.alias(n) for n, c in leaves(df.schema) if n not in METADATA])


def renest(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Dotted columns gathered into structs again, but for those in ``keep``; a struct stands where its first field stood."""
    keep = set(keep)

    def build(items: list[tuple[list[str], Column]]) -> list[Column]:
        groups: dict[str, list[tuple[list[str], Column]]] = {}
        for path, c in items:
            groups.setdefault(path[0], []).append((path[1:], c))
        out = []
        for name, rest in groups.items():
            plain = [c for p, c in rest if not p]
            out += [c.alias(name) for c in plain]
            if nested := [(p, c) for p, c in rest if p]:
                out.append(F.struct(*build(nested)).alias(name))
        return out

    return df.select(*build([([n] if n in keep else n.split("."), ref(n)) for n in df.columns]))


@dataclass
class Catalog:
    """Names of tables for ``source =`` and joins.

    A table is a path of Parquet files, a frame, or a function that makes one.
    ``kinds`` says for ``table.column`` whether it is ``text`` (analysed into
    terms) or ``keyword`` (one term); strings are keywords unless said otherwise.
    """

    spark: SparkSession
    tables: dict[str, str | DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of_directory(cls, spark: SparkSession, path: str, names: Iterable[str], kinds: dict[str, str] | None = None) -> Catalog:
        return cls(spark, {n: f"{path}/{n}.parquet" for n in names}, kinds or {})

    def register(self, name: str, table: str | DataFrame | Callable[[], DataFrame], **kinds: str) -> None:
        self.tables[name] = table
        self.kinds.update({f"{name}.{c}": k for c, k in kinds.items()})

    def load(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise LookupError(f"no table named {name!r}")
        t = self.tables[name]
        df = self.spark.read.parquet(t) if isinstance(t, str) else t if isinstance(t, DataFrame) else t()
        return flatten(df)

    def kind(self, table: str | None, column: str) -> str:
        return self.kinds.get(f"{table}.{column}", "keyword")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A file source: parquet, orc, json, csv, text. JSON and CSV want a schema, so that no extra pass infers it."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Iterable[str] = (), mode: str = "errorifexists", **options: str) -> None:
    df.write.format(fmt).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, *keys: str, mode: str = "overwrite") -> None:
    """A table bucketed and sorted by its join keys; two such tables of one bucket count join without a shuffle."""
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def analyze(spark: SparkSession, table: str, *columns: str) -> None:
    """Row counts and column statistics for the cost-based optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(columns)}" if columns else ""))
