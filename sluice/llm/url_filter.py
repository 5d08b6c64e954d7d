"""URL filters: rule look-up by hashed host-suffix and path-prefix expressions.

Every URL expands into the suffixes of its host times the prefixes of its path.
Each expression is hashed; the short hash prefix is the equi-join key against the
rules, the full digest confirms the hit, and the rule of highest precedence wins.
All of it is DataFrame code, with no Python on the executors.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules the rule side is broadcast; it is built from a driver-side list, so its size is known.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("1")).otherwise(F.lit(None))
    after = F.when(rest.isNotNull(), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ranked(rules: Sequence[Rule]) -> list[tuple[int, Rule]]:
    """Rules with a precedence that is higher for longer ones.

    Ties: the longer host, then block before allow, then the text. Of two equal
    rules with different verdicts, block holds.
    """
    best: dict[tuple[str, str], Rule] = {}
    for r in rules:
        old = best.get((r.host, r.path))
        if old is None or r.verdict == "block":
            best[r.host, r.path] = r
    order = sorted(best.values(), key=lambda r: (len(r.text), len(r.host), r.verdict == "block", r.text))
    return list(enumerate(order, 1))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row of ``pages``: columns id, ``host``, ``path``, ``rule``, ``verdict``.

    A rule fits its host and all subdomains of it if the URL's path starts with
    the rule's path. Rows keep their multiplicity; a null or relative URL has an
    empty host and path and gets ``default``. Other columns are ignored, whatever
    their names. No rules: every row gets ``default``. Rules are a driver-side
    list; beyond ``BROADCAST_RULES`` of them they are joined by shuffle.

    Host suffixes of more labels than any rule's host, and path prefixes of
    lengths that no rule has, can equal no rule and are not expanded.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    order = ranked(rules)
    if not order:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = max(r.host.count(".") + 1 for _, r in order)
    lengths = sorted({len(r.path) for _, r in order})
    listed = json.dumps([{"rank": i, "rule": r.text, "rule_verdict": r.verdict} for i, r in order])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<rank:int,rule:string,rule_verdict:string>>")))
    table = table.withColumn("digest", F.sha2("rule", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    if len(order) <= BROADCAST_RULES:
        table = F.broadcast(table)

    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, labels + 1)]))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    seen = (
        rows.withColumn("row", F.monotonically_increasing_id())
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("head", F.explode(prefixes))
        .withColumn("url_digest", F.sha2(F.concat("suffix", "head"), 256))
        .withColumn("url_prefix", F.substring("url_digest", 1, PREFIX_HEX))
    )
    hit = (F.col("url_prefix") == F.col("prefix")) & (F.col("url_digest") == F.col("digest"))
    best = seen.join(table.select("rank", "digest", "prefix"), hit, "left").groupBy("row", "page_id", "host", "path").agg(F.max("rank").alias("best"))
    return best.join(table.select(F.col("rank").alias("best"), "rule", "rule_verdict"), "best", "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))
