"""Connected components of a graph given as an edge table, by alternating star contraction.

Each round links every node to the smallest node that it knows (large star), then
the smaller neighbours of every node to the smallest of them (small star). Edges
stay distributed throughout; a round is cut from its lineage in shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v")))


def _canonical(e: DataFrame) -> DataFrame:
    return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 64) -> DataFrame:
    """Rows (``node``, ``root``) for every node that has an edge, roots excluded.

    ``root`` is the smallest node of the component. Loops, repeated edges and
    edges with a null end change nothing; an empty table gives no rows.
    """
    e = cut(_canonical(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).dropna()))
    print_of = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    old = print_of(e)
    for _ in range(max_rounds):
        if not old[0]:
            break
        e = cut(_canonical(_small_star(_canonical(_large_star(e)))))
        new = print_of(e)
        if new == old:
            break
        old = new
    else:
        raise RuntimeError("star contraction did not end")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
