"""From raw documents to packed training sequences, stage by stage.

Each stage takes what the one before kept. All but the last return the columns of
``documents``; the last returns the pieces of the sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import copies, decontaminate, packing, quality, templates
from sluice.llm._common import stage, table, unstage
from sluice.llm.queries import QUALITY_THRESHOLD, packed_pieces, vocabulary

#: Words of a shingle, and the similarity from which two documents are near copies.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by the labels of those here, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, score_col="__score").where(F.col("__score") >= QUALITY_THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines, which the first document keeps; ``n_chars`` follows the text."""
    kept = templates.dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return copies.keep_one(docs, words=SHINGLE_WORDS, least=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packed_pieces(packing.pack(docs, vocabulary()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", pack_sequences),
]

#: The stages train models, draw trees and pack by heuristics, which SQL does not express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to shared storage for the next."""
    docs, old = table(spark, sf_dir, "documents"), None
    for name, f in STAGES[:-1]:
        docs, path = stage(f(spark, docs, sf_dir), name.split()[0])
        if old is not None:
            unstage(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
