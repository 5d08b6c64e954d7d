from __future__ import annotations

import random

import pytest

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) * (rng.random() < 0.1) for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Prose with exact and near copies, shared passages, repeated lines, empty, blank, null and very long texts, null and repeated ids."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    out: list[tuple[int | None, str | None]] = []
    for i in range(n):
        kind = i % 10
        text = prose(rng, rng.randint(1, 120))
        if kind == 3 and i > 10:
            text = out[i - 10][1] or text
        elif kind == 4 and i > 10:
            w = (out[i - 7][1] or text).split()
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        elif kind == 5:
            text = f"{text} {passage} {prose(rng, 20)}"
        elif kind == 6:
            text = f"{text}\nAll rights reserved by the {i} owners.\n{prose(rng, 9)}"
        out.append((i * 3, text))
    out += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, ""), (None, out[5][1]), (None, None), (out[7][0], out[7][1]), (out[8][0], "another text of the same id"), (2000, prose(rng, 30_000)), (2001, "x" * 5000), (2002, "Éa ß 漢字 \u2028 👍 " * 9)]
    return out


#: Names that operators use inside, on columns that they must ignore.
CLASHES = ["doc", "fp", "h", "w", "c", "row", "rank", "rule", "host", "path", "verdict", "score", "spans", "kept", "runs", "lines", "line", "leaf", "keys", "key", "rep", "least", "component_id", "shard", "sig", "seed", "item", "item_id", "at", "found", "ids", "length", "start", "offset", "vec", "id", "cell", "side", "n_tokens", "base", "model", "rest", "held_out"]


@pytest.fixture(scope="session")
def rows() -> list[tuple[int | None, str | None]]:
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):  # noqa: ANN001, ANN201
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from pyspark.sql import functions as F

    return df.select("doc_id", "text", *[F.lit(f"extra {c}").alias(c) for c in CLASHES]).cache()


@pytest.fixture(scope="session")
def none(docs):  # noqa: ANN001, ANN201
    return docs.limit(0)
