"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A text is compressed twice, piece by piece, once with a dictionary trained on
good and once on bad text. The difference of the two sizes over the text's length
is the only input of a logistic calibration.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm._common import fold_of

#: Bytes of a piece. Each is compressed on its own, so that the dictionary and not the text's own history decides.
PIECE = 512
DICT_BYTES = 112_640
LEVEL = 3
#: The classifier is fitted on at most so many labelled texts of a class, the first by a hash of the id; counts of them calibrate it.
FIT_ROWS = 1_500


def pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


class _Sizer:
    def __init__(self, good: bytes, bad: bytes):
        import zstandard as zs

        make = lambda d: zs.ZstdCompressor(level=LEVEL, dict_data=zs.ZstdCompressionDict(d) if d else None, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.good, self.bad = make(good), make(bad)

    def difference(self, text: str | None) -> float:
        """(size with the bad dictionary - size with the good one) / length; 0 for an empty text."""
        parts = pieces(text)
        n = sum(map(len, parts))
        if not n:
            return 0.0
        good, bad = self.good.compress, self.bad.compress
        return (sum(len(bad(p)) for p in parts) - sum(len(good(p)) for p in parts)) / n


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    mean: float
    scale: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.offset + self.slope * (np.asarray(x, dtype=np.float64) - self.mean) / self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _dictionary(texts: list[str]) -> bytes:
    import zstandard as zs

    samples: list[bytes] = []
    for t in texts:
        samples += [p for p in pieces(t) if len(p) >= 8]
    size = DICT_BYTES
    while size >= 1024:
        try:
            return zs.train_dictionary(size, samples, level=LEVEL).as_bytes()
        except zs.ZstdError:
            size //= 4
    return b"".join(samples)[-DICT_BYTES:]


def fit(labelled: list[tuple[str, int]]) -> QualityModel:
    """Train both dictionaries on half of the texts and calibrate on the other half, so that no text calibrates what it trained."""
    labelled = [(t or "", int(y)) for t, y in labelled if y is not None]
    train, hold = labelled[::2], labelled[1::2]
    good = _dictionary([t for t, y in train if y == 1])
    bad = _dictionary([t for t, y in train if y == 0])
    sizer = _Sizer(good, bad)
    x = np.array([sizer.difference(t) for t, _ in hold])
    y = np.array([q for _, q in hold], dtype=np.float64)
    mean, scale = (float(x.mean()), float(x.std()) or 1.0) if len(x) else (0.0, 1.0)
    a, b = np.array([math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0])
    z = (x - mean) / scale
    for _ in range(50 if len(x) else 0):  # Newton steps of a logistic fit with a weak ridge
        p = 1 / (1 + np.exp(-np.clip(a + b * z, -500, 500)))
        w = p * (1 - p)
        g = np.array([(p - y).sum(), ((p - y) * z).sum() + 1e-2 * b])
        h = np.array([[w.sum() + 1e-6, (w * z).sum()], [(w * z).sum(), (w * z * z).sum() + 1e-2]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -4, 4), b - np.clip(db, -4, 4)
        if abs(da) + abs(db) < 1e-9:
            break
    return QualityModel(good, bad, float(b), float(a), mean, scale)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, folds: int = 5, held_out: int = 0) -> QualityModel:
    """Fit on at most ``fit_rows`` labelled texts of each class outside the held-out fold.

    Rows with a null id, or a label other than 0 and 1, teach nothing; of repeated
    labels of one id all count, and of different texts of one id that of least
    hash. Without labels the score is the prior, 0.5.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold_of(F.col("id"), folds) != held_out))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(picked.groupBy("id", "y").count()), "id")
    # However many rows an id has, one text of it comes to the driver for each label.
    rows = rows.groupBy("id", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.first("count").alias("n")).collect()
    rows.sort(key=lambda r: (hash_of(r["id"]), r["y"]))
    return fit([(r["t"], r["y"]) for r in rows for _ in range(min(r["n"], fit_rows))])


def hash_of(x: object) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(str(x).encode(), 7)


def score(docs: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` added, the calibrated probability of label 1.

    Null and empty texts have difference 0 and get the score that belongs to it.
    A column of that name in ``docs`` is replaced. Order and multiplicity stay.
    """
    keep = [c for c in docs.columns if c.lower() != score_col.lower()]
    docs = docs.select(*[docs[c] for c in keep])
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    cast = docs.columns

    def run(batches):
        sizer = _Sizer(model.good, model.bad)
        for b in batches:
            x = [sizer.difference(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.probability(np.array(x)), pa.float64())], names=[*cast, score_col])

    return docs.mapInArrow(run, schema)
