"""Near copies by Jaccard similarity of word shingles, found by SimHash.

One fingerprint of a whole text moves by many bits when a few words in a hundred
change. So the shingles of a text are also dealt by hash to small parts, and each
part has a fingerprint of its own; texts that share most shingles agree on whole
parts. Texts that show an equal part are compared by signatures, all with all but
in tiles of bounded size, and links of these together with those of fingerprints
of whole texts within a radius (BK-trees) make clusters of candidates. In a
cluster all texts are compared by all their shingles, again in tiles. Texts of
equal shingle sets are one throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import cut, stage, unstage
from sluice.llm.components import components
from sluice.llm.simhash import RADIUS, _majority, links, shingle_hashes, sorted_runs

#: A text of so many shingles and more shows parts of 4 to 8 and of 2 to 4 shingles, PARTS of each at most; shorter texts show single shingles.
SHORT, PARTS = 16, 32
#: Bytes of a signature, one for each range of hashes: from the range's least hash, 0 where there is none.
SLOTS = 128
#: Standard errors by which signatures must miss the wanted similarity before two texts are not compared.
ERRORS = 5.5
#: Texts of a chunk of those that share a part; shingles of a chunk of a cluster. A tile holds two chunks.
CHUNK, CHUNK_SHINGLES = 512, 1 << 17
#: Up to so many names of texts to compare are broadcast; they are counted first.
BROADCAST_TEXTS = 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(np.array(shingle_hashes(text, words), dtype=np.uint64))


def signature(h: np.ndarray) -> bytes:
    slot = (h >> np.uint64(57)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(h) else []
    out = np.zeros(SLOTS, dtype=np.uint8)
    out[slot[at]] = _mixed(h[at]) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def part_keys(h: np.ndarray, least: float) -> list[int]:
    """Keys of which two texts from ``least`` on share one.

    Of fewer than SHORT shingles, each text shows as many of its least ones as may
    differ and one more, which is exact. Longer ones are cut into parts by leading
    bits: as many parts as shingles that may differ, or more, so that one stays
    whole; of very long texts PARTS of them are enough but for a chance of one in
    hundreds of thousands.
    """
    n = len(h)
    keys = []
    if n * least < SHORT:
        most = n - int(np.ceil(round(least * n, 9))) + 1
        keys.append(_mixed(h[:most] * np.uint64(2)))
    if n >= SHORT:
        level = (n // 8).bit_length()
        for g in (level, level + 1):
            part = h >> np.uint64(64 - g)
            m = int(np.searchsorted(part, PARTS))
            if not m:
                continue
            at = np.flatnonzero(np.r_[True, part[1:m] != part[: m - 1]])
            sums = np.add.reduceat(_mixed(h[:m]), at) * np.uint64(2) + np.uint64(1)
            keys.append(_mixed(sums ^ _mixed(part[at] + np.uint64(g << 32))))
    return np.concatenate(keys).view("<i8").tolist() if keys else []


def describe(text: str | None, words: int, least: float) -> tuple[int, int, int, list[int], bytes]:
    """(hash of the shingle set, SimHash, its size, part keys, signature) of a text; zeros and nothing without words."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0, 0, 0, [], bytes(SLOTS)
    fp = int(_majority(hashes, [0])[0].astype("<i8"))
    h = np.unique(np.array(hashes, dtype=np.uint64))
    whole = int(_mixed(_mixed(h).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))[0].astype("<i8"))
    return whole, fp, len(h), part_keys(h, least), signature(h)


def likely(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether rows of signatures do not rule a similarity of ``least`` out."""
    some = ((a | b) != 0).sum(axis=-1)
    same = ((a == b) & (a != 0)).sum(axis=-1)
    return same >= least * some - ERRORS * np.sqrt(least * (1 - least) * some)


class _Groups:
    """Disjoint sets of the numbers below ``n``, each under its smallest."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.root[i], self.root[j]))
        if a != b:
            self.root[self.root == b] = a


def _tile_pairs(first: np.ndarray, across: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a tile with those that it is to be compared with: rows before it, or in a tile of two chunks those of the first chunk."""
    ahead = np.flatnonzero(first)
    for i in np.flatnonzero(~first) if across else range(1, len(first)):
        yield i, ahead if across else np.arange(i)


def _tiles(rows: DataFrame, sizes: DataFrame, key: str, member: str) -> DataFrame:
    """``rows`` with ``sizes``' ``parts`` of their ``key`` dealt to tiles (``i``, ``j``): all pairs of chunks, each row once for each of its tiles."""
    dealt = rows.join(sizes, key).withColumn("mine", F.pmod(F.xxhash64(member), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).withColumn("second", (F.col("mine") > F.col("other")).cast("int"))


def _matrix(col: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(col.tolist()), dtype=np.uint8).reshape(-1, SLOTS)


def _edges(us: list[int], vs: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _candidates(prints: DataFrame, least: float, radius: int) -> DataFrame:
    """Links (``u``, ``v``) that join all texts (``whole``, ``fp``, ``keys``, ``sig``) to be compared into clusters."""
    # Most keys are of one text; the few others' rows get their signatures after that is known.
    keyed = prints.select("whole", F.explode("keys").alias("key")).repartition("key")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j, second, whole, sig), cuts in sorted_runs(batches, 3):
            us: list[int] = []
            vs: list[int] = []
            s = _matrix(sig)
            lengths = np.diff(cuts)
            two = np.array(cuts[:-1])[lengths == 2]
            two = two[(i[two] == j[two]) | (second[two] != second[two + 1])]
            good = two[likely(s[two], s[two + 1], least)]
            us += whole[good].tolist()
            vs += whole[good + 1].tolist()
            for lo, n in zip(cuts, lengths.tolist(), strict=False):
                if n < 3:
                    continue
                own, groups = s[lo : lo + n], _Groups(n)
                for x, others in _tile_pairs(second[lo : lo + n] == 0, bool(i[lo] != j[lo])):
                    open_ = others[groups.root[others] != groups.root[x]]
                    for y in open_[likely(own[open_], own[x], least)]:
                        groups.join(x, y)
                moved = np.flatnonzero(groups.root != np.arange(n))
                us += whole[lo + moved].tolist()
                vs += whole[lo + groups.root[moved]].tolist()
            yield _edges(us, vs)

    sigs = prints.select("whole", "sig")
    tiles = _tiles(keyed, sizes, "key", "whole").join(sigs, "whole").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "second", "whole").select("key", "i", "j", "second", "whole", "sig")
    by_part = tiles.mapInArrow(meet, "u long, v long").distinct()
    fps = cut(prints.groupBy("fp").agg(F.min("whole").alias("rep")))
    by_print = prints.join(fps, "fp").where("whole <> rep").select(F.col("whole").alias("u"), F.col("rep").alias("v"))
    near = links(fps.select("fp"), radius=radius).distinct().withColumnsRenamed({"u": "fu", "v": "fv"})
    u, v = fps.select(F.col("fp").alias("fu"), F.col("rep").alias("u")), fps.select(F.col("fp").alias("fv"), F.col("rep").alias("v"))
    return by_part.unionAll(by_print).unionAll(near.join(u, "fu").join(v, "fv").select("u", "v"))


def _linked(sets: DataFrame, least: float) -> DataFrame:
    """Links (``u``, ``v``) that join the texts (``whole``, ``cluster``, ``n``, ``shingles``) of a cluster from a similarity of ``least`` on into the right components."""
    parts = F.ceil(F.sum("n") / CHUNK_SHINGLES).cast("int")
    sizes = sets.groupBy("cluster").agg(parts.alias("parts"))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j, second, whole, raw), cuts in sorted_runs(batches, 3):
            us: list[int] = []
            vs: list[int] = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                n = hi - lo
                sets = [np.frombuffer(x, dtype="<u8") for x in raw[lo:hi]]
                size = np.array(list(map(len, sets)))
                sig = _matrix(np.array([signature(x) for x in sets], dtype=object))
                groups = _Groups(n)
                for x, others in _tile_pairs(second[lo:hi] == 0, bool(i[lo] != j[lo])):
                    others = others[(groups.root[others] != groups.root[x]) & (np.minimum(size[others], size[x]) >= least * np.maximum(size[others], size[x]) - 1e-9)]
                    for y in others[likely(sig[others], sig[x], least)]:
                        if groups.root[x] != groups.root[y]:
                            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                            if common >= least * (size[x] + size[y] - common) - 1e-9:
                                groups.join(x, y)
                moved = np.flatnonzero(groups.root != np.arange(n))
                us += whole[lo + moved].tolist()
                vs += whole[lo + groups.root[moved]].tolist()
            yield _edges(us, vs)

    tiles = _tiles(sets, sizes, "cluster", "whole").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "second", "whole").select("cluster", "i", "j", "second", "whole", "shingles")
    return tiles.mapInArrow(meet, "u long, v long")


def _prints(docs: DataFrame, *, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """Rows (``doc``, ``print``, ``whole``, ``fp``, ``n``, ``keys``, ``sig``), one for each row with an id; ``print`` tells texts of one id apart."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out = [describe(t.as_py(), words, least) for t in b.column(2)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc", "print", "whole", "fp", "n", "keys", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text")).where("doc is not null")
    return rows.mapInArrow(run, "doc long, print long, whole long, fp long, n long, keys array<long>, sig binary")


def _grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """Rows (``doc``, ``print``, ``n_rows``, ``root``): each distinct id and text, in how many rows it is, and the name of its group."""
    spark = docs.sparkSession
    prints, prints_path = stage(_prints(docs, id_col=id_col, text_col=text_col, words=words, least=least), "prints")
    # One text stands for all of equal shingle sets.
    alone = prints.where("n > 0").groupBy("whole").agg(F.min(F.struct("doc", "print")).alias("at"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    found = components(_candidates(alone, least, radius))
    clusters = cut(found.select(F.col("node").alias("whole"), F.col("root").alias("cluster")).unionAll(found.select(F.col("root").alias("whole"), F.col("root").alias("cluster")).distinct()))
    held = cut(alone.select("whole", "at.doc", "at.print").join(clusters, "whole"))
    few = held.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS

    def sets(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            found = [shingle_set(t.as_py(), words) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, found), pa.int64()), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())], names=["whole", "cluster", "n", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    texts = rows.join(F.broadcast(held) if few else held, ["doc", "print"]).select("whole", "cluster", "text").mapInArrow(sets, "whole long, cluster long, n long, shingles binary")
    texts, texts_path = stage(texts.dropDuplicates(["whole"]) if docs_repeat(prints) else texts, "sets")
    roots = components(_linked(texts, least)).withColumnRenamed("node", "whole")
    named = prints.groupBy("doc", "print", "whole").agg(F.count("*").alias("n_rows")).join(F.broadcast(roots) if few else roots, "whole", "left")
    named = cut(named.select("doc", "print", "n_rows", F.coalesce("root", "whole").alias("root")))
    unstage(spark, prints_path)
    unstage(spark, texts_path)
    return named


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """Rows (``doc_id``, ``print``, ``component_id``): for each distinct id and text the smallest id that chains of similar texts reach.

    ``print`` is XXH64 of the text; different texts of one id are different
    documents. Texts are linked from a similarity of ``least`` on, judged by all
    their shingles. Texts without words are linked to each other. Rows with a null
    id are left out. Other columns are ignored. An empty table gives no rows.
    """
    named = _grouped(docs, id_col=id_col, text_col=text_col, words=words, least=least, radius=radius)
    least_of = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    return named.join(least_of, "root").select(F.col("doc").alias("doc_id"), "print", "component_id")


def docs_repeat(prints: DataFrame) -> bool:
    """Whether an id and text is in several rows."""
    return prints.groupBy("doc", "print").count().where("count > 1").limit(1).count() > 0


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **more) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of smallest id; rows with a null id stay.

    Of several texts of that id in one group the one of least hash stays, and of
    rows of one id and text any one. Different texts of an id are different documents.
    """
    text_col = more.get("text_col", "text")
    found = _grouped(docs, id_col=id_col, **more)
    best = cut(found.groupBy("root").agg(F.min(F.struct("doc", "print", "n_rows")).alias("b")).select(F.col("b.doc").alias("__doc"), F.col("b.print").alias("__print"), F.col("b.n_rows").alias("__rows")))
    mine = docs.where(F.col(id_col).isNotNull())
    kept = mine.join(best, (mine[id_col] == F.col("__doc")) & (F.xxhash64(mine[text_col]) == F.col("__print")))
    out = kept.where("__rows = 1").select(*[mine[c] for c in docs.columns])
    if best.where("__rows > 1").limit(1).count():
        out = out.unionAll(kept.where("__rows > 1").dropDuplicates(["__doc", "__print"]).select(*[mine[c] for c in docs.columns]))
    return out.unionAll(docs.where(F.col(id_col).isNull()))
