"""SimHash near-duplicates: 64-bit fingerprints linked by BK-trees over shards.

Two fingerprints within ``radius`` bits agree on at least ``k`` of ``radius + k``
blocks, so the fingerprints that share the values of ``k`` blocks form a shard;
``k`` grows with the count of fingerprints, which keeps shards small. A shard's
BK-tree keys children by their Hamming distance to the parent, and a probe only
follows edges within the radius. Trees of all documents together have no size
bound, so they are not sent from the driver: the shuffle brings the probes of a
shard to its tree. Large shards are cut into chunks; each pair of chunks is a
task-sized tile of its own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import cut
from sluice.llm.components import components

SEED = 42
RADIUS = 3
#: Fingerprints of a chunk; a tile holds at most two chunks in expectation.
CHUNK = 512
FLUSH = 1 << 17


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of every shingle of ``words`` words, repeats included."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not w:
        return []
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return [h(b" ".join(w), SEED)]
    if words == 3:
        return [h(b"%b %b %b" % t, SEED) for t in zip(w, w[1:], w[2:], strict=False)]
    return [h(b" ".join(w[i : i + words]), SEED) for i in range(len(w) - words + 1)]


def _majority(hashes: list[int], starts: list[int]) -> np.ndarray:
    """Fingerprints of consecutive runs of ``hashes``; no run is empty."""
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    sizes = np.diff([*starts, len(hashes)])
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(text: str | None, words: int = 3) -> int:
    h = shingle_hashes(text, words)
    return int(_majority(h, [0])[0]) if h else 0


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Rows (``doc_id``, ``fp``): every row's fingerprint as a signed long. No words, or null: 0."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out = np.zeros(b.num_rows, dtype="<u8")
            hashes: list[int] = []
            starts: list[int] = []
            at: list[int] = []
            for i, t in enumerate(b.column(1)):
                if h := shingle_hashes(t.as_py(), words):
                    at.append(i)
                    starts.append(len(hashes))
                    hashes += h
                if at and (len(hashes) >= FLUSH or i == b.num_rows - 1):
                    out[at] = _majority(hashes, starts)
                    hashes, starts, at = [], [], []
            if at:
                out[at] = _majority(hashes, starts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view("<i8"), pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Integers under Hamming distance; children are keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.kids: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        n = len(self.nodes)
        self.nodes.append(x)
        self.kids.append({})
        if not n:
            return
        i = 0
        while True:
            d = (self.nodes[i] ^ x).bit_count()
            j = self.kids[i].get(d)
            if j is None:
                self.kids[i][d] = n
                return
            i = j

    def within(self, x: int, radius: int) -> list[int]:
        """Numbers (in the order of adding) of the nodes within ``radius`` of ``x``."""
        if not self.nodes:
            return []
        found, todo, nodes, kids = [], [0], self.nodes, self.kids
        while todo:
            i = todo.pop()
            d = (nodes[i] ^ x).bit_count()
            if d <= radius:
                found.append(i)
            low, high = d - radius, d + radius
            todo += [j for e, j in kids[i].items() if low <= e <= high]
        return found


def _tile_links(fps: list[int], part: list[int], across: bool, radius: int) -> list[tuple[int, int]]:
    """A star of links for every component that a tile shows: (member, smallest member)."""
    parent = list(range(len(fps)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree, held = BKTree(), []
    if across:
        held = [i for i, p in enumerate(part) if p == 0]
        for i in held:
            tree.add(fps[i])
    for i, x in enumerate(fps):
        if across and part[i] == 0:
            continue
        for k in tree.within(x, radius):
            a, b = find(held[k]), find(i)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if not across:
            tree.add(x)
            held.append(i)
    return [(i, r) for i in range(len(fps)) if (r := find(i)) != i]


def sorted_runs(rows: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Columns of whole runs of equal leading ``keys`` columns, over the batches of a sorted partition, and where runs begin and the last ends."""
    kept: list[np.ndarray] | None = None
    for b in rows:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(cols[0]):
            continue
        if kept is not None:
            cols = [np.concatenate(p) for p in zip(kept, cols, strict=True)]
        new = np.zeros(len(cols[0]), dtype=bool)
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        if len(cuts) > 1:
            yield [c[: cuts[-1]] for c in cols], cuts
        kept = [c[cuts[-1] :] for c in cols]
    if kept is not None:
        yield kept, [0, len(kept[0])]


def sorted_groups(rows: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of each run of equal leading ``keys`` columns, over the batches of a sorted partition."""
    for cols, cuts in sorted_runs(rows, keys):
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield [c[lo:hi] for c in cols]


def agreeing(n: int, radius: int, chunk: int) -> int:
    """How many blocks the members of a shard share, so that ``n`` evenly spread fingerprints make the fewest rows of tiles."""
    return min(range(1, 4), key=lambda k: math.comb(radius + k, k) * max(1.0, n / 2 ** (64 * k / (radius + k)) / chunk))


def shard_masks(radius: int, agree: int) -> list[int]:
    """Bits of every choice of ``agree`` among ``radius + agree`` blocks, as signed longs: within ``radius`` bits, one choice at least is untouched."""
    edges = [64 * i // (radius + agree) for i in range(radius + agree + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(some) for some in itertools.combinations(blocks, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, *, radius: int = RADIUS, chunk: int = CHUNK, agree: int | None = None) -> DataFrame:
    """Links (``u``, ``v``) that join all distinct ``fp`` within ``radius`` bits into the right components.

    ``agree``, the number of blocks that a shard's members share, changes the work
    and never the components; it is chosen by a count of ``distinct`` if not given.
    """
    if agree is None:
        agree = agreeing(distinct.count(), radius, chunk)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(shard_masks(radius, agree))])
    rows = distinct.select("fp", F.explode(keys).alias("shard"))
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    tiles = (
        rows.join(sizes, "shard")
        .withColumn("parts", parts)
        .withColumn("mine", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("shard", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("part"), "fp")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us: list[int] = []
        vs: list[int] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype="<u8").view("<i8"), pa.int64()) for x in (us, vs)], names=["u", "v"])

        for _, i, j, part, fp in sorted_groups(batches, 3):
            if len(fp) < 2:
                continue
            fps = fp.astype("<i8").view("<u8").tolist()
            for a, b in _tile_links(fps, part.tolist(), bool(i[0] != j[0]), radius):
                us.append(fps[a])
                vs.append(fps[b])
            if len(us) > FLUSH:
                yield out()
                us, vs = [], []
        yield out()

    return tiles.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "part", "fp").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id of all documents that chains of links
    within ``radius`` differing bits reach. Null and empty texts have fingerprint
    zero and are linked like others; null ids never name a component (it is null
    if all its ids are); repeated rows stay. Other columns are ignored.
    """
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col, words=words))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), radius=radius, chunk=chunk))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    names = classes.join(least, "root").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
