"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree's upper part is fitted on a bounded sample; every row is then filed in a
leaf, and each leaf of many rows gets a tree of its own below it, fitted where its
rows are, so that leaves grow in number with the rows. A query descends through a priority queue of nodes, best centre first, and visits leaves
until the number of visits that a calibration found enough for the wanted recall.
Leaves lie in cells of bounded size, which are the units of work; a query goes
once to each cell that holds a leaf it visits.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._common import cut

#: The tree is fitted on at most so many distinct vectors, the first by a hash of the vector.
FIT_ROWS = 20_000
BRANCHES, LEAF_ROWS, ITERATIONS = 12, 40, 12
#: So many queries, the first by a hash of the id, are answered exactly to calibrate the visits.
CALIBRATION = 200
TARGET = 0.97
#: Spreads that a node's rows are hoped to lie nearer than its centre.
OPTIMISM = 0.5
#: A leaf of more rows gets a tree of its own, fitted on so many of its rows. The whole tree stays under 1,000 times the sub-sample's leaves.
SPLIT_ROWS, SUB_FIT = 4_096, 2_048
#: Rows of a cell.
CELL_ROWS = 8_192
BLOCK = 256


@dataclass
class Tree:
    """Nodes in order of making; ``spread[n]`` is the root of the mean square distance of its rows, ``kids[n]`` are numbers of nodes, ``leaf[n]`` a leaf's number or -1."""

    centres: np.ndarray
    spread: np.ndarray
    kids: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return 1 + max(self.leaf)

    def scores(self, q: np.ndarray) -> np.ndarray:
        """How promising each node is for each query: the product with its centre, and more the wider its rows are spread."""
        return q @ self.centres.T + OPTIMISM * np.sqrt((q * q).sum(1))[:, None] * self.spread

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest centre at every level."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            n, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[n] >= 0:
                out[rows] = self.leaf[n]
                continue
            near = _nearest(x[rows], self.centres[self.kids[n]])
            todo += [(k, rows[near == i]) for i, k in enumerate(self.kids[n])]
        return out

    def visits(self, scores: np.ndarray, most: int, counts: np.ndarray | None = None, rows: int = 0) -> list[int]:
        """Leaves in best-bin-first order, ``most`` of them, or more until they hold ``rows`` by ``counts``; ``scores`` are a query's for all nodes."""
        queue: list[tuple[float, int]] = [(0.0, 0)]
        found: list[int] = []
        held = rows if counts is None else 0
        while queue and (len(found) < most or held < rows):
            _, n = heapq.heappop(queue)
            if self.leaf[n] >= 0:
                found.append(self.leaf[n])
                held += 0 if counts is None else int(counts[self.leaf[n]])
            else:
                for k in self.kids[n]:
                    heapq.heappush(queue, (-scores[k], k))
        return found

    def graft(self, subs: dict[int, Tree]) -> Tree:
        """This tree with trees in place of some of its leaves."""
        centres, spread, kids, leaf, leaves = [self.centres], [self.spread], [list(k) for k in self.kids], [-1] * len(self.leaf), 0
        for n, old in enumerate(self.leaf):
            sub = subs.get(old) if old >= 0 else None
            if sub is None:
                if old >= 0:
                    leaf[n], leaves = leaves, leaves + 1
                continue
            first = len(kids)  # the sub-tree's root is node n itself
            number = lambda k, n=n, first=first: n if k == 0 else first + k - 1
            for k, (own, at) in enumerate(zip(sub.kids, sub.leaf, strict=True)):
                moved, place = [number(x) for x in own], -1
                if at >= 0:
                    place, leaves = leaves, leaves + 1
                if k == 0:
                    kids[n], leaf[n] = moved, place
                else:
                    kids.append(moved)
                    leaf.append(place)
            centres.append(sub.centres[1:])
            spread.append(sub.spread[1:])
        return Tree(np.concatenate(centres), np.concatenate(spread), kids, leaf)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ centres.T - half, axis=1) for i in range(0, len(x), 8192)])


def _spread(x: np.ndarray) -> float:
    return float(np.sqrt(((x - x.mean(0)) ** 2).sum(1).mean()))


def fit(sample: np.ndarray, seed: int = 5) -> Tree:
    """Hierarchical k-means; a node of at most LEAF_ROWS sample rows, or of equal rows, is a leaf."""
    rng = np.random.default_rng(seed)
    centres, spread, kids, leaf, leaves = [sample.mean(0)], [_spread(sample)], [[]], [-1], 0
    todo = [(0, sample)]
    while todo:
        n, x = todo.pop()
        parts: list[np.ndarray] = []
        if len(x) > LEAF_ROWS:
            c = x[rng.choice(len(x), min(BRANCHES, math.ceil(len(x) / LEAF_ROWS) + 1), replace=False)]
            for _ in range(ITERATIONS):
                near = _nearest(x, c)
                c = np.array([x[near == i].mean(0) for i in range(len(c)) if (near == i).any()])
            near = _nearest(x, c)
            parts = [x[near == i] for i in range(len(c)) if (near == i).any()]
        if len(parts) < 2:
            leaf[n] = leaves
            leaves += 1
            continue
        for p in parts:
            kids[n].append(len(centres))
            todo.append((len(centres), p))
            centres.append(p.mean(0))
            spread.append(_spread(p))
            kids.append([])
            leaf.append(-1)
    return Tree(np.array(centres), np.array(spread), kids, leaf)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of aligned rows, summed from the first component on, so that equal vectors score equally."""
    s = np.zeros(len(q))
    for j in range(q.shape[1]):
        s += q[:, j] * v[:, j]
    return s


def products(q: np.ndarray, v: np.ndarray, leaf: np.ndarray, leaves: list[list[int]]) -> np.ndarray:
    """Products of each query with the rows of the leaves that it visits; -inf for all other rows. ``leaf`` is sorted."""
    s = np.full((len(q), len(v)), -np.inf)
    asked: dict[int, list[int]] = {}
    for i, ns in enumerate(leaves):
        for n in ns:
            asked.setdefault(n, []).append(i)
    for n, rows in asked.items():
        lo, hi = np.searchsorted(leaf, [n, n + 1])
        s[rows, lo:hi] = q[rows] @ v[lo:hi].T
    return s


def best(q: np.ndarray, own: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, s: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of ``v`` for each row of ``q``: (query row, row of v, score).

    Rows with the query's own id are left out. Products ``s`` by BLAS (-inf: not
    to be found) select; whatever is within rounding of the k-th is scored exactly.
    """
    s = q @ v.T if s is None else s
    s[own[:, None] == ids[None, :]] = -np.inf
    if s.shape[1] > k:
        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        slack = 1e-12 * np.sqrt((q * q).sum(1)) * math.sqrt((v * v).sum(1).max())
        keep = s >= (kth - slack)[:, None]
    else:
        keep = np.ones_like(s, dtype=bool)
    keep &= np.isfinite(s)
    i, j = np.nonzero(keep)
    score = _exact(q[i], v[j])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, i)
    top = np.arange(len(i)) - first < k
    return i[top], j[top], score[top]


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    """A binary column of little-endian doubles as a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype="<f8").reshape(-1, dims)


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _as_bytes(df: DataFrame, dims: int) -> DataFrame:
    """Columns (``id`` long, ``vec`` doubles) with ``vec`` as bytes."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "vec"])

    return df.select("id", "vec").mapInArrow(run, "id long, vec binary")


def _top(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(vectors: DataFrame, *, k: int = 20, query_modulus: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """The ``k`` rows of largest inner product for every row whose id is divisible by ``query_modulus``.

    Columns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the
    smaller id. Rows with a null id, and vectors that are null, zero, or hold null
    or non-finite components, take no part, nor do vectors of another length than
    most have. Equal rows count once; an id never finds itself. Of equal vectors
    the ``k`` + 1 smallest ids are indexed: all score the same, so ties can never
    reach the others. Empty tables give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], empty)
    dims = sizes["d"]
    rows = rows.where(F.size("vec") == dims)

    same = Window.partitionBy("key", "vec").orderBy("id")
    kept = rows.withColumn("key", F.xxhash64("vec")).withColumn("copy", F.dense_rank().over(same)).where(F.col("copy") <= k + 1).select("key", "id", "vec").distinct()
    data = cut(_as_bytes(kept, dims))
    queries = cut(_as_bytes(rows.where(F.col("id") % query_modulus == 0).distinct(), dims))

    picked = data.orderBy(F.xxhash64("vec"), "id").limit(FIT_ROWS).select("vec").collect()
    tree = fit(np.frombuffer(b"".join(sorted(r["vec"] for r in picked)), dtype="<f8").reshape(-1, dims))

    filed, counts = _filed(data, tree, dims)
    if any(c > SPLIT_ROWS for c in counts.values()):
        tree = tree.graft(_subtrees(filed, [n for n, c in counts.items() if c > SPLIT_ROWS], dims))
        filed, counts = _filed(data, tree, dims)
    visits = _calibrate(filed, queries, tree, dims, k, target)

    # Cells: whole small leaves together, large leaves in several by a hash of the id. One entry a leaf is known to the driver.
    first, parts, cell, room = [0] * tree.leaves, [1] * tree.leaves, 0, CELL_ROWS
    for n in range(tree.leaves):
        c = counts.get(n, 0)
        if c > CELL_ROWS:
            cell += room < CELL_ROWS
            first[n], parts[n] = cell, math.ceil(c / CELL_ROWS)
            cell, room = cell + parts[n], CELL_ROWS
        else:
            if c > room:
                cell, room = cell + 1, CELL_ROWS
            first[n] = cell
            room -= c
    cells = cell + 1
    known = spark.createDataFrame([(n, first[n], parts[n]) for n in range(tree.leaves)], "leaf int, first int, parts int")
    rows_at = filed.join(F.broadcast(known), "leaf").select((F.col("first") + F.pmod(F.xxhash64("id"), "parts")).cast("int").alias("cell"), F.lit(0).alias("side"), "id", "leaf", F.lit(None).cast("array<int>").alias("leaves"), "vec")

    sizes_of = np.array([counts.get(n, 0) for n in range(tree.leaves)])
    sent = spark.sparkContext.broadcast((tree, first, parts, sizes_of))

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, first, parts, sizes_of = sent.value
        for b in batches:
            ids = b.column(0).to_pylist()
            raw = b.column(1).to_pylist()
            vectors = _matrix(b.column(1), dims)
            for lo in range(0, len(ids), BLOCK):
                out: list[tuple] = []
                scores = tree.scores(vectors[lo : lo + BLOCK])
                for i in range(lo, min(lo + BLOCK, len(ids))):
                    to: dict[int, list[int]] = {}
                    # Leaves beyond the calibrated number, if need be, until there are k rows beside the query's own.
                    for n in tree.visits(scores[i - lo], visits, sizes_of, k + 1):
                        for c in range(first[n], first[n] + parts[n]):
                            to.setdefault(c, []).append(n)
                    out += [(c, 1, ids[i], -1, ns, raw[i]) for c, ns in to.items()]
                cols = list(zip(*out, strict=True)) if out else [[]] * 6
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["cell", "side", "id", "leaf", "leaves", "vec"])

    asked = queries.mapInArrow(route, "cell int, side int, id long, leaf int, leaves array<int>, vec binary")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, leaf, v = -1, [], [], []
        ready: tuple | None = None
        for b in batches:
            cell = b.column(0).to_numpy()
            side = b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(cell)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if cell[lo] != at:
                    at, ids, leaf, v, ready = cell[lo], [], [], [], None
                if side[lo] == 0:
                    ids.append(part.column(2).to_numpy())
                    leaf.append(part.column(3).to_numpy())
                    v.append(_matrix(part.column(5), dims))
                    continue
                if not ids:
                    continue
                if ready is None:
                    order = np.argsort(np.concatenate(leaf), kind="stable")
                    ready = tuple(np.concatenate(x)[order] for x in (ids, leaf, v))
                for o in range(0, hi - lo, BLOCK):
                    some = part.slice(o, BLOCK)
                    own = some.column(2).to_numpy()
                    q = _matrix(some.column(5), dims)
                    i, j, s = best(q, own, ready[2], ready[0], k, products(q, ready[2], ready[1], some.column(4).to_pylist()))
                    yield pa.RecordBatch.from_arrays([pa.array(own[i], pa.int64()), pa.array(ready[0][j], pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    near = rows_at.unionByName(asked).repartition(max(1, min(cells, 10_000)), "cell").sortWithinPartitions("cell", "side").mapInArrow(meet, "query_id long, vec_id long, score double")
    return _top(near.distinct(), k).select("query_id", "rank", "vec_id", "score")


def _filed(data: DataFrame, tree: Tree, dims: int) -> tuple[DataFrame, dict[int, int]]:
    """``data`` (id, vec) with each row's ``leaf``, and the rows of each leaf."""
    sent = data.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = sent.value.file(_matrix(b.column(1), dims))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=["id", "vec", "leaf"])

    filed = cut(data.mapInArrow(run, "id long, vec binary, leaf int"))
    return filed, {r["leaf"]: r["count"] for r in filed.groupBy("leaf").count().collect()}


def _subtrees(filed: DataFrame, leaves: list[int], dims: int) -> dict[int, Tree]:
    """A tree for each of ``leaves``, fitted on SUB_FIT of its rows at most, the first by a hash of the vector."""
    some = filed.where(F.col("leaf").isin(leaves)).withColumn("n", F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("vec"), "id"))).where(F.col("n") <= SUB_FIT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        held: list[bytes] = []

        def out() -> pa.RecordBatch:
            t = fit(np.frombuffer(b"".join(held), dtype="<f8").reshape(-1, dims))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([t.centres.tobytes()], pa.binary()), pa.array([t.spread.tobytes()], pa.binary()), pa.array([t.kids], pa.list_(pa.list_(pa.int32()))), pa.array([t.leaf], pa.list_(pa.int32()))], names=["leaf", "centres", "spread", "kids", "leaves"])

        for b in batches:
            for leaf, vec in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if leaf != at and held:
                    yield out()
                    held = []
                at = leaf
                held.append(vec)
        if held:
            yield out()

    rows = some.repartition("leaf").sortWithinPartitions("leaf", "n").select("leaf", "vec").mapInArrow(run, "leaf int, centres binary, spread binary, kids array<array<int>>, leaves array<int>")
    return {r["leaf"]: Tree(np.frombuffer(r["centres"], dtype="<f8").reshape(-1, dims), np.frombuffer(r["spread"], dtype="<f8"), [list(k) for k in r["kids"]], list(r["leaves"])) for r in rows.collect()}


def exact_neighbours(filed: DataFrame, q: np.ndarray, own: np.ndarray, dims: int, k: int) -> DataFrame:
    """The true ``k`` best of a stated, bounded query set, with their leaves, by one scan in blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, leaf, v = b.column(0).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(1), dims)
            for o in range(0, len(ids), 4096):
                i, j, s = best(q, own, v[o : o + 4096], ids[o : o + 4096], k)
                yield pa.RecordBatch.from_arrays([pa.array(own[i], pa.int64()), pa.array(ids[o + j], pa.int64()), pa.array(leaf[o + j], pa.int32()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "leaf", "score"])

    return _top(filed.mapInArrow(run, "query_id long, vec_id long, leaf int, score double"), k)


def _calibrate(filed: DataFrame, queries: DataFrame, tree: Tree, dims: int, k: int, target: float) -> int:
    """The fewest leaf visits with which the calibration queries find ``target`` of their true neighbours."""
    some = queries.orderBy(F.xxhash64("id"), "vec").limit(CALIBRATION).collect()
    if not some or tree.leaves == 1:
        return 1
    own = np.array([r["id"] for r in some])
    q = np.frombuffer(b"".join(r["vec"] for r in some), dtype="<f8").reshape(-1, dims)
    scores = tree.scores(q)
    place = {int(o): {n: i for i, n in enumerate(tree.visits(s, tree.leaves))} for o, s in zip(own, scores, strict=True)}
    seen = [place[r["query_id"]][r["leaf"]] for r in exact_neighbours(filed, q, own, dims, k).select("query_id", "leaf").collect()]
    if not seen:
        return 1
    return int(np.sort(seen)[min(len(seen) - 1, math.ceil(target * len(seen)) - 1)]) + 1
