"""Sequence packing by Karmarkar-Karp multiway differencing.

Token sequences of documents are dealt to windows of a fixed capacity. Within a
batch, multiway differencing merges partial partitions whose imbalances oppose
each other until one partition into near-equal windows is left. A window above
capacity is cut at it; what was cut fills windows below it, and what still
remains raises the window count: it goes to windows whose lengths are powers of two.
A batch never leaves its task, so nothing is shuffled.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITY = 2048
#: A batch is packed when it holds so many tokens; memory of a task is bounded by it and its longest text.
BATCH_TOKENS = 1 << 20
#: A worker keeps at most so many pieces of text with their ids; then only the first KEEP_WORDS stay, which frequent ones are among.
CACHE_WORDS, KEEP_WORDS = 700_000, 200_000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """Ids of a word-level BPE vocabulary file, as little-endian unsigned 32-bit bytes.

    Texts of plain Latin letters are split at white space, which no token
    crosses, and looked up chunk by chunk. New chunks are split into the
    vocabulary's words; new words are encoded together, without the steps that
    change nothing in them, and told apart by the tokens that end a word. Any
    other text goes to the library as it is. Both ways give the same ids.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache: dict[str, bytes] = {}
        self.plain = re.compile("[\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ÿ]*").fullmatch
        self.words = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+").findall
        ends = self.full.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(ends.values()) + 1, dtype=bool)
        self.ends[[i for t, i in ends.items() if t.endswith("</w>")]] = True

    def _learn(self, new: list[str]) -> None:
        cache = self.cache
        split = [self.words(p) for p in new]
        words = list({w for ws in split for w in ws if w not in cache})
        if words:
            ids = np.asarray(self.bare.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
            lo, raw = 0, ids.tobytes()
            for w, hi in zip(words, (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
                cache[w] = raw[lo:hi]
                lo = hi
        for p, ws in zip(new, split, strict=True):
            if len(ws) > 1:
                cache[p] = b"".join([cache[w] for w in ws])

    def __call__(self, text: str) -> bytes:
        if "<|" in text or not self.plain(text):
            return np.asarray(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        parts, cache = text.lower().split(), self.cache
        got = list(map(cache.get, parts))
        if None in got:
            at = [i for i, g in enumerate(got) if g is None]
            if len(cache) + 2 * len(at) > CACHE_WORDS:
                self.cache = cache = dict(itertools.islice(cache.items(), KEEP_WORDS))
            self._learn(list({parts[i] for i in at}))
            for i in at:
                got[i] = cache[parts[i]]
        return b"".join(got)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp for ``k`` parts: which items of ``sizes`` go to which part.

    A heap holds partial partitions by spread; the two of the largest spread are
    merged, the fullest part of one with the emptiest of the other.
    """
    if k <= 1:
        return [list(range(len(sizes)))]
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    tick = 0
    # A partition lists only its non-empty parts, fullest first; the other k - len parts are empty.
    for i, s in enumerate(sizes):
        heap.append((-s, tick, [(s, [i])]))
        tick += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a)
        low = len(b) - free  # so many parts of b meet parts of a, its smallest ones the fullest of a
        if low <= 0:
            merged = a + b
        else:
            merged = a[: len(a) - low] + b[:free]
            merged += [(a[len(a) - 1 - j][0] + b[free + j][0], a[len(a) - 1 - j][1] + b[free + j][1]) for j in range(low)]
        merged.sort(key=lambda p: -p[0])
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], tick, merged))
        tick += 1
    parts = [p for _, p in heap[0][2]] if heap else []
    return parts + [[] for _ in range(k - len(parts))]


def pack_batch(sizes: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (item, start, length); every token of every item lies in exactly one.

    Whole windows are cut from items longer than one. The rest is differenced
    into as many windows as it fills; surpluses fill deficits, and the last
    ``total % capacity`` tokens go to windows of power-of-two lengths.
    """
    out: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for i, n in enumerate(sizes):
        full = n // capacity
        out += [[(i, j * capacity, capacity)] for j in range(full)]
        if n % capacity:
            rest.append((i, full * capacity, n % capacity))
    total = sum(p[2] for p in rest)
    k = total // capacity
    if k:
        windows = [[rest[j] for j in part] for part in differencing([p[2] for p in rest], k)]
    else:
        windows, spare = [], list(rest)
    if k:
        spare = []
        for w in windows:
            over = sum(p[2] for p in w) - capacity
            while over > 0:  # cut the surplus off the last pieces
                i, s, n = w.pop()
                cut = min(n, over)
                if n > cut:
                    w.append((i, s, n - cut))
                spare.append((i, s + n - cut, cut))
                over -= cut
        spare.reverse()
        for w in windows:
            room = capacity - sum(p[2] for p in w)
            while room > 0:
                i, s, n = spare.pop()
                take = min(n, room)
                w.append((i, s, take))
                if n > take:
                    spare.append((i, s + take, n - take))
                room -= take
        out += windows
    left, queue = sum(p[2] for p in spare), spare[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        w = []
        while room:
            i, s, n = queue.pop()
            take = min(n, room)
            w.append((i, s, take))
            if n > take:
                queue.append((i, s + take, n - take))
            room -= take
        out.append(w)
    return out


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Pack all documents; one row for each piece, with its token ids as bytes.

    A document is the ids of its text and then ``end_id``; a null or empty text is
    ``end_id`` alone. Rows with a null or repeated id are packed like others.
    ``sequence_id`` is unique over all tasks: partition number, then count. Other
    columns are ignored. An empty table gives no rows.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def batches(rows: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer(vocabulary)
        ids: list[int | None] = []
        codes: list[bytes] = []
        held, made = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, codes, held, made
            cols: list[list] = [[] for _ in range(7)]
            for w in pack_batch([len(c) // 4 for c in codes], capacity):
                offset, seq = 0, (at << 40) | made
                made += 1
                for i, s, n in w:
                    for c, v in zip(cols, (ids[i], s, n, codes[i][4 * s : 4 * (s + n)], len(codes[i]) // 4, seq, offset), strict=True):
                        c.append(v)
                    offset += n
            ids, codes, held = [], [], 0
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in rows:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                codes.append(encode(t.as_py() or "") + end)
                held += len(codes[-1]) // 4
                if held >= batch_tokens:
                    yield from flush()
        if ids:
            yield from flush()

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return batches(rows, TaskContext.get().partitionId())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def local_pack(spark: SparkSession, rows: list[tuple[int, str]], vocabulary: str, **more) -> list:
    """``pack`` over a driver-side list, for examples and tests."""
    return pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary, **more).collect()
