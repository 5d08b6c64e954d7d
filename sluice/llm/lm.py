"""LM scoring: a gated recurrent language model with a class-factored output, in numpy.

Counts of all training words give a unigram base score. The recurrent model sees
the most frequent words as themselves and every other word as one of a few
classes of word shape; a word's probability is that of its class, times that of
the word within it: by softmax for frequent words, by add-one counts for others.
Weights start from a bounded sample. Then every training document is dealt by
hash to one of several rounds and shards; the shards of a round are trained side
by side from the same weights, and averaged for the next round. So the result
depends on the rows and not on how they are partitioned. States carry over
windows, so a text is scored as a whole. Words beyond the broadcast table get
their counts by a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import cut, stage, unstage

#: The token that ends a text. No word equals it, as words hold no white space.
END = b"\n"
#: Words that the recurrent model knows, in classes of equal size; further words of the table that every task holds.
FREQUENT, CLASS_SIZE, TABLE_WORDS = 2048, 64, 131_072
SHAPES = 16
HIDDEN = 16
#: Steps of truncated backpropagation, and texts side by side.
WINDOW, LANES = 24, 1024
#: Where few texts are left side by side, windows are up to so many times longer.
STRETCH = 8
#: Training documents, the first by a hash of the id, of the warm-up; passes over them; learning rates of warm-up and of the pass over all.
WARM_DOCS, WARM_PASSES, WARM_RATE, RATE = 1_000, 3, 8e-3, 1.5e-3
#: Rounds of the pass over all; tokens of a shard while there are few shards, and however many there are.
ROUNDS, SHARD_TOKENS, LARGE_SHARD_TOKENS, FEW_SHARDS = 2, 1 << 20, 1 << 26, 2048
#: A shard is read in blocks of so many texts, or fewer of so many tokens together.
BLOCK_TEXTS, BLOCK_TOKENS = 4096, 1 << 22
#: Rows whose scores of all classes are worked out together, so that they stay in a core's cache.
ROWS = 2048
#: Texts are cut into words together up to so many bytes, or one by one.
SPLIT_BYTES = 4 << 20
SLICES = 8
LOG10 = float(np.log(10.0))
_WORD_END = np.array([bytes([i]).isalnum() or i > 127 for i in range(256)])


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, and the end."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w.append(END)
    return w


def split(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """Some texts at a time (from, to): their words one after another, as of ``words``, and how many each text has with its end; the ends themselves are left out."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lo = 0
    while lo < len(texts):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), SPLIT_BYTES, side="right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(lo, hi - lo), "")))
        ends = lists.offsets.to_numpy().astype(np.int64)
        found = lists.flatten().cast(pa.binary())
        real = pc.greater(pc.binary_length(found), 0)  # white space at either side of a text gives empty words
        ends = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][ends - ends[0]]
        yield lo, hi, found.filter(real), np.diff(ends) + 1
        lo = hi


def shape(word: bytes) -> int:
    """One of SHAPES classes: by length, by whether it is ASCII, by whether it ends in a letter or digit."""
    n = len(word)
    size = 0 if n <= 5 else 1 if n <= 8 else 2 if n <= 12 else 3
    return size * 4 + 2 * word.isascii() + (word[-1:].isalnum() or word[-1] > 127)


def shapes(words: pa.Array) -> np.ndarray:
    """``shape`` of each of an array of words."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    letters = np.frombuffer(data, dtype=np.uint8)[: at[-1]]
    ascii_only = np.add.reduceat(letters > 127, at[:-1], dtype=np.int64) == 0
    return np.searchsorted([5, 8, 12], np.diff(at)) * 4 + 2 * ascii_only + _WORD_END[letters[at[1:] - 1]]


@dataclass
class Weights:
    """inputs: a row for each frequent word, shape and the start; the rest as named in ``Net``."""

    arrays: list[np.ndarray]

    def pack(self) -> bytes:
        return np.concatenate([a.ravel() for a in self.arrays]).astype("<f4").tobytes()

    @staticmethod
    def shapes(classes: int) -> list[tuple[int, ...]]:
        h = HIDDEN
        return [(classes * CLASS_SIZE + SHAPES + 1, 3 * h), (h, 3 * h), (h, classes + SHAPES), (classes + SHAPES,), (classes, h, CLASS_SIZE), (classes, CLASS_SIZE)]

    @classmethod
    def unpack(cls, raw: bytes, classes: int) -> Weights:
        flat, out, at = np.frombuffer(raw, dtype="<f4"), [], 0
        for s in cls.shapes(classes):
            n = int(np.prod(s))
            out.append(flat[at : at + n].reshape(s).copy())
            at += n
        return cls(out)

    @classmethod
    def fresh(cls, classes: int, unigram: np.ndarray, seed: int = 3) -> Weights:
        """Small random weights; output biases from the log counts of the tokens."""
        rng = np.random.default_rng(seed)
        w = [rng.normal(0, 0.1, s).astype("f4") for s in cls.shapes(classes)]
        w[1] *= 2.0
        inside = unigram[: classes * CLASS_SIZE].reshape(classes, CLASS_SIZE)
        outer = np.concatenate([inside.sum(1), unigram[classes * CLASS_SIZE :]]) + 1
        w[3] = np.log(outer / outer.sum()).astype("f4")
        w[5] = np.log((inside + 0.1) / (inside + 0.1).sum(1, keepdims=True)).astype("f4")
        return cls(w)


def _softmax(s: np.ndarray, w: np.ndarray, b: np.ndarray, y: np.ndarray, grads: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probabilities of the targets ``y`` by the scores ``s @ w + b``; adds the gradients of their negative sum for ``w`` and ``b``, if asked, and returns those for ``s``."""
    x = s @ w
    x += b
    rows = np.arange(len(y))
    own = x[rows, y]
    # Scores stay far below the bound, which only keeps floats finite.
    if x.size and np.abs(w).sum(0).max() * max(s.max(), -s.min()) + np.abs(b).max() > 80:
        np.minimum(x, 80, out=x)
    d = np.exp(x, out=x)
    sums = d @ np.ones(d.shape[1], dtype=d.dtype)
    lp = own - np.log(sums)
    if grads is None:
        return lp, None
    d /= sums[:, None]
    d[rows, y] -= 1
    grads[0][...] += s.T @ d
    grads[1][...] += np.ones(len(d), dtype=d.dtype) @ d
    return lp, d @ w.T


class Net:
    """A gated recurrent net over token numbers: frequent words first, then shapes."""

    def __init__(self, weights: Weights, classes: int):
        self.w, self.classes = weights.arrays, classes
        self.start = classes * CLASS_SIZE + SHAPES
        self.m = [np.zeros_like(a) for a in self.w]
        self.v = [np.zeros_like(a) for a in self.w]
        self.t = 0

    def steps(self, x: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each of the inputs ``x`` (steps, lanes), from ``h``; what the way back needs.

        The gates' parts lie apart, so that all work is on whole arrays. A
        sigmoid is half a tanh of half its input.
        """
        inputs, u = self.w[0], self.w[1]
        n = HIDDEN
        parts, us = (np.ascontiguousarray(w.reshape(-1, 3, n).transpose(1, 0, 2)) for w in (inputs, u))
        parts[:2] *= 0.5
        us[:2] *= 0.5
        out = np.empty((len(x) + 1, len(h), n), dtype=np.result_type(h, u))
        out[0] = h
        trace = []
        new, part, gates = np.empty_like(out[0]), np.empty_like(out[0]), np.empty((2, len(h), n), dtype=out.dtype)
        for t, ids in enumerate(x):
            h = out[t]
            g = parts.take(ids, axis=1)
            zr = g[:2]
            zr += np.matmul(h, us[:2], out=gates)
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r, c = g
            rh = r * h
            c += np.matmul(rh, us[2], out=part)
            np.tanh(c, out=c)
            np.subtract(h, c, out=new)
            new *= z
            np.add(new, c, out=out[t + 1])
            if keep:
                trace.append((h, z, r, rh, c))
        return out[1:], trace

    def loss(self, s: np.ndarray, y: np.ndarray, grads: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of targets ``y`` from states ``s``; gradients of their negative sum, if asked."""
        _, _, wc, bc, wo, bo = self.w
        frequent = self.classes * CLASS_SIZE
        cls = np.where(y < frequent, y // CLASS_SIZE, y - frequent + self.classes)
        out, ds = np.empty(len(y)), None if grads is None else np.empty_like(s)
        for lo in range(0, len(y), ROWS):
            at = slice(lo, lo + ROWS)
            out[at], some = _softmax(s[at], wc, bc, cls[at], grads and (grads[2], grads[3]))
            if ds is not None:
                ds[at] = some
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(self.classes + 1)).tolist()
        # Sorted by class, the rows of each are one slice.
        order = order[: cuts[-1]]
        ss, ys, lps = s.take(order, axis=0), y[order] % CLASS_SIZE, np.empty(len(order))
        dss = None if ds is None else np.empty_like(ss)
        for c, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if lo == hi:
                continue
            lps[lo:hi], some = _softmax(ss[lo:hi], wo[c], bo[c], ys[lo:hi], grads and (grads[4][c], grads[5][c]))
            if dss is not None:
                dss[lo:hi] = some
        out[order] += lps
        if ds is not None:
            ds[order] += dss
        return out, ds

    def back(self, x: np.ndarray, trace: list, ds: np.ndarray, grads: list[np.ndarray]) -> None:
        n = HIDDEN
        u = self.w[1]
        uz, ur, un = (np.ascontiguousarray(u[:, i * n : i * n + n].T) for i in range(3))
        dg = np.empty((3, *x.shape, n), dtype=np.float32)
        dh = np.zeros_like(trace[0][0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, rh, c = trace[t]
            dh += ds[t]
            dz, dr, dc = dg[:, t]
            free = 1 - z
            free *= dh  # what goes by the candidate
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= free
            np.subtract(h, c, out=dz)
            dz *= z
            dz *= free
            drh = dc @ un
            np.subtract(1, r, out=dr)
            dr *= rh
            dr *= drh
            dh *= z
            drh *= r
            dh += drh
            dh += dz @ uz
            dh += dr @ ur
        flat = np.empty((x.size, 3 * n), dtype=np.float32)
        hs = np.concatenate([t[0] for t in trace])
        rhs = np.concatenate([t[3] for t in trace])
        for i, (d, by) in enumerate(zip(dg.reshape(3, -1, n), (hs, hs, rhs), strict=True)):
            grads[1][:, i * n : i * n + n] += by.T @ d
            flat[:, i * n : i * n + n] = d
        ids = x.ravel()
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        sorted_ids = ids[order]
        first = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
        grads[0][sorted_ids[first]] += np.add.reduceat(flat.take(order, axis=0), first, axis=0)

    def update(self, grads: list[np.ndarray], tokens: int, rate: float) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float(np.vdot(g, g)) for g in grads))) / tokens
        scale = np.float32(min(1.0, 1.0 / (norm + 1e-9)) / tokens)
        step = rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for w, m, v, g in zip(self.w, self.m, self.v, grads, strict=True):
            # m += 0.1 (g - m), v += 0.01 (g g - v), w -= step m / (sqrt(v) + 1e-6)
            g *= scale
            d = g - m
            d *= np.float32(0.1)
            m += d
            np.multiply(g, g, out=d)
            d -= v
            d *= np.float32(0.01)
            v += d
            np.sqrt(v, out=d)
            d += np.float32(1e-6)
            np.divide(m, d, out=d)
            d *= np.float32(step)
            w -= d

    def run(self, texts: list[np.ndarray], rate: float = 0.0) -> np.ndarray:
        """log10 probability of each text; with a rate, the net also learns, window by window.

        Texts lie side by side, longest first, and keep their states from window
        to window until they end. How long windows are matters for learning only;
        where there is none, they hold as many tokens however few texts are left.
        """
        total = np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        blocks = [order[i : i + LANES] for i in range(0, len(order), LANES)]
        if rate:
            np.random.default_rng(1).shuffle(blocks)
        for block in blocks:
            size = np.array([len(texts[i]) for i in block])
            flat_texts = np.concatenate([texts[i] for i in block]) if len(block) else np.zeros(0, dtype=np.int64)
            begin = np.cumsum(size) - size
            h = np.zeros((len(block), HIDDEN), dtype=np.float32)
            last = np.full(len(block), self.start, dtype=np.int64)
            at, end = 0, int(size[0])
            while at < end:
                live = int(np.searchsorted(-size, -at))  # texts longer than ``at``
                longer = min(STRETCH, LANES // 16 // live) if rate else LANES // live
                step = np.arange(at, min(at + WINDOW * max(1, longer), end))[:, None]
                at += len(step)
                inside = step < size[:live]
                y = np.where(inside, flat_texts[np.where(inside, begin[:live] + step, 0)], -1)
                steps = len(y)
                x = np.empty_like(y)
                x[0] = last[:live]
                x[1:] = np.where(y[:-1] < 0, self.start, y[:-1])
                s, trace = self.steps(x, h[:live], bool(rate))
                h, last = s[-1], y[-1]
                known = np.flatnonzero(y.ravel() >= 0)
                flat = s.reshape(-1, HIDDEN)
                grads = [np.zeros_like(a) for a in self.w] if rate else None
                lp, ds = self.loss(flat.take(known, axis=0), y.ravel()[known], grads)
                if rate:
                    d = np.zeros_like(flat)
                    d[known] = ds
                    self.back(x, trace, d.reshape(s.shape), grads)
                    self.update(grads, len(known), rate)
                each = np.zeros(len(flat))
                each[known] = lp
                total[block[:live]] += each.reshape(steps, live).sum(0)
        return total / LOG10


@dataclass
class Model:
    """What every task holds: bounded by TABLE_WORDS and the net's size.

    ``index`` numbers the words of the table; ``numbers`` and ``logs`` hold for
    each, and last for any other word, the net's token and log10(count + 1).
    """

    index: dict[bytes, int]
    numbers: np.ndarray
    logs: np.ndarray
    classes: int
    weights: bytes
    total: int
    distinct: int
    shape_total: list[int]

    def ids(self, w: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The net's tokens, the log counts, and the places of words beyond the table, whose log count is left 0."""
        get, none = self.index.get, len(self.index)
        at = np.array([get(x, none) for x in w], dtype=np.int64)
        ids = self.numbers[at]
        rest = np.flatnonzero(at == none)
        if len(rest):
            ids[rest] = [self.classes * CLASS_SIZE + shape(w[i]) for i in rest.tolist()]
        return ids, self.logs[at], rest


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (``w``, ``c``): how often each token is in the texts of ``docs`` (doc_id, text)."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for lo, hi, found, _ in split(b.column(1)):
                seen = found.value_counts()
                yield pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], names=["w", "c"])
                yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([hi - lo], pa.int64())], names=["w", "c"])

    return docs.mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _by_shape(counts: DataFrame, frequent: set[bytes]) -> list[int]:
    """For each shape: training tokens plus distinct words plus one, without the frequent words."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SHAPES, dtype=np.int64)
        listed = pc.SetLookupOptions(value_set=pa.array(list(frequent), pa.binary()))
        for b in rows:
            others = b.filter(pc.invert(pc.is_in(b.column(0), options=listed)))
            np.add.at(sums, shapes(others.column(0)), others.column(1).to_numpy() + 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SHAPES), pa.int32()), pa.array(sums, pa.int64())], names=["s", "n"])

    found = {r["s"]: r["n"] for r in counts.mapInArrow(run, "s int, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) + 1 for s in range(SHAPES)]


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, ``most`` at most, by falling count.

    A histogram of counts finds the count from which on they fit, so that no task
    sends more than belongs to the result.
    """
    bucket = F.floor(F.log2("c") * 16).cast("int")
    total, least = 0, None
    for r in counts.groupBy(bucket.alias("b")).count().orderBy(F.desc("b")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["b"]
    if least is None:
        return []
    return sorted(((bytes(r["w"]), r["c"]) for r in counts.where(bucket >= least).collect()), key=lambda x: (-x[1], x[0]))


def prepare(docs: DataFrame, counts: DataFrame) -> Model:
    """The word table and warm weights. ``docs`` (doc_id, text) are the training documents, ``counts`` their word counts."""
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = frequent_words(counts, TABLE_WORDS)
    classes = max(1, min(FREQUENT, len(top)) // CLASS_SIZE)
    frequent = top[: classes * CLASS_SIZE]
    base = classes * CLASS_SIZE
    numbers = np.array([*(i if i < base else base + shape(w) for i, (w, _) in enumerate(top)), base], dtype=np.int64)
    logs = np.log10(np.array([*(c for _, c in top), 0], dtype=np.float64) + 1)
    by_shape = _by_shape(counts, {w for w, _ in frequent})
    unigram = np.zeros(base + SHAPES)
    unigram[: len(frequent)] = [c for _, c in frequent]
    unigram[base:] = by_shape
    model = Model({w: i for i, (w, _) in enumerate(top)}, numbers, logs, classes, Weights.fresh(classes, unigram).pack(), sums["n"], sums["v"], by_shape)

    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(WARM_DOCS)
    # However many rows an id has, one text of it comes to the driver.
    warm = docs.join(F.broadcast(ids.distinct()), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    net = Net(Weights.unpack(model.weights, classes), classes)
    texts = [model.ids(words(r["text"]))[0] for r in sorted(warm, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["text"] or ""))]
    for p in range(WARM_PASSES if texts else 0):
        for i in range(0, len(texts), LANES // 8):  # few lanes: many updates
            net.run(texts[i : i + LANES // 8], WARM_RATE / (1 + p))
    model.weights = Weights(net.w).pack()
    return model


_CODED = [("row", "long", pa.int64()), ("teach", "boolean", pa.bool_()), ("n_tokens", "long", pa.int64()), ("n_known", "long", pa.int64()), ("base", "double", pa.float64()), ("rare", "double", pa.float64()), ("ids", "binary", pa.binary()), ("rest", "array<binary>", pa.list_(pa.binary())), ("times", "array<long>", pa.list_(pa.int64()))]


def encode(rows: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, text, teach) as the net's tokens with their counts."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *[n for n, _, _ in _CODED]]
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = sent.value
        base, none = m.classes * CLASS_SIZE, len(m.index)
        listed = pc.SetLookupOptions(value_set=pa.array(list(m.index), pa.binary()))
        shape_log = np.log10(np.array(m.shape_total, dtype=np.float64))
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo, hi, found, sizes in split(b.column(1)):
                n, ends = hi - lo, np.cumsum(sizes)
                begins = ends - sizes
                at = np.full(ends[-1], m.index.get(END, none))
                inner = np.ones(len(at), dtype=bool)
                inner[ends - 1] = False
                at[inner] = pc.fill_null(pc.index_in(found, options=listed), none).to_numpy()
                ids, known = m.numbers[at], m.logs[at]
                # Words beyond the table: each with the text that it is in and how often it is there.
                beyond = np.flatnonzero(at == none)
                owner = np.searchsorted(ends, beyond, side="right")
                places = np.where(inner[beyond], beyond - owner, len(found))
                coded = pa.concat_arrays([found, pa.array([END], pa.binary())]).take(pa.array(places)).dictionary_encode()
                kinds, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                ids[beyond] = base + shapes(kinds)[code]
                pairs, times = np.unique(owner * max(1, len(kinds)) + code, return_counts=True)
                of, code = np.divmod(pairs, max(1, len(kinds)))
                cuts = pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32())
                rare = ids >= base
                logs = np.zeros(len(at))
                logs[rare] = known[rare] - shape_log[ids[rare] - base]
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.array(np.r_[0, 2 * ends], pa.int32()).buffers()[1], pa.py_buffer(ids.astype("<u2"))])
                cols = [
                    np.arange(number, number + n),
                    b.column(2).slice(lo, n),
                    sizes,
                    sizes - np.bincount(owner, minlength=n),
                    np.add.reduceat(known, begins),
                    np.add.reduceat(logs, begins),
                    raw,
                    pa.ListArray.from_arrays(cuts, kinds.take(pa.array(code))),
                    pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), *[c if isinstance(c, pa.Array) else pa.array(c, k) for c, (_, _, k) in zip(cols, _CODED, strict=True)]], names=names)
                number += n

    return rows.select("doc_id", "text", "teach").mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{n} {t}" for n, t, _ in _CODED))


def shards_of(tokens: int) -> int:
    """Shards of a round that learns ``tokens``."""
    return max(1, min(FEW_SHARDS, tokens // SHARD_TOKENS), tokens // LARGE_SHARD_TOKENS)


def train(coded: DataFrame, model: Model) -> bytes:
    """Weights that have learned from every teaching text once."""
    classes, weights = model.classes, model.weights
    shards = shards_of(model.total // ROUNDS)
    key = F.xxhash64("doc_id", "ids")
    texts = coded.where("teach").select(key.alias("key"), "ids").withColumn("round", F.pmod(F.shiftright("key", 40), F.lit(ROUNDS))).withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    for r in range(ROUNDS):
        weights = averaged(_learned(texts.where(F.col("round") == r), weights, classes, shards)) or weights
    return weights


def _learned(texts: DataFrame, weights: bytes, classes: int, shards: int) -> DataFrame:
    """Rows (``slice``, ``shard``, ``n``, ``raw``): the weights that each shard of ``texts`` (key, ids, shard) has learned, in pieces, and from how many tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, net, learned = None, None, 0
        block: list[np.ndarray] = []

        def learn() -> None:
            nonlocal block, learned
            if block:
                net.run(block, RATE)
                learned += sum(map(len, block))
            block = []

        def out() -> pa.RecordBatch:
            pieces = [p.tobytes() for p in np.array_split(np.frombuffer(Weights(net.w).pack(), dtype="<f4"), SLICES)]
            return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([at] * SLICES, pa.int32()), pa.array([learned] * SLICES, pa.int64()), pa.array(pieces, pa.binary())], names=["slice", "shard", "n", "raw"])

        held = 0
        for b in batches:
            for shard, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if shard != at:
                    if at is not None:
                        learn()
                        yield out()
                    at, net, learned, held = shard, Net(Weights.unpack(weights, classes), classes), 0, 0
                block.append(np.frombuffer(ids, dtype="<u2").astype(np.int64))
                held += len(block[-1])
                if len(block) >= BLOCK_TEXTS or held >= BLOCK_TOKENS:
                    learn()
                    held = 0
        if at is not None:
            learn()
            yield out()

    dealt = texts.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", "ids").select("shard", "ids")
    return dealt.mapInArrow(run, "slice int, shard int, n long, raw binary")


def averaged(learned: DataFrame) -> bytes:
    """The mean of the shards' weights, by the tokens that each has learned from; piece by piece and in a fixed order, so that no task holds more than a sum."""

    def mean(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for b in rows:
            for s, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                old = sums.get(s, (0, 0.0))
                sums[s] = (old[0] + n, old[1] + n * np.frombuffer(raw, dtype="<f4").astype(np.float64))
        rows_out = [(s, (x / n).astype("<f4").tobytes()) for s, (n, x) in sums.items()]
        cols = list(zip(*rows_out, strict=True)) if rows_out else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], names=["slice", "raw"])

    parts = learned.repartition(SLICES, "slice").sortWithinPartitions("slice", "shard").select("slice", "n", "raw").mapInArrow(mean, "slice int, raw binary").collect()
    return b"".join(bytes(r["raw"]) for r in sorted(parts, key=lambda r: r["slice"]))


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """One row per row of ``docs`` with the base and the model's log10 probability of its whole text.

    Learned from rows whose crc32(id as text) modulo ``folds`` is not
    ``held_out``; rows with a null id are scored but teach nothing and are not
    held out. A null or empty text is the end token alone. Repeated rows stay and
    count. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("teach", F.coalesce(fold != held_out, F.lit(False)))
    training = rows.where("teach").select("doc_id", "text")
    counts, counts_path = stage(word_counts(training), "counts")
    model = prepare(training, counts)
    texts, _ = stage(encode(rows, model), "coded")
    weights, classes = train(texts, model), model.classes

    rest = texts.select("row", F.explode(F.arrays_zip("rest", "times")).alias("e")).select("row", F.col("e.rest").alias("w"), F.col("e.times").alias("times"))
    found = cut(rest.join(counts, "w").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("logs")))
    unstage(spark, counts_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(Weights.unpack(weights, classes), classes)
        for b in batches:
            at = b.schema.names.index("ids")
            lp = net.run([np.frombuffer(x, dtype="<u2").astype(np.int64) for x in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(lp, pa.float64())], names=[*b.schema.names[:at], "net"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    scored = texts.select("doc_id", "row", "n_tokens", "n_known", "base", "rare", "ids").mapInArrow(run, f"doc_id {id_type}, row long, n_tokens long, n_known long, base double, rare double, net double")
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "doc_id",
        F.coalesce(fold == held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + more).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.log10(F.lit(float(model.total + model.distinct + 1)))).alias("base_score"),
        (F.col("net") + F.col("rare") + logs).alias("score"),
    )
