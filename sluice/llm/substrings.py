"""Removal of repeated substrings by sorting sampled suffixes.

A difference cover samples positions so that any two equal strings meet at a
sample. Here the sample is chosen by content: of the 20-byte strings in a 50-byte
window the one of least hash is the window's anchor, so equal windows have equal
anchors at equal offsets, at a tenth of a cover's size. Anchors that occur in one
document only are left out. The rest meet, with the bytes around them, in shards;
there the suffixes from the anchors are sorted and named by adjacent common
prefixes, and so are the reversed strings before them. A window is the pair of its
two names, and equal pairs are equal windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import cut

#: Bytes of a string that counts, of an anchor, and how many anchors a string has room for.
LENGTH, GRAM = 50, 20
ROOM = LENGTH - GRAM + 1
LEFT = LENGTH - GRAM
#: Bytes that are worked on at a time; a longer text is cut into overlapping pieces that hold every window once.
CHUNK = 1 << 22
#: The filter of anchors that more than one document holds: a bit map of this many bits, whatever the input. A full map filters nothing and results stay the same.
MAP_BITS = 28
#: Bytes of text for each shard and for each task that judges shards, where the session has fewer shuffle partitions.
SHARD_BYTES, TASK_BYTES = 1 << 24, 1 << 25
#: An anchor counts twice in a buffer, or four times if DENSE documents of it hold the anchor. It is hot if it counts three times a buffer, and HOT times at least; its occurrences are dealt to SALTS shards or more.
DENSE, HOT, SALTS = 64, 64, 4
_EVEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A mixing of 64-bit numbers, in place."""
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(by)
        x *= np.uint64(times)
    x ^= x >> np.uint64(31)
    return x


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; numbers go byte by byte of their places, as high bytes are mostly zero."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() if a.itemsize == 1 else np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays))


def _unpack(raw: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """The arrays again, of the given types and lengths."""
    import zstandard

    flat, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8), [], 0
    for kind, n in kinds:
        size = np.dtype(kind).itemsize
        part = flat[at : at + n * size]
        at += n * size
        out.append(part if size == 1 else np.ascontiguousarray(part.reshape(size, n).T).view(kind).ravel())
    return out


def _loads(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number."""
    n = len(buf) - 7
    out = np.empty(n, dtype=np.uint64)
    for s in range(min(8, n)):
        m = (n - s + 7) // 8
        out[s::8] = np.frombuffer(buf[s : s + 8 * m].tobytes(), dtype="<u8")
    return out


def anchors(buf: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a buffer of texts: (position, first window, last window, hash).

    ``piece`` numbers the text of every byte; windows within one text count. The
    windows of an anchor follow each other.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(buf) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    u = _loads(buf)
    n = len(buf) - GRAM + 1
    h = u[12 : n + 12] * np.uint64(0xD6E8FEB86659FD93)
    h += u[8 : n + 8]
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= u[:n] * _EVEN
    _mix(h)
    # Bytes 12 to 19 and 8 to 15 overlap; together with the first eight they are the twenty of the anchor.
    low = np.uint64(CHUNK * 2 - 1)
    m = (h & ~low) | np.arange(n, dtype=np.uint64)
    for step in (1, 2, 4, 8):
        m = np.minimum(m[:-step], m[step:])
    m = np.minimum(m[: n - ROOM + 1], m[ROOM - 16 : n - ROOM + 1 + ROOM - 16])
    at = np.flatnonzero(piece[: len(m)] == piece[LENGTH - 1 :])
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    p = (m[at] & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    first, last = at[new], at[np.r_[new[1:], len(at)] - 1]
    return p[new], first, last, h[p[new]]


def _pieces(rows: Iterable[pa.RecordBatch], id_at: int, text_at: int, sig_at: int | None = None) -> Iterator[tuple]:
    """Buffers of at most about CHUNK bytes: (bytes, piece of each byte, documents, signatures, offsets in the text) by piece."""
    parts: list[bytes] = []
    docs: list[int] = []
    sigs: list[int] = []
    offs: list[int] = []
    held = 0

    def out() -> tuple:
        sizes = [len(p) for p in parts]
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.repeat(np.arange(len(parts)), sizes), np.array(docs, dtype=np.int64), np.array(sigs, dtype=np.int64), np.array(offs, dtype=np.int64), np.cumsum([0, *sizes])

    for b in rows:
        for k, t in enumerate(b.column(text_at)):
            doc = b.column(id_at)[k].as_py()
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            if doc is None or len(raw) < LENGTH:
                continue
            for lo in range(0, max(1, len(raw) - LENGTH + 1), CHUNK - LENGTH):
                part = raw[lo : lo + CHUNK - 1]
                if held + len(part) > CHUNK and parts:
                    yield out()
                    parts, docs, sigs, offs, held = [], [], [], [], 0
                parts.append(part)
                docs.append(doc)
                sigs.append(b.column(sig_at)[k].as_py() if sig_at is not None else 0)
                offs.append(lo)
                held += len(part)
    if parts:
        yield out()


def _shared_map(docs: DataFrame, bits: int, tasks: int, hot: int) -> tuple[bytes, np.ndarray]:
    """Bit map of the hashes of anchors that at least two documents hold, and the leading 32 + ``bits`` bits of those that count ``hot`` times.

    The latter are as many as the text's anchors over ``hot`` at most, which grows with the text.
    """
    shift = np.uint64(64 - bits)

    def emit(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buf, piece, ids, _, _, _ in _pieces(rows, 0, 1):
            p, _, _, h = anchors(buf, piece)
            if not len(p):
                continue
            order = np.lexsort((ids[piece[p]], h))
            h, d = h[order], ids[piece[p]][order]
            fresh = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
            h = h[fresh]  # once a document; and of those at most two, or four
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            many = np.diff(np.r_[new, len(h)])
            h = h[np.arange(len(h)) - np.repeat(new, many) < np.repeat(np.where(many >= DENSE, 4, 2), many)]
            value = (h << np.uint64(bits) >> np.uint64(32)).astype("<u4")
            part = (h >> shift).astype(np.int64)
            cuts = np.searchsorted(part, np.arange((1 << bits) + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32), pa.int32()), pa.array([value[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())], names=["part", "h"])

    def gather(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(k: int, raw: list[bytes]) -> pa.RecordBatch:
            v = np.sort(np.frombuffer(b"".join(raw), dtype="<u4"))
            twice = v[1:][v[1:] == v[:-1]]
            often = np.unique(v[hot - 1 :][v[hot - 1 :] == v[: max(0, len(v) - hot + 1)]])
            seg = np.zeros(1 << (MAP_BITS - bits), dtype=np.uint8)
            seg[twice >> np.uint32(32 - (MAP_BITS - bits))] = 1
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(seg, bitorder="little").tobytes()], pa.binary()), pa.array([often.tobytes()], pa.binary())], names=["part", "seg", "hot"])

        at, raw = None, []
        for b in rows:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != at:
                    if raw:
                        yield out(at, raw)
                    at, raw = k, []
                raw.append(x)
        if raw:
            yield out(at, raw)

    size = 1 << (MAP_BITS - bits - 3)
    whole = bytearray(1 << (MAP_BITS - 3))
    found = docs.mapInArrow(emit, "part int, h binary").repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(gather, "part int, seg binary, hot binary")
    often = [np.zeros(0, dtype=np.uint64)]
    for r in found.collect():
        whole[r["part"] * size : (r["part"] + 1) * size] = r["seg"]
        often.append(np.frombuffer(r["hot"], dtype="<u4").astype(np.uint64) | np.uint64(r["part"] << 32))
    return bytes(whole), np.sort(np.concatenate(often))


_U8 = np.arange(-LEFT, LENGTH)


def _contexts(buf: np.ndarray, p: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The bytes around each anchor that its windows cover; others are zero."""
    at = p[:, None] + _U8
    inside = (at >= first[:, None]) & (at < last[:, None] + LENGTH)
    return np.where(inside, buf[np.clip(at, 0, len(buf) - 1)], 0).astype(np.uint8)


def _names(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings and the common prefix of each with the one before it."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    s = rows[order]
    differ = s[1:] != s[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, np.r_[-1, lcp]


def equal_windows(ctx: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each context and each offset of an anchor, the least document that has that window; the largest number if none.

    ``lo`` and ``hi`` are the least and the largest offset of the context's windows.
    """
    n = len(ctx)
    out = np.full((n, ROOM), np.iinfo(np.int64).max)
    right, right_lcp = _names(ctx[:, LEFT:])
    left, left_lcp = _names(ctx[:, LEFT - 1 :: -1] if LEFT else ctx[:, :0])
    name_r, name_l = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for o in range(ROOM):
        have = np.flatnonzero((lo <= o) & (o <= hi))
        if not len(have):
            continue
        name_r[right] = np.cumsum(right_lcp < LENGTH - o)
        name_l[left] = np.cumsum(left_lcp < o)
        key = (name_r[have] << 32) | name_l[have]
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        least = np.minimum.reduceat(doc[have][order], new)
        out[have[order], o] = np.repeat(least, np.diff(np.r_[new, len(k)]))
    return out


_PACK = "shard int, n int, m int, raw binary"


def spans(docs: DataFrame) -> DataFrame:
    """Rows (``doc``, ``sig``, ``runs``) for each text of ``docs`` (doc_id, text, sig) that loses bytes.

    ``runs`` holds the starts and ends of the maximal removed runs, as
    little-endian 64-bit numbers.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    bits = min(16, max(8, (4 * tasks - 1).bit_length()))
    shards = max(64, tasks, size // SHARD_BYTES)
    salts = max(SALTS, min(256, size // CHUNK // 4096))
    sent = spark.sparkContext.broadcast(_shared_map(docs, bits, tasks, max(HOT, 3 * size // CHUNK)))
    drop = np.uint64(64 - MAP_BITS)

    def emit(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, often = np.frombuffer(sent.value[0], dtype=np.uint8), sent.value[1]
        for buf, piece, ids, sigs, offs, starts in _pieces(rows, 0, 1, 2):
            p, first, last, h = anchors(buf, piece)
            i = h >> drop
            keep = (held[(i >> np.uint64(3)).astype(np.int64)] >> (i & np.uint64(7)).astype(np.uint8)) & 1 == 1
            p, first, last, h = p[keep], first[keep], last[keep], h[keep]
            if not len(p):
                continue
            ctx = _contexts(buf, p, first, last)
            off = np.stack([p - last, p - first], axis=1).astype(np.uint8)  # least and largest offset
            mark = _mix(_mix(ctx.view("<u8") ^ (_EVEN * np.arange(1, 11, dtype=np.uint64))).sum(1, dtype=np.uint64) ^ h ^ _mix(off[:, 0].astype(np.uint64) * np.uint64(64) + off[:, 1] + np.uint64(1)))
            doc = ids[piece[p]]
            _, one, which = np.unique(mark, return_index=True, return_inverse=True)  # equal contexts go once
            least = np.full(len(one), np.iinfo(np.int64).max)
            np.minimum.at(least, which, doc)
            # An entry for each context; for one of a hot anchor an entry in each of several shards, to which its members are dealt.
            top = h[one] >> np.uint64(32 - bits)
            hot = often[np.searchsorted(often, top).clip(max=len(often) - 1)] == top if len(often) else np.zeros(len(one), dtype=bool)
            times = np.where(hot, salts, 1)
            base = np.cumsum(times) - times
            entry = np.repeat(np.arange(len(one)), times)
            salt = np.arange(len(entry)) - base[entry]
            dealt = np.where(hot[which], (_mix(doc.astype(np.uint64) * _EVEN + p.astype(np.uint64)) % np.uint64(salts)).astype(np.int64), 0)
            one, least = one[entry], least[entry]
            shard_one = ((h[one] + salt.astype(np.uint64) * _EVEN) % np.uint64(shards)).astype(np.int32)
            order_one = np.argsort(shard_one, kind="stable")
            place = np.empty(len(one), dtype=np.int64)
            place[order_one] = np.arange(len(one))
            cuts = np.searchsorted(shard_one[order_one], np.arange(shards + 1))
            home = place[base[which] + dealt]
            order = np.argsort(home, kind="stable")  # members in the order of their contexts
            of = piece[p][order]
            doc, sig = doc[order], sigs[of].astype("<i4")
            start = offs[of] + p[order] - starts[of]  # the anchor's place in its text
            cut_m = np.searchsorted(home[order], cuts)
            count = np.bincount(home, minlength=len(one)).astype("<i4")
            full = np.flatnonzero(np.diff(cuts)).tolist()
            raw = []
            for k in full:
                o, m = order_one[cuts[k] : cuts[k + 1]], slice(cut_m[k], cut_m[k + 1])
                raw.append(_pack(ctx[one[o]].ravel(), off[one[o]].ravel(), least[o], count[cuts[k] : cuts[k + 1]], doc[m], sig[m], start[m]))
            cols = [pa.array(full, pa.int32()), pa.array(np.diff(cuts)[full].astype(np.int32)), pa.array(np.diff(cut_m)[full].astype(np.int32)), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "n", "m", "raw"])

    def judge(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: list[tuple]) -> pa.RecordBatch:
            parts = [_unpack(raw, ("u1", 80 * n), ("u1", 2 * n), ("<i8", n), ("<i4", n), ("<i8", m), ("<i4", m), ("<i8", m)) for _, n, m, raw in group]
            ctx, off, low, count, doc, sig, start = (np.concatenate(x) for x in zip(*parts, strict=True))
            ctx, off = ctx.reshape(-1, LEFT + LENGTH), off.reshape(-1, 2)
            least = equal_windows(ctx, off[:, 0], off[:, 1], low)
            # Windows by start: the largest offset first. Runs of removed ones become byte ranges.
            gone = least[np.repeat(np.arange(len(count)), count)] < doc[:, None]
            step = np.diff(np.pad(gone[:, ::-1], ((0, 0), (1, 1))).astype(np.int8), axis=1)
            r, first = np.nonzero(step == 1)
            _, past = np.nonzero(step == -1)
            at, size = start[r] - (ROOM - 1) + first, (past - first - 1 + LENGTH).astype(np.uint8)
            doc, sig = doc[r], sig[r]
            to = (_mix(doc.astype(np.uint64)) % np.uint64(tasks)).astype(np.int32)
            order = np.lexsort((at, sig, doc, to))
            doc, sig, at, size = doc[order], sig[order], at[order], size[order]
            cuts = np.searchsorted(to[order], np.arange(tasks + 1))
            full = np.flatnonzero(np.diff(cuts)).tolist()
            raw = [_pack(doc[a:z], sig[a:z], at[a:z], size[a:z]) for a, z in zip(cuts[full].tolist(), cuts[1:][full].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.diff(cuts)[full].astype(np.int32)), pa.array(raw, pa.binary())], names=["to", "n", "raw"])

        at, group = None, []
        for b in rows:
            for g in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g[0] != at:
                    if group:
                        yield out(group)
                    at, group = g[0], []
                group.append(g)
        if group:
            yield out(group)

    def join(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: list[tuple]) -> pa.RecordBatch:
            parts = [_unpack(raw, ("<i8", n), ("<i4", n), ("<i8", n), ("u1", n)) for _, n, raw in group]
            doc, sig, at, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((at, sig, doc))
            doc, sig, x = doc[order], sig[order], np.stack([at, at + size], axis=1)[order]
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (sig[1:] != sig[:-1])])
            runs = [_merged(x[a:z]).astype("<i8").tobytes() for a, z in zip(new.tolist(), [*new[1:].tolist(), len(doc)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(doc[new], pa.int64()), pa.array(sig[new], pa.int32()), pa.array(runs, pa.binary())], names=["doc", "sig", "runs"])

        at, group = None, []
        for b in rows:
            for g in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g[0] != at:
                    if group:
                        yield out(group)
                    at, group = g[0], []
                group.append(g)
        if group:
            yield out(group)

    packed = docs.mapInArrow(emit, _PACK).repartition(tasks, "shard").sortWithinPartitions("shard")
    parts = packed.mapInArrow(judge, "to int, n int, raw binary")
    return parts.repartition(tasks, "to").sortWithinPartitions("to").mapInArrow(join, "doc long, sig int, runs binary")


def _merged(x: np.ndarray) -> np.ndarray:
    """Maximal runs of ranges sorted by start; ranges that touch are one run."""
    if len(x) < 2:
        return x
    reach = np.maximum.accumulate(x[:, 1])
    new = np.flatnonzero(np.r_[True, x[1:, 0] > reach[:-1]])
    return np.stack([x[new, 0], reach[np.r_[new[1:], len(x)] - 1]], axis=1)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: what is left of its text without strings that an earlier document holds.

    Columns ``doc_id``, ``n_bytes``, ``runs`` (array of (start, end) in bytes) and
    ``kept`` (binary). A byte goes if a string of LENGTH bytes over it also starts
    in a document of smaller id; strings are judged on the input. Rows of one id
    are one document and take nothing from each other. Rows with a null id lose
    nothing and take nothing. Null and empty texts have no bytes. Other columns
    are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("sig", F.xxhash64("text").bitwiseAND(0x7FFFFFFF).cast("int"))
    lost = cut(spans(rows))

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], []]
            for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                runs = np.frombuffer(x, dtype="<i8").reshape(-1, 2).tolist() if x else []
                kept, at = [], 0
                for a, z in runs:
                    kept.append(raw[at:a])
                    at = z
                kept.append(raw[at:])
                for c, v in zip(cols, (len(raw), [{"start": a, "end": z} for a, z in runs], b"".join(kept)), strict=True):
                    c.append(v)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), kind, pa.binary()), strict=True)]], names=["doc_id", "n_bytes", "runs", "kept"])

    known = lost.select(F.col("doc").alias("lost_doc"), F.col("sig").alias("lost_sig"), "runs")
    joined = rows.join(known, (F.col("doc_id") == F.col("lost_doc")) & (F.col("sig") == F.col("lost_sig")), "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(apply, "doc_id long, n_bytes long, runs array<struct<start:bigint,end:bigint>>, kept binary")
