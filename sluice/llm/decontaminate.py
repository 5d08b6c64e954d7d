"""Benchmark decontamination by spaced-seed hashing, in DataFrame code alone.

A mask is a fixed set of token offsets; the tokens between them are ignored, so a
seed survives substitutions there. Seeds of benchmark items and of documents are
equi-joined by hash, and each hit is verified on the tokens around it. The masks
are complete: whichever tokens of a window are substituted, as many as the
tolerance allows, one seed stays whole, so no overlap is lost. A bit map of the
benchmark's seeds first removes most document positions without a row for each.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import cut

#: An overlap is judged on windows of so many tokens (fewer, if the item is shorter) and needs this share of equal tokens.
WINDOW, SHARE = 13, 0.8
#: Offsets of the tokens that count. Any two substitutions in 13 tokens leave a place for one of the masks.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
#: Bits of the map for each seed, and the most longs of the map (1 MB). A full map removes nothing, and results stay the same.
MAP_BITS, MAP_LONGS = 32, 1 << 17
#: Seed rows hold a bounded slice of their item; they are broadcast up to so many bytes, by a count.
BROADCAST_BYTES = 64 << 20
#: Up to so many ids of documents to drop are broadcast, by a count.
BROADCAST_IDS = 500_000
#: Document positions of one seed that go to one task, where seeds are joined by shuffle.
HOT = 50_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def needed(size: int, share: float) -> int:
    """Equal tokens that a window of ``size`` needs."""
    return math.ceil(round(size * share, 9))


def complete(masks: tuple[tuple[int, ...], ...], window: int, lost: int) -> bool:
    """Whether any ``lost`` substitutions in ``window`` tokens leave a place for one of the masks, by enumeration."""
    places = [{s + o for o in m} for m in masks for s in range(window - m[-1])]
    return all(any(p.isdisjoint(gone) for p in places) for gone in itertools.combinations(range(window), lost))


def families(masks: tuple[tuple[int, ...], ...], window: int, share: float) -> list[tuple[tuple[int, ...], dict[int, list[int]], bool]]:
    """Masks as (offsets, places in items of a length under ``window``, whether longer items have it everywhere).

    Items shorter than a window are cut into one block more than they may have
    substitutions, so that a block stays whole. Where ``masks`` are not complete
    for the window, a run of tokens that any window must keep takes their place.
    """
    lost = window - needed(window, share)
    if not complete(masks, window, lost):
        masks = (tuple(range(window // (lost + 1))),)
    blocks: dict[int, dict[int, list[int]]] = {}
    for n in range(1, window):
        parts = n - needed(n, share) + 1
        blocks.setdefault(n // parts, {})[n] = [i * (n // parts) for i in range(parts)]
    out: list[tuple[tuple[int, ...], dict[int, list[int]], bool]] = [(m, {}, True) for m in masks]
    return out + [(tuple(range(size)), places, False) for size, places in sorted(blocks.items())]


def _seed(hashes: Column, at: Column, mask: tuple[int, ...], number: int) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(hashes, at + o) for o in mask])


def _seeds(bench: DataFrame, family: list, window: int) -> DataFrame:
    """Rows (``seed``, ``mask``, ``item_id``, ``size``, ``first``, ``back``, ``item_at``, ``near``): each seed with the slice of its item that windows around it reach."""
    out = None
    n = F.size("item")
    for number, (mask, places, everywhere) in enumerate(family):
        starts = F.when((n >= window) & F.lit(everywhere), F.sequence(F.lit(0), n - (mask[-1] + 1)))
        for length, at in places.items():
            starts = starts.when(n == length, F.array(*map(F.lit, at)))
        part = bench.select("item_id", "item", F.explode(starts).alias("item_at")).withColumn("mask", F.lit(number))
        part = part.withColumn("seed", _seed(F.col("item"), F.col("item_at"), mask, number)).withColumn("span", F.lit(mask[-1] + 1))
        out = part if out is None else out.unionAll(part)
    size = F.least(F.lit(window), n)
    first = F.greatest(F.lit(0), F.col("item_at") + F.col("span") - F.col("size"))
    last = F.least(F.col("item_at"), n - F.col("size"))
    out = out.withColumn("size", size).withColumn("first", first).withColumn("last", last)
    return out.select("seed", "mask", "item_id", "size", "first", (F.col("item_at") - F.col("first")).alias("back"), "item_at", F.slice("item", F.col("first") + 1, F.col("last") + F.col("size") - F.col("first")).alias("near"))


def _bit(h: Column, turn: int, longs: int) -> tuple[Column, Column]:
    """Word and bit of the map for one of two probes."""
    x = F.shiftrightunsigned(h, turn)
    return F.shiftright(x, 6).bitwiseAND(longs - 1).cast("int"), x.bitwiseAND(63).cast("int")


def _map(seeds: DataFrame, longs: int) -> Column:
    """The seeds' bit map as an array constant: a row for each non-zero long comes to the driver, MAP_LONGS at most."""
    probes = None
    for turn in (0, 24):
        word, bit = _bit(F.col("seed"), turn, longs)
        part = seeds.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
        probes = part if probes is None else probes.unionAll(part)
    words = [0] * longs
    for r in probes.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        words[r["word"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def _held(bits: Column, h: Column, longs: int) -> Column:
    test = None
    for turn in (0, 24):
        word, bit = _bit(h, turn, longs)
        one = F.getbit(F.get(bits, word), bit) == 1
        test = one if test is None else test & one
    return test


def _spread(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """Both joined by shuffle; the positions of a frequent seed are dealt to several tasks, each of which gets that seed's items."""
    hits = cut(hits)
    parts = F.ceil(F.count("*") / HOT).cast("int")
    hot = cut(hits.groupBy("doc_seed").agg(parts.alias("parts")).where("parts > 1"))
    dealt = hits.join(hot, "doc_seed", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "at"), "parts")).cast("int")).drop("parts")
    ready = seeds.join(hot.withColumnRenamed("doc_seed", "seed"), "seed", "left").withColumn("item_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(ready, (F.col("doc_seed") == F.col("seed")) & (F.col("part") == F.col("item_part")))


def overlaps(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """A row (``doc_id``, ``item_id``, ``n_equal``, ``n_alignments``, ``doc_start``, ``item_start``) for each pair that overlaps.

    A document and an item, laid over each other at any offset, overlap where a
    window of ``window`` tokens of the item (the whole item, if it is shorter) has
    a ``share`` of equal tokens at least; a window may hang over the document's
    ends. ``n_equal`` is the most equal tokens of such a window, ``n_alignments``
    the number of offsets with one, and the starts are the smallest token
    positions at which one begins (0 for one that hangs over the start). Items
    under five tokens must therefore occur in full.

    Rows with a null id or without tokens match nothing, nor do such items; items
    of equal tokens are one, under the smallest id; repeated document ids count
    as one document. Pairs without overlap give no row. Empty tables give none.
    Other columns are ignored.
    """
    family = families(masks, window, share)
    bench = items.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text_col)).alias("w")).where(F.col("item_id").isNotNull() & (F.size("w") > 0))
    bench = bench.groupBy(F.transform("w", lambda w: F.xxhash64(w)).alias("item")).agg(F.min("item_id").alias("item_id"))
    seeds = cut(_seeds(bench, family, window))
    used = {r["mask"]: r["count"] for r in seeds.groupBy("mask").count().collect()}
    total = sum(used.values())
    longs = min(MAP_LONGS, 1 << max(6, (total * MAP_BITS // 64).bit_length()))
    bits = _map(seeds, longs)
    small = total * (16 * window + 128) <= BROADCAST_BYTES
    mine = [(n, m) for n, (m, _, _) in enumerate(family) if n in used] or [(0, family[0][0])]

    rows = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("w")).where(F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    # explode_outer: for explode, the optimizer would put a filter that computes all hashes anew below it.
    # The second explode keeps the bit map's filter from being merged with the seeds' code, which then is too long for the JVM to compile.
    # Seeds that would run over a document's end leave tokens out and equal none of the benchmark's.
    reach = F.size("h") - (min(m[-1] for _, m in mine) + 1)
    at = rows.select("doc_id", "h", F.explode_outer(F.when(reach >= 0, F.sequence(F.lit(0), reach))).alias("at")).where("at is not null")
    pairs = F.array(*[F.struct(F.lit(n).alias("mask"), _seed(F.col("h"), F.col("at"), m, n).alias("seed")) for n, m in mine])
    hits = at.select("doc_id", "h", "at", F.explode(pairs).alias("f")).where(_held(bits, F.col("f.seed"), longs))
    # Only the tokens that a window over the hit can reach go on.
    left = F.least(F.col("at"), F.lit(window))
    hits = hits.select("doc_id", F.col("f.seed").alias("doc_seed"), "at", left.alias("left"), F.slice("h", F.col("at") - left + 1, F.lit(2 * window)).alias("around"))
    joined = hits.join(F.broadcast(seeds), F.col("doc_seed") == F.col("seed")) if small else _spread(hits, seeds)
    skip = F.col("left") - F.col("back")
    # Outside the document nothing is equal.
    equal = F.transform("near", lambda x, j: F.coalesce((F.get("around", skip + j) == x).cast("int"), F.lit(0)))
    sums = F.transform(F.sequence(F.lit(0), F.size("near") - F.col("size")), lambda s: F.aggregate(F.slice("equal", s + 1, F.col("size")), F.lit(0), lambda a, x: a + x))
    need = F.coalesce(*[F.when(F.col("size") == n, F.lit(needed(n, share))) for n in range(1, window + 1)])
    judged = joined.withColumn("equal", equal).withColumn("sums", sums).withColumn("best", F.array_max("sums")).withColumn("need", need).where("best >= need")
    begin = F.array_position(F.transform("sums", lambda s: s >= F.col("need")), F.lit(True)).cast("int") - 1
    judged = judged.withColumn("begin", begin)
    each = judged.select(
        "doc_id",
        "item_id",
        (F.col("at") - F.col("item_at")).alias("offset"),
        "best",
        F.greatest(F.lit(0), F.col("at") - F.col("back") + F.col("begin")).alias("doc_at"),
        (F.col("first") + F.col("begin")).alias("item_from"),
    )
    found = each.groupBy("doc_id", "item_id", "offset").agg(F.max("best").alias("best"), F.min("doc_at").alias("doc_at"), F.min("item_from").alias("item_from"))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("best").cast("long").alias("n_equal"), F.count("*").alias("n_alignments"), F.min("doc_at").cast("long").alias("doc_start"), F.min("item_from").cast("long").alias("item_start")
    )


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **more) -> DataFrame:
    """The rows of ``docs`` whose document overlaps no item, all columns kept; rows with a null id stay."""
    hit = cut(overlaps(docs, items, id_col=id_col, **more).select(F.col("doc_id").alias("__hit")).distinct())
    few = hit.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(hit) if few else hit, docs[id_col] == F.col("__hit"), "left_anti")
