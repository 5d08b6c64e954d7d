from __future__ import annotations

import itertools
import random

import regex

from pyspark.sql import functions as F

from sluice.llm import decontaminate as D
from sluice.plans.explain import plan_text


def tokens(text):  # noqa: ANN001, ANN201
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def brute(docs, items, share=0.8):  # noqa: ANN001, ANN201
    """(doc, item) -> (most equal tokens of a window, alignments with a good one, least starts), over all alignments and windows."""
    first = {}
    for i, u in items:
        if i is not None and tokens(u):
            key = tuple(tokens(u))
            first[key] = min(i, first.get(key, i))
    out = {}
    for d, t in docs:
        if d is None:
            continue
        h = tokens(t)
        for w, i in first.items():
            size = min(13, len(w))
            need = -(-size * 8 // 10)
            for off in range(-len(w) + 1, len(h)):
                eq = [0 <= off + j < len(h) and h[off + j] == w[j] for j in range(len(w))]
                good = [(sum(eq[s : s + size]), s) for s in range(len(w) - size + 1) if sum(eq[s : s + size]) >= need]
                if good:
                    best, offs, ds, js = out.get((d, i), (0, set(), 10**9, 10**9))
                    out[d, i] = (max(best, max(good)[0]), offs | {off}, min(ds, *(max(0, off + s) for _, s in good)), min(js, *(s for _, s in good)))
    return {k: (v[0], len(v[1]), v[2], v[3]) for k, v in out.items()}


def test_masks_lose_no_pattern_of_substitutions():
    for masks, window, share in ((D.MASKS, 13, 0.8), (((0, 2, 5),), 13, 0.8), (D.MASKS, 13, 0.7), (D.MASKS, 9, 0.5)):
        family = D.families(masks, window, share)
        for n in range(1, window + 1):
            lost = n - D.needed(n, share)
            places = [{s + o for o in m} for m, at, everywhere in family for s in (range(n - m[-1]) if everywhere and n == window else at.get(n, ()))]
            assert places and all(max(p) < n for p in places)
            assert all(any(p.isdisjoint(gone) for p in places) for gone in itertools.combinations(range(n), lost)), (window, share, n)
    assert D.families(D.MASKS, 13, 0.8)[1][0] == D.MASKS[1]


def test_every_placement_of_tolerated_substitutions_is_found(spark):  # noqa: ANN001
    docs, items, k = [], [], 0
    for n in (4, 5, 8, 10, 12, 13):
        w = [f"i{n}x{j}" for j in range(n)]
        items.append((n, " ".join(w)))
        for gone in itertools.combinations(range(n), n - -(-n * 8 // 10)):
            docs.append((k, "before this " + " ".join("zzz" if j in gone else x for j, x in enumerate(w)) + " and after"))
            k += 1
    one = spark.createDataFrame(docs, "doc_id long, text string")
    got = D.overlaps(one, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(k)) and all(r["n_equal"] == -(-r["item_id"] * 8 // 10) for r in got)


def test_equals_brute_force(spark, docs, rows, none):  # noqa: ANN001
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    items0 = " ".join(rng.choices(vocab, k=30))
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice((3, 5, 7, 10, 12, 13, 14, 25, 40))))) for i in range(25)] + [(90, None), (91, ""), (92, "one two"), (None, "no id at all here " * 4), (93, "same same same same same same same same same same same same"), (80, items0), (81, items0)]
    texts = []
    for k in range(150):
        body = rng.choices(vocab, k=rng.randint(0, 60))
        if k % 3 == 0:
            w = (items[k % 25][1] or "").split()
            for j in range(len(w)):
                if rng.random() < 0.12:
                    w[j] = "swapped"
            at = rng.randint(0, len(body))
            body[at:at] = w[rng.choice((0, 0, 3)) : rng.randint(8, 50)]
        texts.append((k, " ".join(body).upper() + "."))
    texts += [(499, items0), (500, None), (501, ""), (None, items[4][1]), (3, items[7][1]), (600, "same " * 400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as seed", "'y' as h", "2 as at", "3 as __hit2", "'w' as near")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "'z' as w", "0 as mask")
    got = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in D.overlaps(df, bench).collect()}
    want = brute(texts, items)
    assert len(want) > 20 and got == want
    left = D.clean(df, bench)
    assert left.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(d) for d, _ in texts if d is None or d not in {k[0] for k in want})
    assert D.overlaps(none, bench).count() == 0 and D.overlaps(df, bench.limit(0)).count() == 0
    assert D.overlaps(docs, bench).count() == 0


def test_large_benchmarks_are_joined_by_shuffle(spark, monkeypatch):  # noqa: ANN001
    """With a hot seed that many positions show, dealt to several tasks."""
    rng = random.Random(3)
    items = [(i, "the same start of each item " + " ".join(rng.choices("abcdefghij", k=12))) for i in range(12)]
    docs = [(k, "lead " * (k % 3) + (items[k % 12][1] if k % 2 else "the same start of each item and other words after it as in no item")) for k in range(60)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    near = sorted(tuple(r) for r in D.overlaps(df, bench).collect())
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(D, "HOT", 7)
    assert sorted(tuple(r) for r in D.overlaps(df, bench).collect()) == near
    assert {(a, b): tuple(c) for a, b, *c in near} == brute(docs, items)


def test_long_items_make_bounded_seeds(spark):  # noqa: ANN001
    w = [f"t{i}" for i in range(10_000)]
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    seeds = D._seeds(bench.select("item_id", F.transform(D.tokens(F.col("text")), lambda x: F.xxhash64(x)).alias("item")), D.families(D.MASKS, 13, 0.8), 13)
    assert seeds.agg(F.max(F.size("near"))).first()[0] <= 18
    docs = spark.createDataFrame([(7, "x y " + " ".join(w[5000:5013])), (8, " ".join(w[100:111])), (9, "t1 t2 t3")], "doc_id long, text string")
    assert sorted(tuple(r) for r in D.overlaps(docs, bench).collect()) == [(7, 1, 13, 1, 0, 4998), (8, 1, 11, 1, 0, 98)]


def test_plan_is_native(spark, sf):  # noqa: ANN001
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    text = plan_text(D.overlaps(read("documents"), read("benchmark")), "simple")
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text and "NestedLoop" not in text
