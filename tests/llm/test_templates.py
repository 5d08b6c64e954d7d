from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from sluice.llm import templates as T

def mask(line):  # noqa: ANN001, ANN201
    return " ".join("<*>" if re.search("[0-9]", t) else t for t in re.split("[\x20\x09-\x0d]+", line) if t)


def brute(rows, values=10, depth=3, similarity=0.8):  # noqa: ANN001, ANN201
    """The kept texts, with a tree of lines in memory."""
    where = defaultdict(set)
    for i, t in rows:
        for line in map(mask, (t or "").split("\n")):
            if i is not None and line.count(" ") >= 2:
                where[line].add(i)
    leaves = defaultdict(list)
    for line in where:
        w = line.split(" ")
        leaves[len(w), *w[:depth]].append(w)
    template = {line: line for line in where}
    for lines in leaves.values():
        for w in lines:
            varies = [p for p in range(depth, len(w)) if w[p] != "<*>" and sum(v[:p] == w[:p] and v[p + 1 :] == w[p + 1 :] for v in lines) >= values]
            if varies and len(varies) <= int(len(w) * (1 - similarity) + 1e-9):
                template[" ".join(w)] = ("field", *("<*>" if p in varies else x for p, x in enumerate(w)))
    seen = defaultdict(set)
    for line, t in template.items():
        seen[t] |= where[line]
    recurs = {line: min(seen[t]) for line, t in template.items() if len(seen[t]) > 1}
    out = Counter()
    for i, t in rows:
        own = None if t is None else t.split("\n")
        kept = None if own is None else [x for x in own if i is None or mask(x) not in recurs or recurs[mask(x)] == i]
        out[i, None if own is None else "\n".join(kept), 0 if own is None else len(own) - len(kept)] += 1
    return out


def test_masks(spark):  # noqa: ANN001
    some = ["a 1b  c", "", "   ", "x9\ty", "Éa ß2 漢字3", "1", "plain text only", "no-digit 12:30:45 end", "\x1fodd 1", " two\x0b\x0clines\r\n  of 2 \n\n", None]
    df = spark.createDataFrame([(s,) for s in some], "s string")
    assert [r[0] for r in df.select(T.masked_lines(df["s"])).collect()] == [None if s is None else list(map(mask, s.split("\n"))) for s in some]


def lines_with_fields(rng):  # noqa: ANN001, ANN201
    """Logs with a word field, lines that differ in a word without being a field, digits, repeats and near copies."""
    names = [f"{a}{b}" for a in "bdfklmprst" for b in ("ann", "eve")]
    rows = []
    for i in range(120):
        n = rng.choice(names)
        text = [f"service started by operator {n} without any problem today", f"the main office of our company is in {rng.choice(('paris', 'rome', 'oslo'))} since {1900 + i}"]
        text += [f"job {i} of {rng.choice('xyz')} ended at 12:{i % 60} with result {rng.choice(names[:4])} here"]
        if i % 4 == 0:
            text.append("  this exact\tline  is in many documents ")
        if i % 9 == 0:
            text.append(f"service started by operator {n} with some small problem today")
        text += [" ".join(rng.choices(names, k=rng.randint(1, 9)))] * rng.randint(0, 2)
        rng.shuffle(text)
        rows.append((i // 2 if i > 100 else i, "\n".join(text)))
    return rows


def test_templates_equal_brute_force(spark, docs, rows, none):  # noqa: ANN001
    """At the production parameters, and with others."""
    made = lines_with_fields(random.Random(4))
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    for values in (T.FIELD_VALUES, 3):
        got = Counter(tuple(r) for r in T.dedup_lines(df, count_col="n", values=values).collect())
        assert got == brute(made, values)
    assert sum(n * k[2] for k, n in brute(made).items()) > sum(n * k[2] for k, n in brute(made, 10**9).items()) > 20
    out = T.dedup_lines(docs, count_col="n")
    assert out.columns == [*docs.columns, "n"] and Counter((r["doc_id"], r["text"], r["n"]) for r in out.collect()) == brute(rows)
    assert T.dedup_lines(none).count() == 0


def test_joins_by_shuffle_give_the_same(spark, monkeypatch):  # noqa: ANN001
    made = lines_with_fields(random.Random(5))
    monkeypatch.setattr(T, "BROADCAST_ROWS", 0)
    assert Counter(tuple(r) for r in T.dedup_lines(spark.createDataFrame(made, "doc_id long, text string"), count_col="n").collect()) == brute(made)


def test_lines_that_differ_in_a_word_stay(spark):  # noqa: ANN001
    towns = "paris rome oslo lima cairo".split()
    docs = [(i, f"the main office of the company in this region is {t} today") for i, t in enumerate(towns)]
    assert T.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), count_col="n").where("n > 0").count() == 0


def test_variable_fields_are_generalised(spark):  # noqa: ANN001
    names = "ann bob cid dan eve fay gus hal ida joe".split()
    docs = [(i, f"intro {n} text here\nservice started by operator {n} without any problem today\nclosing words") for i, n in enumerate(names)]
    out = {r["doc_id"]: (r["text"], r["n"]) for r in T.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), count_col="n").collect()}
    assert out[0] == (docs[0][1], 0)
    for i, n in list(enumerate(names))[1:]:
        assert out[i] == (f"intro {n} text here\nclosing words", 1)


def test_lines_of_two_documents_recur(spark):  # noqa: ANN001
    long, other = (" ".join(f"{c}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) for c in "wx")
    docs = [(1, f"first of all\n{long}"), (2, f"{long}\nsecond in row"), (3, other), (4, "nothing of it stays alone"), (4, "nothing of it stays alone"), (5, other.replace("xfb", "changed"))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = sorted(tuple(r) for r in T.dedup_lines(df, count_col="n").collect())
    assert out == [(1, docs[0][1], 0), (2, "second in row", 1), (3, other, 0), (4, docs[3][1], 0), (4, docs[3][1], 0), (5, docs[5][1], 0)]
