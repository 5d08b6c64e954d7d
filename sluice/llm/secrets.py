"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

A prefix tree of the labelled credentials of a format counts how often each state
is passed and left by each symbol. Its states are merged, red to blue, while a
Hoeffding bound finds their frequencies compatible; the result is a probabilistic
automaton. All runs of credential characters, and what '=', '/' and '.' separate
in them, are scored under the automata of all formats against one of ordinary text,
whatever the fixed patterns find there.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", "grammar")
#: Symbols of a candidate's head are kept as they are; behind it a class of characters is one symbol.
HEAD = 5
#: Labelled credentials of each format that an automaton is inferred from, and others that set its threshold.
LEARN, CALIBRATE = 300, 200
ALPHA = 0.05
FLOOR = 1e-4
_FLOOR_BITS = math.log2(FLOOR)
#: Bits a symbol by which a credential's format must beat ordinary text.
MARGIN = 0.5
#: A format takes candidates of the lengths of its labelled credentials, give or take this share.
SLACK = 0.1

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
#: Where candidates start in a run and end in it.
_START = re.compile(r"(?:\A|(?<=[=/.]))-*([A-Za-z0-9+/_])")
_END = re.compile(r"[A-Za-z0-9+_](?=-*(?:[=/.]|\Z))|-(?=[=/.]|\Z)|=+")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def _symbol(c: str) -> str:
    if c.isdigit():
        return "0"
    if "a" <= c <= "f":
        return "a"
    if "g" <= c <= "z":
        return "g"
    if "A" <= c <= "F":
        return "A"
    if "G" <= c <= "Z":
        return "G"
    return c


def symbols(s: str) -> list[str]:
    return [c if i < HEAD else _symbol(c) for i, c in enumerate(s)]


@dataclass
class Automaton:
    """Probabilistic deterministic automaton; state 0 starts. ``next[q][a]`` is (state, log2 probability)."""

    next: list[dict[str, tuple[int, float]]] = field(default_factory=list)
    end: list[float] = field(default_factory=list)

    def bits(self, seq: list[str]) -> float:
        """log2 probability of ``seq``; a step that the automaton lacks costs FLOOR and stays in its state."""
        return self.bits_at(seq, [len(seq)])[0]

    def bits_at(self, seq: list[str], ends: list[int], least: float = -math.inf) -> list[float]:
        """The bits of each prefix of a length in ``ends`` (ascending); -inf from where they are under ``least``."""
        q, total, done, out = 0, 0.0, 0, []
        for n in ends:
            for a in seq[done:n]:
                step = self.next[q].get(a)
                if step is None:
                    total += _FLOOR_BITS
                else:
                    q = step[0]
                    total += step[1]
                if total < least:
                    return out + [-math.inf] * (len(ends) - len(out))
            done = n
            out.append(total + self.end[q])
        return out


class _Tree:
    """Prefix tree with counts; states are merged by redirecting edges and adding counts."""

    def __init__(self, samples: Iterable[list[str]]):
        self.kids: list[dict[str, int]] = [{}]
        self.passed: list[dict[str, int]] = [{}]
        self.n = [0]
        self.ends = [0]
        for s in samples:
            q = 0
            self.n[0] += 1
            for a in s:
                self.passed[q][a] = self.passed[q].get(a, 0) + 1
                if a not in self.kids[q]:
                    self.kids[q][a] = len(self.n)
                    self.kids.append({})
                    self.passed.append({})
                    self.n.append(0)
                    self.ends.append(0)
                q = self.kids[q][a]
                self.n[q] += 1
            self.ends[q] += 1

    @staticmethod
    def _differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        if not n1 or not n2:
            return False
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) > bound

    def compatible(self, r: int, b: int) -> bool:
        todo = [(r, b)]
        while todo:
            x, y = todo.pop()
            if self._differ(self.ends[x], self.n[x], self.ends[y], self.n[y]):
                return False
            for a in self.passed[x].keys() | self.passed[y].keys():
                if self._differ(self.passed[x].get(a, 0), self.n[x], self.passed[y].get(a, 0), self.n[y]):
                    return False
            todo += [(self.kids[x][a], self.kids[y][a]) for a in self.kids[y] if a in self.kids[x]]
        return True

    def fold(self, r: int, b: int) -> None:
        todo = [(r, b)]
        while todo:
            x, y = todo.pop()
            self.n[x] += self.n[y]
            self.ends[x] += self.ends[y]
            for a, c in self.passed[y].items():
                self.passed[x][a] = self.passed[x].get(a, 0) + c
            for a, k in self.kids[y].items():
                if a in self.kids[x]:
                    todo.append((self.kids[x][a], k))
                else:
                    self.kids[x][a] = k

    def merged(self) -> Automaton:
        red, seen = [0], {0}
        blue = [(0, a) for a in sorted(self.kids[0])]
        while blue:
            q, a = blue.pop(0)
            b = self.kids[q][a]
            if b in seen:
                continue
            for r in red:
                if self.compatible(r, b):
                    self.kids[q][a] = r
                    self.fold(r, b)
                    break
            else:
                red.append(b)
                seen.add(b)
            blue = [(x, s) for x in red for s in sorted(self.kids[x]) if self.kids[x][s] not in seen]
        number = {q: i for i, q in enumerate(red)}
        out = Automaton()
        for q in red:
            total = self.ends[q] + sum(self.passed[q].values())
            out.next.append({a: (number[self.kids[q][a]], math.log2(max(c, 0.5) / total)) for a, c in self.passed[q].items()})
            out.end.append(math.log2(self.ends[q] / total) if self.ends[q] else math.log2(FLOOR))
        return out


def infer(samples: Iterable[str]) -> Automaton:
    """The automaton of a format's labelled credentials."""
    return _Tree(map(symbols, samples)).merged()


def _made(rng: random.Random, head: str, alphabet: str, low: int, high: int) -> str:
    return head + "".join(rng.choices(alphabet, k=rng.randint(low, high)))


_ALNUM = string.ascii_letters + string.digits
_HEXES = "0123456789abcdef"
_URLSAFE = _ALNUM + "_-"
#: Public formats of credentials as (heads, alphabet, least and most characters behind the head, tail).
_SIMPLE = {
    "hex": (("",), _HEXES, 32, 64, ""),
    "access": (("AKIA", "ASIA"), string.ascii_uppercase + "234567", 16, 16, ""),
    "prefixed": (("ghp_", "gho_", "ghs_", "ghr_", "ghu_"), _ALNUM, 36, 36, ""),
    "personal": (("github_pat_",), _ALNUM + "_", 82, 82, ""),
    "project": (("glpat-", "gldt-", "glrt-"), _URLSAFE, 20, 20, ""),
    "live": (("sk_live_", "rk_live_", "sk_test_"), _ALNUM, 24, 32, ""),
    "model": (("sk-",), _ALNUM, 48, 48, ""),
    "hub": (("hf_",), string.ascii_letters, 34, 34, ""),
    "maps": (("AIza",), _URLSAFE, 35, 35, ""),
    "package": (("npm_",), _ALNUM, 36, 36, ""),
    "index": (("pypi-AgEIcHlwaS5vcmc",), _URLSAFE, 70, 110, ""),
    "shop": (("shpat_", "shpss_", "shpca_"), _HEXES, 32, 32, ""),
    "cloud": (("dop_v1_", "doo_v1_"), _HEXES, 64, 64, ""),
    "phone": (("SK", "AC"), _HEXES, 32, 32, ""),
    "post": (("key-",), _HEXES, 32, 32, ""),
    "base64": (("",), _ALNUM + "+/", 39, 43, "="),
    "storage": (("",), _ALNUM + "+/", 86, 86, "=="),
}
_FORMATS = {k: lambda r, v=v: _made(r, r.choice(v[0]), v[1], v[2], v[3]) + v[4] for k, v in _SIMPLE.items()} | {
    "chat": lambda r: "-".join((r.choice(("xoxb", "xoxp", "xoxa")), _made(r, "", string.digits, 10, 12), _made(r, "", _ALNUM, 24, 24))),
    "mail": lambda r: ".".join(("SG", _made(r, "", _URLSAFE, 22, 22), _made(r, "", _URLSAFE, 43, 43))),
    "signed": lambda r: ".".join(("eyJ" + _made(r, "", _ALNUM, 17, 60), "eyJ" + _made(r, "", _ALNUM, 40, 600), _made(r, "", _URLSAFE, 43, 43))),
}


def labelled(seed: int = 7, each: int = LEARN + CALIBRATE) -> dict[str, list[str]]:
    """Made-up credentials of public formats, labelled by format; the same list each time."""
    rng = random.Random(seed)
    return {k: [f(rng) for _ in range(each)] for k, f in _FORMATS.items()}


def ordinary(seed: int = 11, each: int = 400) -> list[str]:
    """Long runs of credential characters that are none: words, numbers, versions, dates, paths, identifiers."""
    rng = random.Random(seed)
    word = lambda: _made(rng, "", "etaoinshrdlucmfwypvbgk", 2, 9)
    kinds = (
        lambda: _made(rng, "", "etaoinshrdlucmfwypvbgk", 16, 34),
        lambda: _made(rng, "", string.digits, 16, 24),
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(5)),
        lambda: "/".join(word() for _ in range(rng.randint(3, 6))),
        lambda: "_".join(word() for _ in range(rng.randint(3, 5))),
        lambda: "-".join(word() for _ in range(rng.randint(3, 6))),
        lambda: ".".join(word() for _ in range(rng.randint(3, 5))),
        lambda: "".join(word().capitalize() for _ in range(rng.randint(3, 5))),
        lambda: "_".join(word().upper() for _ in range(rng.randint(3, 5))),
        lambda: f"{word()}.{rng.randint(1, 99)}.{word()}{rng.randint(1, 9)}.{word()}",
        lambda: f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}",
        lambda: rng.choice("=-._") * rng.randint(16, 60),
        lambda: "/".join(word() + str(rng.randint(0, 9999)) * (rng.random() < 0.5) for _ in range(rng.randint(3, 30))),
        lambda: "/".join(rng.choice((word(), word().capitalize() + word(), str(rng.randint(0, 99999)), f"{word()}_{word()}", f"{word()}-{rng.randint(1, 99)}")) for _ in range(rng.randint(3, 20))),
        lambda: "www." + word() + ".com/" + "/".join(word() + "-" + word() for _ in range(rng.randint(2, 8))) + ".html",
        lambda: "=".join((word() + rng.choice(("", "_id", str(rng.randint(1, 9)))), word() + word() + str(rng.randint(0, 99)))) + "." + word(),
        lambda: f"{word()}_{rng.randint(1990, 2030)}-{rng.randint(10, 12)}.{word()}.v{rng.randint(1, 30)}.{word()}",
        lambda: "-".join(_made(rng, "", _HEXES, n, n) for n in (8, 4, 4, 4, 12)),
        lambda: "".join(word().capitalize() + str(rng.randint(0, 99)) * (rng.random() < 0.3) for _ in range(rng.randint(4, 9))),
    )
    return [k() for k in kinds for _ in range(each)]


@dataclass
class SecretModel:
    """Automata with the least bits a symbol and the lengths that each accepts, and that of ordinary text."""

    formats: list[tuple[Automaton, float, int, int]]
    background: Automaton

    @property
    def shortest(self) -> int:
        return min((f[2] for f in self.formats), default=1)

    @property
    def longest(self) -> int:
        return max((f[3] for f in self.formats), default=0)

    def gains(self, run: str, ends: list[int]) -> list[float]:
        """For each prefix of ``run`` of a length in ``ends`` (ascending) the bits by which a format that accepts it beats ordinary text, or -inf.

        A format accepts what has the length of its own credentials, is as likely as
        they are, and beats ordinary text by MARGIN a symbol.
        """
        seq = symbols(run[: ends[-1]])
        base: list[float] | None = None
        found = [-math.inf] * len(ends)
        for a, least, lo, hi in self.formats:
            first, last = bisect_left(ends, lo), bisect_right(ends, hi)
            if first >= last:
                continue
            for i, bits in enumerate(a.bits_at(seq, ends[first:last], least * (hi + 1)), first):
                if bits >= least * (ends[i] + 1):
                    base = base or self.background.bits_at(seq, ends)
                    gain = bits - base[i]
                    if gain >= MARGIN * (ends[i] + 1):
                        found[i] = max(found[i], gain)
        return found

    def is_secret(self, run: str) -> bool:
        """Whether a format's likelihood is as high as those of its own credentials, and beats ordinary text."""
        return self.gains(run, [len(run)])[0] > 0


def learn(credentials: dict[str, list[str]] | None = None, common: list[str] | None = None) -> SecretModel:
    """Automata from labelled credentials; a format's threshold is the least likelihood of those it did not learn from."""
    formats = []
    for texts in (credentials or labelled()).values():
        cut = max(1, len(texts) * LEARN // (LEARN + CALIBRATE))
        auto = infer(texts[:cut])
        held = [auto.bits(s) / (len(s) + 1) for s in map(symbols, texts[cut:] or texts)]
        sizes = list(map(len, texts))
        formats.append((auto, min(held), math.ceil(min(sizes) * (1 - SLACK)), math.floor(max(sizes) * (1 + SLACK))))
    return SecretModel(formats, infer(common or ordinary()))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the fixed patterns as (start, end, kind), leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for r in _RUN.finditer(text):
        lo, s = r.start(), r[0]
        if "AKIA" in s:
            found += [(lo + m.start(), lo + m.end(), "access") for m in _ACCESS.finditer(s)]
        found += [(lo + m.start(), lo + m.end(), "hex") for m in _HEX.finditer(s)]
    return found


def candidates(run: str, shortest: int, longest: int) -> Iterator[tuple[int, list[int]]]:
    """Where a credential may lie in a run: starts, each with its ends (ascending).

    Credentials start at the run's start or behind '=', '/' or '.', and end before
    one, behind '=' signs (padding) or at the run's end; their lengths are bounded
    by those of the formats.
    """
    ends = [m.end() for m in _END.finditer(run)]
    for m in _START.finditer(run):
        lo = m.start(1)
        if some := ends[bisect_left(ends, lo + shortest) : bisect_right(ends, lo + longest)]:
            yield lo, some


def grammar_spans(run: str, model: SecretModel) -> list[tuple[int, int]]:
    """The candidates of a run that formats accept: the one that beats ordinary text by most, then others apart from it.

    The more candidates a run has, the more one must gain, by the logarithm of their number.
    """
    some = list(candidates(run, model.shortest, model.longest))
    least = math.log2(1 + sum(len(ends) for _, ends in some))
    good = []
    for lo, ends in some:
        gains = model.gains(run[lo : ends[-1]], [e - lo for e in ends])
        good += [(-g, lo, e) for g, e in zip(gains, ends, strict=True) if g >= least]
    found: list[tuple[int, int]] = []
    for _, lo, hi in sorted(good):
        at = bisect_left(found, (lo, hi))
        if (at == 0 or found[at - 1][1] <= lo) and (at == len(found) or found[at][0] >= hi):
            found.insert(at, (lo, hi))
    return found


def spans(text: str | None, model: SecretModel | None) -> list[tuple[int, int, str]]:
    """All spans by start, then kind: those of the fixed patterns, and what the model finds, wherever it lies."""
    text = text or ""
    found = base_spans(text)
    if model is not None:
        for r in re.finditer(r"[A-Za-z0-9+/_.=-]{%d,}" % model.shortest, text):
            found += [(r.start() + lo, r.start() + hi, "grammar") for lo, hi in grammar_spans(r[0], model)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame, model: SecretModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans``, an array of (kind, start, end).

    Starts and ends are code points, the end exclusive. A null or empty text has
    no spans. Null and repeated ids stay as they are. Other columns are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in spans(t.as_py(), model)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")
