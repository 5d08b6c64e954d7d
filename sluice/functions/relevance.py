"""Full-text predicates as column expressions, without an index and without user-defined functions.

A text column is analysed: lower-cased and split at all but letters and digits. A
keyword column is one term, as it stands. Options that only change a score are
read and have no effect on a filter.
"""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OPTIONS = {
    "match": {"analyzer", "auto_generate_synonyms_phrase_query", "boost", "fuzziness", "fuzzy_rewrite", "fuzzy_transpositions", "lenient", "max_expansions", "minimum_should_match", "operator", "prefix_length", "zero_terms_query"},
    "match_phrase": {"analyzer", "boost", "slop", "zero_terms_query"},
    "match_phrase_prefix": {"analyzer", "boost", "max_expansions", "slop", "zero_terms_query"},
    "match_bool_prefix": {"analyzer", "boost", "fuzziness", "fuzzy_rewrite", "fuzzy_transpositions", "max_expansions", "minimum_should_match", "operator", "prefix_length"},
}
_MANY = {"analyze_wildcard", "analyzer", "boost", "default_field", "default_operator", "flags", "fuzziness", "fuzzy_max_expansions", "fuzzy_prefix_length", "fuzzy_rewrite", "fuzzy_transpositions", "lenient", "max_expansions", "minimum_should_match", "operator", "phrase_slop", "quote_field_suffix", "slop", "tie_breaker", "time_zone", "type", "auto_generate_synonyms_phrase_query", "cutoff_frequency", "zero_terms_query", "prefix_length", "rewrite", "allow_leading_wildcard", "enable_position_increments", "escape", "max_determinized_states", "quote_analyzer"}
for _n in ("multi_match", "simple_query_string", "query_string"):
    OPTIONS[_n] = _MANY


@dataclass(frozen=True)
class TextField:
    column: Column
    kind: str  # text or keyword

    @property
    def terms(self) -> Column:
        if self.kind == "keyword":
            return F.array(self.column.cast("string"))
        return F.filter(F.split(F.lower(self.column), r"[^\p{L}\p{N}]+"), lambda t: t != "")

    def analyse(self, query: str) -> list[str]:
        return [query] if self.kind == "keyword" else [t for t in re.split(r"[\W_]+", query.lower()) if t]


def _any(parts: list[Column]) -> Column:
    return functools.reduce(operator.or_, parts) if parts else F.lit(False)


def _all(parts: list[Column]) -> Column:
    return functools.reduce(operator.and_, parts) if parts else F.lit(False)


def _sure(c: Column) -> Column:
    """A missing field does not match."""
    return F.coalesce(c, F.lit(False))


def _at_least(text: str | None, n: int) -> int | None:
    """How many of ``n`` optional terms a minimum wants."""
    if text is None:
        return None
    text = str(text).strip()
    if text.endswith("%"):
        p = int(text[:-1])
        return max(0, n * p // 100 if p >= 0 else n + -(-n * p // 100))
    k = int(text)
    return max(0, k if k >= 0 else n + k)


def _fuzzy(term: str, options: dict) -> int:
    f = options.get("fuzziness")
    if f is None:
        return 0
    if str(f).upper().startswith("AUTO"):
        return 0 if len(term) < 3 else 1 if len(term) < 6 else 2
    return int(f)


def _has(field: TextField, term: str, options: dict) -> Column:
    edits = _fuzzy(term, options)
    if not edits:
        return F.array_contains(field.terms, term)
    head = term[: int(options.get("prefix_length", 0))]
    return F.exists(field.terms, lambda t: (F.levenshtein(t, F.lit(term)) <= edits) & t.startswith(head))


def match(field: TextField, query: str, options: dict) -> Column:
    """Any term, or all with operator=AND; ``minimum_should_match`` asks for so many."""
    terms = field.analyse(query)
    if not terms:
        return F.lit(str(options.get("zero_terms_query", "none")).lower() == "all")
    hits = [_has(field, t, options) for t in terms]
    if str(options.get("operator", "or")).lower() == "and":
        return _sure(_all(hits))
    need = _at_least(options.get("minimum_should_match"), len(hits))
    if need is not None and need > 1:
        return _sure(sum((h.cast("int") for h in hits[1:]), hits[0].cast("int")) >= need)
    if not any(_fuzzy(t, options) for t in terms):
        return _sure(F.arrays_overlap(field.terms, F.array(*map(F.lit, terms))))
    return _sure(_any(hits))


def match_phrase(field: TextField, query: str, options: dict, prefix: bool = False) -> Column:
    """Terms next to each other and in order; ``slop`` lets so many others stand between them."""
    terms = field.analyse(query)
    if not terms:
        return F.lit(str(options.get("zero_terms_query", "none")).lower() == "all")
    if field.kind == "keyword":
        return _sure(field.column.startswith(query) if prefix else field.column == query)
    slop, n = int(options.get("slop", 0)), len(terms)
    equal = lambda t, i: t.startswith(terms[i]) if prefix and i == n - 1 else t == terms[i]
    if n == 1:
        return _sure(F.exists(field.terms, lambda t: equal(t, 0)))
    if not slop and not prefix:
        # Padded with spaces, whole terms are found as a piece of text.
        return _sure(F.contains(F.concat(F.lit(" "), F.array_join(field.terms, " "), F.lit(" ")), F.lit(" " + " ".join(terms) + " ")))
    if not slop:
        return _sure(F.contains(F.concat(F.lit(" "), F.array_join(field.terms, " "), F.lit(" ")), F.lit(" " + " ".join(terms))))
    gap = rf"(?: \S+){{0,{slop}}} "
    body = gap.join(map(re.escape, terms))
    return _sure(F.concat(F.lit(" "), F.array_join(field.terms, " "), F.lit(" ")).rlike(f" {body}" + ("" if prefix else " ")))


def match_bool_prefix(field: TextField, query: str, options: dict) -> Column:
    """Any term, the last as a prefix."""
    terms = field.analyse(query)
    if not terms:
        return F.lit(False)
    hits = [_has(field, t, options) for t in terms[:-1]] + [F.exists(field.terms, lambda t: t.startswith(terms[-1]))]
    return _sure(_all(hits) if str(options.get("operator", "or")).lower() == "and" else _any(hits))


def multi_match(fields: list[TextField], query: str, options: dict) -> Column:
    kind = str(options.get("type", "best_fields")).lower()
    one = match_phrase if kind == "phrase" else functools.partial(match_phrase, prefix=True) if kind == "phrase_prefix" else match_bool_prefix if kind == "bool_prefix" else match
    return _any([one(f, query, options) for f in fields])


def _term(fields: list[TextField], text: str, options: dict) -> Column:
    """A word of a query string: with a star at its end a prefix, with others a pattern, with a tilde fuzzy."""
    if text == "*":
        return _any([f.column.isNotNull() for f in fields])
    if m := re.fullmatch(r"(.+)~(\d*)", text):
        return _any([match(f, m[1], options | {"fuzziness": m[2] or "AUTO"}) for f in fields])
    if "*" in text or "?" in text:
        out = []
        for f in fields:
            p = text if f.kind == "keyword" else text.lower()
            rx = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) + "$"
            out.append(_sure(F.exists(f.terms, _matcher(rx))))
        return _any(out)
    return _any([match(f, text, options) for f in fields])


def _matcher(rx: str):  # noqa: ANN202
    return lambda t: t.rlike(rx)


class _Strings:
    """Parser of query strings. The simple grammar has + | - " * ( ); the full one AND OR NOT, fields and ranges too."""

    def __init__(self, text: str, fields: list[TextField], options: dict, simple: bool, lookup):  # noqa: ANN001
        self.fields, self.options, self.simple, self.lookup = fields, options, simple, lookup
        self.all = str(options.get("default_operator", "or")).lower() == "and"
        words = r'"(?:[^"\\]|\\.)*"(?:~\d+)?|[()+|]|-(?=\S)|[^\s()"|+]+' if simple else r'[A-Za-z_@][\w.@]*:(?=\S)|"(?:[^"\\]|\\.)*"(?:~\d+)?|\[[^\]]*\]|\{[^}]*\}|&&|\|\||[()+!]|-(?=\S)|[^\s()":]+(?:\^[\d.]+)?'
        self.tokens, self.at = re.findall(words, text), 0

    def now(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Column:
        if not self.tokens:
            return F.lit(False)
        return self.either(self.fields)

    def either(self, fields: list[TextField]) -> Column:
        """Clauses of a level. Required ones all hold and forbidden ones none; of the optional ones, if nothing is required, one does."""
        groups: list[list[Column]] = [[]]
        must: list[Column] = []
        never: list[Column] = []
        while self.now() is not None and self.now() != ")":
            t = self.now()
            if t in ("OR", "||") and not self.simple or t == "|" and self.simple:
                self.take()
                groups.append([])
                continue
            if t in ("AND", "&&") and not self.simple or t == "+" and self.simple and groups[-1]:
                self.take()
                neg = self.negated()
                c = self.clause(fields)
                prior = groups[-1].pop() if groups[-1] else F.lit(True)
                groups[-1].append(prior & (~c if neg else c))
                continue
            if t == "+":
                self.take()
                if not self.simple:
                    must.append(self.clause(fields))
                continue
            if self.negated():
                c = self.clause(fields)
                if not self.simple:
                    never.append(c)
                    continue
                c = ~c
            else:
                c = self.clause(fields)
            if self.all and groups[-1]:
                groups[-1][-1] = groups[-1][-1] & c
            else:
                groups[-1].append(c)
        optional = [c for g in groups for c in g]
        out = _all(must) if must else _any(optional) if optional else F.lit(True)
        for c in never:
            out = out & ~c
        return out

    def negated(self) -> bool:
        if self.now() == "-" or not self.simple and self.now() in ("NOT", "!"):
            self.take()
            return True
        return False

    def clause(self, fields: list[TextField]) -> Column:
        t = self.now()
        if t is None or t == ")":
            return F.lit(False)
        t = self.take()
        if t == "(":
            out = self.either(fields)
            if self.now() == ")":
                self.take()
            return out
        if not self.simple and t.endswith(":") and len(t) > 1 and t[0] != '"':
            if t == "_exists_:":
                return self.lookup(self.take()).column.isNotNull()
            return self.clause([self.lookup(t[:-1])])
        if t.startswith('"'):
            m = re.fullmatch(r'"(.*)"(?:~(\d+))?', t, re.DOTALL)
            return _any([match_phrase(f, m[1].replace('\\"', '"'), self.options | ({"slop": m[2]} if m[2] else {})) for f in fields])
        if not self.simple and t[0] in "[{" and " TO " in t:
            low, high = re.fullmatch(r"[\[{]\s*(.*?)\s+TO\s+(.*?)\s*[\]}]", t).groups()
            out = []
            for f in fields:
                c = F.lit(True)
                if low != "*":
                    c = c & (f.column >= low if t[0] == "[" else f.column > low)
                if high != "*":
                    c = c & (f.column <= high if t[-1] == "]" else f.column < high)
                out.append(_sure(c))
            return _any(out)
        if not self.simple and (m := re.fullmatch(r"(>=|<=|>|<)(.+)", t)):
            op = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}[m[1]]
            return _any([_sure(op(f.column, m[2])) for f in fields])
        return _term(fields, re.sub(r"\^[\d.]+$", "", t).replace("\\", ""), self.options)


def query_string(fields: list[TextField], query: str, options: dict, lookup) -> Column:  # noqa: ANN001
    return _Strings(query, fields, options, False, lookup).whole()


def simple_query_string(fields: list[TextField], query: str, options: dict) -> Column:
    return _Strings(query, fields, options, True, None).whole()
