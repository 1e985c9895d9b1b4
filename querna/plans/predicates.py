"""From AST and filters to Column predicates and scores.  Nulls keep SQL's three-valued logic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from querna import constants as K
from querna.functions.analysis import standard_tokens
from querna.plans import query as Q

_OPS = {"gte": "__ge__", "gt": "__gt__", "lte": "__le__", "lt": "__lt__", "eq": "__eq__"}


def visible(strict: bool = True) -> Column:
    """Active, verified and not blocked; without strict, unknown flags pass."""
    on = lambda c, miss: F.col(c) if strict else F.coalesce(F.col(c), F.lit(miss))
    return on("is_active", True) & on("is_verified", True) & ~on("is_blocked", False)


def _field(name: str) -> Column:
    return F.col(name.removesuffix(".keyword"))


def _escape(v: str) -> str:
    return v.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def term_condition(field: str, value, arrays: frozenset[str] = frozenset()) -> Column:
    """Flags pass nulls; long-text fields contain the value, case aside; arrays hold it; others equal it as text."""
    values = value if isinstance(value, (list, tuple)) else [value]
    name = field.removesuffix(".keyword")
    if name in K.FLAGS and isinstance(value, bool):
        return (_field(name) == value) | _field(name).isNull()
    if name in arrays:
        return F.arrays_overlap(_field(name).cast("array<string>"), F.array(*[F.lit(_text(v)) for v in values]))
    if name in K.LIKE_FIELDS and not field.endswith(".keyword"):
        return reduce(lambda a, b: a | b, [_field(name).cast("string").ilike(f"%{_escape(_text(v))}%") for v in values])
    return reduce(lambda a, b: a | b, [_field(name).cast("string") == _text(v) for v in values])


def _text(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def range_condition(field: str, bounds: dict) -> Column:
    """A numeric bound compares as a number, any other as text; unknown operators mean equality."""
    out = []
    for op, v in bounds.items():
        number = isinstance(v, (int, float)) and not isinstance(v, bool)
        c = _field(field).try_cast("double") if number else _field(field).cast("string")
        out.append(getattr(c, _OPS.get(op, "__eq__"))(F.lit(float(v) if number else str(v))))
    return reduce(lambda a, b: a & b, out)


def filter_condition(f: dict, arrays: frozenset[str] = frozenset(), top: bool = True) -> Column:
    """term, range, exists-free bool filters, nested at will; an unknown kind raises at the top and passes inside."""
    if "bool" in f:
        b = f["bool"]
        each = lambda k: [filter_condition(x, arrays, False) for x in Q._list(b.get(k, []))]
        parts = each("must") + each("filter")
        if b.get("should"):
            parts.append(reduce(lambda x, y: x | y, each("should")))
        parts += [~c for c in each("must_not")]
        return reduce(lambda x, y: x & y, parts, F.lit(True))
    if "term" in f or "terms" in f:
        t = f.get("term", f.get("terms"))
        if "field" in t:
            return term_condition(t["field"], t["value"], arrays)
        return reduce(lambda x, y: x & y, [term_condition(k, v, arrays) for k, v in t.items()])
    if "range" in f:
        r = f["range"]
        if "field" in r:
            return range_condition(r["field"], {k: v for k, v in r.items() if k != "field"})
        return reduce(lambda x, y: x & y, [range_condition(k, v) for k, v in r.items()])
    if top:
        raise ValueError(f"unknown filter: {sorted(f)}")
    return F.lit(True)


def tokens_of(field: str) -> Column:
    return standard_tokens(F.coalesce(F.col(field).cast("string"), F.lit("")))


def predicate(q: Q.Query) -> Column:
    """Membership of a document, on its own text columns."""
    if isinstance(q, Q.MatchAll):
        return F.lit(True)
    if isinstance(q, Q.Term):
        if q.fuzziness:  # a bound lets the distance stop early
            return F.exists(tokens_of(q.field), lambda x: F.levenshtein(x, F.lit(q.value), q.fuzziness) >= 0)
        return F.array_contains(tokens_of(q.field), q.value)
    if isinstance(q, Q.Phrase):
        if not q.terms:
            return F.lit(False)
        t, n = tokens_of(q.field), len(q.terms)
        at = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.exists(at, lambda i: F.slice(t, i, n) == F.array(*[F.lit(w) for w in q.terms]))
    if isinstance(q, Q.Wildcard):
        return F.col(q.field).cast("string").rlike(q.regex)
    if isinstance(q, Q.Range):
        return range_condition(q.field, dict(q.bounds))
    parts = [predicate(x) for x in q.must]
    if q.should and not q.must:
        parts.append(reduce(lambda a, b: a | b, [predicate(x) for x in q.should]))
    if not q.must and not q.should and not q.must_not:
        return F.lit(False)
    parts += [~predicate(x) for x in q.must_not]
    return reduce(lambda a, b: a & b, parts)


def boost_score(q: Q.Query) -> Column:
    """The summed boosts of the clauses that match."""
    if isinstance(q, Q.Bool):
        return reduce(lambda a, b: a + b, [boost_score(x) for x in q.must + q.should], F.lit(0.0))
    return F.when(predicate(q), float(getattr(q, "boost", 1.0))).otherwise(0.0)


def base_rank(name: Column, query: str) -> Column:
    """Exact name 1000, prefix 500, else 100."""
    q = query.lower().strip()
    return F.when(F.lower(name) == q, 1000.0).when(F.lower(name).startswith(q), 500.0).otherwise(100.0)


def contains_rank(name: Column, category: Column, query: str) -> Column:
    q, n = query.lower().strip(), F.lower(name)
    return F.when(n == q, 1.0).when(n.startswith(q), 0.8).when(n.contains(q), 0.6).when(F.lower(category).contains(q), 0.4)


def sort_columns(spec: str | None, key: str = "document_id") -> list[Column]:
    """field:asc,field:desc; nulls last; the id breaks ties."""
    out = []
    for part in filter(None, (spec or "").split(",")):
        f, _, d = part.strip().partition(":")
        c = F.col(f.removesuffix(".keyword"))
        out.append(c.desc_nulls_last() if d.lower() == "desc" else c.asc_nulls_last())
    return [*out, F.asc(key)]


def highlight(c: Column, terms: list[str]) -> Column:
    import re

    return F.regexp_replace(c, rf"(?i)\b({'|'.join(re.escape(t) for t in terms)})\b", "<em>$1</em>")


def highlight_fragments(c: Column, terms: list[str], around: int = 40) -> Column:
    """The matches with ``around`` characters of their line on either side, words of the query marked: one string a fragment."""
    import re

    words = "|".join(re.escape(t) for t in terms)
    found = F.regexp_extract_all(c, F.lit(rf"(?i)[^\n]{{0,{around}}}\b(?:{words})\b[^\n]{{0,{around}}}"), F.lit(0))
    return F.transform(found, lambda x: highlight(x, terms))


def trigram_matches(query: str, fields: list[str]) -> Column:
    """Some field is like the query by trigrams, wildcards aside (FLT-14)."""
    from querna.functions import fuzzy

    bare = query.replace("*", "").replace("?", "")
    return reduce(lambda a, b: a | b, [fuzzy.similarity(F.lit(bare), F.coalesce(F.col(f), F.lit(""))) >= K.TRIGRAM_THRESHOLD for f in fields])
