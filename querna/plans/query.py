"""Query AST and the parser of raw queries (strings and JSON-like dicts)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from querna import constants as K


@dataclass(frozen=True)
class Term:
    field: str
    value: str
    boost: float = 1.0
    fuzziness: int = 0  # edits that a word may be away


@dataclass(frozen=True)
class Phrase:
    field: str
    terms: tuple[str, ...]
    boost: float = 1.0


@dataclass(frozen=True)
class Wildcard:
    field: str
    pattern: str
    boost: float = 1.0

    @property
    def regex(self) -> str:
        """Anchored, case aside: * any run, ? one character."""
        return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in self.pattern) + "$"


@dataclass(frozen=True)
class Range:
    field: str
    bounds: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class MatchAll:
    boost: float = 1.0


@dataclass(frozen=True)
class Bool:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()


Query = Term | Phrase | Wildcard | Range | MatchAll | Bool


def normalize(s: str) -> str:
    return re.sub(r"\s+", " ", s.lower()).strip()


def normalize_live(s: str | None) -> str:
    """White space as one blank, wildcards and case kept; nothing asks for everything."""
    return re.sub(r"\s+", " ", s or "").strip() or "*"


def strip_boost(field: str) -> tuple[str, float]:
    name, _, boost = field.partition("^")
    return name, float(boost) if boost else 1.0


def phrases(s: str) -> tuple[list[str], str]:
    """The quoted phrases, blank ones dropped, and the rest."""
    return [p for p in re.findall(r'"([^"]*)"', s) if p.strip()], re.sub(r'"[^"]*"', " ", s)


def analyze(s: str) -> list[str]:
    return [w for w in re.sub(r"[^a-z0-9_\s]", " ", s.lower()).split() if w not in K.STOP_WORDS]


def parse_string(s: str, fields: list[str], operator: str = "or") -> Query:
    if not s.strip() or s.strip() == "*":
        return MatchAll()
    named = [strip_boost(f) for f in fields]
    if "*" in s or "?" in s:
        wild = tuple(Wildcard(f, normalize(s), b) for f, b in named)
        return wild[0] if len(wild) == 1 else Bool(should=wild)
    quoted, rest = phrases(normalize(s))
    parts = [tuple(Phrase(f, tuple(analyze(p)), b) for f, b in named) for p in quoted] + [tuple(Term(f, w, b) for f, b in named) for w in analyze(rest)]
    if operator == "and":
        return Bool(must=tuple(p[0] if len(p) == 1 else Bool(should=p) for p in parts))
    flat = tuple(x for p in parts for x in p)
    return flat[0] if len(flat) == 1 else Bool(should=flat)


def parse(raw: str | dict | None, fields: list[str] | None = None) -> Query:
    """match_all, match, term, wildcard, range and bool; several bare words of a match must all occur in its field."""
    fields = fields or ["name"]
    if raw is None or raw == {}:
        return MatchAll()
    if isinstance(raw, str):
        return parse_string(raw, fields)
    if "bool" in raw:
        each = lambda k: tuple(parse(x, fields) for x in _list(raw["bool"].get(k, [])))
        return Bool(each("must") + each("filter"), each("should"), each("must_not"))
    if "wildcard" in raw:
        w = raw["wildcard"]
        if isinstance(w, str):
            return parse_string(w, fields)
        if "value" in w:
            names = [w["field"]] if "field" in w else fields
            return _one([Wildcard(strip_boost(f)[0], normalize(w["value"]), float(w.get("boost", 1))) for f in names])
        (f, v), *_ = w.items()
        return Wildcard(f, normalize(v["value"] if isinstance(v, dict) else v), float(v.get("boost", 1)) if isinstance(v, dict) else 1.0)
    if "match" in raw:
        m = raw["match"]
        if isinstance(m, str):
            return parse_string(m, fields)
        text = m.get("value", m.get("query"))
        names = [m["field"]] if "field" in m else fields
        if text is None:
            (f, v), *_ = m.items()
            names, text = [f], (v.get("query", "") if isinstance(v, dict) else v)
            m = v if isinstance(v, dict) else {}
        text = str(text)
        if not text.strip() or text.strip() == "*" or "*" in text or "?" in text:
            return parse_string(text, names)
        if '"' in text:
            return parse_string(text, names[:1], "and")
        words, fuzz = analyze(text), m.get("fuzziness", 0)
        edits = lambda w: (0 if len(w) < 3 else 1 if len(w) < 6 else 2) if str(fuzz).lower() == "auto" else int(fuzz)
        if m.get("operator", "and") == "or":
            return _one([Term(f, w, b, edits(w)) for w in words for f, b in map(strip_boost, names)])
        f, b = strip_boost(names[0])
        return Term(f, words[0], b, edits(words[0])) if len(words) == 1 else Bool(must=tuple(Term(f, w, b, edits(w)) for w in words))
    if "term" in raw:
        (f, v), *_ = raw["term"].items()
        if "field" in raw["term"]:
            f, v = raw["term"]["field"], raw["term"]["value"]
        v = v["value"] if isinstance(v, dict) else v
        return parse_string(str(v), [f])
    if "range" in raw:
        r = raw["range"]
        if "field" in r:
            return Range(r["field"], tuple((k, v) for k, v in r.items() if k != "field"))
        ranges = tuple(Range(f, tuple(v.items())) for f, v in r.items())
        return ranges[0] if len(ranges) == 1 else Bool(must=ranges)
    if "match_all" in raw:
        return MatchAll(float((raw["match_all"] or {}).get("boost", 1)))
    return MatchAll()


def _one(parts: list) -> Query:
    return parts[0] if len(parts) == 1 else Bool(should=tuple(parts))


def _list(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def text_of(raw: str | dict) -> str:
    """The words of a query, for logs and correction."""
    if isinstance(raw, str):
        return raw
    if "bool" in raw:
        return " ".join(t for k in ("must", "should") for x in _list(raw["bool"].get(k, [])) if (t := text_of(x)))
    for kind in ("match", "wildcard", "term"):
        if kind in raw:
            v = raw[kind]
            if isinstance(v, dict):
                v = v.get("value", v.get("query", next(iter(v.values()), "")))
            return str(v.get("value", v.get("query", "")) if isinstance(v, dict) else v)
    return "*" if "match_all" in raw else ""


def is_simple(text: str) -> bool:
    return len(text) < 50 and len(text.split()) <= 3 and not re.search(r"[^\w\s]", text)


def page(size: int | None = None, start: int | None = None) -> tuple[int, int]:
    return min(K.MOST_PAGE_SIZE, max(0, K.PAGE_SIZE if size is None else size)), max(0, start or 0)
