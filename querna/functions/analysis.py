"""Tokenizers, token filters and analyzers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from querna import constants as K
from querna.functions.porter import stem_tokens

Expr = Callable[[Column], Column]
_SPACE = r"[ \t\n\r\f\x0B]+"


def _full(c: Column) -> Column:
    return F.filter(c, lambda x: x != "")


def standard_tokens(c: Column, lowercase: bool = True, special: str | None = None, unicode: bool = False, stop_words: Iterable[str] | None = None) -> Column:
    """Words of letters, digits and underscores; anything else, or what ``special`` matches, separates."""
    low = F.lower(c) if lowercase else c
    if special is None:  # one pass of the regex machine instead of two and a filter
        t = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+" if unicode else "[A-Za-z0-9_]+"), F.lit(0))
    else:
        t = _full(F.split(F.regexp_replace(low, special, " "), _SPACE))
    return stop_filter(stop_words)(t) if stop_words else t


def whitespace_tokens(c: Column, lowercase: bool = False) -> Column:
    return _full(F.split(F.lower(c) if lowercase else c, _SPACE))


def ngram_tokens(c: Column, low: int = 2, high: int = 3) -> Column:
    """Character n-grams, by place and then by length."""
    at = F.when(F.length(c) >= low, F.sequence(F.lit(1), F.length(c) - low + 1)).otherwise(F.array().cast("array<int>"))
    one = lambda i: F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(c) - i + 1)), lambda n: F.substring(c, i, n))
    return F.flatten(F.transform(at, one))


def keyword_token(c: Column) -> Column:
    return F.array(F.lower(F.trim(c)))


def lowercase_filter(t: Column) -> Column:
    return F.transform(t, F.lower)


def stop_filter(words: Iterable[str] | None = None) -> Expr:
    words = sorted(K.STOP_WORDS if words is None else words)
    return lambda t: F.filter(t, lambda x: ~x.isin(words))


TOKENIZERS: dict[str, Expr] = {"standard": standard_tokens, "whitespace": whitespace_tokens, "ngram": ngram_tokens}
FILTERS: dict[str, Expr] = {"lowercase": lowercase_filter, "stopword": stop_filter(), "stemming": stem_tokens}


def create_tokenizer(kind: str, **options) -> Expr:
    if kind not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {kind!r}")
    return lambda c: TOKENIZERS[kind](c, **options)


def create_filter(kind: str) -> Expr:
    if kind not in FILTERS:
        raise ValueError(f"unknown token filter {kind!r}")
    return FILTERS[kind]


def custom_analyzer(config: dict) -> Expr:
    """{tokenizer: {type, ...options} or its name, filters: [name or {type}]}."""
    if "tokenizer" not in config:
        raise ValueError("an analyzer needs a tokenizer")
    spec = config["tokenizer"]
    spec = {"type": spec} if isinstance(spec, str) else dict(spec)
    tokenize = create_tokenizer(spec.pop("type"), **spec)
    filters = [create_filter(f if isinstance(f, str) else f["type"]) for f in config.get("filters", [])]
    return lambda c: reduce(lambda t, f: f(t), filters, tokenize(c))


class AnalyzerRegistry:
    def __init__(self) -> None:
        self._held: dict[str, Expr] = {}
        self.register("standard", lambda c: FILTERS["stopword"](standard_tokens(c)))
        self.register("standard25", lambda c: stop_filter(K.STOP_WORDS_SHORT)(standard_tokens(c)))
        self.register("keyword", keyword_token)
        self.register("lowercase", lambda c: whitespace_tokens(F.trim(c), lowercase=True))
        self.register("whitespace", whitespace_tokens)
        self.register("simple", standard_tokens)

    def register(self, name: str, analyzer: Expr) -> None:
        if name in self._held:
            raise ValueError(f"analyzer {name!r} exists")
        self._held[name] = analyzer

    def create(self, name: str, config: dict) -> Expr:
        self.register(name, custom_analyzer(config))
        return self._held[name]

    def get(self, name: str) -> Expr:
        if name not in self._held:
            raise ValueError(f"unknown analyzer {name!r}")
        return self._held[name]

    def has(self, name: str) -> bool:
        return name in self._held

    def remove(self, name: str) -> bool:
        return self._held.pop(name, None) is not None


def field_text(c: Column, kind: str) -> Column:
    """A field's value as text, by its Spark type."""
    if kind.startswith("array"):
        return F.array_join(c.cast("array<string>"), " ")
    if kind.startswith(("struct", "map")):
        return F.to_json(c)
    if kind.startswith(("timestamp", "date")):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.trim(c.cast("string"))


def words_longer(c: Column, least: int = 3) -> Column:
    """Words cut at white space, &, dots and hyphens, of ``least`` characters, alphanumeric."""
    return F.filter(F.split(F.lower(c), r"[ \t\n\r&.-]+"), lambda x: (F.length(x) >= least) & x.rlike("^[a-z0-9]+$"))


def term_count(c: Column, term: str) -> Column:
    """Whole-word occurrences, case aside."""
    import re

    bare = term.replace("*", "").replace("?", "")
    return F.regexp_count(c, F.lit(rf"(?i)\b{re.escape(bare)}\b"))


def term_count_split(c: Column, term: str) -> Column:
    """Words between runs of other characters than [A-Za-z0-9_] that equal the term, case aside (TXT-32)."""
    return F.size(F.filter(F.split(F.lower(c), "[^a-z0-9_]+"), lambda x: x == term.lower()))


def dotted(content: Column, path: str) -> Column:
    """A value of JSON text by its dotted path, as text; null where the path leads nowhere (TXT-18)."""
    return F.get_json_object(content, "$." + path)


def clean_token(t: Column) -> Column:
    """Lower case, [a-z0-9_-] alone, no edge hyphens; null where shorter than 2 or digits alone."""
    x = F.regexp_replace(F.regexp_replace(F.lower(t), r"[^a-z0-9_-]", ""), r"^-+|-+$", "")
    return F.when((F.length(x) >= 2) & ~x.rlike(r"^[0-9]+$"), x)


def weight_label(w: Column) -> Column:
    out = F.lit("D")
    for bound, label in reversed(K.LABELS):
        out = F.when(w >= bound, label).otherwise(out)
    return out


def infer_weight(field: str) -> float:
    """Exact names first, then names that hold one, separators aside."""
    bare = field.lower()
    for w, names in K.PATTERN_WEIGHTS:
        if bare in names.split():
            return w
    flat = bare.replace("_", "").replace("-", "")
    for w, names in K.PATTERN_WEIGHTS:
        if any(n.replace("_", "") in flat for n in names.split()):
            return w
    return 1.0
