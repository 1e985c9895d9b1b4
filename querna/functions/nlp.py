"""Query understanding: over a column of a query log, or one query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querna import constants as K
from querna.functions.geo import parse_location


def intent(q: Column) -> Column:
    low = F.lower(q)
    has = lambda words: F.array_contains(F.array(*[low.contains(w) for w in words]), True)
    return F.when(has(K.TRANSACTIONAL), "transactional").when(has(K.NAVIGATIONAL), "navigational").otherwise("informational")


def _strings(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def words(q: Column) -> Column:
    return F.split(F.lower(F.trim(q)), r"\s+")


def _forms(word: str) -> list[str]:
    """A word, its naive plural and its naive singular."""
    return [word, word + "s", word + "es", *([word[:-1]] if word.endswith("s") and len(word) > 3 else [])]


def business_types(q: Column) -> Column:
    """Types of which the name or a word that stands for it is among the query's words."""
    ws = words(q)
    hits = [F.when(F.arrays_overlap(ws, _strings(sorted({f for w in [k, *v] for f in _forms(w)}))), F.lit(k)) for k, v in sorted(K.BUSINESS_TYPES.items())]
    return F.array_compact(F.array(*hits))


def services(q: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.lower(q).contains(s), F.lit(s)) for s in K.SERVICES]))


def modifiers(q: Column) -> Column:
    return F.array_intersect(_strings(K.MODIFIERS), words(q))


def locations(q: Column) -> Column:
    low = F.lower(q)
    return F.array_compact(F.array(*[F.when(low.contains(n), F.lit(n)) for n in sorted(K.GAZETTEER)]))


def synonyms(extra: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """The synonym table, with further words of a caller's own."""
    out = {k: list(v) for k, v in K.SYNONYMS.items()}
    for k, v in (extra or {}).items():
        out[k] = list(dict.fromkeys([*out.get(k, []), *v]))
    return out


def expansion(q: Column, extra: dict[str, list[str]] | None = None) -> Column:
    """The query's words, two synonyms of its first type and one of its first service, each once."""
    syn = F.create_map(*[x for k, v in sorted(synonyms(extra).items()) for x in (F.lit(k), _strings(v))])
    none = F.array().cast("array<string>")
    two = F.slice(F.coalesce(F.try_element_at(syn, F.get(business_types(q), 0)), none), 1, 2)
    one = F.slice(F.coalesce(F.try_element_at(syn, F.get(services(q), 0)), none), 1, 1)
    return F.array_distinct(F.concat(words(q), two, one))


def query_type(q: Column, has_location: Column) -> Column:
    low = F.lower(q)
    business = ["best", "top", "popular", "luxury", "cheap", "expensive", "delivery", "takeout", "appointment", "booking", "24/7", "pool"]
    return (
        F.when(has_location, "location_based").when(F.array_contains(F.array(*[low.contains(w) for w in business]), True), "business_type")
        .when((F.length(q) > 30) & (F.size(F.split(q, " ")) > 6), "semantic").otherwise("default")
    )


def understand(q: Column) -> Column:
    """All of the above as one struct."""
    return F.struct(intent(q).alias("intent"), business_types(q).alias("business_types"), locations(q).alias("locations"), services(q).alias("services"), modifiers(q).alias("modifiers"), expansion(q).alias("expansion"))


def simplified(business: list[str], query: str) -> str:
    """A broader query to fall back on: the first type, and the place."""
    at = parse_location(query)
    return (business[0] if business else query) + (f" in {at['name']}" if at and "name" in at else "")
