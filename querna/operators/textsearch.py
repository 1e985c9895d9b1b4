"""Full-text predicates over several weighted fields, with their ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querna.operators import stored
from querna.plans import predicates as P
from querna.plans.query import analyze


def tokens(fields: list[str]) -> Column:
    return F.flatten(F.array(*[P.tokens_of(f) for f in fields]))


def all_terms(fields: list[str], text: str) -> Column:
    """Every word of the text in some field; a text without words matches nothing."""
    t = tokens(fields)
    return reduce(lambda a, b: a & b, [F.array_contains(t, w) for w in analyze(text)]) if analyze(text) else F.lit(False)


def any_terms(fields: list[str], text: str) -> Column:
    ws = analyze(text)
    return F.arrays_overlap(tokens(fields), F.array(*[F.lit(w) for w in ws])) if ws else F.lit(False)


def all_or_any(fields: list[str], text: str) -> Column:
    """(a and b) or (a or b): what any admits, all lifts."""
    return all_terms(fields, text) | any_terms(fields, text)


def prefix_term(fields: list[str], prefix: str) -> Column:
    p = prefix.lower().strip()
    return F.exists(tokens(fields), lambda x: x.startswith(p))


def density(fields: list[str], text: str, every: bool) -> Column:
    """Cover density of the text's words over the labelled fields: of all of them, or of any."""
    ws = list(dict.fromkeys(analyze(text)))
    if not ws:
        return F.lit(0.0)
    e = stored.entries([(f, P.tokens_of(f)) for f in fields], ws)
    return stored.cover_rank(e, len(ws)) if every else stored.any_rank(e)


def prefix_rank(fields: list[str], prefix: str) -> Column:
    """The label weights of all words that begin with the prefix."""
    p = prefix.lower().strip()
    return reduce(lambda a, b: a + b, [F.size(F.filter(P.tokens_of(f), lambda x: x.startswith(p))) * stored.label_weight(f) for f in fields])


def prefix_or_text(docs: DataFrame, q: str, name: Column, fields: list[str]) -> DataFrame:
    """Names that begin with the text, or documents that hold all its words; exact 1000, prefix 500, else 100."""
    return docs.where(F.lower(name).startswith(q.lower().strip()) | all_terms(fields, q)).withColumn("score", P.base_rank(name, q))


def boosted(docs: DataFrame, q: str, name: Column, fields: list[str]) -> DataFrame:
    """Exact 1000, prefix 500, else the cover density of all words."""
    low = q.lower().strip()
    s = F.when(F.lower(name) == low, 1000.0).when(F.lower(name).startswith(low), 500.0).otherwise(density(fields, q, True))
    return docs.where(all_terms(fields, q) | F.lower(name).startswith(low)).withColumn("score", s)


def ranked_any(docs: DataFrame, q: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Documents with any word, by cover density; the total apart, so that hits needn't meet in one partition."""
    hit = docs.where(any_terms(fields, q)).withColumn("score", density(fields, q, False))
    return hit, hit.agg(F.count("*").alias("total"))


def constant_fallback(docs: DataFrame, q: str, name: Column, category: Column, n: int = 10) -> DataFrame:
    """Score 0.5 for every name or category that contains the text; names that equal it or begin with it first."""
    low = q.lower().strip()
    hit = docs.where(F.lower(name).contains(low) | F.lower(category).contains(low)).withColumn("score", F.lit(0.5))
    return hit.orderBy((F.lower(name) == low).desc(), F.lower(name).startswith(low).desc(), "document_id").limit(n)


def active_documents(docs: DataFrame) -> DataFrame:
    return docs.where(P.visible())


def valid_results(rows: DataFrame, content: str, key: str = "document_id") -> DataFrame:
    return rows.dropna(subset=[key, content])
