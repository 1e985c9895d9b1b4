"""The search call: predicate, rank, filter, sort, page, total, facets, highlights."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querna import constants as K
from querna.functions import fuzzy, ranking
from querna.operators import index as I
from querna.plans import predicates as P
from querna.plans import query as Q


@dataclass
class Request:
    query: str | dict | None = None
    fields: list[str] = field(default_factory=lambda: ["name"])
    filter: dict | None = None
    sort: str | None = None
    size: int | None = None
    start: int | None = None
    facets: list[str] = field(default_factory=list)
    highlight: list[str] = field(default_factory=list)
    candidate_limit: int | None = None
    rank: str = "base"  # base, bm25, wildcard or boost


@dataclass
class Response:
    hits: DataFrame
    total: DataFrame
    facets: DataFrame | None = None
    summary: DataFrame | None = None  # total and greatest score in one row

    def envelope(self, size: int | None = None, start: int | None = None) -> dict:
        """The driver-side answer: total, pages and hits of one page."""
        size, start = Q.page(size, start)
        total = self.total.first()["total"]
        hits = [r.asDict(recursive=True) for r in self.hits.collect()]  # at most MOST_PAGE_SIZE rows
        best = self.summary.first()["max_score"] if self.summary is not None else None
        return {"total": total, "max_score": best, "pagination": page_meta(total, size, start), "hits": hits}


def page_meta(total: int, size: int, start: int) -> dict:
    pages = -(-total // size) if size else 0
    now = start // size + 1 if size else 1
    return {"current_page": now, "total_pages": pages, "page_size": size, "has_next": now < pages, "has_previous": now > 1}


def matches(docs: DataFrame, r: Request, arrays: frozenset[str] = frozenset()) -> DataFrame:
    """All documents that the query and its filter admit: hits and totals share this one predicate."""
    cond = P.predicate(Q.parse(r.query, r.fields))
    if r.filter:
        cond = cond & P.filter_condition(r.filter, arrays)
    return docs.where(cond)


def score_column(r: Request) -> Column:
    q = Q.parse(r.query, r.fields)
    text = Q.text_of(r.query) if r.query is not None else "*"
    if isinstance(q, Q.MatchAll):
        return F.lit(q.boost)
    f = Q.strip_boost(r.fields[0])[0]
    if r.rank == "wildcard" or "*" in text or "?" in text:
        bare = text.replace("*", "").replace("?", "")
        best = [fuzzy.word_similarity(F.lit(bare), F.col(Q.strip_boost(x)[0])) * (1000 if i == 0 else 500) for i, x in enumerate(r.fields[:2])]
        return F.greatest(*best) if len(best) > 1 else best[0]
    if r.rank == "boost":
        return P.boost_score(q)
    return P.base_rank(F.col(f), text)


def search(docs: DataFrame, r: Request, arrays: frozenset[str] = frozenset()) -> Response:
    hit = matches(docs, r, arrays)
    if r.rank == "bm25":
        terms = Q.analyze(Q.text_of(r.query))
        scored = hit.join(I.bm25_search(docs, terms, [Q.strip_boost(f)[0] for f in r.fields]), "document_id")
    else:
        scored = hit.withColumn("score", score_column(r))
    size, start = Q.page(r.size, r.start)
    order = P.sort_columns(r.sort) if r.sort else [F.desc("score"), F.asc("document_id")]
    if r.candidate_limit:
        scored = scored.orderBy(F.desc("score"), F.asc("document_id")).limit(r.candidate_limit)
    page = scored.orderBy(*order).offset(start).limit(size) if start else scored.orderBy(*order).limit(size)
    if r.highlight:
        terms = Q.analyze(Q.text_of(r.query)) or ["\x00"]
        page = page.withColumns({f"highlight_{f}": P.highlight(F.col(f), terms) for f in r.highlight})
    summary = scored.agg(F.count("*").alias("total"), F.max("score").alias("max_score"))
    return Response(page, hit.agg(F.count("*").alias("total")), facets(hit, r.facets) if r.facets else None, summary)


def facets(hits: DataFrame, fields: list[str]) -> DataFrame:
    """(field, key, count): term buckets; array fields count each element."""
    kinds = dict(hits.dtypes)
    parts = []
    for f in fields:
        c = F.explode(F.col(f).cast("array<string>")) if kinds[f].startswith("array") else F.col(f).cast("string")
        parts.append(hits.select(F.lit(f).alias("field"), c.alias("key")))
    return reduce(DataFrame.unionByName, parts).where("key is not null").groupBy("field", "key").agg(F.count("*").alias("count"))


def delete_by_query(docs: DataFrame, query: dict, fields: list[str] | None = None, arrays: frozenset[str] = frozenset()) -> DataFrame:
    """What stays; nulls in the predicate keep a document.  An empty predicate is refused."""
    if not query or "match_all" in query:
        raise ValueError("delete by query needs a predicate")
    kind = next(iter(query))
    cond = P.filter_condition(query, arrays) if kind in ("term", "terms", "range", "bool") else P.predicate(Q.parse(query, fields))
    return docs.where(~F.coalesce(cond, F.lit(False)))


def ranked(docs: DataFrame, query: str, as_of: Column, candidate_limit: int | None = None) -> DataFrame:
    """Tiered ranking over all matches: name, health, rating, is_verified, is_featured, updated_at."""
    r = Request(query, ["name"], rank="base")
    hit = matches(docs, r).withColumn("score", score_column(r))
    if candidate_limit:
        hit = hit.orderBy(F.desc("score"), F.asc("document_id")).limit(candidate_limit)
    hit = ranking.classify(hit, query, text_score=F.col("score"))
    final = ranking.tiered_score(F.col("tier"), F.col("is_verified"), F.col("health"), F.col("rating"), ranking.freshness(F.col("updated_at"), as_of), F.col("is_featured"), F.col("score"))
    return hit.withColumn("final_score", final).orderBy(*ranking.tier_order())


def merge_suggestions(found: list[DataFrame], size: int) -> DataFrame:
    """Hits of several corrected queries: one an id, the best first."""
    return ranking.deduplicate(reduce(DataFrame.unionByName, found)).orderBy(F.desc("score"), F.asc("document_id")).limit(min(size, K.MOST_PAGE_SIZE))


def search_near(docs: DataFrame, query: str, as_of: Column, user: tuple[float, float] | None = None, known: set[str] | None = None, corrected: str | None = None, size: int | None = None, start: int | None = None) -> Response:
    """The whole search of one text: correction where the text looks wrong, matching by any word, the place that the
    text names or the user's own, tiered ranking, one page.

    ``docs`` has name, health, rating, is_verified, is_featured, updated_at, lat and lng.  ``corrected`` is what
    ``dictionary.correct_queries`` gives for the text; it is taken where ``known`` words say that the text is wrong.
    """
    from querna.functions import geo
    from querna.operators.suggest import looks_correct

    text = corrected if corrected and known is not None and not looks_correct(query, known) else query
    place = geo.parse_location(text, user)
    words = [w for w in Q.analyze(text) if not place or w not in Q.analyze(str(place.get("name", "")))]
    hit = docs.where(P.predicate(Q.parse({"match": {"field": "name", "value": " ".join(words) or "*", "operator": "or"}})))
    if place or user:
        hit = geo.filter_by_location(hit, place, user=user)
    else:
        hit = hit.withColumn("location_score", F.lit(0.5))
    bare = " ".join(words)
    hit = hit.withColumn("score", P.base_rank(F.col("name"), bare))
    hit = ranking.classify(hit, bare, text_score=F.col("score"))
    final = ranking.tiered_score(F.col("tier"), F.col("is_verified"), F.col("health"), F.col("rating"), ranking.freshness(F.col("updated_at"), as_of), F.col("is_featured"), F.col("score"))
    hit = hit.withColumn("final_score", final)
    size, start = Q.page(size, start)
    order = [F.desc("location_score"), *ranking.tier_order()] if place or user else ranking.tier_order()
    page = hit.orderBy(*order).offset(start).limit(size) if start else hit.orderBy(*order).limit(size)
    total = hit.agg(F.count("*").alias("total"), F.max("final_score").alias("max_score"))
    return Response(page, total, None, total)
