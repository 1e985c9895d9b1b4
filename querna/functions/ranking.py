"""Match quality, tiered and multi-signal ranking, rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querna import constants as K
from querna.functions.fuzzy import bounded_levenshtein, simple_similarity
from querna.plans.ranks import global_rank


def _some(parts: Column, test, word: str) -> Column:
    return F.exists(parts, lambda n: test(n, word))


def exact_type(name: Column, query: str) -> Column:
    """perfect, prefix, substring or all_words; null where none holds."""
    q = query.lower().strip()
    ws = q.split()
    every = F.lit(False)
    if len(ws) >= 2:
        parts = F.split(name, r"\s+")
        every = reduce(lambda a, b: a & b, [_some(parts, lambda n, w: (n == w) | n.startswith(w), w) for w in ws])
    return F.when(name == q, "perfect").when(name.startswith(q), "prefix").when(name.contains(q), "substring").when(every, "all_words")


def close_match(name: Column, query: str, text_score: Column) -> Column:
    """struct(type, confidence) of the first close check that holds; null where none does."""
    q = query.lower().strip()
    ws = q.split()
    most = min(3, -(-len(q) // 3))
    pair = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.cast("double").alias("confidence"))
    lev = bounded_levenshtein(name, F.lit(q))
    parts = F.split(name, r"\s+")
    out = F.when((lev > 0) & (lev <= most), pair("fuzzy", 1 - lev / max(1, len(q))))
    if len(ws) == 1:
        near = F.filter(F.transform(parts, lambda n: bounded_levenshtein(n, F.lit(q))), lambda d: (d > 0) & (d <= most))
        out = out.when(F.size(near) > 0, pair("fuzzy_word", 1 - F.get(near, 0) / max(1, len(q))))
    sim = simple_similarity(name, F.lit(q))
    out = out.when(sim > K.CLASSIFIER_SIMILARITY, pair("similarity", sim))
    if len(ws) >= 2:
        hit = reduce(lambda a, b: a + b, [_some(parts, lambda n, w: bounded_levenshtein(n, F.lit(w)) <= 2, w).cast("int") for w in ws])
        out = out.when(hit / len(ws) >= 0.6, pair("partial_words", hit / len(ws)))
    return out.when(text_score >= 5, pair("high_text_score", F.least(F.lit(1.0), text_score / 10)))


def classify(hits: DataFrame, query: str, name: str = "name", text_score: Column | None = None, corrected: tuple[str, float] | None = None) -> DataFrame:
    """Adds tier (3 exact, 2 close, 1 other), match_type and confidence."""
    low = F.trim(F.lower(F.coalesce(F.col(name), F.lit(""))))
    text_score = F.lit(0.0) if text_score is None else text_score
    exact, close = exact_type(low, query), close_match(low, query, text_score)
    typo = exact_type(low, corrected[0]) if corrected and corrected[0] != query else F.lit(None).cast("string")
    tier = F.when(exact.isNotNull(), 3).when(typo.isNotNull() | close.isNotNull(), 2).otherwise(1)
    kind = F.coalesce(exact, F.concat(F.lit("typo_corrected_"), typo), close["type"], F.lit("other"))
    conf = F.when(exact.isNotNull(), 1.0).when(typo.isNotNull(), corrected[1] if corrected else 0.0).otherwise(F.coalesce(close["confidence"], F.lit(0.5)))
    return hits.withColumns({"tier": tier, "match_type": kind, "confidence": conf})


def freshness(updated: Column, as_of: Column) -> Column:
    """10, 8, 6, 4 or 2 by age at 30, 90, 180 and 365 days; 5 where unknown."""
    days = F.datediff(as_of, updated)
    return F.when(days.isNull(), 5).when(days <= 30, 10).when(days <= 90, 8).when(days <= 180, 6).when(days <= 365, 4).otherwise(2)


def tier_points(tier: Column) -> Column:
    return F.when(tier == 3, K.TIER_EXACT).when(tier == 2, K.TIER_CLOSE).otherwise(K.TIER_OTHER)


def tiered_score(tier: Column, confirmed: Column, health: Column, rating: Column, fresh: Column, featured: Column, text_score: Column) -> Column:
    text = F.least(F.lit(10.0), 2.5 * F.log10(F.greatest(F.lit(1.0), text_score)))
    yes = lambda c, points: F.when(F.coalesce(c, F.lit(False)), points).otherwise(0)
    return tier_points(tier) + yes(confirmed, K.CONFIRMED_BOOST) + health + 10 * rating + fresh + yes(featured, K.FEATURED_BOOST) + text


def tier_order(score: str = "final_score", health: str = "health", tier: str = "tier", key: str = "document_id") -> list[Column]:
    return [F.desc(score), F.desc(health), F.desc(tier), F.asc(key)]


def tier_statistics(hits: DataFrame) -> DataFrame:
    return hits.groupBy("tier", "match_type").agg(F.count("*").alias("hits"), F.avg("confidence").alias("avg_confidence"))


def ranking_breakdown(hits: DataFrame, confirmed: str = "is_verified") -> DataFrame:
    c = F.coalesce(F.col(confirmed), F.lit(False))
    return hits.groupBy("tier").agg(F.count_if(c).alias("confirmed"), F.count_if(~c).alias("unconfirmed"))


def breakdown_top(hits: DataFrame, n: int = 10) -> DataFrame:
    """(name, tier, confirmed, health, score) of the n best ranked hits (RNK-08)."""
    confirmed = F.coalesce(F.col("is_verified"), F.lit(False)).alias("confirmed")
    top = hits.orderBy(*tier_order()).limit(n)
    tier = F.when(F.col("tier") == 3, "EXACT_MATCH").when(F.col("tier") == 2, "CLOSE_MATCH").otherwise("OTHER_MATCH")
    return top.select(F.coalesce("name", F.lit("Unknown")).alias("name"), tier.alias("tier"), confirmed, "health", F.col("final_score").alias("score"))


def text_score(name: Column, query: str, base: Column) -> Column:
    """The base score, boosted by how the name matches."""
    q = query.lower().strip()
    name = F.lower(name)
    ws, parts = q.split(), F.split(name, r"\s+")
    found = [_some(parts, lambda n, w: n.contains(w) | F.lit(w).contains(n), w).cast("int") for w in ws]
    share = reduce(lambda a, b: a + b, found, F.lit(0)) / max(1, len(ws))
    every = (share == 1) if len(ws) >= 2 else F.lit(False)
    return F.when(name == q, base * 10).when(name.startswith(q), base * 5).when(name.contains(q), base * 3).when(every, base * 2.5).when(share >= 0.5, base * (1 + share)).otherwise(base)


def popularity(health: Column, rating: Column, views: Column, verified: Column, featured: Column) -> Column:
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return 0.4 * clamp(health / 100) + 0.3 * F.least(F.lit(1.0), rating / 5) + 0.1 * F.least(F.lit(1.0), views / 1000) + F.when(verified, 0.2).otherwise(0.0) + F.when(featured, 0.15).otherwise(0.0)


def signal_freshness(updated: Column, as_of: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.1), 1 - F.datediff(as_of, updated) / 365), F.lit(0.1))


def _name_boost(name: Column, query: str) -> Column:
    q = query.lower().strip()
    return F.when(name == q, 2000).when(name.startswith(q), 1000).when(name.contains(q), 500).otherwise(0)


def quick_score(name: Column, query: str, health: Column, confirmed: Column, featured: Column) -> Column:
    return health + _name_boost(name, query) + F.when(confirmed, 5000).otherwise(0) + F.when(featured, 10000).otherwise(0)


def multi_signal_score(name: Column, query: str, text: Column, health: Column, location: Column, fresh: Column, semantic: Column, confirmed: Column, featured: Column) -> Column:
    """Four weightings, by whether the hit is confirmed and whether it matches exactly, and boosts."""
    h = F.greatest(F.lit(0.0), F.least(F.lit(1.0), health / 100))
    exact = name.startswith(query.lower().strip()) | (text >= 5)
    mix = lambda t, hw, lw, fw, sw: text * t + h * hw + location * lw + fresh * fw + semantic * sw
    base = (
        F.when(confirmed & exact, mix(400, 400, 100, 60, 40)).when(confirmed, mix(0.2, 700, 50, 30, 20))
        .when(exact, mix(500, 300, 100, 60, 40)).otherwise(mix(0.4, 300, 150, 100, 50))
    )
    return base + _name_boost(name, query) + F.when(featured, 10000).when(confirmed, 5000).otherwise(0)


def feature_vector(**signals: Column) -> Column:
    """text, semantic, location, freshness, popularity, health and rating as one struct."""
    order = ("text", "semantic", "location", "freshness", "popularity", "health", "rating")
    return F.struct(*[signals.get(s, F.lit(0.0)).cast("double").alias(s) for s in order])


def fuse(lists: list[DataFrame], k: int = K.RRF_K, weights: list[float] | None = None, key: str = "document_id", score: str = "score") -> DataFrame:
    """Reciprocal rank fusion: (key, rrf) over lists that hold key and score."""
    ranked = []
    for df, w in zip(lists, weights or [1.0] * len(lists)):
        at = global_rank(df.select(key, score), score, key, "__at")
        ranked.append(at.select(key, (F.lit(w) / (k + F.col("__at"))).alias("part")))
    return reduce(DataFrame.unionByName, ranked).groupBy(key).agg(F.sum("part").alias("rrf"))


def deduplicate(hits: DataFrame, key: str = "document_id", score: str = "score", order: list[Column] | None = None) -> DataFrame:
    """One hit an id: the first in the given order (best score first)."""
    w = Window.partitionBy(key).orderBy(*(order or [F.desc(score)]))
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
