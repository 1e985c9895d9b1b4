"""Typo dictionaries, suggestions and corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querna import constants as K
from querna.functions import fuzzy


def search_terms(docs: DataFrame, whole: list[str], split: list[str] = [], least: int = 2) -> DataFrame:
    """(term, field_types, total_frequency, trigrams): values of the whole fields, words of the split ones."""
    parts = [docs.select(F.lit(f).alias("field_type"), F.lower(F.trim(F.col(f))).alias("term")) for f in whole]
    parts += [docs.select(F.lit(f).alias("field_type"), F.explode(F.split(F.lower(F.col(f)), r"[^a-z0-9]+")).alias("term")) for f in split]
    t = reduce(DataFrame.unionByName, parts)
    t = t.where(F.length("term").between(3, 100) & F.col("term").rlike("^[a-z][a-z0-9 &'.-]*$") & ~F.col("term").isin(sorted(K.VIEW_STOP_WORDS)))
    t = t.groupBy("term").agg(F.sort_array(F.collect_set("field_type")).alias("field_types"), F.count("*").alias("total_frequency"))
    return t.where(F.col("total_frequency") >= least).withColumn("trigrams", F.sort_array(fuzzy.trigrams(F.col("term"))))


def field_terms(docs: DataFrame, fields: list[str], n: int = 10_000) -> DataFrame:
    """(field, term, frequency): words of string and array fields, of three letters or more, that begin with a letter
    and hold no run of three digits; the n most frequent of each field (FUZ-17)."""
    kinds = dict(docs.dtypes)
    text = lambda f: F.array_join(F.col(f), " ") if kinds[f].startswith("array") else F.col(f).cast("string")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.split(F.lower(text(f)), r"[^a-z0-9]+").alias("ws")) for f in fields]))
    t = docs.select(pairs.alias("x")).select("x.field", F.explode("x.ws").alias("term"))
    t = t.where((F.length("term") >= 3) & F.col("term").rlike("^[a-z]") & ~F.col("term").rlike("[0-9]{3}"))
    counted = t.groupBy("field", "term").agg(F.count("*").alias("frequency"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("frequency"), "term"))
    return counted.withColumn("place", rank).where(F.col("place") <= n).drop("place")


def exact_or_similar(terms: DataFrame, q: str, threshold: float = K.TRIGRAM_THRESHOLD) -> DataFrame:
    """The term itself, then those alike, with where they come from (FUZ-39)."""
    exact = terms.where(F.col("term") == q).withColumn("source", F.lit("exact"))
    near = terms.where((F.col("term") != q) & (fuzzy.similarity(F.lit(q), F.col("term")) > threshold)).withColumn("source", F.lit("similar"))
    return exact.unionByName(near)


def dictionary_stats(terms: DataFrame, n: int = 10) -> DataFrame:
    top = F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("total_frequency")).alias("f"), "term"))), 1, n), lambda x: x["term"])
    # the heap of the best n a partition, not a list of all terms
    best = terms.orderBy(F.desc("total_frequency"), F.asc("term")).limit(n).agg(top.alias("top_terms"))
    return terms.agg(F.count("*").alias("terms"), F.avg("total_frequency").alias("avg_frequency"), F.max("total_frequency").alias("max_frequency")).crossJoin(best)


def prefix_search(terms: DataFrame, prefix: str, n: int = 5) -> DataFrame:
    p = prefix.lower()
    hit = terms.where(F.col("term").startswith(p))
    return hit.orderBy((F.col("term") != p).asc(), F.length("term"), F.desc("total_frequency"), F.asc("term")).limit(n)


def similarity_search(terms: DataFrame, q: str, n: int = 10, threshold: float = K.TRIGRAM_THRESHOLD) -> DataFrame:
    q = q.lower()
    t = F.col("term")
    sim, lev = fuzzy.similarity(F.lit(q), t), F.levenshtein(F.lit(q), t)
    hit = terms.withColumns({"similarity": sim, "distance": lev}).where((F.col("similarity") >= threshold) | t.startswith(q) | t.contains(q) | (F.col("distance") <= 3))
    return hit.orderBy(F.desc("similarity"), F.desc("total_frequency"), F.asc("distance"), F.asc("term")).limit(n)


def symspell_index(terms: DataFrame, depth: int = 2) -> DataFrame:
    """(del_key, term, total_frequency): built once, then joined by key."""
    return terms.select(F.explode(fuzzy.deletes(F.col("term"), depth)).alias("del_key"), "term", "total_frequency")


def symspell(queries: DataFrame, index: DataFrame, depth: int = 2, n: int | None = 10) -> DataFrame:
    """(query, term, distance, total_frequency, rank): equal delete keys, then the true distance; all where n is None."""
    keys = queries.select("query", F.explode(fuzzy.deletes(F.col("query"), depth)).alias("del_key"))
    hit = keys.join(index, "del_key").select("query", "term", "total_frequency").distinct()
    hit = hit.withColumn("distance", F.levenshtein("query", "term")).where(F.col("distance") <= depth)
    w = Window.partitionBy("query").orderBy("distance", F.desc("total_frequency"), "term")
    hit = hit.withColumn("rank", F.row_number().over(w))
    return hit if n is None else hit.where(F.col("rank") <= n)


def correct(queries: DataFrame, index: DataFrame, depth: int = 2) -> DataFrame:
    """(query, corrected, score, confidence, n_suggestions): best candidate by relevance score."""
    hit = symspell(queries, index, depth, None)
    hit = hit.withColumn("score", fuzzy.correction_score(F.col("query"), F.col("term"), F.col("total_frequency")))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "term")
    best = hit.withColumns({"place": F.row_number().over(w), "n_suggestions": F.count("*").over(Window.partitionBy("query"))}).where("place = 1")
    return best.select("query", F.col("term").alias("corrected"), "score", F.least(F.lit(0.95), F.col("score") / 1000).alias("confidence"), "n_suggestions")


def suggest(docs: DataFrame, text: str, field: str = "name", n: int = 5) -> DataFrame:
    """Prefix matches, then contained ones; each value once, in order."""
    q = text.lower()
    v = F.lower(F.col(field))
    hit = docs.select(F.col(field).alias("text"), F.when(v.startswith(q), 1).when(v.contains(q), 2).alias("stage")).where("stage is not null")
    return hit.groupBy("text").agg(F.min("stage").alias("stage"), F.count("*").alias("frequency")).orderBy("stage", "text").limit(n)


def direct_suggestions(docs: DataFrame, q: str, field: str = "name", n: int = 5) -> DataFrame:
    t = docs.select(F.lower(F.col(field)).alias("text")).groupBy("text").agg(F.count("*").alias("frequency"))
    c = F.col("text")
    t = t.where(F.length(c).between(4, 20) & ~c.contains("<") & ((fuzzy.similarity(F.lit(q), c) > K.DIRECT_SIMILARITY) | (F.levenshtein(F.lit(q), c) <= 2) | c.startswith(q)))
    return t.withColumn("score", fuzzy.suggestion_score(F.lit(q), c, F.col("frequency"))).where("score > 100").orderBy(F.desc("score"), "text").limit(n)


def spell_check(words: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """(word, suggestions, confidence): dictionary words within the distance, by symmetric delete keys."""
    index = dictionary.select(F.explode(fuzzy.deletes(F.col("word"), most)).alias("k"), F.col("word").alias("good"))
    hit = words.select("word", F.explode(fuzzy.deletes(F.col("word"), most)).alias("k")).join(index, "k").select("word", "good").distinct()
    hit = hit.withColumn("d", F.levenshtein("word", "good")).where((F.col("d") >= 1) & (F.col("d") <= most))
    found = hit.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "good"))), lambda x: x["good"]).alias("suggestions"))
    return found.withColumn("confidence", F.least(F.lit(0.9), 0.5 + 0.1 * F.size("suggestions")))


def looks_correct(q: str, known: set[str]) -> bool:
    """A short query passes; of several words half must be known; a single one must be known."""
    ws = [w.strip("*?").lower() for w in q.split()]
    if len(q.strip()) < 3:
        return True
    return sum(w in known for w in ws) * 2 >= len(ws) if len(ws) > 1 else ws[0] in known


def first_wins(terms: DataFrame, order: list) -> DataFrame:
    w = Window.partitionBy(F.lower("term")).orderBy(*order)
    return terms.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
