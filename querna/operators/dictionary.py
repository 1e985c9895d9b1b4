"""The stored typo dictionary: terms of an index, their delete keys, refresh, and the correction of whole queries.

Layout: ``<path>/terms/index_name=<i>`` and ``<path>/keys/index_name=<i>/bucket=<b>``,
where a bucket is crc32(delete key) modulo KEY_BUCKETS, so a correction reads the
folders of its own keys alone.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querna import constants as K
from querna.functions import fuzzy
from querna.operators import suggest

KEY_BUCKETS = 64


def refresh(docs: DataFrame, path: str, index_name: str, whole: list[str], split: list[str] = [], least: int = 2) -> None:
    """Writes the terms of one index and their delete keys; those of other indices stay as they are."""
    spark = docs.sparkSession
    to = lambda df, at, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{path}/{at}")
    terms = suggest.search_terms(docs, whole, split, least).withColumn("index_name", F.lit(index_name))
    to(terms, "terms", "index_name")
    keys = suggest.symspell_index(load(spark, path, index_name)).withColumn("index_name", F.lit(index_name))
    keys = keys.withColumn("bucket", F.pmod(F.crc32(F.col("del_key").cast("binary")), F.lit(KEY_BUCKETS)).cast("int"))
    to(keys.repartition("bucket").sortWithinPartitions("bucket", "del_key"), "keys", "index_name", "bucket")


def load(spark: SparkSession, path: str, index_name: str, least: int = 1, n: int | None = None) -> DataFrame:
    """The stored terms of an index of at least that frequency; the n most frequent where n is given (FUZ-49: 5 and 5000)."""
    t = spark.read.parquet(f"{path}/terms").where((F.col("index_name") == index_name) & (F.col("total_frequency") >= least)).drop("index_name")
    return t if n is None else t.orderBy(F.desc("total_frequency"), "term").limit(n)


def save_json(terms: DataFrame, path: str) -> None:
    """The dictionary as JSON lines, for readers other than Spark (SRC-12)."""
    terms.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, field_types array<string>, total_frequency long, trigrams array<string>").json(path)


def _deletes(word: str, depth: int = 2) -> set[str]:
    out = level = {word}
    for _ in range(depth):
        level = {w[:i] + w[i + 1 :] for w in level if len(w) > 1 for i in range(len(w))}
        out = out | level
    return out


def keys_of(spark: SparkSession, path: str, index_name: str, words: list[str]) -> DataFrame:
    """(del_key, term, total_frequency): the stored delete keys that these words' neighbours share."""
    keys = sorted(set().union(*map(_deletes, words)))
    buckets = sorted({zlib.crc32(k.encode()) % KEY_BUCKETS for k in keys})
    k = spark.read.parquet(f"{path}/keys").where((F.col("index_name") == index_name) & F.col("bucket").isin(buckets) & F.col("del_key").isin(keys))
    return k.select("del_key", "term", "total_frequency")


def stored_correct(spark: SparkSession, path: str, index_name: str, queries: list[str]) -> DataFrame:
    """``suggest.correct`` of a few words, from the stored keys."""
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    return suggest.correct(asked, keys_of(spark, path, index_name, queries))


def fallback(queries: DataFrame, terms: DataFrame, n: int = 5) -> DataFrame:
    """(query, term, similarity, score): the n words most like each query by trigrams, above 0.4 (FUZ-27).

    Words meet queries by a trigram that they share, without which no similarity is above 0."""
    words = terms.where((F.length("term") >= 3) & F.col("term").rlike("^[a-z]")).select("term").distinct()
    gram = lambda c: F.explode(fuzzy.trigrams(F.col(c))).alias("gram")
    met = queries.select("query", gram("query")).join(words.select("term", gram("term")), "gram").select("query", "term").distinct()
    q, t = F.lower("query"), F.col("term")
    sim = F.greatest(fuzzy.similarity(t, q), fuzzy.word_similarity(t, q))
    met = met.withColumn("similarity", sim).where(F.col("similarity") > K.FALLBACK_SIMILARITY)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "term"))
    best = met.withColumn("place", rank).where(F.col("place") <= n)
    gap = F.abs(F.length("query") - F.length("term"))
    overlap = fuzzy.common_characters(q, t) / F.greatest(F.length("query"), F.length("term")) * 200
    strong = F.when((F.col("similarity") > 0.7) & (gap <= 2), 300).otherwise(0)
    score = F.round(F.round(F.col("similarity") * 1000) + F.greatest(F.lit(0), 100 - gap * 20) + overlap + strong)
    return best.select("query", "term", "similarity", score.alias("score"), "place")


def correct_queries(queries: DataFrame, terms: DataFrame, index: DataFrame, english: DataFrame | None = None) -> DataFrame:
    """(query, corrected, confidence, source): one row a query (FUZ-23).

    Trailing asterisks go; then the first of these that gives something: the map of
    known typos, the nearest terms by delete keys, words alike by trigrams (taken above
    a confidence of 0.6), the spell checker's words.  ``index`` is ``suggest.symspell_index`` of ``terms``.
    """
    clean = F.regexp_replace(F.col("query"), r"\*+$", "")
    q = queries.select("query", F.lower(F.trim(clean)).alias("clean")).distinct()
    known = F.create_map(*[F.lit(x) for kv in sorted(K.COMMON_TYPOS.items()) for x in kv])
    mapped = q.withColumn("to", F.try_element_at(known, F.col("clean"))).where("to is not null")
    found = [mapped.select("query", F.lit(1).alias("stage"), F.lit("known").alias("source"), F.col("to").alias("corrected"), F.lit(0.95).alias("confidence"))]
    words = q.select(F.col("clean").alias("query")).distinct()
    near = suggest.correct(words, index).select(F.col("query").alias("clean"), "corrected", "confidence")
    found.append(q.join(near, "clean").select("query", F.lit(2).alias("stage"), F.lit("symspell").alias("source"), "corrected", "confidence"))
    like = fallback(words, terms).where("place = 1").select(F.col("query").alias("clean"), "term", "score")
    sure = F.col("score") / 1000 > 0.6
    found.append(q.join(like, "clean").where(sure).select("query", F.lit(3).alias("stage"), F.lit("similar").alias("source"), F.col("term").alias("corrected"), (F.col("score") / 1000).alias("confidence")))
    if english is not None:
        spelt = correct_words(q.select(F.col("clean").alias("query")).distinct(), english).where("changed > 0")
        found.append(q.join(spelt.select(F.col("query").alias("clean"), "corrected", "confidence"), "clean").select("query", F.lit(4).alias("stage"), F.lit("spelling").alias("source"), "corrected", "confidence"))
    best = reduce(DataFrame.unionByName, found)
    first = F.row_number().over(Window.partitionBy("query").orderBy("stage"))
    best = best.withColumn("first", first).where("first = 1").drop("first", "stage")
    out = q.join(best, "query", "left")
    return out.select("query", F.coalesce("corrected", "clean").alias("corrected"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("source", F.lit("none")).alias("source"))


def correct_words(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query, corrected, changed, confidence): each unknown word of a query as its best suggestion, the others as they
    are (FUZ-33); confidence is the mean over the words, 1 for known ones and 0 for those without a suggestion."""
    w = queries.select("query", F.posexplode(F.filter(F.split(F.lower("query"), r"[ \t\n\r]+"), lambda x: x != "")).alias("at", "word"))
    known = dictionary.select("word", F.lit(True).alias("known")).distinct()
    spelt = suggest.spell_check(w.select("word").distinct().join(known, "word", "left_anti"), dictionary)
    spelt = spelt.select("word", F.get("suggestions", F.lit(0)).alias("best"), "confidence")
    x = w.join(known, "word", "left").join(spelt, "word", "left")
    good = F.when(F.col("known"), 1.0).otherwise(F.coalesce("confidence", F.lit(0.0)))
    x = x.select("query", "at", F.when(F.col("known").isNull(), F.col("best")).alias("best"), "word", good.alias("good"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("best", "word").alias("w")))), lambda s: s["w"]), " ")
    return x.groupBy("query").agg(text.alias("corrected"), F.count("best").alias("changed"), F.avg("good").alias("confidence"))


def suggestions(terms: DataFrame, docs: DataFrame, text: str, field: str = "name", n: int = 5) -> DataFrame:
    """(text, id, score, distance, frequency): the dictionary's suggestions, or the documents' where it has none
    (FUZ-30, FUZ-38); a text of fewer than two characters has none."""
    q = text.lower().strip()
    view = suggest.similarity_search(terms, q, n).select(F.col("term").alias("text"), F.col("total_frequency").alias("frequency"))
    direct = suggest.direct_suggestions(docs, q, field, n).select("text", "frequency")
    both = view.withColumn("stage", F.lit(1)).unionByName(direct.withColumn("stage", F.lit(2)))  # 2 * n rows at most
    both = both.withColumn("first", F.min("stage").over(Window.partitionBy())).where((F.col("stage") == F.col("first")) & F.lit(len(q) >= 2))
    c = F.col("text")
    scored = both.select(c, c.alias("id"), fuzzy.suggestion_score(F.lit(q), c, F.col("frequency")).alias("score"), F.levenshtein(F.lit(q), c).alias("distance"), "frequency")
    return scored.orderBy(F.desc("score"), "text").limit(n)


def autocomplete(docs: DataFrame, text: str, field: str = "name", n: int = 5, key: str = "document_id", category: str = "category_name") -> DataFrame:
    """(text, id, category): values that begin with the text; without any, those that contain it; without any, those of
    more than two characters (FUZ-31).  Each value once, with its least id, in order."""
    v, q = F.col(field), text.lower()
    stages = [F.lower(v).startswith(q), F.lower(v).contains(q), F.length(v) > 2]

    def top(cond: Column, stage: int) -> DataFrame:
        one = docs.where(v.isNotNull() & cond).groupBy(v.alias("text")).agg(F.min(F.struct(key, category)).alias("least"))
        return one.orderBy("text").limit(n).select("text", F.col(f"least.{key}").alias("id"), F.col(f"least.{category}").alias("category"), F.lit(stage).alias("stage"))

    both = reduce(DataFrame.unionByName, [top(c, i) for i, c in enumerate(stages)])  # 3 * n rows at most
    return both.withColumn("first", F.min("stage").over(Window.partitionBy())).where("stage = first").orderBy("text").select("text", "id", "category")


def estimated_frequency(term: Column) -> Column:
    """What a term's frequency is taken to be without counts: 1000 for a business word, else by length (FUZ-47)."""
    return F.when(F.lower(term).isin(sorted(K.BUSINESS_WORDS)), 1000).when(F.length(term) <= 3, 500).when(F.length(term) <= 6, 100).otherwise(10)
