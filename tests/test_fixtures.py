"""Worked examples of classification, ranking, scoring and analysis."""

import pytest
from pyspark.sql import functions as F

from querna.functions import analysis, porter, ranking
from querna.operators import index


@pytest.mark.parametrize("name, query, score, corrected, tier, kind", [
    ("Pencil Store", "pencil store", 0.0, None, 3, "perfect"), ("Pencil Store and Supplies", "pencil store", 0.0, None, 3, "prefix"), ("The Pencil Store", "pencil store", 0.0, None, 3, "substring"),
    ("Pensil Store", "pencil store", 3.5, None, 2, "fuzzy"), ("Pencil Store", "pensil", 0.0, ("pencil", 0.9), 2, "typo_corrected_prefix"), ("Office Supplies Store", "pencil", 6.5, None, 2, "high_text_score"),
    ("General Store", "pencil", 1.2, None, 1, "other"), ("Luxury Hotel Lagos", "luxury hotel", 0.0, None, 3, "prefix"),
])
def test_classification(spark, name, query, score, corrected, tier, kind):
    r = ranking.classify(spark.createDataFrame([(name,)], "name string"), query, text_score=F.lit(score), corrected=corrected).first()
    assert (r.tier, r.match_type) == (tier, kind)


def test_tiered_order(spark):
    rows = [("b1", "Pencil Store", True, 90, 4.0, 5.5), ("b2", "The Pencil Shop", True, 85, 3.5, 5.2), ("b3", "Office Pencil", False, 98, 5.0, 5.0), ("b4", "Pensil Store", True, 100, 5.0, 3.5), ("b5", "Office Supplies", True, 100, 5.0, 1.5)]
    df = spark.createDataFrame(rows, "document_id string, name string, is_verified boolean, health int, rating double, score double")
    x = ranking.classify(df, "pencil", text_score=F.lit(0.0))
    c = F.col
    x = x.withColumn("final_score", ranking.tiered_score(c("tier"), c("is_verified"), c("health"), c("rating"), F.lit(10), F.lit(False), c("score"))).orderBy(*ranking.tier_order())
    got = x.collect()
    assert [r.document_id for r in got] == ["b1", "b2", "b3", "b4", "b5"] and [r.tier for r in got] == [3, 3, 3, 2, 1]
    assert [r.final_score for r in got] == pytest.approx([12141.8509, 12131.7900, 10159.7474, 7161.3602, 3160.4402], abs=1e-3)


def bm25(spark, tf, df, n, length, avg, weight=1.0, **k):
    args = [F.lit(float(x)) for x in (tf, df, n, length, avg, weight)]
    return spark.range(1).select(index.bm25(*args, **k).alias("s")).first().s


def test_bm25_properties(spark):
    banana = bm25(spark, 2, 2, 3, 5, 5)
    assert banana == pytest.approx(0.646255, abs=1e-6)
    assert bm25(spark, 2, 1, 3, 3, 5) > banana > 0 and bm25(spark, 0, 2, 3, 5, 5) == 0 and bm25(spark, 2, 0, 3, 5, 5) == 0 and bm25(spark, 2, 2, 3, 5, 0) == 0
    assert bm25(spark, 2, 2, 3, 5, 5, 3.0) == pytest.approx(3 * banana) and bm25(spark, 9, 2, 3, 5, 5, k1=2.0) > bm25(spark, 9, 2, 3, 5, 5)


def test_analysis(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(analysis.ngram_tokens(F.lit("hello"))) == "he hel el ell ll llo lo".split()
    text = F.lit("Hello world, this is a test!")
    r = analysis.AnalyzerRegistry()
    assert one(r.get("standard")(text)) == ["hello", "world", "test"] and one(r.get("whitespace")(text)) == ["Hello", "world,", "this", "is", "a", "test!"]
    assert [porter.stem(w) for w in "running jumps jumped flies driving easily".split()] == "run jump jump fli drive easili".split()
    chain = analysis.custom_analyzer({"tokenizer": "standard", "filters": ["lowercase", "stopword", "stemming"]})
    assert one(chain(F.lit("The running dogs are barking loudly"))) == ["run", "dog", "bark", "loudli"]
