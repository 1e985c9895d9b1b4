import pytest
from pyspark.sql import functions as F

from querna import constants as K
from querna.functions import analysis, fuzzy, geo, nlp, porter, ranking
from querna.operators import index, schema, search, suggest, vector
from querna.plans import predicates as P
from querna.plans import query as Q
from querna.sources import catalog, store, synthetic


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_constants():
    assert len(K.STOP_WORDS) >= 64 and len(K.STOP_WORDS_SHORT) == 25 and len(K.DICTIONARY_STOP_WORDS) == 15 and len(K.VIEW_STOP_WORDS) == 37
    assert len([1 for v in K.GAZETTEER.values() if v[2] == "city"]) == 28 and len(K.GAZETTEER) == 54


@pytest.mark.parametrize("word, stem", [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("generalization", "gener"), ("adoption", "adopt"), ("controll", "control"), ("rate", "rate"), ("is", "is")])
def test_porter(word, stem):
    assert porter.stem(word) == stem


@pytest.mark.parametrize("c, want", [
    (lambda: analysis.standard_tokens(F.lit("The Quick-brown fox_1!")), ["the", "quick", "brown", "fox_1"]), (lambda: analysis.standard_tokens(F.lit("Éa b"), unicode=True), ["éa", "b"]),
    (lambda: analysis.whitespace_tokens(F.lit(" A  b\tC ")), ["A", "b", "C"]), (lambda: analysis.ngram_tokens(F.lit("abc")), ["ab", "abc", "bc"]), (lambda: analysis.ngram_tokens(F.lit("a")), []), (lambda: analysis.keyword_token(F.lit(" Ab ")), ["ab"]),
    (lambda: fuzzy.trigrams(F.lit("cat")), ["  c", " ca", "cat", "at "]), (lambda: fuzzy.deletes(F.lit("abc"), 1), ["abc", "bc", "ac", "ab"]), (lambda: nlp.modifiers(F.lit("best cheap food")), ["best", "cheap"]),
    (lambda: nlp.services(F.lit("24/7 Delivery")), ["24/7", "delivery"]), (lambda: fuzzy.bounded_levenshtein(F.lit("a"), F.lit("abcdef")), 5), (lambda: fuzzy.phonetically_similar(F.lit("phone"), F.lit("fone")), True),
    (lambda: analysis.clean_token(F.lit("-Ab!c-")), "abc"), (lambda: analysis.clean_token(F.lit("12")), None), (lambda: nlp.intent(F.lit("Book a table")), "transactional"), (lambda: geo.distance_phrase(F.lit(1500.0)), "1.5 km"),
])
def test_expressions(spark, c, want):
    assert one(spark, c()) == want


def test_similarity_example(spark):
    assert one(spark, fuzzy.similarity(F.lit("resturant"), F.lit("restaurant"))) == pytest.approx(8 / 13)
    assert one(spark, fuzzy.similarity(F.lit(""), F.lit(""))) == 0 and one(spark, fuzzy.word_similarity(F.lit("ring"), F.lit("red ring"))) == 1


def test_registry():
    r = analysis.AnalyzerRegistry()
    assert r.has("standard") and not r.has("x")
    with pytest.raises(ValueError):
        r.register("standard", None)
    with pytest.raises(ValueError):
        r.get("x")
    with pytest.raises(ValueError):
        analysis.custom_analyzer({"filters": []})
    with pytest.raises(ValueError):
        analysis.create_tokenizer("x")
    with pytest.raises(ValueError):
        analysis.create_filter("x")
    r.create("mine", {"tokenizer": "whitespace", "filters": [{"type": "lowercase"}]})
    assert r.remove("mine") and not r.remove("mine")


@pytest.mark.parametrize("raw, want", [
    ("*", Q.MatchAll()), ("", Q.MatchAll()), (None, Q.MatchAll()), ({"match_all": {"boost": 2}}, Q.MatchAll(2.0)), ("sm*", Q.Wildcard("name", "sm*")), ("Ring", Q.Term("name", "ring")),
    ("red ring", Q.Bool(should=(Q.Term("name", "red"), Q.Term("name", "ring")))), ({"match": {"name": "red ring"}}, Q.Bool(must=(Q.Term("name", "red"), Q.Term("name", "ring")))),
    ({"match": {"name": "*"}}, Q.MatchAll()), ({"match": {"field": "title", "value": "x*"}}, Q.Wildcard("title", "x*")), ({"term": {"name": {"value": "Gear"}}}, Q.Term("name", "gear")),
    ('"red ring"', Q.Phrase("name", ("red", "ring"))), ({"wildcard": "a?b"}, Q.Wildcard("name", "a?b")), ({"wildcard": {"f": {"value": "a*", "boost": 2}}}, Q.Wildcard("f", "a*", 2.0)),
    ({"range": {"p": {"gte": 1}}}, Q.Range("p", (("gte", 1),))), ({"bool": {"must": "ring", "must_not": [{"term": {"name": "old"}}]}}, Q.Bool(must=(Q.Term("name", "ring"),), must_not=(Q.Term("name", "old"),))),
])
def test_parser(raw, want):
    assert Q.parse(raw) == want


def test_parser_helpers():
    assert Q.strip_boost("title^3") == ("title", 3.0) and Q.phrases('a "b c" ""') [0] == ["b c"]
    assert Q.text_of({"bool": {"must": [{"match": {"name": "a"}}], "should": [{"term": {"x": "b"}}]}}) == "a b" and Q.text_of({"range": {}}) == ""
    assert Q.is_simple("red ring") and not Q.is_simple("a b c d") and not Q.is_simple("a-b!")
    assert Q.page(500, -3) == (100, 0) and Q.page() == (10, 0)
    assert search.page_meta(25, 10, 10) == {"current_page": 2, "total_pages": 3, "page_size": 10, "has_next": True, "has_previous": True}
    assert Q.Wildcard("f", "a.b*").regex == r"(?i)^a\.b.*$"


def test_three_valued_filters(spark):
    df = spark.createDataFrame([(1, "5", True), (2, None, None), (3, "7", False)], "id int, f string, is_active boolean")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(P.filter_condition({"bool": {"must_not": [{"term": {"f": "5"}}]}})) == [3]
    assert ids(P.filter_condition({"term": {"f": 5}})) == [1] and ids(P.filter_condition({"term": {"is_active": True}})) == [1, 2]
    assert ids(P.filter_condition({"range": {"f": {"gt": 5}}})) == [3] and ids(P.filter_condition({"range": {"f": {"weird": "5"}}})) == [1]
    with pytest.raises(ValueError):
        P.filter_condition({"geo": {}})
    assert ids(P.filter_condition({"bool": {"must": [{"geo": {}}]}})) == [1, 2, 3]


def test_like_escapes(spark):
    df = spark.createDataFrame([("50% off",), ("50 off",)], "name string")
    assert df.where(P.term_condition("name", "50%")).count() == 1


def test_classifier(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["Red Ring", "red rings ltd", "the red ring", "ring red", "red rinf", "zzz"])], "document_id int, name string")
    got = {r.name: (r.tier, r.match_type) for r in ranking.classify(df, "red ring").collect()}
    assert got["Red Ring"] == (3, "perfect") and got["red rings ltd"] == (3, "prefix") and got["the red ring"] == (3, "substring") and got["ring red"] == (3, "all_words")
    assert got["red rinf"] == (2, "fuzzy") and got["zzz"] == (1, "other")
    typo = {r.name: r.match_type for r in ranking.classify(df, "rde rnig", corrected=("red ring", 0.8)).collect()}
    assert typo["Red Ring"] == "typo_corrected_perfect"


def test_locations():
    assert geo.parse_location("food near me", (1.0, 2.0))["kind"] == "user" and geo.parse_location("food") is None
    assert geo.parse_location("food in lagos island")["kind"] == "area" and geo.parse_location("x in abuja 3 miles")["radius"] == pytest.approx(3 * K.MILE_M)
    assert geo.parse_location("at 6.5, 3.4 within 2km")["radius"] == 2000 and geo.place(" Lagos ")[2] == "city" and nlp.simplified(["hotel"], "inn in abuja") == "hotel in abuja"


def test_schema(spark):
    df = spark.createDataFrame([(1, '{"email":"a@b.co","url":"https://x.y","day":"2024-01-02","code":"abc","long":"two words","n":3,"f":1.5,"b":true,"o":{"a":1},"l":[1],"z":null}')], "document_id int, content string")
    got = {r.path: r.kind for r in schema.infer_mapping(df).collect()}
    assert got == {"email": "keyword", "url": "keyword", "day": "date", "code": "keyword", "long": "text", "n": "integer", "f": "float", "b": "boolean", "o": "object", "l": "array"}
    v = spark.createDataFrame([], "name string, version int, schema string")
    v = schema.register(schema.register(v, "s", "1"), "s", "2")
    assert [tuple(r) for r in schema.latest(v).collect()] == [("s", 2, "2")]
    m = schema.mapping_of(spark.createDataFrame([], "name string, a struct<b: int>, tags array<string>, at timestamp").schema)
    assert m["name"]["fields"] and m["a.b"]["type"] == "integer" and m["tags.array"]["type"] == "text" and m["at"]["type"] == "date"
    assert schema.analyzers_of(m)["a.b"]["analyzer"] == "keyword"
    assert "extra: unknown field" in schema.validate(spark.createDataFrame([(1,)], "extra int"), {}, strict=True).first().errors


def test_store_and_catalog(spark, tmp_path):
    old = spark.createDataFrame([("i", 1, "a", 1), ("i", 2, "b", 1)], "index_name string, document_id int, v string, t int")
    new = spark.createDataFrame([("i", 2, "c", 2), ("i", 3, "d", 2)], old.schema)
    get = lambda df: sorted((r.document_id, r.v) for r in df.collect())
    assert get(store.upsert(old, new, store.KEY, ["t"])) == [(1, "a"), (2, "c"), (3, "d")] and get(store.upsert(old, new, store.KEY, ["t"], True)) == [(1, "a"), (2, "b"), (3, "d")]
    assert get(store.delete(old, new, store.KEY)) == [(1, "a")]
    store.write(old, str(tmp_path / "docs"))
    assert store.scan(spark, str(tmp_path / "docs"), "i").count() == 2 and store.scan(spark, str(tmp_path / "docs"), "j").count() == 0
    (tmp_path / "w.dic").write_text("# no\n\nApple/XY\nab\nPear\n")
    assert sorted(r.word for r in store.word_list(spark, str(tmp_path / "w.dic")).collect()) == ["apple", "pear"]
    c = catalog.update(catalog.create(catalog.empty(spark), "i", {"a": 1}), "i", {"b": 2}, status="closed")
    assert catalog.get(c, "i") == {"name": "i", "settings": {"a": 1, "b": 2}, "mappings": {}, "status": "closed", "documentCount": 0}
    assert catalog.get(catalog.reconcile(c, old), "i")["documentCount"] == 2
    with pytest.raises(ValueError):
        catalog.create(c, "i")
    with pytest.raises(KeyError):
        catalog.get(c, "none")
    assert [x.count() for x in catalog.delete(c, old, "i")] == [0, 0]


def test_delete_by_query_refuses_all(spark):
    with pytest.raises(ValueError):
        search.delete_by_query(spark.range(1), {})


def test_index_merge_is_incremental(spark):
    docs = synthetic.businesses(spark, 60)
    whole = index.postings(docs, ["name"], positions=True)
    halves = index.merge_postings(index.postings(docs.where("document_id < 30"), ["name"], positions=True), index.postings(docs.where("document_id >= 30"), ["name"], positions=True))
    key = lambda r: (r.document_id, r.term, r.tf, r.positions)
    assert sorted(map(key, whole.collect())) == sorted(map(key, halves.collect()))


def test_cover_density(spark):
    p = spark.createDataFrame([(1, "a", [0, 5]), (1, "b", [1]), (2, "a", [0]), (2, "c", [3])], "document_id int, term string, positions array<int>")
    assert [(r.document_id, r.score) for r in index.cover_density(p, ["a", "b"]).collect()] == [(1, pytest.approx(1 / 2 + 1 / 5))]


def test_search_response(spark):
    r = search.search(synthetic.businesses(spark, 300), search.Request("hotel", ["name"], size=3, facets=["city"], highlight=["name"], filter={"term": {"is_active": True}}))
    e = r.envelope(3)
    assert e["total"] > 3 and len(e["hits"]) == 3 and all("<em>Hotel</em>" in h["highlight_name"] for h in e["hits"])
    assert sum(x["count"] for x in r.facets.collect()) == e["total"]
    ranked = search.ranked(synthetic.businesses(spark, 300).withColumn("updated_at", F.lit(None).cast("date")), "hotel", F.current_date()).collect()
    assert len(ranked) and ranked == sorted(ranked, key=lambda x: -x.final_score)


def test_suggestions(spark):
    words = spark.createDataFrame([("bolt", 5), ("bold", 3), ("ring", 2)], "term string, total_frequency int")
    got = suggest.correct(spark.createDataFrame([("blot",)], "query string"), suggest.symspell_index(words)).first()
    assert got.corrected == "bolt" and got.confidence <= 0.95
    assert suggest.looks_correct("ab", set()) and suggest.looks_correct("red xx", {"red"}) and not suggest.looks_correct("xyz", {"red"})


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "vec_id int, embedding array<float>")
    assert [(r.vec_id, round(r.similarity, 4)) for r in vector.semantic_search(v, [1.0, 0.0]).collect()] == [(1, 1.0), (2, 0.7071)]


def test_plans_prune_and_push(spark):
    from querna import catalogue

    plan = catalogue.queries()["filter_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "o_custkey" not in plan
    plan = catalogue.queries()["bm25_multi_field"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "p_size" not in plan


def test_global_rank(spark):
    import random

    from querna.plans.ranks import global_rank

    r = random.Random(1)
    rows = [(i, r.choice([None, float(r.randrange(40)), r.random()])) for i in range(500)]
    got = {x.k: x.rank for x in global_rank(spark.createDataFrame(rows, "k int, s double"), "s", "k", buckets=8).collect()}
    want = sorted(rows, key=lambda t: (t[1] is None, -(t[1] or 0), t[0]))
    assert [got[k] for k, _ in want] == list(range(1, 501))
    assert global_rank(spark.createDataFrame([], "k int, s double"), "s", "k").collect() == []
