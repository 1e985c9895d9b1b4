"""The stored index and dictionary, plans and corner cases of the search engine."""

import re

import pytest
from pyspark.sql import functions as F

from querna import catalogue
from querna import constants as K
from querna.functions import fuzzy
from querna.operators import dictionary, search, stored, suggest, textsearch
from querna.operators import index as I
from querna.plans import query as Q
from querna.sources import store
from querna.streaming import ingest

from .test_queries import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def docs(spark):
    rows = [(1, "red ring of red", "a"), (2, "ring", "red"), (3, None, None), (4, "", "b"), (5, "The THE the", "c"), (6, "blue Ring ring", "a")]
    return spark.createDataFrame(rows, "document_id long, name string, category_name string")


def test_postings_shuffle_nothing(docs):
    p = I.postings(docs, ["name"], positions=True)
    assert "Exchange" not in plan(p)
    got = {(r.document_id, r.term): (r.tf, r.field_length, r.positions) for r in p.collect()}
    assert got == {(1, "red"): (2, 3, [0, 2]), (1, "ring"): (1, 3, [1]), (2, "ring"): (1, 1, [0]), (6, "blue"): (1, 3, [0]), (6, "ring"): (2, 3, [1, 2])}


def test_postings_are_those_of_the_column_analyzer(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("doc_id", "document_id")
    key = lambda rows: sorted((r.document_id, r.term, r.tf, r.field_length, r.positions) for r in rows)
    assert key(I.postings(d, ["text"], positions=True).collect()) == key(I.postings(d, ["text"], positions=True, analyzer=lambda c: I.analyzed(c)).collect())


def test_index_reads_the_buckets_of_its_terms(spark, docs, tmp_path):
    at = f"file://{tmp_path}/index"
    with pytest.raises(FileNotFoundError):
        stored.read(spark, at)
    stored.build(docs, at, ["name", "category_name"], buckets=16)
    one = stored.read(spark, at, ["red"])
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan(one)) and re.search(r"PushedFilters: \[[^\]]*term", plan(one))
    assert len(one.inputFiles()) >= 1 and sorted((r.document_id, r.field) for r in one.collect()) == [(1, "name"), (2, "category_name")]
    assert stored.has_term(spark, at, "blue") and not stored.has_term(spark, at, "green")
    stats = {r.field: (r.doc_count, r.total_length) for r in stored.field_statistics(spark, at).collect()}
    assert stats["name"] == (6, 7)


def test_index_changes_make_new_generations(spark, docs, tmp_path):
    at = f"file://{tmp_path}/index"
    stored.build(docs, at, ["name"], buckets=4)
    stored.remove(spark, at, docs.where("document_id = 6"))
    assert not stored.has_term(spark, at, "blue")
    stored.upsert(spark.createDataFrame([(2, "green plate", None), (7, "blue", None)], docs.schema), at, ["name"])
    assert sorted(r.document_id for r in stored.read(spark, at, ["ring", "blue", "green"]).collect()) == [1, 2, 7]
    assert stored.generations(spark, at) == [1, 2]
    stored.rebuild(docs, at, ["name"])
    assert stored.has_term(spark, at, "ring") and not stored.has_term(spark, at, "green")


def test_no_task_holds_more_of_an_index_than_its_own_documents(spark, tmp_path):
    """However few the buckets."""
    at = f"file://{tmp_path}/index"
    d = spark.range(0, 2400, 1, 24).selectExpr("id as document_id", "concat('all same w', id) as name")
    stored.build(d, at, ["name"], buckets=1)
    files = stored.read(spark, at).groupBy(F.input_file_name()).count()
    assert files.agg(F.max("count")).first()[0] == 300 and stored.read(spark, at, ["same"]).count() == 2400


def test_buckets_are_bounded(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "BUCKET_POSTINGS", 1)
    monkeypatch.setattr(stored, "MOST_BUCKETS", 5)
    at = f"file://{tmp_path}/index"
    stored.build(docs, at, ["name"])  # 7 tokens
    assert stored.field_statistics(spark, at).first()["buckets"] == 5 and stored.has_term(spark, at, "ring")


@pytest.mark.parametrize("words, want", [(["red", "ring"], {1: [0]}), (["ring", "ring"], {6: [1]}), (["ring", "red", "red"], {}), (["none"], {})])
def test_phrases_from_positions(spark, docs, tmp_path, words, want):
    at = f"file://{tmp_path}/index"
    stored.build(docs, at, ["name"], buckets=4)
    assert {r.document_id: r.begins for r in stored.phrase(spark, at, words, "name").collect()} == want


def test_posting_lists_leave_out_invalid_entries(spark):
    p = spark.createDataFrame([(1, "f", "t", 2, [0, 3]), (None, "f", "t", 1, [0]), (2, "f", "t", 0, [])], "document_id long, field string, term string, tf long, positions array<int>")
    lists = stored.serialise(p)
    assert [r.entries for r in lists.collect()] == [1]
    assert [tuple(r) for r in stored.deserialise(lists).collect()] == [(1, "f", "t", 2, [0, 3])]


def covers(spots: list[tuple[int, int, float]], n: int) -> float:
    """Cover density of (position, word, weight) by trying every interval."""
    spots, total = sorted(spots), 0.0
    for i in range(len(spots)):
        for j in range(i, len(spots)):
            inside = spots[i : j + 1]
            if {w for _, w, _ in inside} == set(range(n)) and all({w for _, w, _ in x} != set(range(n)) for x in (inside[1:], inside[:-1])):
                total += len(inside) / sum(1 / v for *_, v in inside) / (1 + inside[-1][0] - inside[0][0] - (j - i))
    return total


def test_cover_density_against_all_intervals(spark):
    import random

    r, rows = random.Random(5), []
    for i in range(60):
        rows.append((i, " ".join(r.choice("abcxyz") for _ in range(r.randrange(12))), " ".join(r.choice("abx") for _ in range(r.randrange(5)))))
    d = spark.createDataFrame(rows, "document_id long, name string, category_name string")
    got = {x.document_id: x.s for x in d.select("document_id", textsearch.density(["name", "category_name"], "x y", True).alias("s")).collect()}
    loose = {x.document_id: x.s for x in d.select("document_id", textsearch.density(["name", "category_name"], "x y", False).alias("s")).collect()}
    for i, name, cat in rows:
        words = [(k, w, 1.0) for k, w in enumerate(name.split())]
        words += [(len(name.split()) + k, w, 0.4) for k, w in enumerate(cat.split())]
        spots = [(k, "xy".index(w), v) for k, w, v in words if w in "xy"]
        assert got[i] == pytest.approx(covers(spots, 2)) and loose[i] == pytest.approx(sum(v for *_, v in spots))


def test_late_older_events_do_not_win(spark, tmp_path):
    at, schema = f"file://{tmp_path}", "document_id long, ts timestamp, name string"
    for n, rows in enumerate([[(1, "2024-01-02", "new"), (2, "2024-01-01", "b")], [(1, "2024-01-01", "late"), (2, "2024-01-01", "a")]]):
        spark.createDataFrame(rows, "document_id long, ts string, name string").selectExpr("document_id", "cast(ts as timestamp) as ts", "name").coalesce(1).write.mode("append").parquet(f"{at}/in")
        ingest.index_batches(ingest.read(spark, f"{at}/in", schema, 1), f"{at}/out", f"{at}/checkpoint", ["name"]).awaitTermination()
    now = {r.document_id: r.name for r in ingest.current(spark, f"{at}/out").collect()}
    assert now == {1: "new", 2: "a"}
    assert sorted((r.document_id, r.term) for r in ingest.current_postings(spark, f"{at}/out").collect()) == [(1, "new")]
    assert tuple(ingest.progress(spark, f"{at}/out").first()) == (4, 2)
    assert {r.path for r in spark.read.parquet(f"{at}/out/mapping").collect()} == {"document_id", "ts", "name"}


def test_upsert_ties_are_no_chance(spark):
    old = spark.createDataFrame([(1, 0, "old")], "id long, o int, v string")
    new = spark.createDataFrame([(1, 1, "x"), (1, 1, "y")], old.schema)
    for n in (1, 2, 5):
        assert [r.v for r in store.upsert(old, new.repartition(n), ["id"], ["o"]).collect()] == ["y"]


def test_dictionary_refresh_of_one_index(spark, tmp_path):
    at = f"file://{tmp_path}"
    make = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    dictionary.refresh(make("alpha", "alpha", "beta", "beta"), at, "one", ["name"])
    dictionary.refresh(make("gamma", "gamma"), at, "two", ["name"])
    dictionary.refresh(make("delta", "delta", "delta"), at, "one", ["name"])
    have = lambda i: {r.term: r.total_frequency for r in dictionary.load(spark, at, i).collect()}
    assert have("one") == {"delta": 3} and have("two") == {"gamma": 2}
    assert [r.corrected for r in dictionary.stored_correct(spark, at, "one", ["dlta"]).collect()] == ["delta"]
    assert dictionary.stored_correct(spark, at, "two", ["dlta"]).collect() == []
    assert dictionary._deletes("abc") == {r.k for r in spark.range(1).select(F.explode(fuzzy.deletes(F.lit("abc"), 2)).alias("k")).collect()}


def test_spelling_is_the_last_stage(spark):
    terms = spark.createDataFrame([("widget", 3)], "term string, total_frequency long")
    english = spark.createDataFrame([("hello",), ("world",)], "word string")
    asked = spark.createDataFrame([("helo wrld*",), ("wdget",), ("zzzzzzzz",), ("",)], "query string")
    got = {r.query: (r.corrected, r.source) for r in dictionary.correct_queries(asked, terms, suggest.symspell_index(terms), english).collect()}
    assert got == {"helo wrld*": ("hello world", "spelling"), "wdget": ("widget", "symspell"), "zzzzzzzz": ("zzzzzzzz", "none"), "": ("", "none")}


def test_suggestions_come_from_documents_where_the_view_has_none(spark):
    none = spark.createDataFrame([], "term string, field_types array<string>, total_frequency long, trigrams array<string>")
    docs = spark.createDataFrame([(1, "harbour")], "document_id long, name string")
    assert [r.text for r in dictionary.suggestions(none, docs, "harbor").collect()] == ["harbour"]
    assert dictionary.suggestions(none, docs, "h").collect() == []


def test_fuzziness_follows_word_length():
    q = Q.parse({"match": {"name": {"query": "ab abcd abcdefg", "fuzziness": "auto"}}})
    assert [t.fuzziness for t in q.must] == [0, 1, 2]
    assert Q.parse({"match": {"name": "ab"}}).fuzziness == 0


def test_whole_search_takes_the_correction_and_the_place(spark):
    rows = [(1, "pencil store", 90.0, 4.0, True, False, None, 6.5083, 3.3833), (2, "pencil shop", 80.0, 3.0, True, False, None, 9.0, 7.0), (3, "hotel", 50.0, 1.0, None, None, None, 6.5083, 3.3833)]
    docs = spark.createDataFrame(rows, "document_id long, name string, health double, rating double, is_verified boolean, is_featured boolean, updated_at timestamp, lat double, lng double")
    as_of = F.lit("2024-01-01").cast("date")
    near = search.search_near(docs, "pensil in yaba", as_of, known={"pencil"}, corrected="pencil in yaba").envelope()
    assert [h["document_id"] for h in near["hits"]] == [1] and near["total"] == 1 and near["max_score"] > 10_000
    anywhere = search.search_near(docs, "pencil", as_of).envelope()
    assert [h["document_id"] for h in anywhere["hits"]] == [1, 2]
    mine = search.search_near(docs, "pencil near me", as_of, user=(9.0, 7.0)).envelope()
    assert [h["document_id"] for h in mine["hits"]] == [2]


def test_every_query_but_stemming_has_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"porter_stem"}


def test_labels_weigh_as_published():
    assert [K.LABEL_WEIGHTS[x] for x in "DCBA"] == [0.1, 0.2, 0.4, 1.0] and stored.label_weight("unknown") == 0.1


def test_few_lists_find_most(spark):
    import numpy as np

    from querna.operators import vector

    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 8)) * 3
    x = np.concatenate([c + r.normal(size=(40, 8)) for c in centres])
    lists = vector.inverted_lists(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 20)
    unit, hit = x / np.sqrt((x * x).sum(1, keepdims=True)), []
    for i in range(0, 800, 80):
        best = set(np.argsort(-(unit @ unit[i]), kind="stable")[:10].tolist())
        hit.append(len(best & {r.vec_id for r in vector.probe(lists, x[i].tolist(), 5, -1.0).collect()}) / 10)
    assert np.mean(hit) >= 0.9


def test_live_normalisation_and_own_synonyms():
    from querna.functions import nlp

    assert [Q.normalize_live(s) for s in ("  A   b* ", " ", None)] == ["A b*", "*", "*"]
    assert nlp.synonyms({"bank": ["till", "bank"], "new": ["fresh"]})["new"] == ["fresh"] and "till" in nlp.synonyms({"bank": ["till"]})["bank"]
