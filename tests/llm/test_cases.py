"""Every operator and stage on hard rows and on empty tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from querna.llm import bloom_lm, jaccard_join, line_crf, multi_index, packing, pii, quality_rules, sentencepiece_scan, sharding, suffix_dedup

from .conftest import make

LABELS = "doc_id long, quality int, toxic int"


def crf(docs):
    spark = docs.sparkSession
    return line_crf.classify(docs, line_crf.train(docs, spark.createDataFrame([(1, 1, 0), (8, 0, 0), (None, 1, 0), (5, None, None)], LABELS)))


PER_ROW = {"1": crf, "4": bloom_lm.score, "6": lambda docs: sentencepiece_scan.encode(docs, sentencepiece_scan.MODEL), "7": sharding.assign, "8": quality_rules.quality}
OTHERS = {"2": packing.pack, "5": jaccard_join.near_duplicate_groups, "9": pii.find_pii, "10": suffix_dedup.repeated_passages}


@pytest.mark.parametrize("n", PER_ROW)
def test_one_row_a_row(hard, n):
    got = sorted((-1 if r.doc_id is None else r.doc_id) for r in PER_ROW[n](hard).collect())
    assert got == sorted((-1 if r.doc_id is None else r.doc_id) for r in hard.select("doc_id").collect())


@pytest.mark.parametrize("n", [*PER_ROW, *OTHERS])
def test_empty_table(empty, n):
    assert (PER_ROW | OTHERS)[n](empty).collect() == []


def test_packing_hard_rows(hard):
    got = sorted((-1 if r.doc_id is None else r.doc_id) for r in packing.pack(hard).where("piece = 0").collect())
    assert got == sorted((-1 if r.doc_id is None else r.doc_id) for r in hard.select("doc_id").collect())


def test_groups_and_classes_of_hard_rows(hard):
    got = sorted((r.doc_id, r.group_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicate_groups(hard).collect())
    assert got == [(1, 1, 1, 1), (2, 1, 1, 1), (9, 1, 9, 1)]


def test_pii_of_hard_rows(hard):
    assert pii.find_pii(hard).collect() == []
    assert sorted(map(str, pii.redact(hard).collect())) == sorted(map(str, hard.collect()))


def test_passages_of_hard_rows(hard):
    got = sorted((r.doc_id, r.removed, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(hard).collect())
    assert got == [(1, False, 0, 80), (2, False, 0, 80), (2, True, 0, 80), (9, False, 0, 80), (9, True, 0, 80)]
    kept = sorted((-1 if r.doc_id is None else r.doc_id, (r.text or "")[:4]) for r in suffix_dedup.cut_passages(hard).collect())
    whole = sorted((-1 if r.doc_id is None else r.doc_id, (r.text or "")[:4]) for r in hard.collect() if r.doc_id not in (2, 9))
    assert kept == sorted([*whole, (9, "tail")]) or kept == sorted([*whole, (9, " tai")])


def test_passages_with_other_kinds_of_n_chars(spark):
    p = " ".join(f"w{i}" for i in range(60))
    docs = make(spark, [(1, p), (2, p + " tail")]).withColumn("n_chars", F.lit("many"))
    assert {r.doc_id: r.n_chars for r in suffix_dedup.cut_passages(docs).collect()} == {1: "many", 2: str(len("tail"))}
    assert {r.n_chars for r in pii.redact(docs).collect()} == {"many"}


def test_decode_hard_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (None, []), (3, [1, 2]), (3, [1, 2])], "doc_id long, ids array<int>")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in sentencepiece_scan.decode(rows, sentencepiece_scan.MODEL).collect())
    assert [i for i, _ in got] == [-1, 1, 2, 3, 3] and [t for _, t in got][:3] == ["", "", ""]
    assert sentencepiece_scan.decode(rows.limit(0), sentencepiece_scan.MODEL).collect() == []


def test_wordless_quality_is_zero(hard):
    got = {r.doc_id: (r.quality, r.keep) for r in quality_rules.quality(hard).collect()}
    assert got[3] == got[4] == got[5] == (0.0, False)


def test_groups_of_hard_rows(hard):
    got = {r.doc_id: r.group_id for r in jaccard_join.near_duplicate_groups(hard).collect()}
    assert got == {1: 1, 2: 1, 9: 1}


def test_scores_of_hard_rows(hard):
    got = {r.doc_id: r for r in bloom_lm.score(hard).collect()}
    assert got[4].n_words == 0 and got[4].perplexity is None and got[4].log_prob == 0
    assert got[6].n_words == 60_000


def test_packing_holds_every_word(hard):
    rows = packing.pack(hard, capacity=100).collect()
    assert sum(r.n_words for r in rows) == sum(len((r.text or "").split()) for r in hard.collect())
    bins = {}
    for r in rows:
        bins.setdefault((r.stretch, r.sequence), []).append((r.begin, r.n_words))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) <= 100
        assert all(a + n <= b for (a, n), (b, _) in zip(parts, parts[1:]))


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, v string, part int"
    assert multi_index.neighbours(spark.createDataFrame([], schema)).collect() == []
    v = [1.0, 0.0, 0.5, 0.25]
    rows = [(1, v, 0, "x", 1), (2, v, 0, "x", 1), (3, [0.0, 1.0, 0.0, 0.0], None, None, None), (None, v, 0, "x", 1), (4, None, 0, "x", 1), (5, [1.0], 0, "x", 1), (6, [float("nan")] * 4, 0, "x", 1), (1, v, 0, "x", 1), (7, [1.0, None, 0.0, 0.0], 0, "x", 1)]
    got = {}
    for r in multi_index.neighbours(spark.createDataFrame(rows, schema), k=5).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id, r.distance))
    assert set(got) == {1, 2, 3}
    assert sorted(got[1])[0] == (1, 2, 0.0) and [x[1] for x in sorted(got[3])] == [1, 2]


def test_stages_on_hard_rows(spark, hard, empty, tmp_path):
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, hard, str(tmp_path))
        out.write.parquet(str(tmp_path / f"{name}"))
        assert stage(spark, empty, str(tmp_path)).collect() == []
        if i < 4:
            assert out.columns == hard.columns and [t for _, t in out.dtypes] == [t for _, t in hard.dtypes]


def test_near_duplicate_stage_keeps_one(spark, hard):
    kept = [r.doc_id for r in jaccard_join.drop_near_duplicates(hard).select("doc_id").collect()]
    assert sorted(i for i in kept if i) == [1, 3, 4, 5, 6, 7, 8, 10] and kept.count(None) == 2


def test_null_labels_and_no_labels(spark, hard):
    model = line_crf.train(hard, spark.createDataFrame([], LABELS))
    assert all(r.quality == 0.5 for r in line_crf.classify(hard, model).where("doc_id in (1, 2)").collect())


def test_other_columns_stay(spark):
    docs = make(spark, [(1, "mail me at anna.lee@post.example.com now"), (2, "nothing here")]).withColumn("score", F.lit(3)).withColumn("kind", F.lit("k"))
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "mail me at <EMAIL> now" and got[1].n_chars == len(got[1].text) and got[1].score == 3 and got[2].text == "nothing here"
