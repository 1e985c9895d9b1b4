
from querna import catalogue
from querna.operators import suggest

from .test_queries import SF


def test_lateral_outer_words_keeps_whole_turns(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'").collect()
    got = {}
    for r in catalogue.queries()["lateral_outer"](spark, SF).collect():
        got.setdefault((r.conv_id, r.turn), []).append(r.word)
    assert any(len(t.text.split(" ")) > 3 for t in turns)
    assert all(got[t.conv_id, t.turn] == t.text.split(" ") for t in turns)


def test_correct_ranks_all_candidates(spark):
    terms = spark.createDataFrame([(f"small{a}{b}", 1) for a in "abcdefghij" for b in "klmnopqr"], "term string, total_frequency long")
    r = suggest.correct(spark.createDataFrame([("small",)], "query string"), suggest.symspell_index(terms)).collect()
    assert [x.n_suggestions for x in r] == [80]
