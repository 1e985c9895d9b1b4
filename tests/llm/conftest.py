import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use inside.
CLASH = ["n", "key", "part", "size", "bucket", "words", "row", "chunk", "a", "b", "rep", "comp", "anchor", "hits", "spans", "quality", "keep", "stretch", "slot", "tokens", "chars", "once", "gram", "__id2", "__id", "__text", "__lost", "__again", "a.b", "c`d", "class", "tie", "cut", "text_id", "members", "marked", "first"]


def make(spark, rows):
    """rows: (doc_id, text); other columns filled in."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def prose(r: random.Random, n: int, vocabulary: int = 500) -> str:
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture()
def hard(spark):
    """Nulls in every column, empty and wordless texts, repeated rows, ties, a very long text, clashing names."""
    from pyspark.sql import functions as F

    r = random.Random(1)
    p = prose(r, 80)
    rows = [(1, p), (2, p), (2, p), (3, None), (None, p), (None, None), (4, ""), (5, "  \n\t "), (6, prose(r, 60_000, 5000)), (7, "x" * 70_000), (8, "one"), (9, p + " tail"), (10, "é 世 \U0001f600\n" * 30)]
    df = make(spark, rows).withColumn("lang", F.when(F.col("doc_id") > 4, F.col("lang"))).withColumn("source", F.when(F.col("doc_id") != 2, F.col("source")))
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH))


@pytest.fixture()
def empty(spark):
    return make(spark, [])
