"""The stored inverted index: postings by term in the shared folder, read by the terms asked for.

Layout of an index folder: ``generation=<n>/postings/bucket=<b>`` with rows sorted by
term, ``generation=<n>/documents`` with the length of every field of every document,
and ``generation=<n>/fields`` with the fields' statistics, which is written last: a
generation without it isn't complete and isn't read.  A bucket is crc32(term) modulo the number of buckets, so a reader
knows the folders of its terms without reading anything.  Postings are written where they are made: a task sorts
those of its own documents and adds a file to each bucket, so nothing is shuffled, no task holds more than its share of
the documents, and a term that a third of all documents hold is never one task's.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querna import constants as K
from querna.operators import index as I

#: Postings that a bucket holds about, up to so many buckets; more would be files in the square of the documents.
BUCKET_POSTINGS, MOST_BUCKETS = 20_000_000, 64
#: Documents a block of a serialised posting list, on average.
LIST_BLOCK = 1_000


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def generations(spark: SparkSession, path: str) -> list[int]:
    """The complete generations, the newest last."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("generation=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "fields/_SUCCESS")):
            out.append(int(name.partition("=")[2]))
    return sorted(out)


def _at(spark: SparkSession, path: str) -> str:
    have = generations(spark, path)
    if not have:
        raise FileNotFoundError(f"no index at {path}")
    return f"{path}/generation={have[-1]}"


def _write(spark: SparkSession, path: str, postings: DataFrame, lengths: DataFrame, buckets: int | None = None) -> None:
    """A new generation; older ones but the last are deleted."""
    have = generations(spark, path)
    at = f"{path}/generation={have[-1] + 1 if have else 0}"
    lengths.write.mode("overwrite").parquet(f"{at}/documents")
    stats = I.field_stats(spark.read.parquet(f"{at}/documents"))
    if not buckets:
        tokens = stats.agg(F.sum("total_length")).first()[0] or 0
        buckets = min(MOST_BUCKETS, max(1, math.ceil(tokens / BUCKET_POSTINGS)))
    p = postings.withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int"))
    p.sortWithinPartitions("bucket", "term", "field").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/postings")
    stats.withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{at}/fields")
    fs, _ = _fs(spark, path)
    for old in have[:-1]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/generation={old}"), True)


def build(docs: DataFrame, path: str, fields: list[str], key: str = "document_id", buckets: int | None = None) -> None:
    """Indexes all documents anew (IDX-09, IDX-11); ``buckets`` follow from the number of tokens where not given."""
    _write(docs.sparkSession, path, I.postings(docs, fields, key, positions=True), I.doc_lengths(docs, fields, key), buckets)


rebuild = build


def read(spark: SparkSession, path: str, terms: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """(key, field, term, tf, field_length, positions) of the terms: their buckets' folders alone, and
    of these the row groups that may hold them; all postings where terms is None."""
    at = _at(spark, path)
    p = spark.read.parquet(f"{at}/postings")
    if terms is not None:
        n = field_statistics(spark, path).select("buckets").first()[0]
        buckets = sorted({zlib.crc32(t.encode()) % n for t in terms})
        p = p.where(F.col("bucket").isin(buckets) & F.col("term").isin(sorted(set(terms))))
    return (p.where(F.col("field").isin(fields)) if fields else p).drop("bucket")


def field_statistics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{_at(spark, path)}/fields")


def lengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{_at(spark, path)}/documents")


def has_term(spark: SparkSession, path: str, term: str) -> bool:
    return not read(spark, path, [term]).isEmpty()


def bm25(spark: SparkSession, path: str, terms: list[str], fields: list[str] | None = None, weights: dict[str, float] | None = None, key: str = "document_id") -> DataFrame:
    """(key, score) from the stored postings and statistics; no document is read."""
    return I.bm25_from_postings(read(spark, path, terms, fields), field_statistics(spark, path), None, terms, weights, key)


def phrase(spark: SparkSession, path: str, words: list[str], field: str, key: str = "document_id") -> DataFrame:
    """(key, field, begins): where the words stand next to each other, stop words left out; from positions alone."""
    p = read(spark, path, words, [field])
    def begins(i: int) -> Column:
        return F.transform("positions", lambda x: x - i)

    starts = [begins(i) for i in range(len(words))]
    which = F.coalesce(*[F.when(F.col("term") == w, s) for w, s in reversed(list(zip(words, starts)))])
    if len(set(words)) == len(words):
        met = p.select(key, "term", which.alias("at")).groupBy(key).agg(F.collect_list("at").alias("ats"))  # one array a word
        met = met.where(F.size("ats") == len(words))
    else:
        per = [p.where(F.col("term") == w).select(key, s.alias("at")) for w, s in zip(words, starts)]
        met = per[0].select(key, F.array("at").alias("ats"))
        for x in per[1:]:
            met = met.join(x, key).select(key, F.concat("ats", F.array("at")).alias("ats"))
    both = F.aggregate(F.slice("ats", 2, F.size("ats") - 1), F.get("ats", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return met.select(key, F.lit(field).alias("field"), F.sort_array(both).alias("begins")).where(F.size("begins") > 0)


def remove(spark: SparkSession, path: str, ids: DataFrame, key: str = "document_id") -> None:
    """Drops documents from postings and statistics (IDX-02, IDX-10); a term without postings is gone."""
    gone = ids.select(key).distinct()
    kept, left = read(spark, path).join(gone, key, "left_anti"), lengths(spark, path).join(gone, key, "left_anti")
    _write(spark, path, kept, left)


def upsert(docs: DataFrame, path: str, fields: list[str], key: str = "document_id") -> None:
    """Replaces the postings of these documents (IDX-04, IDX-09); ids that repeat must be resolved before."""
    spark = docs.sparkSession
    gone = docs.select(key).distinct()
    left = lengths(spark, path).join(gone, key, "left_anti").unionByName(I.doc_lengths(docs, fields, key))
    kept = read(spark, path).join(gone, key, "left_anti").unionByName(I.postings(docs, fields, key, positions=True))
    _write(spark, path, kept, left)


def set_frequency(p: DataFrame, changes: DataFrame, key: str = "document_id") -> DataFrame:
    """Postings with the frequencies of ``changes`` (key, field, term, tf); those of 0 or less go (IDX-06)."""
    new = changes.select(key, "field", "term", F.col("tf").alias("new_tf"))
    return p.join(new, [key, "field", "term"], "left").withColumn("tf", F.coalesce("new_tf", "tf")).drop("new_tf").where("tf > 0")


def serialise(p: DataFrame, key: str = "document_id") -> DataFrame:
    """(field, term, block, entries, postings): posting lists as JSON in blocks of about LIST_BLOCK documents
    (IDX-07, IDX-08); entries without an id or a positive frequency are left out."""
    ok = p.where(F.col(key).isNotNull() & (F.col("tf") > 0))
    size = ok.groupBy("field", "term").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("blocks"))
    blocked = ok.join(size, ["field", "term"]).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    entry = F.struct(F.col(key).alias("docId"), F.col("tf").alias("frequency"), F.col("positions"))
    return blocked.groupBy("field", "term", "block").agg(F.count("*").alias("entries"), F.to_json(F.sort_array(F.collect_list(entry))).alias("postings"))


def deserialise(lists: DataFrame, kind: str = "long", key: str = "document_id") -> DataFrame:
    e = F.explode(F.from_json("postings", f"array<struct<docId:{kind},frequency:long,positions:array<int>>>"))
    return lists.select("field", "term", e.alias("e")).select(F.col("e.docId").alias(key), "field", "term", F.col("e.frequency").alias("tf"), "e.positions")


# the vector's labels and what they weigh


def label_weight(field: str) -> float:
    return K.LABEL_WEIGHTS[K.VECTOR_LABELS.get(field, "D")]


def entries(tokens: list[tuple[str, Column]], words: list[str]) -> Column:
    """array<struct(t, pos, inv)>: where the words stand in the concatenated fields, in order, with 1 / weight of the field's label."""
    ws = F.array(*[F.lit(w) for w in words])

    def one(t: Column, before: Column, inv: float) -> Column:
        at = F.transform(t, lambda x, i: F.struct((F.array_position(ws, x) - 1).cast("int").alias("t"), (i + before).cast("int").alias("pos"), F.lit(inv).alias("inv")))
        return F.filter(at, lambda e: e["t"] >= 0)

    out, before = [], F.lit(0)
    for field, t in tokens:
        out.append(one(t, before, 1.0 / label_weight(field)))
        before = before + F.size(t)
    return F.concat(*out)


def any_rank(e: Column) -> Column:
    """Any word covers the query: each occurrence is an extent of one word, worth its label's weight."""
    return F.aggregate(e, F.lit(0.0), lambda s, x: s + 1.0 / x["inv"])


def cover_rank(e: Column, words: int) -> Column:
    """All words must be covered: each shortest extent adds the mean weight of the words in it,
    harmonically, over one more than the words between them that aren't asked for."""
    seat = "struct<k:int,pos:int,cum:double>"
    start = F.struct(
        F.lit(0).alias("k"), F.lit(0.0).alias("cum"), F.array_repeat(F.lit(None).cast(seat), words).alias("last"), F.lit(-1).alias("low"), F.lit(0.0).alias("sum")
    )

    def step(a: Column, x: Column) -> Column:
        here = F.struct(a["k"].alias("k"), x["pos"].alias("pos"), a["cum"].alias("cum"))
        last = F.transform(a["last"], lambda s, i: F.when(i == x["t"], here).otherwise(s))
        low, cum = F.array_min(last), a["cum"] + x["inv"]
        new = F.forall(last, lambda s: s.isNotNull()) & (low["k"] != a["low"])
        noise = (x["pos"] - low["pos"]) - (a["k"] - low["k"])
        worth = (a["k"] - low["k"] + 1) / (cum - low["cum"]) / (1 + noise)
        return F.struct((a["k"] + 1).alias("k"), cum.alias("cum"), last.alias("last"), F.when(new, low["k"]).otherwise(a["low"]).alias("low"), (a["sum"] + F.when(new, worth).otherwise(0.0)).alias("sum"))

    return F.aggregate(e, start, step, lambda a: a["sum"])
