"""Postings, index statistics, BM25 and cover density."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querna import constants as K
from querna.functions.analysis import FILTERS, clean_token, standard_tokens
from querna.session import reach_workers


def analyzed(c: Column) -> Column:
    return FILTERS["stopword"](standard_tokens(c))


_WORD = re.compile(r"[a-z0-9_]+")
#: Characters of text that one block of postings is made from.
BLOCK_CHARS = 1 << 20


def _block(fields: list[str], keyword: tuple[str, ...], ignore_above: int, positions: bool):
    """Postings of Arrow batches, each document's from its own text: nothing is shuffled."""

    def tokens(f: str, text: str | None) -> list[str]:
        if f not in keyword:
            return [w for w in _WORD.findall((text or "").lower()) if w not in K.STOP_WORDS]
        return [text.strip(" ").lower()] if text is not None and len(text) <= ignore_above else []

    def run(batches):
        for b in batches:
            rows, field, term, tf, size, at, chars = [], [], [], [], [], [], 0
            for i, texts in enumerate(zip(*(b.column(c + 1).to_pylist() for c in range(len(fields))))):
                for f, text in zip(fields, texts):
                    ts = tokens(f, text)
                    held: dict[str, list[int]] = {}
                    for k, t in enumerate(ts):
                        held.setdefault(t, []).append(k)
                    rows += [i] * len(held)
                    field += [f] * len(held)
                    term += held
                    tf += map(len, held.values())
                    size += [len(ts)] * len(held)
                    at += held.values()
                    chars += len(text or "")
                if chars > BLOCK_CHARS:
                    yield one(b, rows, field, term, tf, size, at)
                    rows, field, term, tf, size, at, chars = [], [], [], [], [], [], 0
            if rows:
                yield one(b, rows, field, term, tf, size, at)

    def one(b, rows, field, term, tf, size, at) -> pa.RecordBatch:
        cols = [b.column(0).take(pa.array(rows)), pa.array(field, pa.string()), pa.array(term, pa.string()), pa.array(tf, pa.int64()), pa.array(size, pa.int32())]
        return pa.RecordBatch.from_arrays([*cols, *([pa.array(at, pa.list_(pa.int32()))] if positions else [])], ["key", "field", "term", "tf", "field_length", *(["positions"] if positions else [])])

    return run


def postings(docs: DataFrame, fields: list[str], key: str = "document_id", analyzer=analyzed, positions: bool = False, keyword: tuple[str, ...] = (), ignore_above: int = 256) -> DataFrame:
    """(key, field, term, tf, field_length[, positions]), one row a document, field and term.

    A document is one row of ``docs``.  With the standard analyzer each row's postings come out of the row
    itself and nothing is shuffled; other analyzers are Columns, whose tokens meet again by document."""
    if analyzer is analyzed:
        reach_workers(docs.sparkSession)
        kind = docs.schema[key].dataType.simpleString()
        rows = docs.select(F.col(key), *[F.col(f).cast("string").alias(f"field{i}") for i, f in enumerate(fields)])
        out = rows.mapInArrow(_block(fields, keyword, ignore_above, positions), f"key {kind}, field string, term string, tf long, field_length int" + (", positions array<int>" if positions else ""))
        return out.withColumnRenamed("key", key)
    each = F.array(
        *[F.struct(F.lit(f).alias("field"), (F.when(F.length(F.col(f)) <= ignore_above, F.array(F.lower(F.trim(F.col(f))))).otherwise(F.array().cast("array<string>")) if f in keyword else analyzer(F.coalesce(F.col(f).cast("string"), F.lit("")))).alias("terms")) for f in fields]
    )
    x = docs.select(key, F.explode(each).alias("x")).select(key, "x.field", F.size("x.terms").alias("field_length"), F.posexplode("x.terms").alias("pos", "term"))
    extra = [F.sort_array(F.collect_list("pos")).alias("positions")] if positions else []
    return x.groupBy(key, "field", "term").agg(F.count("*").alias("tf"), F.first("field_length").alias("field_length"), *extra)


def merge_postings(a: DataFrame, b: DataFrame, key: str = "document_id") -> DataFrame:
    cols = [key, "field", "term"]
    out = a.unionByName(b).groupBy(*cols).agg(F.sum("tf").alias("tf"), F.first("field_length").alias("field_length"), *([F.flatten(F.collect_list("positions")).alias("positions")] if "positions" in a.columns else []))
    return out.where("tf > 0")


def remove_documents(postings_: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    return postings_.join(ids.select(key).distinct(), key, "left_anti")


def doc_lengths(docs: DataFrame, fields: list[str], key: str = "document_id", analyzer=analyzed) -> DataFrame:
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.size(analyzer(F.coalesce(F.col(f).cast("string"), F.lit("")))).alias("field_length")) for f in fields])
    return docs.select(key, F.inline(each))


def field_stats(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field").agg(F.count("*").alias("doc_count"), F.sum("field_length").alias("total_length"), F.avg("field_length").alias("avg_length"))


def term_stats(p: DataFrame, per_field: bool = False, key: str = "document_id") -> DataFrame:
    """df: documents that hold the term, in any field unless per_field."""
    if per_field:
        return p.groupBy("field", "term").agg(F.count("*").alias("df"))
    return p.select("term", key).distinct().groupBy("term").agg(F.count("*").alias("df"))


def top_terms(p: DataFrame, n: int = 100, key: str = "document_id") -> DataFrame:
    return term_stats(p, key=key).orderBy(F.desc("df"), F.asc("term")).limit(n)


def document_frequency(docs: DataFrame, fields: list[str], analyzer=analyzed) -> DataFrame:
    """df straight from the documents: distinct terms a document, then counts, combined before the one shuffle."""
    terms = F.array_distinct(F.flatten(F.array(*[analyzer(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields])))
    return docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25(tf: Column, df: Column, n: Column, length: Column, avg: Column, weight: Column, k1: float = K.BM25_K1, b: float = K.BM25_B) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    s = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg)) * weight
    return F.when((tf > 0) & (df > 0) & (avg > 0), s).otherwise(0.0)


def _count_of(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def bm25_search(docs: DataFrame, terms: list[str], fields: list[str], weights: dict[str, float] | None = None, key: str = "document_id", k1: float = K.BM25_K1, b: float = K.BM25_B, weight_power: int = 1) -> DataFrame:
    """(key, score) of documents that hold a term.  Fields are scanned once for statistics and once for
    matches, and only one row of statistics leaves a partition, so nothing is shuffled."""
    weights = weights or K.FIELD_WEIGHTS

    def scanned(d: DataFrame) -> DataFrame:
        # tokens come out of a generator, so that they are made once a row and not once a use
        toks = F.inline(F.array(F.struct(*[analyzed(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"__{f}") for f in fields])))
        return d.select(key, toks).select(key, *[F.struct(F.size(f"__{f}").alias("n"), *[_count_of(F.col(f"__{f}"), w).alias(f"t{i}") for i, w in enumerate(terms)]).alias(f) for f in fields])

    has = [reduce(lambda a, c: a | c, [F.col(f"{f}.t{i}") > 0 for f in fields]) for i in range(len(terms))]
    stats = scanned(docs).agg(F.count("*").alias("N"), *[F.avg(f"{f}.n").alias(f"avg_{f}") for f in fields], *[F.count_if(h).alias(f"df{i}") for i, h in enumerate(has)])
    parts = [
        bm25(F.col(f"{f}.t{i}"), F.col(f"df{i}"), F.col("N"), F.col(f"{f}.n"), F.col(f"avg_{f}"), F.lit(weights.get(f, 1.0) ** weight_power), k1, b)
        for f in fields for i in range(len(terms))
    ]
    # a document without the term's characters needn't be tokenized again
    maybe = reduce(lambda a, c: a | c, [F.lower(F.col(f).cast("string")).contains(w) for f in fields for w in terms])
    hit = scanned(docs.where(maybe)).where(reduce(lambda a, c: a | c, has)).crossJoin(F.broadcast(stats))  # one row of statistics
    return hit.select(key, reduce(lambda a, c: a + c, parts).alias("score"))


def bm25_from_postings(p: DataFrame, stats: DataFrame, lengths: DataFrame, terms: list[str], weights: dict[str, float] | None = None, key: str = "document_id") -> DataFrame:
    """The same from stored tables; the query's terms prune the scan of the postings."""
    weights = weights or K.FIELD_WEIGHTS
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("field")), F.lit(1.0))
    mine = p.where(F.col("term").isin(terms))
    df = mine.select("term", key).distinct().groupBy("term").agg(F.count("*").alias("df"))
    fs = stats.select("field", F.col("doc_count").alias("N"), F.col("avg_length").alias("avg"))
    x = mine.join(F.broadcast(df), "term").join(F.broadcast(fs), "field")  # len(terms) and len(fields) rows
    return x.groupBy(key).agg(F.sum(bm25(F.col("tf"), F.col("df"), F.col("N"), F.col("field_length"), F.col("avg"), w)).alias("score"))


def blend(hits: DataFrame, db: str = "db_score", score: str = "score") -> DataFrame:
    return hits.withColumn("final_score", K.BLEND_DB * F.coalesce(F.col(db), F.lit(0.0)) + K.BLEND_BM25 * F.coalesce(F.col(score), F.lit(0.0)))


def weighted_lexemes(docs: DataFrame, weights: dict[str, str], key: str = "document_id") -> DataFrame:
    """(key, term, label): each term with the best label of the fields that hold it."""
    p = postings(docs, list(weights), key)
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("field"))
    return p.select(key, clean_token(F.col("term")).alias("term"), label.alias("label")).where("term is not null").groupBy(key, "term").agg(F.min("label").alias("label"))


def processed(docs: DataFrame, weights: dict[str, str], boost: Column | None = None, key: str = "document_id") -> DataFrame:
    """(key, lexemes, field_lengths, boost_factor), one row a document: what a document is stored with (TXT-35)."""
    names = list(weights)
    lengths = F.create_map(*[x for f in names for x in (F.lit(f), F.size(analyzed(F.coalesce(F.col(f).cast("string"), F.lit("")))))])
    lexemes = weighted_lexemes(docs, weights, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "label"))).alias("lexemes"))
    rows = docs.select(key, lengths.alias("field_lengths"), (F.lit(1.0) if boost is None else F.coalesce(boost.cast("double"), F.lit(1.0))).alias("boost_factor"))
    none = F.array().cast("array<struct<term:string,label:string>>")
    return rows.join(lexemes, key, "left").select(key, F.coalesce("lexemes", none).alias("lexemes"), "field_lengths", "boost_factor")


def cover_density(positions: DataFrame, terms: list[str], key: str = "document_id") -> DataFrame:
    """(key, score): each shortest extent that covers all terms adds 1 / its length in words."""
    w = Window.partitionBy(key).orderBy("pos")
    p = positions.where(F.col("term").isin(terms)).select(key, "term", F.explode("positions").alias("pos"))
    for i, t in enumerate(terms):
        p = p.withColumn(f"l{i}", F.last(F.when(F.col("term") == t, F.col("pos")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    starts = [F.col(f"l{i}") for i in range(len(terms))]
    low = F.least(*starts) if len(starts) > 1 else starts[0]
    p = p.where(reduce(lambda a, b: a & b, [s.isNotNull() for s in starts])).withColumn("low", low)
    # an extent that begins where an earlier one does is not a shortest one
    p = p.groupBy(key, "low").agg(F.min("pos").alias("high"))
    return p.groupBy(key).agg(F.sum(1.0 / (F.col("high") - F.col("low") + 1)).alias("score"))


def infer_weights(fields: list[str]) -> dict[str, float]:
    from querna.functions.analysis import infer_weight

    return {f: infer_weight(f) for f in fields}


def recount(docs: DataFrame, catalog: DataFrame, index: str = "index_name") -> DataFrame:
    """Catalogued and counted documents of each index."""
    real = docs.groupBy(index).agg(F.count("*").alias("counted"))
    return catalog.join(real, index, "left").select(index, "document_count", F.coalesce("counted", F.lit(0)).alias("counted"), (F.col("document_count") == F.coalesce("counted", F.lit(0))).alias("consistent"))
