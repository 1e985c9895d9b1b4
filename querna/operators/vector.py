"""Exact vector search, hybrid fusion and embedding statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querna import constants as K
from querna.plans.ranks import global_rank
from querna.session import reach_workers


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def semantic_search(vectors: DataFrame, query: list[float], threshold: float = K.SEMANTIC_THRESHOLD, n: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col(vector), q).alias("similarity")).where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), key).limit(n).withColumn("score", F.col("similarity") * 100)


def hybrid(keyword: DataFrame, semantic: DataFrame, key: str = "document_id", score: str = "score", wk: float = 0.6, ws: float = 0.4, k: int = K.RRF_K) -> DataFrame:
    """Keyword hits, lifted by their semantic rank where they have one."""
    a = global_rank(keyword.select(key, score), score, key, "kw_rank").select(key, "kw_rank")
    b = global_rank(semantic.select(key, score), score, key, "sem_rank").select(key, "sem_rank")
    s = F.lit(wk) / (k + F.col("kw_rank")) + F.coalesce(F.lit(ws) / (k + F.col("sem_rank")), F.lit(0.0))
    return a.join(b, key, "left").select(key, s.alias("score"))


def _rows(col) -> np.ndarray:
    return np.array(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


@dataclass
class Lists:
    """Vectors by their nearest centroid: a partition of the table for approximate search."""

    centroids: np.ndarray
    assigned: DataFrame  # key, vector, list


def inverted_lists(vectors: DataFrame, lists: int = 100, rounds: int = 5, fit: int = 100_000, key: str = "vec_id", vector: str = "embedding") -> Lists:
    """Spherical k-means on ``fit`` vectors at most, then all vectors by their nearest centroid (SEM-04); vectors
    must be of one length.  Sums of ``lists`` centroids alone reach the driver."""
    reach_workers(vectors.sparkSession)
    v = vectors.select(key, F.col(vector).cast("array<double>").alias(vector)).where(F.col(vector).isNotNull())
    few = v.orderBy(F.xxhash64(key), key).limit(fit).select(vector)
    c = _unit(np.array([r[0] for r in v.orderBy(F.xxhash64(key), key).limit(lists).select(vector).collect()], np.float64))

    def sums(c: np.ndarray):
        def run(batches):
            total, count = np.zeros_like(c), np.zeros(len(c))
            for b in batches:
                x = _unit(_rows(b.column(0)))
                a = (x @ c.T).argmax(1)
                np.add.at(total, a, x)
                count += np.bincount(a, minlength=len(c))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c))), pa.array(count), pa.array(list(total), pa.list_(pa.float64()))], ["list", "n", "total"])

        return run

    def assign(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((_unit(_rows(b.column(1))) @ c.T).argmax(1).astype(np.int32))], [key, vector, "list"])

    for _ in range(rounds if len(c) else 0):
        new = np.zeros_like(c)
        for r in few.mapInArrow(sums(c), "list long, n double, total array<double>").collect():
            new[r[0]] += r[2]
        c = np.where((new != 0).any(1, keepdims=True), _unit(new), c)
    return Lists(c, v.mapInArrow(assign, f"{key} {dict(vectors.dtypes)[key]}, {vector} array<double>, list int"))


def probe(index: Lists, query: list[float], probes: int = 10, threshold: float = K.SEMANTIC_THRESHOLD, n: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``semantic_search`` over the ``probes`` lists nearest to the query alone."""
    near = np.argsort(-(index.centroids @ np.array(query, np.float64)), kind="stable")[:probes]
    return semantic_search(index.assigned.where(F.col("list").isin([int(i) for i in near])), query, threshold, n, key, vector)


def embedding_stats(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    return vectors.groupBy(group).agg(F.count("*").alias("vectors"), F.avg(F.size(vector)).alias("avg_dimensions"))
