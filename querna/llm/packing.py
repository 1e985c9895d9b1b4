"""Packing along a space-filling curve.

Every document is a vector of hashed word counts, projected to a few dimensions
by random signs; its Hilbert key orders documents so that neighbours on the
curve are alike.  Documents are packed in curve order into sequences of
``capacity`` words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T
from .common import cut, slices, string_bytes, texts

DIMS, BITS = 4, 15
#: Packing starts afresh after this many sequences' worth of words, at places that depend on the data alone.
STRETCH = 512


def hilbert_key(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points, shape (n, dims), coordinates below 2**bits (Skilling 2004)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def project(h: np.ndarray, first: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Random-sign projections of the documents' word-count vectors, scaled to unit variance for unrelated words."""
    n = np.diff(first)
    v = np.zeros((len(n), dims))
    for d in range(dims):
        s = np.append(0, np.cumsum(np.where((h >> np.uint64(d)) & np.uint64(1), 1, -1)))
        v[:, d] = (s[first[1:]] - s[first[:-1]]) / np.sqrt(np.maximum(n, 1))
    return v


def cells(v: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Coordinates on the curve's grid: the logistic squash spreads them over the cube."""
    return np.minimum((1 / (1 + np.exp(-np.clip(v, -30, 30) / 4)) * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def _keys(batches):
    for b in slices(batches):
        data, offs = string_bytes(b.column(1))
        h, first, _, _ = T.word_hashes(data, offs)
        key = hilbert_key(cells(project(h, first)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key), pa.array(np.diff(first).astype(np.int64))], ["doc_id", "curve_key", "n_words"])


def curve_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, curve_key, n_words), one row a row of ``docs``."""
    return texts(docs).mapInArrow(_keys, "doc_id long, curve_key long, n_words long")


def next_fit(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, sequence, begin) of each piece.  A row that doesn't fit the open sequence
    starts the next one; a row above the capacity is cut, its full pieces each filling one."""
    row, piece, seq, begin = [], [], [], []
    now, used = 0, 0
    for i, size in enumerate(n.tolist()):
        part = 0
        while size > capacity:
            if used:
                now, used = now + 1, 0
            row.append(i), piece.append(part), seq.append(now), begin.append(0)
            now, size, part = now + 1, size - capacity, part + 1
        if used + size > capacity:
            now, used = now + 1, 0
        row.append(i), piece.append(part), seq.append(now), begin.append(used)
        used += size
    return np.array(row, np.int64), np.array(piece, np.int64), np.array(seq, np.int64), np.array(begin, np.int64)


def _fill(capacity: int):
    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["before", "curve_key", "doc_id"], na_position="first")
        row, piece, seq, begin = next_fit(p["n_words"].to_numpy(), capacity)
        size = np.minimum(p["n_words"].to_numpy()[row] - piece * capacity, capacity)
        return pd.DataFrame({"doc_id": p["doc_id"].to_numpy()[row], "piece": piece, "stretch": int(key[0]), "sequence": seq, "begin": begin, "n_words": size, "curve_key": p["curve_key"].to_numpy()[row]})

    return run


def pack(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, stretch, sequence, begin, n_words, curve_key).

    (stretch, sequence) names a packed sequence; begin is the piece's place in it, in
    words.  Documents follow the curve, ties in key by doc_id (null first); stretches
    begin where the words before, along the whole curve, pass multiples of
    512 * capacity (a word-less document counts as one there), so the result doesn't depend on how the data are partitioned.
    Documents longer than a sequence are cut into pieces.  Null, empty and word-less
    texts take one piece of no words; repeated rows are packed as often as they come;
    an empty table gives no rows; columns other than doc_id and text are ignored.
    """
    keys = curve_keys(docs)
    # range partitions, then a running total over all of them: one small row a partition meets in a broadcast
    ranged = keys.repartitionByRange("curve_key", "doc_id").select("*", F.spark_partition_id().alias("part"))
    ranged = cut(ranged)
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    size = F.greatest("n_words", F.lit(1))
    totals = ranged.groupBy("part").agg(F.sum(size).alias("total")).select("part", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("part").orderBy("curve_key", "doc_id", "n_words").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum(size).over(inner), F.lit(0))).join(F.broadcast(totals), "part")
    placed = placed.select("doc_id", "curve_key", "n_words", (F.col("offset") + F.col("inside")).alias("before"))
    placed = placed.withColumn("stretch", F.floor(F.col("before") / (STRETCH * capacity)).cast("long"))
    return placed.groupBy("stretch").applyInPandas(_fill(capacity), "doc_id long, piece long, stretch long, sequence long, begin long, n_words long, curve_key long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
