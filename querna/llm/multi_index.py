"""Approximate nearest neighbours by an inverted multi-index.

The two halves of the vectors are quantised apart, each by its own k-means; a
pair of centroids is a cell.  A query takes the cells in order of summed
distance, from a heap over the two sorted lists, until they hold enough entries,
and these are reranked by exact distance.  How many are enough is measured: for
a sample of queries the true neighbours' places in that order are found, and the
quantile of these that gives the recall asked for is taken.

Entries are cut into blocks of cells and shuffled to them once, never copied per
query; a query goes to the blocks that hold cells it visits.  Where one block's
queries are more than QUERY_ROWS, they are cut and that block's entries follow.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querna.session import reach_workers

from .common import drop, table

ROUNDS = 6
#: Centroids a half, so that the table of cells that goes to workers has a million numbers at most; beyond
#: 32 million vectors a cell holds more entries instead, and a query visits fewer cells.
MOST_CENTROIDS = 1024
#: The codebooks are fitted on this many vectors at most (those of the least hashed id); all are indexed.
FIT_VECTORS = 200_000
#: Entries of a cell on average, entries of a block that one reducer ranks, query rows that come to it at once.
CELL_ENTRIES, BLOCK_ENTRIES, QUERY_ROWS = 32, 8_000, 16_000
#: Queries held against all vectors to measure how many entries are enough.
SAMPLE = 512


def _matrix(col: pa.Array) -> np.ndarray:
    return np.array(col.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(col), -1)


def vectors(embeddings: DataFrame, dims: int | None = None) -> tuple[DataFrame, int]:
    """((vec_id, v), dimensions): valid vectors of ``dims`` dimensions, or of the commonest length, one an id."""
    reach_workers(embeddings.sparkSession)
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    e = e.where("vec_id is not null and v is not null and size(v) > 1 and not exists(v, x -> x is null or isnan(x))")
    if dims is None:
        top = e.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dims = top["d"] if top else 2
    return e.where(F.size("v") == dims).groupBy("vec_id").agg(F.min("v").alias("v")), dims


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)


def codebooks(vecs: DataFrame, d: int, k: int, rounds: int = ROUNDS, fit: int = FIT_VECTORS) -> list[np.ndarray]:
    """Lloyd's iterations over ``fit`` vectors at most; centroids' sums alone reach the driver."""
    order = (F.xxhash64("vec_id"), "vec_id")
    seed = np.array([r["v"] for r in vecs.orderBy(*order).limit(k).collect()], np.float32)
    books = [np.unique(seed[:, : d // 2], axis=0), np.unique(seed[:, d // 2 :], axis=0)]
    width = d - d // 2
    bound = vecs.agg(F.count("*")).first()[0]
    if bound > fit:  # a share by hash, a little above the bound, then the bound itself
        least = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1_000_003)) < math.ceil(1_000_003 * min(1, 1.1 * fit / bound))
        vecs = table(vecs.where(least).orderBy(*order).limit(fit), "fitted")

    def sums(books):
        def run(batches):
            held = [[np.zeros(len(c)), np.zeros((len(c), width))] for c in books]
            for b in batches:
                x = _matrix(b.column(0))
                for h, (c, y) in enumerate(zip(books, (x[:, : d // 2], x[:, d // 2 :]))):
                    a = nearest(y, c)
                    held[h][0] += np.bincount(a, minlength=len(c))
                    np.add.at(held[h][1][:, : y.shape[1]], a, y)
            for h, (n, s) in enumerate(held):
                i = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), h, np.int32)), pa.array(i.astype(np.int32)), pa.array(n[i]), *(pa.array(s[i, j]) for j in range(width))], names)

        return run

    names = ["half", "centroid", "n", *(f"s{j}" for j in range(width))]
    kinds = ", ".join(f"{c} {'int' if c in ('half', 'centroid') else 'double'}" for c in names)
    for _ in range(rounds):
        got = vecs.select("v").mapInArrow(sums(books), kinds).groupBy("half", "centroid").agg(*(F.sum(c).alias(c) for c in names[2:])).collect()
        for r in got:
            c = books[r[0]]
            c[r[1]] = np.array(r[3 : 3 + c.shape[1]]) / r[2]
    return books


def pairs(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells in order of d1 + d2 until they hold ``enough`` entries."""
    o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    heap, out, held = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        n = counts[o1[i]][o2[j]]
        if n:
            out.append((o1[i], o2[j]))
            held += n
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def _cells(books: list[np.ndarray], d: int):
    def run(batches):
        for b in batches:
            x = _matrix(b.column(1))
            a, c = nearest(x[:, : d // 2], books[0]), nearest(x[:, d // 2 :], books[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(a.astype(np.int32)), pa.array(c.astype(np.int32))], ["vec_id", "v", "c1", "c2"])

    return run


def _parted(of_cell: np.ndarray):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of_cell[b.column(2).to_numpy()])], ["vec_id", "v", "cell", "part"])

    return run


def _distances(books: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    h = books[0].shape[1]
    return [((c * c).sum(1)[None] - 2 * y @ c.T) for c, y in zip(books, (x[:, :h], x[:, h:]))]


def _visits(books: list[np.ndarray], counts: np.ndarray, of_cell: np.ndarray, enough: int):
    """(vec_id, v, part, cells): a query once for each part whose cells it visits, with these cells' numbers."""
    width = counts.shape[1]

    def run(batches):
        for b in batches:
            x, ids = _matrix(b.column(1)), b.column(0)
            d1, d2 = _distances(books, x)
            rows, to, cells = [], [], []
            for i in range(len(x)):
                at = np.array([c * width + e for c, e in pairs(d1[i], d2[i], counts, enough)], np.int32)
                part = of_cell[at]
                order = np.argsort(part, kind="stable")
                at, part = at[order], part[order]
                cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, int)
                for s, e in zip(cut, np.append(cut[1:], len(part))):
                    rows.append(i), to.append(int(part[s])), cells.append(at[s:e].tobytes())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), b.column(1).take(at), pa.array(to, pa.int32()), pa.array(cells, pa.binary())], ["vec_id", "v", "part", "cells"])

    return run


def _top(q: np.ndarray, qi: np.ndarray, e: np.ndarray, ei: np.ndarray, k: int, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, entry, distance) of each query's k nearest entries and those that tie with them."""
    d = np.maximum((q * q).sum(1)[:, None] - 2 * q @ e.T + (e * e).sum(1)[None], 0)
    d[qi[:, None] == ei[None]] = np.inf
    if allowed is not None:
        d[~allowed] = np.inf
    bound = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
    r, c = np.nonzero((d <= bound[:, None] + 1e-9) & np.isfinite(d))
    exact = np.sqrt(((q[r] - e[c]) ** 2).sum(1))
    return r, c, np.round(exact, 6)


def _rerank(k: int):
    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(entries):
            e, ei = _matrix(entries.column("v").combine_chunks()).astype(np.float64), entries.column("vec_id").to_numpy()
            held, cell = np.unique(entries.column("cell").to_numpy(), return_inverse=True)
            v, ids, cells = queries.column("v").combine_chunks(), queries.column("vec_id").to_numpy(), queries.column("cells").to_pylist()
            for s in range(0, len(ids), 512):
                visits = [np.frombuffer(x, np.int32) for x in cells[s : s + 512]]
                seen = np.zeros((len(visits), len(held)), bool)
                for i, x in enumerate(visits):
                    seen[i] = np.isin(held, x)
                r, c, dist = _top(_matrix(v.slice(s, 512)).astype(np.float64), ids[s : s + 512], e, ei, k, seen[:, cell])
                out.append((ids[s : s + 512][r], ei[c], dist))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("vec_id", "neighbour_id", "distance"), cols)))

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", "distance")


def enough_for(queries: DataFrame, index: Index, k: int, recall: float) -> int:
    """Entries to rerank: the quantile ``recall`` of the true neighbours' places, over SAMPLE queries held against all vectors."""
    few = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "v").collect()
    qi, q = np.array([r[0] for r in few], np.int64), np.array([r[1] for r in few], np.float64)
    if not len(qi):
        return 1
    counts, books = index.counts, index.books

    def run(batches):
        for b in batches:
            e, ei = _matrix(b.column(1)).astype(np.float64), b.column(0).to_numpy()
            for s in range(0, len(e), 4096):
                r, c, dist = _top(q, qi, e[s : s + 4096], ei[s : s + 4096], k, None)
                at = pa.array(c + s)
                yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(ei[s : s + 4096][c]), pa.array(dist), b.column(2).take(at), b.column(3).take(at)], ["vec_id", "neighbour_id", "distance", "c1", "c2"])

    found = index.celled.mapInArrow(run, "vec_id long, neighbour_id long, distance double, c1 int, c2 int")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbour_id"))
    true = found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "c1", "c2").collect()  # SAMPLE * k rows at most
    d1, d2 = _distances(books, q.astype(np.float32))
    at = {int(i): n for n, i in enumerate(qi)}
    places = []
    for i, c1, c2 in true:
        s = d1[at[i]][:, None] + d2[at[i]][None]
        places.append(int(counts[s <= s[c1, c2]].sum()))
    return int(np.quantile(places, recall)) + 1 if places else 1


@dataclass
class Index:
    """All vectors by cell: codebooks and counts (bounded) on the driver, entries in the shared folder."""

    books: list[np.ndarray]
    counts: np.ndarray
    celled: DataFrame  # vec_id, v, c1, c2
    dims: int

    @property
    def entries(self) -> int:
        return int(self.counts.sum())


def build(embeddings: DataFrame) -> Index:
    """The index of all valid vectors (see ``neighbours``)."""
    vecs, d = vectors(embeddings)
    vecs = table(vecs, "vectors")
    n = vecs.count()
    books = codebooks(vecs, d, min(MOST_CENTROIDS, max(1, round(math.sqrt(n / CELL_ENTRIES))))) if n else [np.zeros((1, d // 2), np.float32), np.zeros((1, d - d // 2), np.float32)]
    celled = table(vecs.mapInArrow(_cells(books, d), "vec_id long, v array<float>, c1 int, c2 int"), "cells")
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)  # MOST_CENTROIDS ** 2 numbers at most
    for r in celled.groupBy("c1", "c2").count().collect():
        counts[r[0], r[1]] = r[2]
    drop(vecs)
    return Index(books, counts, celled, d)


def search(index: Index, queries: DataFrame, k: int = 10, recall: float = 0.95) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): each query's k nearest entries of another id.

    ``queries`` has (vec_id, embedding), of which invalid rows and those of another
    length than the index's are left out.  ``recall`` is what a sample of the queries
    must reach against all entries.
    """
    q, d = vectors(queries, index.dims)
    q = table(q, "queries")
    enough = min(index.entries, enough_for(q, index, k, recall))
    n, width = q.count(), index.counts.shape[1]
    # cells in order, cut where a part holds BLOCK_ENTRIES; a cell above that is a part of several blocks
    flat = index.counts.ravel()
    of_cell = np.minimum((np.cumsum(flat) - flat) // BLOCK_ENTRIES, max(0, -(-index.entries // BLOCK_ENTRIES) - 1)).astype(np.int32)
    held = np.bincount(of_cell, weights=flat)
    blocks = np.maximum(1, np.ceil(held / (2 * BLOCK_ENTRIES))).astype(np.int32)
    spread = q.repartition(min(4096, max(12, n // 500)), "vec_id")
    visits = table(spread.mapInArrow(_visits(index.books, index.counts, of_cell, enough), "vec_id long, v array<float>, part int, cells binary"), "visits")
    cuts = visits.groupBy("part").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("cuts"))
    spark = queries.sparkSession
    parts = spark.createDataFrame([(i, int(b)) for i, b in enumerate(blocks)] or [(0, 1)], "part int, blocks int").join(cuts, "part")
    cell = (F.col("c1") * width + F.col("c2")).alias("cell")
    entries = index.celled.select("vec_id", "v", cell).mapInArrow(_parted(of_cell), "vec_id long, v array<float>, cell int, part int")
    # parts are as many as entries / BLOCK_ENTRIES, a row of three numbers each
    entries = entries.join(parts, "part").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    entries = entries.select("vec_id", "v", "cell", "part", "block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    asked = visits.join(parts, "part").withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int"))
    asked = asked.select("vec_id", "v", "cells", "part", "cut", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    by = ["part", "block", "cut"]
    found = asked.groupBy(*by).cogroup(entries.groupBy(*by)).applyInArrow(_rerank(k), "vec_id long, neighbour_id long, distance double")
    return _best(found, k)


def neighbours(embeddings: DataFrame, k: int = 10, recall: float = 0.95, every: int = 1) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest others by Euclidean distance of
    each vector whose id is divisible by ``every``, against all vectors.

    ``recall`` is what a sample of the queries must reach.  Ties fall to the lower id;
    repeated vectors are neighbours at distance 0; rows that repeat an id count once
    (the least vector); null ids, null vectors, vectors with null or NaN parts or of
    another than the commonest length are left out; an empty table gives no rows; a
    table of n vectors gives n - 1 neighbours where k is more; other columns are ignored.
    """
    return search(build(embeddings), embeddings.where(F.col("vec_id") % every == 0), k, recall)


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100)
