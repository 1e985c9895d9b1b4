"""Sharding as vector bin packing: bytes, tokens and rows are balanced together.

Documents of one source make a group, cut by hashed doc_id where it is large
against its bin.  Groups, the largest first, go where the dot product of their
demand and the bin's residual capacity is highest among bins that they fit.

Bins are placed in two levels, so that no task sees all groups: first groups go to
super-shards of up to PER_SUPER shards each, on the driver, from at most SLOTS +
PER_BIN rows a super-shard; then every super-shard places its own groups, cut
finer, on its shards, all in parallel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, document_id

SLOTS = 65_536
#: A group holds at most about 1 / PER_BIN of a bin; shards that a super-shard holds at most.
PER_BIN, PER_SUPER = 32, 1_024
SLACK = 0.02
BROADCAST_GROUPS = 500_000


def place(demand: np.ndarray, bins: int, slack: float = SLACK, capacity: np.ndarray | None = None) -> np.ndarray:
    """The bin of each group; demand has a row a group, ``capacity`` the shares of the bins (alike
    where not given).  Ties go to the lowest bin; a group that fits nowhere goes where it exceeds
    capacity least."""
    total = np.maximum(demand.sum(0), 1)
    capacity = np.ones(bins) if capacity is None else capacity / capacity.mean()
    d = demand / total * bins
    left = np.repeat(capacity[:, None] * (1 + slack), demand.shape[1], axis=1)
    out = np.zeros(len(d), np.int64)
    for g in np.lexsort((np.arange(len(d)), -d.max(1))) if len(d) else []:
        fits = (left >= d[g] - 1e-12).all(1)
        score = np.where(fits, left @ d[g], -np.inf) if fits.any() else -np.maximum(d[g] - left, 0).max(1)
        s = int(score.argmax())
        out[g] = s
        left[s] -= d[g]
    return out


def measured(docs: DataFrame, group: str = "source") -> DataFrame:
    """(doc_id, slot, spread, bytes, tokens): one row a document; sources share a slot only by hash.
    spread tells documents of a slot apart: by doc_id, and by text where that is null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.pmod(F.xxhash64(F.coalesce(F.col(group).cast("string"), F.lit("\x00"))), F.lit(SLOTS)) if group in docs.columns else F.lit(0)
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.col("doc_id").cast("long")))
    return docs.select(document_id(), key.cast("int").alias("slot"), spread.alias("spread"), F.octet_length(text).cast("long").alias("bytes"), F.regexp_count(text, F.lit(r"[^\x00-\x20]+")).cast("long").alias("tokens"))


def _sums() -> list:
    return [F.sum("bytes").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")]



def _blocks(share: np.ndarray, bins: float) -> np.ndarray:
    """Into how many blocks groups of these shares of all demand are cut."""
    return np.maximum(1, np.ceil(share.max(1) * bins * PER_BIN)).astype(np.int64)


def _inside(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    """The shards of one super-shard's groups."""
    g = g.sort_values(["slot", "block", "part"])
    where = place(g[["b", "t", "n"]].to_numpy(float), int(g["shards"].iloc[0])) + int(g["first"].iloc[0])
    return pd.DataFrame({"slot": g["slot"], "block": g["block"], "part": g["part"], "shard": where})


def assign(docs: DataFrame, shards: int | None = None, shard_bytes: int = 256 << 20, group: str = "source") -> DataFrame:
    """(doc_id, group_slot, block, part, bytes, tokens, shard), one row a row of ``docs``.

    shards is at least 8, or as many as give shard_bytes each.  At most SLOTS + PER_BIN
    rows a super-shard come to the driver (some 77 000 at 100 TB) and SLOTS + PER_BIN *
    PER_SUPER to a task.  A document larger than a group stays whole.  Null and empty
    texts weigh one row; a null source is a source of its own; rows with a null doc_id
    are spread by text; repeated rows go together; texts of any length are measured
    whole; ties are as in ``place``; an empty table gives no rows; columns other than
    doc_id, text and the group's are ignored.
    """
    m = cut(measured(docs, group))
    spark = docs.sparkSession
    slots = m.groupBy("slot").agg(*_sums()).orderBy("slot").collect()
    load = np.array([[r.b, r.t, r.n] for r in slots], float).reshape(-1, 3)
    total = np.maximum(load.sum(0), 1)
    shards = shards or max(8, math.ceil(total[0] / shard_bytes))
    supers = math.ceil(shards / PER_SUPER)
    ends = np.linspace(0, shards, supers + 1).round().astype(int)
    blocks = _blocks(load / total, supers) if supers > 1 else np.ones(len(load), np.int64)
    cuts = spark.createDataFrame([(r.slot, int(b)) for r, b in zip(slots, blocks)], "slot int, blocks int")
    m = m.join(F.broadcast(cuts), "slot").withColumn("block", F.pmod("spread", F.col("blocks")).cast("int")).drop("blocks")
    groups = m.groupBy("slot", "block").agg(*_sums()).orderBy("slot", "block").collect()
    load = np.array([[r.b, r.t, r.n] for r in groups], float).reshape(-1, 3)
    to = place(load, supers, capacity=np.diff(ends).astype(float))
    parts = _blocks(load / total, shards) if len(load) else np.zeros(0, np.int64)
    rows = [(r.slot, r.block, int(s), int(p), int(ends[s]), int(ends[s + 1] - ends[s])) for r, s, p in zip(groups, to, parts)]
    placed = spark.createDataFrame(rows, "slot int, block int, super int, parts int, first int, shards int")
    m = m.join(F.broadcast(placed), ["slot", "block"]).withColumn("part", F.pmod(F.xxhash64("spread"), F.col("parts")).cast("int"))
    fine = m.groupBy("slot", "block", "part").agg(*_sums(), F.first("super").alias("super"), F.first("first").alias("first"), F.first("shards").alias("shards"))
    where = cut(fine.groupBy("super").applyInPandas(_inside, "slot int, block int, part int, shard int"))
    few = where.count() <= BROADCAST_GROUPS
    out = m.join(F.broadcast(where) if few else where, ["slot", "block", "part"])
    return out.select("doc_id", F.col("slot").alias("group_slot"), "block", "part", "bytes", "tokens", "shard")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
