"""Suffix-array dedup: passages of ``min_words`` words or more that stand in two documents.

Winnowing gives every window of ``min_words`` words one anchor gram that depends
on its words alone, so equal windows of any two documents meet at one anchor.
Runs of windows whose anchor occurs in several documents become segments, and
segments meet by anchor.  This loses no window; what it leaves out cannot repeat.

An anchor of more than HOT distinct segments (boilerplate in ever new contexts)
is too much for one task: its windows are counted by hash instead, which finds the
same ones.

The segments of a bucket form a string collection over word ids.  Its
Burrows-Wheeler transform and common prefixes are built column by column: each
round prepends one word to every segment, finds the new suffixes' places from the
transform so far, and merges them into the columns, which lie in files of the
shared folder that are read and written from front to back.  Neighbouring
suffixes that share ``min_words`` words are equal windows.
"""

from __future__ import annotations

import contextlib
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType as Kinds

from . import textops as T
from .common import cut, drop, shared_dir, slices, string_bytes, table, texts, whole_rows, with_texts

GRAM = 24
INDEX_BITS = np.uint64(28)
SEGMENTS_PER_BUCKET = 20_000
#: Distinct segments that an anchor may bring to a bucket.
HOT = 20_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _anchors(min_words: int):
    """(anchor, doc_id, text_id, lo, hi): windows lo..hi of a text have this anchor."""
    gram = min(GRAM, min_words)
    width = min_words - gram + 1

    def run(batches):
        for b in slices(batches):
            data, offs = string_bytes(b.column(1))
            h, first, _, _ = T.word_hashes(data, offs)
            if len(h) < min_words:
                continue
            g = T.gram_hashes(h, gram)
            key = ((g >> INDEX_BITS) << INDEX_BITS) | np.arange(len(g), dtype=np.uint64)
            low = _sliding_min(key, width)
            doc = np.repeat(np.arange(b.num_rows), np.diff(first))
            s = np.flatnonzero(doc[: len(low)] == doc[min_words - 1 : min_words - 1 + len(low)])
            at = (low[s] & np.uint64((1 << int(INDEX_BITS)) - 1)).astype(np.int64)
            if not len(at):
                continue
            new = np.append(True, (at[1:] != at[:-1]) | (doc[s[1:]] != doc[s[:-1]]))
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(at)) - 1
            d = doc[s[begin]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[at[begin]].view(np.int64)), b.column(0).take(pa.array(d)), b.column(2).take(pa.array(d)), pa.array((s[begin] - first[d]).astype(np.int32)), pa.array((s[end] - first[d]).astype(np.int32))],
                ["anchor", "doc_id", "text_id", "lo", "hi"],
            )

    return run


def _segments(min_words: int):
    """The words of each run of windows, as 32-bit ids."""

    def run(batches):
        for b in slices(batches):
            data, offs = string_bytes(b.column(1))
            h, first, _, _ = T.word_hashes(data, offs)
            w = (h >> np.uint64(32)).astype(np.uint32)
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, hits in enumerate(b.column(3).to_pylist()):
                doc, text_id = b.column(0)[i].as_py(), b.column(2)[i].as_py()
                for x in hits:
                    out[0].append(x["anchor"]), out[1].append(doc), out[2].append(text_id), out[3].append(x["lo"])
                    out[4].append(w[first[i] + x["lo"] : min(first[i] + x["hi"] + min_words, first[i + 1])].tobytes())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["anchor", "doc_id", "text_id", "lo", "words"])

    return run


class Columns:
    """The collection's columns in files that are replaced each round."""

    def __init__(self, folder: str):
        self.fs, self.at = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.at, recursive=True)
        self.kinds: dict[str, np.dtype] = {}

    def write(self, **cols: np.ndarray) -> None:
        for k, v in cols.items():
            self.kinds[k] = v.dtype
            with self.fs.open_output_stream(f"{self.at}/{k}.new") as f:
                f.write(np.ascontiguousarray(v).data if len(v) else b"")
            self.fs.move(f"{self.at}/{k}.new", f"{self.at}/{k}")

    def read(self, k: str) -> np.ndarray:
        with self.fs.open_input_stream(f"{self.at}/{k}") as f:
            return np.frombuffer(f.read(), self.kinds[k])

    def drop(self) -> None:
        self.fs.delete_dir(self.at)


def _order(w: np.ndarray) -> np.ndarray:
    """Stable order of symbols by 16-bit radix passes."""
    o = np.argsort((w & 0xFFFF).astype(np.uint16), kind="stable")
    return o[np.argsort((w[o] >> 16).astype(np.uint16), kind="stable")] if len(w) and int(w.max()) >> 16 else o


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo..hi]) for each pair, lo <= hi."""
    out = np.zeros(len(lo), x.dtype)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    for k in range(int(level.max(initial=-1)) + 1):
        sel = level == k
        if sel.any():
            out[sel] = np.minimum(x[lo[sel]], x[hi[sel] - (1 << k) + 1])
        x = np.minimum(x[: -(1 << k)], x[1 << k :]) if len(x) > 1 << k else x
    return out


def column_wise(strings: list[np.ndarray], store: Columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, common prefix with the suffix before) in suffix order.

    Symbols are positive integers; strings may have any length.  Round j puts
    the suffix of length j of every string that long into its place: all suffixes
    ordered by the symbol before them, then by their own order, are the suffixes
    that are one longer, so a new one's place is its row's rank in that order.
    """
    m = len(strings)
    lens = np.array([len(s) for s in strings])
    flat = np.concatenate([*(s[::-1] for s in strings), np.zeros(1, np.uint32)])
    start = np.cumsum(lens) - lens
    before = lambda j: np.where(lens > j, flat[np.minimum(start + j, len(flat) - 1)], 0).astype(np.uint32)
    small = np.min_scalar_type(int(lens.max(initial=0)) + 1)
    store.write(bwt=before(0), lcp=np.zeros(m, small), string=np.arange(m, dtype=np.uint32), length=np.zeros(m, small))
    row = np.arange(m)  # where the newest suffix of each string stands
    live = np.flatnonzero(lens > 0)
    for j in range(1, int(lens.max(initial=0)) + 1):
        bwt, lcp = store.read("bwt"), store.read("lcp")
        order = _order(bwt)
        done = int((bwt == 0).sum())  # whole strings have nothing before them
        order = order[done:]
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(order))
        mine = rank[row[live]]
        place = m + mine  # the m empty suffixes come first
        touched = np.unique(np.concatenate([mine, mine + 1]))
        touched = touched[touched < len(order)]
        here, prev = order[touched], order[touched - 1]
        same = (touched > 0) & (bwt[here] == bwt[prev])
        value = np.zeros(len(touched), small)
        value[same] = 1 + _range_min(lcp, prev[same] + 1, here[same])
        new = np.zeros(m + len(order), bool)
        new[place] = True
        by_place = live[np.argsort(place)]

        def merged(old: np.ndarray, add: np.ndarray) -> np.ndarray:
            out = np.empty(len(new), old.dtype)
            out[new] = add
            out[~new] = old
            return out

        lcp = merged(lcp, np.zeros(len(live), small))
        lcp[m + touched] = value
        store.write(bwt=merged(bwt, before(j)[by_place]), lcp=lcp, string=merged(store.read("string"), by_place.astype(np.uint32)), length=merged(store.read("length"), np.full(len(live), j, small)))
        row[live] = place
        # older rows moved; only the newest are needed again
        live = live[lens[live] > j]
    return store.read("string"), store.read("length"), store.read("lcp")


def _runs(min_words: int, folder: str):
    """(anchor, seg, begin, end, keeper): windows begin..end of a segment stand in several documents, the least of which is keeper."""

    def run(u: pd.DataFrame) -> pd.DataFrame:
        strings = [np.frombuffer(x, np.uint32) for x in u["words"]]
        ids = np.unique(np.concatenate(strings), return_inverse=True)[1].astype(np.uint32) + np.uint32(1)
        strings = np.split(ids, np.cumsum([len(s) for s in strings])[:-1])
        store = Columns(f"{folder}/{uuid.uuid4().hex}")
        try:
            seg, length, lcp = column_wise(strings, store)
        finally:
            with contextlib.suppress(OSError):
                store.drop()
        full = length >= min_words
        cluster = np.cumsum(lcp < min_words)[full]
        seg, off = seg[full].astype(np.int64), np.array([len(s) for s in strings])[seg[full]] - length[full]
        lo, hi = u["lo_doc"].to_numpy()[seg], u["hi_doc"].to_numpy()[seg]
        begin = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1])) if len(cluster) else np.zeros(0, int)
        size = np.diff(np.append(begin, len(cluster)))
        keeper, most = (np.repeat(np.minimum.reduceat(lo, begin), size), np.repeat(np.maximum.reduceat(hi, begin), size)) if len(begin) else (lo, hi)
        ok = keeper != most
        seg, off, keeper = seg[ok], off[ok], keeper[ok]
        o = np.lexsort((off, seg))
        seg, off, keeper = seg[o], off[o], keeper[o]
        new = np.append(True, (seg[1:] != seg[:-1]) | (off[1:] != off[:-1] + 1) | (keeper[1:] != keeper[:-1])) if len(seg) else np.zeros(0, bool)
        b = np.flatnonzero(new)
        e = np.append(b[1:], len(seg)) - 1 if len(b) else b
        return pd.DataFrame({"anchor": u["anchor"].to_numpy()[seg[b]], "seg": u["seg"].to_numpy()[seg[b]], "begin": off[b], "end": off[e], "keeper": keeper[b]})

    return run


def _windows(min_words: int):
    """(anchor, seg, doc_id, at, window): every window of a segment and its hash."""

    def run(batches):
        for b in batches:
            raw = b.column(3).to_pylist()
            w = [T.gram_hashes(np.frombuffer(x, np.uint32).astype(np.uint64), min_words) for x in raw]
            many = np.array([len(x) for x in w], np.int64)
            row = pa.array(np.repeat(np.arange(len(w)), many))
            at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            flat = np.concatenate(w) if w else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(row) for i in range(3)), pa.array(at.astype(np.int32)), pa.array(flat.view(np.int64))], ["anchor", "seg", "doc_id", "at", "window"])

    return run


def _hot_runs(segments: DataFrame, min_words: int) -> DataFrame:
    """What _runs gives, window by window, from counts by hash: no task holds an anchor's segments."""
    w = segments.select("anchor", "seg", "doc_id", "words").mapInArrow(_windows(min_words), "anchor long, seg long, doc_id long, at int, window long")
    ends = w.groupBy("anchor", "window").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("most")).where("keeper != most").drop("most")
    return w.select("anchor", "seg", "at", "window").distinct().join(ends, ["anchor", "window"]).select("anchor", "seg", F.col("at").alias("begin"), F.col("at").alias("end"), "keeper")


def _merge(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a text as one."""
    w = Window.partitionBy("doc_id", "text_id", "removed").orderBy("start_word", "end_word")
    far = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("island", F.when(far >= F.col("start_word"), 0).otherwise(1))
    s = s.withColumn("island", F.sum("island").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("doc_id", "text_id", "removed", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("island")


def _identified(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_id): texts under one doc_id are told apart by their hash."""
    return texts(docs).where("doc_id is not null").withColumn("text_id", F.xxhash64("text"))


def _text_spans(docs: DataFrame, min_words: int) -> DataFrame:
    """``repeated_passages`` with the text_id of each."""
    if min_words < 1:
        raise ValueError("min_words must be positive")
    spark = docs.sparkSession
    t = _identified(docs)
    anchors = t.mapInArrow(_anchors(min_words), "anchor long, doc_id long, text_id long, lo int, hi int")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x != y").select("anchor")
    hits = table(anchors.join(shared, "anchor").groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("anchor", "lo", "hi")).alias("hits")), "anchors")
    segments = t.join(hits, ["doc_id", "text_id"]).select("doc_id", "text", "text_id", "hits").mapInArrow(_segments(min_words), "anchor long, doc_id long, text_id long, lo int, words binary")
    segments = table(segments.withColumn("seg", F.xxhash64("anchor", "words")), "segments")
    unique = table(segments.groupBy("anchor", "seg").agg(F.first("words").alias("words"), F.min("doc_id").alias("lo_doc"), F.max("doc_id").alias("hi_doc")), "unique")
    hot = table(unique.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), "hot")
    count = unique.count()
    buckets = max(1, math.ceil(count / SEGMENTS_PER_BUCKET))
    folder = f"{shared_dir(spark).rstrip('/')}/columns-{uuid.uuid4().hex}"
    few = unique.join(hot, "anchor", "left_anti")
    runs = few.groupBy(F.pmod(F.xxhash64(F.lit(7), "anchor"), F.lit(buckets)).alias("bucket")).applyInPandas(_runs(min_words, folder), "anchor long, seg long, begin int, end int, keeper long")
    if not hot.isEmpty():
        runs = runs.unionByName(_hot_runs(segments.join(hot, "anchor", "left_semi"), min_words))
    runs = cut(runs)
    drop(hits, unique, hot)
    found = segments.select("anchor", "seg", "doc_id", "text_id", "lo").join(runs, ["anchor", "seg"])
    found = found.select("doc_id", "text_id", (F.col("lo") + F.col("begin")).alias("start_word"), (F.col("lo") + F.col("end") + min_words).alias("end_word"), (F.col("doc_id") != F.col("keeper")).alias("cut")).distinct()
    return _merge(found.select("doc_id", "text_id", F.explode(F.when(F.col("cut"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("removed"), "start_word", "end_word"))


def repeated_passages(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, removed, start_word, end_word): spans of words, counted from 0, end excluded.

    Rows with removed = false cover every window of min_words words that stands in
    two documents or more; rows with removed = true cover those whose least doc_id
    is another one, so that cutting them leaves each passage in one document.
    Words are separated by ASCII white space and compared exactly.  A passage that
    repeats inside one document only does not count.  Rows that repeat a doc_id are
    one document: each of its texts has its spans, those of equal texts once.  Null
    doc_ids, null, empty and short texts have no spans; texts of any length are
    searched whole; the keeper is the least doc_id, so there are no ties; an empty
    table gives no rows; columns other than doc_id and text are ignored.
    """
    return _text_spans(docs, min_words).drop("text_id").distinct()


def _cut(text: str, spans: list) -> str:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = T.word_spans(data, np.array([0, len(data)]))
    keep = np.ones(len(data), bool)
    for x in spans:
        to = min(x["end_word"], len(starts))
        if x["start_word"] < to:
            keep[starts[x["start_word"]] : starts[to] if to < len(starts) else ends[-1]] = False
    return data[keep].tobytes().decode()


def _cut_all(batches):
    """(row, new): the text without its spans where it has any, else null."""
    for whole in batches:
        for b in slices([whole]):
            out = [None if s is None else _cut(t or "", s) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["row", "new"])


def cut_passages(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` without the passages that an earlier document holds too, row by row.

    n_chars, where there is a numeric or string one, follows; a document of which
    nothing is left goes.  Rows without such passages, null doc_ids and null, empty
    and short texts among them, stay as they were; rows that repeat a doc_id are each
    cut by the spans of their own text; an empty table stays empty; texts of any
    length are cut whole; columns may have any names.
    """
    spans = _text_spans(docs, min_words).where("removed").groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    spans = table(spans, "spans")
    rows = docs.select(whole_rows(docs), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    joined = rows.withColumn("text_id", F.xxhash64("text")).join(spans, ["doc_id", "text_id"], "left").select("row", "text", "spans")
    done = joined.mapInArrow(_cut_all, Kinds().add("row", docs.schema).add("new", "string")).where("new is null or trim(new) != ''")
    return with_texts(done, docs.schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
with w as (select doc_id, list_filter(string_split_regex(text, '[\x01-\x20]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, ws, unnest(range(0, len(ws) - 49)) as i from w where len(ws) >= 50),
g as (select doc_id, i, array_to_string(ws[i + 1:i + 50], ' ') as passage from s),
r as (select passage, min(doc_id) as keeper from g group by 1 having count(distinct doc_id) > 1),
f as (select doc_id, i, keeper from g join r using (passage)),
k as (select distinct doc_id, false as removed, i from f union all select distinct doc_id, true, i from f where doc_id <> keeper),
n as (select *, case when i - lag(i) over (partition by doc_id, removed order by i) <= 50 then 0 else 1 end as new from k),
h as (select *, sum(new) over (partition by doc_id, removed order by i) as island from n)
select doc_id, removed, cast(min(i) as int) as start_word, cast(max(i) + 50 as int) as end_word from h group by doc_id, removed, island
"""
