"""Language-model scoring from a log-frequency Bloom filter.

An n-gram of count c has level 1 + floor(log_b c), and the filter holds the pairs
(n-gram, 1) .. (n-gram, level), so probing levels upwards until one is missing
reads the quantised count back; errors can only raise it, and rarely.  Counts
cover all documents.  The filter is cut into segments by n-gram hash, each built
by one reducer; workers map the segments' files from the shared folder.  A filter
beyond ``broadcast_mb`` isn't spread to workers: the distinct n-grams of each slice
of text then go to the segment that holds them, and their levels come back.  Both
ways read the same filter, so scores don't depend on which one is taken.
"""

from __future__ import annotations

import functools
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import shared_dir, slices, string_bytes, table, texts

ORDER, BASE, HASHES = 2, 2.0, 7
BITS_PER_ENTRY = HASHES / math.log(2)
COMBINE = 3_000_000
LAMBDA = 0.7
SEGMENT_GRAMS = 4_000_000
_STEP = 0xA24BAED4963EE407


def grams(h: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, document) of all n-grams, for each n up to order."""
    out = []
    for n in range(1, order + 1):
        g, doc = T.doc_grams(h, first, n)
        out.append((T.mix(g + np.uint64(n)), doc))
    return out


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _count(order: int, parts: int):
    """Counts combined within a task, as blocks by segment: once-seen n-grams apart from the others.

    Their totals ride along, for the unigram model."""

    def emit(held: list[np.ndarray], tokens: int) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        part = _part(h, parts)  # ascending, as h is
        cut = np.searchsorted(part, np.arange(parts + 1))
        one = c == 1
        rows = [(p, h[s:e][one[s:e]].tobytes(), h[s:e][~one[s:e]].tobytes(), c[s:e][~one[s:e]].astype(np.uint32).tobytes(), tokens if p == part[0] else 0) for p, (s, e) in enumerate(zip(cut, cut[1:])) if e > s]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))], ["part", "once", "more", "counts", "tokens"])

    def run(batches):
        held, size, tokens = [], 0, 0
        for b in slices(batches):
            h, first, _, _ = T.word_hashes(*string_bytes(b.column(0)))
            if len(h):
                for g, _ in grams(h, first, order):
                    held.append(g)
                    size += len(g)
                tokens += len(h)
            if size >= COMBINE:
                yield emit(held, tokens)
                held, size, tokens = [], 0, 0
        if size:
            yield emit(held, tokens)

    return run


def levels(counts: np.ndarray, base: float = BASE) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def _keys(h: np.ndarray, level: int) -> np.ndarray:
    return T.mix(h + np.uint64(level * _STEP & 0xFFFFFFFFFFFFFFFF))


def _probe(k: np.ndarray, i: int, bits: int) -> np.ndarray:
    low = np.uint64(0xFFFFFFFF)
    return (((((k >> np.uint64(32)) + np.uint64(i) * ((k & low) | np.uint64(1))) & low) * np.uint64(bits)) >> np.uint64(32)).astype(np.int64)


def build_segment(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The bits of a segment that holds n-grams h of counts c, as bytes."""
    q = levels(c)
    bits = max(64, math.ceil(int(q.sum()) * BITS_PER_ENTRY / 8) * 8)
    held = np.zeros(bits, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        k = _keys(h[q >= level], level)
        for i in range(HASHES):
            held[_probe(k, i, bits)] = True
    return np.packbits(held, bitorder="little")


def read_levels(h: np.ndarray, segment: np.ndarray, most: int = 64) -> np.ndarray:
    """Levels by repeated membership probes; 0 where the n-gram is absent."""
    out, held, bits = np.zeros(len(h), np.int64), np.arange(len(h)), len(segment) * 8
    for level in range(1, most + 1):
        k = _keys(h[held], level)
        for i in range(HASHES):
            at = _probe(k, i, bits)
            ok = (segment[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            held, k = held[ok], k[ok]
            if not len(held):
                return out
        out[held] = level
    return out


def _totals(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of a segment's blocks."""
    h = np.concatenate([np.frombuffer(x, np.uint64) for c in ("once", "more") for x in rows[c]])
    c = np.concatenate([*(np.ones(len(x) // 8, np.int64) for x in rows["once"]), *(np.frombuffer(x, np.uint32).astype(np.int64) for x in rows["counts"])])
    o = np.argsort(h)
    h, c = h[o], c[o]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[at], np.add.reduceat(c, at)


def _segment(folder: str):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h, c = _totals(rows)
        bits = build_segment(h, c)
        disk, path = fs.FileSystem.from_uri(folder)
        disk.create_dir(path, recursive=True)
        name = f"{path}/{int(key[0]):06d}"
        with disk.open_output_stream(f"{name}.{(own := uuid.uuid4().hex)}") as f:
            f.write(bits.data)
        disk.move(f"{name}.{own}", name)  # a task that runs again puts the same file in place
        return pd.DataFrame({"part": [int(key[0])], "grams": [len(h)], "bytes": [len(bits)], "tokens": [int(rows["tokens"].sum())]})

    return run


def _level_rows(rows: pd.DataFrame) -> pd.DataFrame:
    h, c = _totals(rows)
    return pd.DataFrame({"gram": h.view(np.int64), "level": levels(c)})


def _level_rows(rows: pd.DataFrame) -> pd.DataFrame:
    h, c = _totals(rows)
    return pd.DataFrame({"gram": h.view(np.int64), "level": levels(c)})


class Segments:
    """The segments' bytes: mapped where the shared folder is a mounted one, read once a worker elsewhere."""

    def __init__(self, folder: str, parts: int):
        self.disk, self.path = fs.FileSystem.from_uri(folder)
        self.parts = parts
        self.held: dict[int, np.ndarray] = {}

    def __getitem__(self, p: int) -> np.ndarray:
        if p not in self.held:
            at = f"{self.path}/{p:06d}"
            if self.disk.get_file_info(at).size == 0:
                self.held[p] = np.zeros(8, np.uint8)
            elif isinstance(self.disk, fs.LocalFileSystem):
                self.held[p] = np.memmap(at, np.uint8, "r")
            else:
                with self.disk.open_input_stream(at) as f:
                    self.held[p] = np.frombuffer(f.read(), np.uint8)
        return self.held[p]

    def levels(self, h: np.ndarray) -> np.ndarray:
        u, back = np.unique(h, return_inverse=True)  # frequent n-grams, of high levels, are probed once a slice
        cut = np.searchsorted(_part(u, self.parts), np.arange(self.parts + 1))
        out = np.zeros(len(u), np.int64)
        for p in np.flatnonzero(np.diff(cut)):
            out[cut[p] : cut[p + 1]] = read_levels(u[cut[p] : cut[p + 1]], self[int(p)])
        return out[back]


@functools.lru_cache(2)
def _open(folder: str, parts: int) -> Segments:
    return Segments(folder, parts)


def smooth(lv: list[np.ndarray], tokens: int) -> np.ndarray:
    """log p of every word from the levels of the n-grams that end at it (-1: none does).

    p_1 = (c + 1/2) / (tokens + 1), p_n = LAMBDA * c(n-gram) / c(history) + (1 - LAMBDA) * p_(n-1).
    """
    count = lambda q: np.where(q > 1, (1 + BASE) / 2 * BASE ** (q - 1.0), np.maximum(q, 0))
    p = (count(lv[0]) + 0.5) / (tokens + 1)
    for n in range(1, len(lv)):
        has = np.flatnonzero(lv[n] >= 0)
        ratio = np.minimum(1, count(lv[n][has]) / np.maximum(count(lv[n - 1][has - 1]), 1))
        p[has] = LAMBDA * ratio + (1 - LAMBDA) * p[has]
    return np.log(p)


def _scored(ids: pa.Array, first: np.ndarray, logp: np.ndarray) -> pa.RecordBatch:
    n = np.diff(first)
    s = np.append(0, np.cumsum(logp))
    total = s[first[1:]] - s[first[:-1]]
    ppl = np.exp(-total / np.maximum(n, 1))
    return pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(np.round(total, 4)), pa.array(np.round(ppl, 4), mask=n == 0)], ["doc_id", "n_words", "log_prob", "perplexity"])


def _gram_levels(h: np.ndarray, first: np.ndarray, order: int, levels) -> list[np.ndarray]:
    """The level of the n-gram that ends at each word, for each n up to order; -1 where none does."""
    lv = []
    for n, (g, _) in enumerate(grams(h, first, order), 1):
        full = np.full(len(h), -1, np.int64)
        if len(g):
            start = np.flatnonzero(np.repeat(first[1:], np.diff(first)) - np.arange(len(h)) >= n)
            full[start + n - 1] = levels(g)
        lv.append(full)
    return lv


SCORED = "doc_id long, n_words long, log_prob double, perplexity double"


def _score(folder: str, parts: int, order: int, tokens: int):
    def run(batches):
        seg = _open(folder, parts)
        for b in slices(batches, 4 << 20):
            h, first, _, _ = T.word_hashes(*string_bytes(b.column(1)))
            lv = _gram_levels(h, first, order, seg.levels)
            yield _scored(b.column(0), first, smooth(lv, tokens) if len(h) else np.zeros(0))

    return run


def _sliced(batches):
    """Rows with the number of their slice, which is that of its first row."""
    for b in batches:
        for x in slices([b], 4 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(x.num_rows, x.column(0)[0].as_py(), np.int64)), *x.columns], ["slice", "row", "doc_id", "text"])


def _distinct(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each text, its distinct n-grams in order) of a slice."""
    h, first, _, _ = T.word_hashes(*string_bytes(texts))
    return h, first, np.unique(np.concatenate([g for g, _ in grams(h, first, order)])) if len(h) else np.zeros(0, np.uint64)


def _asked(order: int, parts: int):
    """The distinct n-grams of slices as blocks by segment; a slice that batches divide asks in runs from row ``at``."""

    def run(batches):
        for b in batches:
            number = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.zeros(0, int)
            for s, e in zip(cuts, np.append(cuts[1:], len(number))):
                _, _, u = _distinct(b.column(2).slice(s, e - s), order)
                at = np.searchsorted(_part(u, parts), np.arange(parts + 1))
                held = np.flatnonzero(np.diff(at))
                blocks = pa.array([u[at[p] : at[p + 1]].tobytes() for p in held], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), number[s])), pa.array(np.full(len(held), b.column(1)[s].as_py(), np.int64)), pa.array(held), blocks], ["slice", "at", "part", "grams"])

    return run


def _answer(folder: str, parts: int):
    """The levels of a segment's blocks, one byte each, in the order of the n-grams."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        bits = Segments(folder, parts)[key[0].as_py()]
        out = [read_levels(np.frombuffer(x.as_buffer(), np.uint64), bits).astype(np.uint8).tobytes() for x in t.column("grams")]
        return pa.table({"slice": t.column("slice"), "at": t.column("at"), "part": t.column("part"), "levels": pa.array(out, pa.binary())})

    return run


def _score_slice(order: int, tokens: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows, answers = rows.sort_by("row").combine_chunks(), answers.sort_by([("at", "ascending"), ("part", "ascending")])
        asked = answers.column("at").to_numpy()
        begin = np.unique(asked)
        cuts = np.searchsorted(rows.column("row").to_numpy(), begin)
        cuts[:1] = 0  # rows without words ask nothing
        out = []
        for a, s, e in zip(begin, cuts, np.append(cuts[1:], len(rows))) if len(begin) else [(0, 0, len(rows))]:
            x = rows.slice(s, e - s).combine_chunks().to_batches()[0]
            h, first, u = _distinct(x.column(x.schema.get_field_index("text")), order)
            lo, hi = np.searchsorted(asked, [a, a + 1])
            level = np.frombuffer(b"".join(answers.column("levels").slice(lo, hi - lo).to_pylist()), np.uint8).astype(np.int64)
            lv = _gram_levels(h, first, order, lambda g: level[np.searchsorted(u, g)])  # noqa: B023
            out.append(_scored(x.column(x.schema.get_field_index("doc_id")), first, smooth(lv, tokens) if len(h) else np.zeros(0)))
        return pa.Table.from_batches(out)

    return run


def _gram_rows(order: int):
    def run(batches):
        for b in slices(batches):
            h, first, _, _ = T.word_hashes(*string_bytes(b.column(1)))
            for n, (g, doc) in enumerate(grams(h, first, order), 1):
                start = np.flatnonzero(np.repeat(first[1:], np.diff(first)) - np.arange(len(h)) >= n) if len(h) else np.zeros(0, int)
                at = start - first[doc] + n - 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(at), pa.array(np.full(len(g), n, np.int32)), pa.array(g.view(np.int64))], ["row", "at", "n", "gram"])

    return run


def _score_rows(order: int, tokens: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = int(rows["at"].max()) + 1
        lv = [np.full(size, -1, np.int64) for _ in range(order)]
        for n in range(1, order + 1):
            x = rows[rows["n"] == n]
            lv[n - 1][x["at"].to_numpy()] = x["level"].to_numpy()
        logp = smooth(lv, tokens)
        return pd.DataFrame({"row": [int(key[0])], "n_words": [size], "log_prob": [round(float(logp.sum()), 4)], "perplexity": [round(float(np.exp(-logp.mean())), 4)]})

    return run


def score(docs: DataFrame, order: int = ORDER, broadcast_mb: float = 1024) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity), one row a row of ``docs``.

    The model is the n-gram counts of all documents, repeated rows included.  log_prob
    is the natural logarithm summed over words.  Null, empty and word-less texts have
    no words, log_prob 0 and a null perplexity; rows with a null doc_id are counted
    and scored like all others; an empty table gives no rows; columns other than
    doc_id and text are ignored.  A ``broadcast_mb`` of 0 asks for exact levels without
    the filter, to compare with.
    """
    spark, t = docs.sparkSession, texts(docs)
    size = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(12, math.ceil(size / 6 * order * 0.6 / SEGMENT_GRAMS))
    folder = f"{shared_dir(spark).rstrip('/')}/bloom-{uuid.uuid4().hex}"
    blocks = t.select("text").mapInArrow(_count(order, parts), "part long, once binary, more binary, counts binary, tokens long")
    made = blocks.groupBy("part").applyInPandas(_segment(folder), "part long, grams long, bytes long, tokens long")
    stats = made.agg(F.sum("bytes"), F.sum("tokens")).first()
    tokens = stats[1] or 0
    if (stats[0] or 0) <= broadcast_mb * 1e6:
        return t.mapInArrow(_score(folder, parts, order, tokens), SCORED)
    numbered = t.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if broadcast_mb:
        rows = table(numbered.mapInArrow(_sliced, "slice long, row long, doc_id long, text string"), "slices")
        asked = rows.select("slice", "row", "text").mapInArrow(_asked(order, parts), "slice long, at long, part long, grams binary")
        answers = asked.groupBy("part").applyInArrow(_answer(folder, parts), "slice long, at long, part long, levels binary")
        return rows.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_score_slice(order, tokens), SCORED)
    rows = table(numbered, "rows")
    lv = blocks.groupBy("part").applyInPandas(_level_rows, "gram long, level long")
    g = rows.select("row", "text").mapInArrow(_gram_rows(order), "row long, at long, n int, gram long").join(lv, "gram")
    scored = g.groupBy("row").applyInPandas(_score_rows(order, tokens), "row long, n_words long, log_prob double, perplexity double")
    out = rows.select("row", "doc_id").join(scored, "row", "left")
    return out.select("doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("log_prob", F.lit(0.0)).alias("log_prob"), "perplexity")


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
