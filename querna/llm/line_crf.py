"""Quality classifier: a linear-chain conditional random field over a document's lines.

A line's features, and those of the lines before and after it, give the score of
its being good; transitions join neighbouring labels.  Forward-backward marginals,
weighted by line length, make up the document's quality.

Labels are known of documents alone, so those of lines are latent: a bad document
has one bad line at least, a good one is good over most of its length.  Fitting
alternates between the lines' labels under these constraints and the field, first
on the lines' own features, then with neighbours and transitions, on the documents
and on good ones into which lines of bad ones are spliced, whose labels are known.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import slices, string_bytes, texts

FEATURES = ["short", "long", "upper", "digit", "symbol", "shout", "stutter", "repeat", "word_length", "no_stop", "empty", "many_symbols", "many_upper", "many_stutters"]
_K = len(FEATURES)
#: Alternations of labels and field; below this marginal a good document's line is surely bad.
EM_ROUNDS, SURE = 3, 0.1
_CLASS = np.zeros((256, 5), np.int64)
_CLASS[ord("A") : ord("Z") + 1, 0] = 1
_CLASS[ord("0") : ord("9") + 1, 1] = 1
_CLASS[[ord(c) for c in "#$%&*|<>{}^~=\\_@"], 2] = 1
_CLASS[ord("!"), 3] = 1
_CLASS[33:, 4] = 1


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, first): one row a line; first[d] is document d's first line, the total comes last."""
    n = len(data)
    nl = np.flatnonzero(data == 10)
    docs = len(offs) - 1
    # a line begins at each document's start and after each newline in it
    inside = np.searchsorted(offs, nl, "right") - 1
    begin = np.concatenate([offs[:-1], nl + 1])
    doc = np.concatenate([np.arange(docs), inside])
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    end = np.where(last, offs[doc + 1], np.append(begin[1:], n) - 1) if len(doc) else begin
    first = np.searchsorted(doc, np.arange(docs + 1))
    size = end - begin
    counts = np.zeros((len(begin), 5))
    for c in range(5):
        total = np.append(0, np.cumsum(_CLASS[data, c]))
        counts[:, c] = total[end] - total[begin]
    h, _, ws, we = T.word_hashes(data, offs)
    wl = np.searchsorted(begin, ws, "right") - 1 if len(ws) else ws
    # empty lines share their begin with nothing: the last line that begins at or before a word holds it
    words = np.bincount(wl, minlength=len(begin))
    same = np.append(False, (h[1:] == h[:-1]) & (wl[1:] == wl[:-1])) if len(h) else np.zeros(0, bool)
    stutter = np.bincount(wl[same], minlength=len(begin))
    pos = np.cumsum(np.bincount(wl, minlength=len(begin))) - words
    rank = (np.arange(len(h)) - pos[wl] + 1).astype(np.uint64) if len(h) else np.zeros(0, np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(T.mix(h ^ T.mix(rank)), dtype=np.uint64)) if len(h) else np.zeros(1, np.uint64)
    digest = sums[pos + words] - sums[pos]
    o = np.lexsort((np.arange(len(begin)), digest, doc))
    repeat = np.zeros(len(begin), bool)
    repeat[o[1:]] = (doc[o[1:]] == doc[o[:-1]]) & (digest[o[1:]] == digest[o[:-1]]) & (words[o[1:]] > 0)
    stop = np.zeros(len(begin), bool)
    some = size > 0
    stop[some] = np.isin(data[end[some] - 1], [ord(c) for c in ".!?:;\"')"])
    ink, w = np.maximum(counts[:, 4], 1), np.maximum(words, 1)
    upper, symbol, st = counts[:, 0] / ink, counts[:, 2] / ink, stutter / w
    x = np.stack([
        words < 4, np.minimum(np.log1p(words) / 6, 2), upper, counts[:, 1] / ink, symbol, np.minimum(counts[:, 3] / w, 1), st, repeat, np.minimum(ink / w / 12, 3), ~stop, words == 0,
        symbol > 0.03, upper > 0.3, (st > 0.2) & (words >= 5),
    ], 1).astype(np.float64)
    return x, size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, its neighbours' (zeros beyond the ends) and a bias."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    starts, ends = first[:-1][np.diff(first) > 0], first[1:][np.diff(first) > 0] - 1
    before[starts], after[ends] = 0, 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], 1)


@dataclass
class Crf:
    weights: np.ndarray  # of a line's being good rather than bad
    trans: np.ndarray  # [label before, label]
    threshold: float = 0.5  # of a document's quality

    def marginals(self, e: np.ndarray, first: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line; with pairs, also the expected transitions.  All documents advance together."""
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        n, at = n[order], first[:-1][order]
        good = 1 / (1 + np.exp(-np.clip(e, -40, 40)))
        emit = np.stack([1 - good, good], 1) + 1e-300
        move = np.exp(self.trans - self.trans.max())
        a, b, xi = np.zeros_like(emit), np.ones_like(emit), np.zeros((2, 2))
        steps = int(n[0]) if len(n) else 0
        alive = np.searchsorted(-n, -np.arange(steps), "left")  # documents of more than t lines
        for t in range(steps):
            i = at[: alive[t]] + t
            v = emit[i] if t == 0 else (a[i - 1] @ move) * emit[i]
            a[i] = v / v.sum(1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            i = at[: alive[t + 1]] + t
            v = (emit[i + 1] * b[i + 1]) @ move.T
            b[i] = v / v.sum(1, keepdims=True)
            if pairs:
                p = a[i][:, :, None] * move[None] * (emit[i + 1] * b[i + 1])[:, None, :]
                xi += (p / p.sum((1, 2), keepdims=True)).sum(0)
        m = a * b
        return m[:, 1] / np.maximum(m.sum(1), 1e-300), xi

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 120, l2: float = 1e-3) -> Crf:
        """Adam on the mean log-likelihood of the lines' labels."""
        seen = np.zeros((2, 2))
        inner = np.ones(len(y), bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        i = np.flatnonzero(inner)
        np.add.at(seen, (y[i - 1], y[i]), 1)
        theta = np.concatenate([self.weights, self.trans.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, rounds + 1):
            self.weights, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
            p, xi = self.marginals(x @ self.weights, first, True)
            g = np.concatenate([x.T @ (y - p), (seen - xi).ravel()]) / max(1, len(y)) - l2 * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.weights, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
        return self


def latent(p: np.ndarray, size: np.ndarray, first: np.ndarray, doc_good: np.ndarray) -> np.ndarray:
    """Line labels from marginals: in a bad document the least line is bad whatever it is; in a
    good one lines are bad where they surely are, and those of half its length at most, the worst first."""
    y = (p >= 0.5).astype(np.int64)
    for d, good in enumerate(doc_good):
        s, e = first[d], first[d + 1]
        if s == e:
            continue
        if not good:
            y[s + int(p[s:e].argmin())] = 0
            continue
        order = np.argsort(p[s:e], kind="stable")
        room = np.cumsum(size[s:e][order]) <= size[s:e].sum() / 2
        y[s:e] = 1
        y[s + order[room & (p[s:e][order] < SURE)]] = 0
    return y


def spliced(x: np.ndarray, y: np.ndarray, first: np.ndarray, doc_good: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, first) of good documents, each with a run of a bad document's bad lines put in."""
    r = np.random.default_rng(seed)
    bad = [np.flatnonzero(y[s:e] == 0) + s for s, e, g in zip(first, first[1:], doc_good) if not g]
    bad = [b for b in bad if len(b)]
    xs, ys = [np.zeros((0, x.shape[1]))], [np.zeros(0, np.int64)]
    for d in np.flatnonzero(doc_good) if bad else []:
        s, e = first[d], first[d + 1]
        lines = bad[r.integers(len(bad))]
        lines = lines[(start := r.integers(len(lines))) : start + 1 + r.integers(3)]
        at = s + r.integers(e - s + 1)
        xs.append(np.concatenate([x[s:at], x[lines], x[at:e]]))
        ys.append(np.concatenate([y[s:at], y[lines], y[at:e]]))
    return np.concatenate(xs), np.concatenate(ys), np.append(0, np.cumsum([len(v) for v in ys[1:]])).astype(np.int64)


def fit_documents(xs: list[np.ndarray], sizes: list[np.ndarray], doc_good: np.ndarray, rounds: int = EM_ROUNDS) -> Crf:
    """The field fitted on documents' lines (own features, lengths in bytes) and labels."""
    first = np.append(0, np.cumsum([len(x) for x in xs]))
    x, size = np.concatenate(xs), np.concatenate(sizes)
    y = np.repeat(doc_good.astype(np.int64), np.diff(first))
    # lines alone: neither neighbours nor transitions, so a clean line of a bad document looks as clean as any
    own = Crf(np.zeros(_K + 1), np.zeros((2, 2)))
    alone, lone = np.concatenate([x, np.ones((len(x), 1))], 1), np.arange(len(x) + 1)
    for _ in range(2):
        own.fit(alone, lone, y)
        y = latent(own.marginals(alone @ own.weights, lone)[0], size, first, doc_good)
    crf = Crf(np.zeros(3 * _K + 1), np.zeros((2, 2)))
    full = with_neighbours(x, first)
    for i in range(rounds):
        sx, sy, sf = spliced(x, y, first, doc_good, i)
        crf.fit(np.concatenate([full, with_neighbours(sx, sf)]), np.append(first, len(x) + sf[1:]), np.concatenate([y, sy]), 40 if i else 120)
        p = crf.marginals(full @ crf.weights, first)[0]
        y = latent(p, size, first, doc_good)
    weight = np.array([(p[s:e] * size[s:e]).sum() / max(1, size[s:e].sum()) for s, e in zip(first, first[1:])])
    if 0 < doc_good.mean() < 1:  # within a thousandth of the least error over the fitted documents, nearest to one half
        bounds = np.arange(0.05, 0.96, 0.05)
        wrong = np.array([((weight >= b) != (doc_good > 0)).sum() for b in bounds])
        fair = bounds[wrong <= wrong.min() + 0.001 * len(weight)]
        crf.threshold = round(float(fair[np.abs(fair - 0.5).argmin()]), 6)
    return crf


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = 3000) -> Crf:
    """Fits on at most fit_docs labelled documents (those of the least hashed doc_id).
    Without any, the model knows nothing and says 0.5."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    rows = texts(docs).join(F.broadcast(few), "doc_id")

    def lines(batches):
        for b in slices(batches):
            x, size, first = line_features(*string_bytes(b.column(1)))
            raw = [(x[s:e].astype(np.float32).tobytes(), size[s:e].astype(np.int64).tobytes()) for s, e in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(v, pa.binary()) for v in zip(*raw))], ["doc_id", "quality", "x", "size"])

    got = rows.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(lines, "doc_id long, quality int, x binary, size binary").collect()
    got.sort(key=lambda r: (r[0], r[2]))
    if not got:
        return Crf(np.zeros(3 * _K + 1), np.zeros((2, 2)))
    xs = [np.frombuffer(r[2], np.float32).reshape(-1, _K).astype(np.float64) for r in got]
    return fit_documents(xs, [np.frombuffer(r[3], np.int64) for r in got], np.array([int(r[1] > 0) for r in got]))


def classify(docs: DataFrame, crf: Crf, threshold: float | None = None) -> DataFrame:
    """(doc_id, n_lines, n_bad, line_good, quality, keep), one row a row of ``docs``.

    line_good tells for every line, split at newlines, whether its marginal reaches
    one half (ties are good); quality is the mean marginal weighted by line length in
    bytes, and keeps where it reaches the threshold, the model's unless one is given.
    Null and empty texts have one empty line and quality 0; rows with a null doc_id
    and repeated rows are classified like all others; texts of any length and number
    of lines are read whole; an empty table gives no rows; columns other than doc_id
    and text are ignored.
    """
    threshold = crf.threshold if threshold is None else threshold

    def run(batches):
        for b in slices(batches):
            x, size, first = line_features(*string_bytes(b.column(1)))
            p, _ = crf.marginals(with_neighbours(x, first) @ crf.weights, first)
            good = p >= 0.5
            w = np.append(0, np.cumsum(size * p))
            s = np.append(0, np.cumsum(size))
            total = s[first[1:]] - s[first[:-1]]
            q = np.round(np.where(total > 0, (w[first[1:]] - w[first[:-1]]) / np.maximum(total, 1), 0), 6)
            g = np.append(0, np.cumsum(good))
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n.astype(np.int32)), pa.array((n - (g[first[1:]] - g[first[:-1]])).astype(np.int32)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(good)), pa.array(q), pa.array(q >= threshold)],
                ["doc_id", "n_lines", "n_bad", "line_good", "quality", "keep"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_lines int, n_bad int, line_good array<boolean>, quality double, keep boolean")


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
