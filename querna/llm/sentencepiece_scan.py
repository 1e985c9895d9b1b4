"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

The vocabulary is a byte-fallback BPE model.  A segmentation is the one that BPE
gives exactly if each two neighbouring pieces are what BPE gives for their
concatenation (the first merge across a boundary would have to happen for the two
pieces alone, too).  So encoding is the best path of a lattice whose steps weigh
-1 a piece, or minus infinity where neighbours don't agree, and whose state is
the last piece.  A giant document is cut into chunks of characters.  The states at
a cut are the pieces that could hold the character before it; a chunk's transfer
matrix has the best path from each state at its left end to each at its right.
Max-plus products of these, which are associative, are taken by blocks of chunks,
then over the blocks, then inside each block again, which tells the state at every
cut, and each chunk is then traced by itself.

No piece has a space after another character, so BPE never merges across such a
place: between the first and the last of them a chunk is the library's to encode.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, texts

#: The vocabulary of the registered query.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT, CHUNK = 32_768, 16_384
#: Chunks of a block, of which the matrices are multiplied in one task.
BLOCK = 64
NONE = -math.inf


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.prefix = "▁" if proto.normalizer_spec.add_dummy_prefix else ""
        proto.normalizer_spec.add_dummy_prefix = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.longest = max(map(len, self.ids))
        if any(b == "▁" != a for p in self.ids for a, b in zip(p, p[1:])):
            raise ValueError("a piece of this model has a space after another character")
        self._own: dict[str, list[int]] = {}
        self._pair: dict[tuple[str | None, str], bool] = {}

    def normal(self, text: str) -> str:
        return self.prefix + text.replace(" ", "▁") if text else ""

    def own(self, t: str) -> list[int]:
        """A piece's id; of a character that is no piece, its bytes' ids."""
        if t not in self._own:
            self._own[t] = [self.ids[t]] if t in self.ids else self.inner.encode(t)
        return self._own[t]

    def agree(self, last: str | None, t: str) -> bool:
        """Whether BPE gives these two pieces for their concatenation (the one, where nothing is before)."""
        key = (last, t)
        if key not in self._pair:
            if len(self._pair) > 2_000_000:
                self._pair.clear()
            self._pair[key] = self.inner.encode((last or "") + t) == (self.own(last) if last else []) + self.own(t)
        return self._pair[key]


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def safe(text: str, i: int) -> bool:
    """No piece lies across place i."""
    return i == 0 or i == len(text) or (text[i] == "▁" and text[i - 1] != "▁")


def states(p: Pieces, text: str, cut: int, at_start: bool, at_end: bool) -> list[tuple[int, int]]:
    """(begin, end) of pieces that could hold the character before the cut; the text's ends have one state each."""
    if at_start or at_end:
        return [(cut, cut)]
    return [
        (s, e)
        for s in range(max(0, cut - p.longest), cut)
        for e in range(cut, min(len(text), s + p.longest) + 1)
        if e - s == 1 or text[s:e] in p.ids
    ]


def walk(p: Pieces, text: str, begin: int, last: str | None, stop: int) -> dict[int, tuple[int, str | None, int]]:
    """place: (pieces so far, last piece, its begin) of the only path to each place up to stop, and a piece beyond it."""
    reach = {begin: (0, last, begin)}
    for i in range(begin, stop):
        if i in reach:
            n, before, _ = reach[i]
            if safe(text, i):
                before = None
            for e in range(i + 1, min(len(text), i + p.longest) + 1):
                t = text[i:e]
                if (e == i + 1 or t in p.ids) and e not in reach and p.agree(before, t):
                    reach[e] = (n + 1, t, i)
    return reach


def trace(p: Pieces, text: str, reach: dict, begin: int, end: int) -> list[int]:
    out: list[list[int]] = []
    while end > begin:
        _, t, s = reach[end]
        out.append(p.own(t))
        end = s
    return [i for ids in reversed(out) for i in ids]


class Chunk:
    """Characters lo..hi of ``text``, which has context on either side."""

    def __init__(self, p: Pieces, text: str, lo: int, hi: int, first: bool, last: bool):
        self.p, self.text, self.lo, self.hi = p, text, lo, hi
        self.ins, self.outs = states(p, text, lo, first, False), states(p, text, hi, False, last)
        self.last = last
        inside = [i for i in range(lo if first else lo + 1, hi + 1 if last else hi) if (i == lo and first) or (i == hi and last) or safe(text, i)]
        self.b1, self.b2 = (inside[0], inside[-1]) if inside else (None, None)

    def _heads(self, state: tuple[int, int]) -> dict:
        s, e = state
        stop = self.hi if self.b1 is None else self.b1
        return walk(self.p, self.text, e, self.text[s:e] or None, stop)

    def _exit(self, reach: dict, state: tuple[int, int]) -> float:
        """Pieces to the end of the exit state's piece."""
        s, e = state
        if s == e:
            return reach[e][0] if e in reach else math.inf
        if s not in reach:
            return math.inf
        n, before, _ = reach[s]
        return n + 1 if self.p.agree(None if safe(self.text, s) else before, self.text[s:e]) else math.inf

    @functools.cached_property
    def middle(self) -> list[int]:
        return self.p.inner.encode(self.text[self.b1 : self.b2]) if self.b1 is not None and self.b2 > self.b1 else []

    def matrix(self) -> np.ndarray:
        m = np.full((len(self.ins), len(self.outs)), NONE)
        if self.b1 is None:
            for i, a in enumerate(self.ins):
                if a[1] > self.hi:
                    # one piece spans the chunk: it is the state on both sides
                    m[i] = [0 if a == b else NONE for b in self.outs]
                    continue
                r = self._heads(a)
                m[i] = [0 if a == b else -self._exit(r, b) for b in self.outs]
            return m
        tail = walk(self.p, self.text, self.b2, None, self.hi)
        outs = np.array([-self._exit(tail, b) if b[0] >= self.b2 else NONE for b in self.outs])
        for i, a in enumerate(self.ins):
            if a[1] <= self.b1:
                r = self._heads(a)
                if self.b1 in r:
                    m[i] = -r[self.b1][0] - len(self.middle) + outs
        return m

    def trace(self, i: int, j: int) -> list[int]:
        a, b = self.ins[i], self.outs[j]
        if self.b1 is None:
            if a == b and a[1] >= self.hi and a[0] < self.lo:
                return []
            r = self._heads(a)
            return trace(self.p, self.text, r, a[1], b[0]) + (self.p.own(self.text[b[0] : b[1]]) if b[1] > b[0] else [])
        head = trace(self.p, self.text, self._heads(a), a[1], self.b1)
        tail = trace(self.p, self.text, walk(self.p, self.text, self.b2, None, self.hi), self.b2, b[0])
        return head + self.middle + tail + (self.p.own(self.text[b[0] : b[1]]) if b[1] > b[0] else [])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product; associative."""
    return (a[:, :, None] + b[None, :, :]).max(1, initial=NONE)


def whole(matrices: list[np.ndarray]) -> np.ndarray:
    """The product of neighbouring chunks' matrices, paired as in a tree."""
    while len(matrices) > 1:
        matrices = [product(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def best_states(matrices: list[np.ndarray], enter: int = 0, leave: int = 0) -> list[int]:
    """The state at each cut, both ends included, on the best path between the states at the ends."""
    start, end = np.full((1, matrices[0].shape[0]), NONE), np.full((matrices[-1].shape[1], 1), NONE)
    start[0, enter] = end[leave, 0] = 0
    left, right = [start], [end]
    for m in matrices:
        left.append(product(left[-1], m))
    for m in reversed(matrices):
        right.append(product(m, right[-1]))
    return [int((a[0] + b[:, 0]).argmax()) for a, b in zip(left, reversed(right))]


def cuts(p: Pieces, text: str, size: int) -> list[tuple[int, str, int, int, bool, bool]]:
    """(number, text with context, lo, hi, first, last) of the chunks of a normalised text."""
    n, reach = max(1, math.ceil(len(text) / size)), p.longest + 1
    out = []
    for k in range(n):
        lo, hi = k * size, min(len(text), (k + 1) * size)
        a, b = max(0, lo - reach), min(len(text), hi + reach)
        out.append((k, text[a:b], lo - a, hi - a, k == 0, k == n - 1))
    return out


def encode_giant(p: Pieces, text: str, size: int = CHUNK) -> list[int]:
    """What the jobs below do to one document, on the spot."""
    chunks = [Chunk(p, *c[1:]) for c in cuts(p, p.normal(text), size)]
    at = best_states([c.matrix() for c in chunks])
    return [i for c, a, b in zip(chunks, at, at[1:]) for i in c.trace(a, b)]


def _encode_small(model: str):
    def run(batches):
        p = pieces(model)
        for b in slices(batches):
            ids = p.whole.encode(b.column(1).to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return run


_CUT = "row long, chunk int, text string, lo int, hi int, first boolean, last boolean"


def _cuts(model: str):
    def run(batches):
        p = pieces(model)
        for b in slices(batches):
            for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = pd.DataFrame(cuts(p, p.normal(t), CHUNK), columns=["chunk", "text", "lo", "hi", "first", "last"])
                c.insert(0, "row", row)
                yield pa.RecordBatch.from_pandas(c.astype({"chunk": "int32", "lo": "int32", "hi": "int32"}), preserve_index=False)

    return run


def _matrices(model: str):
    def run(batches):
        p = pieces(model)
        for b in batches:
            out = [Chunk(p, *c).matrix() for c in zip(*(b.column(i).to_pylist() for i in range(2, 7)))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([m.shape[0] for m in out], pa.int32()), pa.array([m.ravel().tolist() for m in out], pa.list_(pa.float64()))], ["row", "chunk", "ins", "weights"]
            )

    return run


def _each(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.array(w).reshape(n, -1) for n, w in zip(rows["ins"], rows["weights"])]


def _products(rows: pd.DataFrame) -> pd.DataFrame:
    """The matrix of each block of neighbouring chunks."""
    rows = rows.sort_values("chunk")
    m = whole(_each(rows))
    return pd.DataFrame({"row": rows["row"].iloc[:1], "block": rows["block"].iloc[:1], "ins": [m.shape[0]], "weights": [m.ravel().tolist()]})


def _ends(rows: pd.DataFrame) -> pd.DataFrame:
    """The states between a document's blocks."""
    rows = rows.sort_values("block")
    at = best_states(_each(rows))
    return pd.DataFrame({"row": rows["row"], "block": rows["block"], "begin": at[:-1], "end": at[1:]})


def _scan(rows: pd.DataFrame) -> pd.DataFrame:
    """The states between a block's chunks, from those at its ends."""
    rows = rows.sort_values("chunk")
    at = best_states(_each(rows), int(rows["begin"].iloc[0]), int(rows["end"].iloc[0]))
    return pd.DataFrame({"row": rows["row"], "chunk": rows["chunk"], "enter": at[:-1], "leave": at[1:]})


def _traces(model: str):
    def run(batches):
        p = pieces(model)
        for b in batches:
            ids = [Chunk(p, *c[:5]).trace(c[5], c[6]) for c in zip(*(b.column(i).to_pylist() for i in range(2, 9)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["row", "chunk", "ids"])

    return run


def encode(docs: DataFrame, model: str, giant: int = GIANT) -> DataFrame:
    """(doc_id, n_tokens, ids), one row a row of ``docs``: the ids that the library gives.

    ``model`` is the path of the vocabulary file, which every worker must have.  Texts of
    more than ``giant`` characters are scanned in chunks; paths of equal weight do not
    occur, as only one segmentation agrees at every pair.  Null and empty
    texts have no ids; rows with a null doc_id and repeated rows are encoded like all
    others; an empty table gives no rows; columns other than doc_id and text are ignored.
    """
    t = texts(docs)
    small = t.where(F.length("text") <= giant).mapInArrow(_encode_small(model), "doc_id long, n_tokens long, ids array<int>")
    large = table(t.where(F.length("text") > giant).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "giants")
    chunks = table(large.select("row", "text").mapInArrow(_cuts(model), _CUT), "chunks")
    # rows of one file would be one task's: chunks spread over all
    chunks = chunks.repartition(F.col("row"), F.col("chunk"))
    held = table(chunks.mapInArrow(_matrices(model), "row long, chunk int, ins int, weights array<double>").withColumn("block", F.floor(F.col("chunk") / BLOCK).cast("int")), "matrices")
    blocks = held.groupBy("row", "block").applyInPandas(_products, "row long, block int, ins int, weights array<double>")
    ends = blocks.groupBy("row").applyInPandas(_ends, "row long, block int, begin int, end int")
    at = held.join(ends, ["row", "block"]).groupBy("row", "block").applyInPandas(_scan, "row long, chunk int, enter int, leave int")
    traced = chunks.join(at, ["row", "chunk"]).select("row", "chunk", "text", "lo", "hi", "first", "last", "enter", "leave")
    traced = traced.mapInArrow(_traces(model), "row long, chunk int, ids array<int>")
    whole = traced.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
    whole = large.select("row", "doc_id").join(whole, "row").select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
    return small.unionByName(whole)


def id_lists(a: pa.Array) -> list[list[int]]:
    """The lists of a list array, null ones empty.  Its own to_pylist makes an Arrow scalar of each number first."""
    o, v, valid = a.offsets.to_numpy(), a.values.to_numpy(), a.is_valid().to_pylist()
    return [v[s:e].tolist() if ok else [] for s, e, ok in zip(o, o[1:], valid)]


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows that hold ids, row for row; null and empty lists give empty texts,
    null ids and repeated rows stay, an empty table stays empty, other columns are ignored."""

    def run(batches):
        p = pieces(model)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                x = b.slice(s, 256)
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array([p.whole.decode(i) for i in id_lists(x.column(1))], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents, and the text that these give again."""
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), MODEL)

    def run(batches):
        p = pieces(MODEL)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                x = b.slice(s, 256)
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array([p.whole.decode(i) for i in id_lists(x.column(2))], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")
