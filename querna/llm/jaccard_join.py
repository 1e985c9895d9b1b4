"""N-gram Jaccard join by parity sketches.

Each document is the set of its distinct word n-grams.  XOR-ing hashed tokens
into a bit sketch keeps parities, so the Hamming distance of two sketches never
exceeds the symmetric difference of the sets.

Pigeonhole, exactly, in two steps.  A set of a tokens that is linked shares t * a
of them at least with its partner, which lies in its size band or the next one.
First each set's sketch is cut into cells so fine that a cell holds one token, and
every cell is asked whether another set of such a band agrees on it: sets that do
not agree on t * a cells with all others together have no partner and go, which
most do.  The rest are joined on pieces: of the cells, the hot ones last, those that
one partner could do without and one more, so that two sets that are linked agree
on one at least.  Pairs whose sketches are too far apart are dropped (which loses
nothing) and what is left is verified on the full sets.

That tells the connected components, and every link lies within one.  The links are
then counted there: the sets of a component come together, by blocks where it is
large, and each pair of them is compared.

Documents of one token set are one class and stand in the join once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType as Kinds

from querna.session import reach_workers

from . import textops as T
from .common import cut, drop, slices, string_bytes, table, texts, whole_rows
from .components import components

TOKEN = np.uint64((1 << 48) - 1)
#: Up to so many ids (16 bytes each) a broadcast picks the texts to verify; beyond it a join does.
BROADCAST_IDS = 1_000_000
#: 256 bits of parities that the second join compares on the spot.
BRIEF = ("s1", "s2", "s3", "s4")
#: Words a token, least Jaccard similarity of a link.
N, THRESHOLD = 3, 0.6
#: Cells that a map task combines, cells of a reducer's group, members of a bucket's block.
COMBINE, PART_CELLS, BLOCK = 1_000_000, 2_000_000, 2_048
#: Sets and tokens of a block of a component, of which links are counted.
LINK_SETS, LINK_TOKENS = 1_024, 2_000_000
#: Cells of so many classes are hot; so many of them at most, the hottest, are known to all tasks (16 bytes each).
HOT, FREQUENT = 16, 131_072
#: The low bits of a class, which hold its size band.
BAND = np.uint64(63)


def size_bands(threshold: float, limit: int = 1 << 40) -> np.ndarray:
    """Upper sizes: a partner is in the same band or a neighbouring one."""
    uppers, low = [], 1
    while low < limit and len(uppers) < int(BAND):
        uppers.append(max(low, math.floor(low / threshold + 1e-9)))
        low = uppers[-1] + 1
    return np.array([*uppers, 1 << 62])


def least_shared(size: np.ndarray, threshold: float) -> np.ndarray:
    """Tokens that a set shares with any partner at least."""
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


def _parities(bit: np.ndarray, total_words: int) -> np.ndarray:
    """64-bit words of which each bit says whether its number came an odd number of times."""
    odd = (np.bincount(bit, minlength=total_words * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def _token_keys(b: pa.RecordBatch, n: int) -> np.ndarray:
    """Row number and 48-bit token in one word: the distinct tokens of each text, in order."""
    data, offs = string_bytes(b.column(1))
    h, first, _, _ = T.word_hashes(data, offs)
    g, doc = T.doc_grams(h, first, n)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < n))
    if len(short):  # a text of fewer than n words is one token
        s = np.array([T.gram_hashes(h[first[d] : first[d + 1]], first[d + 1] - first[d])[0] for d in short], np.uint64)
        g, doc = np.concatenate([g, s]), np.concatenate([doc, short])
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (g >> np.uint64(16)))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key


def _sums(key: np.ndarray, rows: int, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, class, begin) of each text's token set; the class is a hash of the whole set, with its size band."""
    doc, tok = (key >> np.uint64(48)).astype(np.int64), key & TOKEN
    size = np.bincount(doc, minlength=rows)
    begin = np.cumsum(size) - size
    out = size.astype(np.uint64)
    for seed in (0x3C6EF372, 0x51ED270B):
        c = np.append(np.uint64(0), np.cumsum(T.mix(tok + np.uint64(seed)), dtype=np.uint64))
        out = T.mix(out ^ (c[begin + size] - c[begin]))
    out = (out & ~BAND) | np.searchsorted(bands, size).astype(np.uint64)
    return size, out.view(np.int64), begin


def _rows(b: pa.RecordBatch, most: int = 60_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, most):
        yield b.slice(at, most)


def shared_cells(key: np.ndarray, rows: int) -> np.ndarray:
    """Tokens of each text beyond one a cell, whatever the number of parts: so many fewer cells may two texts agree on than tokens."""
    cell = np.sort((key & ~TOKEN) | (T.mix(key & TOKEN) & np.uint64(0xFFFFFFFF)))
    return np.bincount((cell[1:][cell[1:] == cell[:-1]] >> np.uint64(48)).astype(np.int64), minlength=rows)


def _classes(n: int, bands: np.ndarray):
    """(doc_id, class, size, spare) of texts that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches):
            for b in _rows(whole):
                key = _token_keys(b, n)
                size, code, _ = _sums(key, b.num_rows, bands)
                cols = [b.column(0), pa.array(code), pa.array(size, pa.int64()), pa.array(shared_cells(key, b.num_rows), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "class", "size", "spare"]).filter(pa.array(size > 0))

    return run


def _blocks(held: list[tuple[np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    """Cells of many classes as one block a part: (part, keys, owners)."""
    m, o = (np.concatenate(x) for x in zip(*held))
    part = ((m >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part.astype(np.uint16) if parts <= 65536 else part, kind="stable")
    part, k, o = part[order], m[order].astype(np.uint32), o[order]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    ends = np.append(cuts[1:], len(part)).astype(int)
    return pa.RecordBatch.from_arrays(
        [pa.array(part[cuts]), pa.array([k[s:e].tobytes() for s, e in zip(cuts, ends)], pa.binary()), pa.array([o[s:e].tobytes() for s, e in zip(cuts, ends)], pa.binary())],
        ["part", "keys", "owners"],
    )


def _spread(n: int, parts: int, bands: np.ndarray):
    """All cells of all classes.  A class seen before in the task adds nothing."""

    def run(batches):
        held, many, seen = [], 0, set()
        for whole in slices(batches):
            for b in _rows(whole):
                key = _token_keys(b, n)
                size, code, _ = _sums(key, b.num_rows, bands)
                fresh = np.zeros(b.num_rows, bool)
                for i, c in enumerate(code.tolist()):
                    if size[i] and c not in seen:
                        fresh[i] = True
                        seen.add(c)
                if len(seen) > COMBINE:
                    seen.clear()
                doc = (key >> np.uint64(48)).astype(np.int64)
                mine = fresh[doc]
                if mine.any():
                    held.append((T.mix(key[mine] & TOKEN), code[doc[mine]]))
                    many += int(mine.sum())
                if many >= COMBINE:
                    yield _blocks(held, parts)
                    held, many = [], 0
        if held:
            yield _blocks(held, parts)

    return run


def _cells(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(cell, class) of a part, in order, each once; classes of a cell by band."""
    k = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("keys")])
    o = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("owners")])
    order = np.lexsort((o, o & BAND, k))
    k, o = k[order], o[order]
    new = np.append(True, (k[1:] != k[:-1]) | (o[1:] != o[:-1]))  # tasks that saw the same class
    return k[new], o[new]


def _agreed(t: pa.Table) -> pa.Table:
    """(hot, class, agreed): how many of its cells in this part a class shares with another of its band or a
    neighbouring one; and the cells that HOT classes or more hold, with their number."""
    k, o = _cells(t)
    band = (o & BAND).astype(np.int64)
    next_ = (k[1:] == k[:-1]) & (band[1:] - band[:-1] <= 1)
    met = np.append(next_, False) | np.append(False, next_)
    u, c = np.unique(o[met], return_counts=True)
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    many = np.diff(np.append(start, len(k)))
    some = many >= HOT
    cell = (np.uint64(t.column("part")[0].as_py()) << np.uint64(32)) | k[start[some]].astype(np.uint64)
    hot = np.repeat([False, True], [len(u), len(cell)])
    return pa.table({"hot": pa.array(hot), "class": pa.array(np.concatenate([u, cell]).view(np.int64)), "agreed": pa.array(np.concatenate([c, many[some]]).astype(np.int64))})


def _kept(n: int, bands: np.ndarray):
    """(class, size, s1.., sketch, tokens) of texts of which the class is asked for."""

    def run(batches):
        for whole in slices(batches):
            for b in _rows(whole):
                key = _token_keys(b, n)
                size, code, begin = _sums(key, b.num_rows, bands)
                doc, m = (key >> np.uint64(48)).astype(np.int64), T.mix(key & TOKEN)
                # the whole sketch, a power of two of words so that sketches of unlike sizes fold onto each other
                words = 1 << np.ceil(np.log2(np.maximum(2, size / 48))).astype(np.int64)
                base = np.cumsum(words) - words
                bit = (m & (words[doc] * 64 - 1).astype(np.uint64)).astype(np.int64)
                brief = _parities(doc * 256 + (m & np.uint64(255)).astype(np.int64), b.num_rows * 4).view(np.int64).reshape(-1, 4)
                sketch = _parities(base[doc] * 64 + bit, int(words.sum()))
                packed = np.ascontiguousarray((key & TOKEN).view(np.uint8).reshape(-1, 8)[:, :6])
                cols = [
                    pa.array(code), pa.array(size, pa.int64()), *(pa.array(brief[:, i].copy()) for i in range(4)),
                    pa.array([sketch[x : x + w].tobytes() for x, w in zip(base, words)], pa.binary()),
                    pa.array([packed[x : x + w].tobytes() for x, w in zip(begin, size)], pa.binary()),
                ]
                wanted = pa.array(code == b.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays(cols, ["class", "size", *BRIEF, "sketch", "tokens"]).filter(wanted)

    return run


def first_cells(tokens: np.ndarray, threshold: float, parts: int = 1, hot: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Hashes of the tokens that one partner could do without and one more, those of the least ``hot``
    cells first, then the least.  Any order that is the same for all sets would do."""
    m = T.mix(tokens)
    often = np.zeros(len(m), np.int64)
    if hot is not None and len(hot[0]):
        cell = (((m >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)) << np.uint64(32)) | (m & np.uint64(0xFFFFFFFF))
        at = np.minimum(np.searchsorted(hot[0], cell), len(hot[0]) - 1)
        often = np.where(hot[0][at] == cell, hot[1][at], 0)
    m = m[np.lexsort((m, often))]
    return m[: len(m) - int(least_shared(np.array(len(m)), threshold)) + 1]


def _pieces(threshold: float, parts: int, counted: int, hot: tuple[np.ndarray, np.ndarray]):
    def run(batches):
        for b in batches:
            for x in _rows(b, 4096):
                held = [(c := first_cells(_set(t), threshold, counted, hot), np.full(len(c), k, np.int64)) for k, t in zip(x.column(0).to_pylist(), x.column(1))]
                if held:
                    yield _blocks(held, parts)

    return run


def _meet(t: pa.Table) -> pa.Table:
    """(bucket, members): the distinct sets of classes that share a piece.

    A bucket of more than BLOCK classes comes as pairs of blocks, each pair once."""
    k, o = _cells(t)
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    many = np.diff(np.append(start, len(k)))
    code = T.mix(np.add.reduceat(T.mix(o), start) + many.astype(np.uint64))
    some = np.flatnonzero(many > 1)
    _, at = np.unique(code[some], return_index=True)
    ids, members = [], []
    for i in some[at]:
        x = np.sort(o[start[i] : start[i] + many[i]].view(np.int64))
        if len(x) <= BLOCK:
            ids.append(code[i]), members.append(x)
            continue
        for a in range(0, len(x), BLOCK // 2):
            for b in range(0, a + 1, BLOCK // 2):
                y = x[a : a + BLOCK // 2] if a == b else np.concatenate([x[b : b + BLOCK // 2], x[a : a + BLOCK // 2]])
                ids.append(T.mix(np.array([int(code[i]) ^ (a * 0x9E3779B1 + b)], np.uint64))[0]), members.append(y)
    flat = np.concatenate(members) if members else np.zeros(0, np.int64)
    offs = np.append(0, np.cumsum([len(x) for x in members])).astype(np.int32)
    return pa.table({"bucket": pa.array(np.array(ids, np.uint64).view(np.int64)), "members": pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))})


def _near(threshold: float):
    """Keeps pairs whose sizes and whose sketches' Hamming distance allow the threshold."""

    def run(batches):
        for b in batches:
            a_n, b_n = b.column(2).to_numpy(), b.column(4).to_numpy()
            ok = np.minimum(a_n, b_n) >= threshold * np.maximum(a_n, b_n) - 1e-9
            most = (1 - threshold) / (1 + threshold) * (a_n + b_n) + 1e-9
            for i in np.flatnonzero(ok):
                x, y = np.frombuffer(b.column(3)[i].as_buffer(), np.uint64), np.frombuffer(b.column(5)[i].as_buffer(), np.uint64)
                w = min(len(x), len(y))
                x, y = np.bitwise_xor.reduce(x.reshape(-1, w)), np.bitwise_xor.reduce(y.reshape(-1, w))
                ok[i] = int(np.bitwise_count(x ^ y).sum()) <= most[i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    return run


def _set(x) -> np.ndarray:
    raw = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view(np.uint64).ravel()


def _verify(threshold: float):
    def run(batches):
        for b in batches:
            j = np.zeros(b.num_rows)
            for i in range(b.num_rows):
                x, y = _set(b.column(2)[i]), _set(b.column(3)[i])
                z = np.sort(np.concatenate([x, y]))
                both = int((z[1:] == z[:-1]).sum())
                j[i] = both / (len(z) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(j)], ["a", "b", "jaccard"]).filter(pa.array(j >= threshold - 1e-12))

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Tokens that each two of the sets have in common."""
    k, owner = len(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    tok = np.concatenate(sets)
    order = np.argsort(tok, kind="stable")
    tok, owner = tok[order], owner[order]
    start = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
    many = np.diff(np.append(start, len(tok)))
    owner, many = owner[np.repeat(many > 1, many)], many[many > 1]
    column, step = np.repeat(np.arange(len(many)), many), max(1, (1 << 22) // k)
    out = np.zeros((k, k), np.int64)
    for at in range(0, len(many), step):
        lo, hi = np.searchsorted(column, [at, at + step])
        m = np.zeros((k, min(step, len(many) - at)), np.float32)  # exact: sums below 2 ** 24
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def _links(threshold: float):
    """(class, n_links) within each pair of blocks of a component."""

    def run(t: pa.Table) -> pa.Table:
        comp, p, q, block, code = (t.column(c).to_numpy() for c in ("comp", "p", "q", "block", "class"))
        order = np.lexsort((code, block, q, p, comp))
        t, comp, p, q, block, code = t.take(pa.array(order)), comp[order], p[order], q[order], block[order], code[order]
        begin = np.flatnonzero(np.append(True, (comp[1:] != comp[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
        tokens, links = t.column("tokens"), np.zeros(len(code), np.int64)
        for s, e in zip(begin, np.append(begin[1:], len(code))):
            sets = [_set(tokens[i]) for i in range(s, e)]
            size, both = np.array([len(x) for x in sets]), _shared(sets)
            linked = both / (size[:, None] + size[None, :] - both) >= threshold - 1e-12
            if p[s] == q[s]:
                np.fill_diagonal(linked, False)
            else:  # pairs within a block are counted where it meets itself
                linked &= block[s:e, None] != block[None, s:e]
            links[s:e] = linked.sum(1)
        return pa.table({"class": pa.array(code), "n_links": pa.array(links)})

    return run


def _count_links(found: DataFrame, kept: DataFrame, threshold: float) -> DataFrame:
    """(class, n_links): the other classes that each class of the components ``found`` is linked with.

    Blocks are stretches of a component's classes by size, so that those of too unlike sizes need not meet."""
    sizes = found.select(F.col("node").alias("class"), "comp").join(kept.select("class", "size"), "class")
    by_size = Window.partitionBy("comp").orderBy("size", "class")
    block = F.floor((F.row_number().over(by_size) - 1) / LINK_SETS) + F.floor(F.sum("size").over(by_size.rowsBetween(Window.unboundedPreceding, 0)) / LINK_TOKENS)
    placed = cut(sizes.select("class", "comp", "size", block.alias("block"), F.count("*").over(Window.partitionBy("comp")).alias("many")))
    pairs = placed.where("many = 2").select("class", F.lit(1).cast("long").alias("n_links"))
    placed = placed.where("many > 2")
    blocks = placed.groupBy("comp", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.sum("size").alias("tokens"))
    whole = Window.partitionBy("comp")
    blocks = cut(blocks.withColumn("single", F.count("*").over(whole) == 1))
    total = blocks.where("single").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    x, y = blocks.alias("x"), blocks.alias("y")
    meet = x.join(y, (F.col("x.comp") == F.col("y.comp")) & (F.col("x.block") <= F.col("y.block")) & (F.col("x.hi") >= threshold * F.col("y.lo") - 1e-9))
    # components of one block share groups; which rows come in one group changes nothing else
    work = F.when(F.col("x.single"), F.pmod(F.xxhash64("x.comp"), F.lit(max(12, math.ceil(total / LINK_TOKENS))))).otherwise(F.xxhash64("x.comp", "x.block", "y.block"))
    meet = meet.select(F.col("x.comp").alias("comp"), F.col("x.block").alias("p"), F.col("y.block").alias("q"), work.alias("work"))
    meet = meet.select("*", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    rows = placed.select("class", "comp", "block").join(meet, ["comp", "block"]).join(kept.select("class", "tokens"), "class")
    counted = rows.select("work", "comp", "p", "q", "block", "class", "tokens").groupBy("work").applyInArrow(_links(threshold), "class long, n_links long")
    return cut(pairs.unionByName(counted.groupBy("class").agg(F.sum("n_links").alias("n_links"))))


def _check(pairs: DataFrame, kept: DataFrame, threshold: float) -> DataFrame:
    """The pairs of classes that reach the threshold: sizes and sketches first, then sets."""

    def with_columns(p: DataFrame, *names: str) -> DataFrame:
        for side in ("a", "b"):
            p = p.join(kept.select(F.col("class").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in names)), side)
        return p.select("a", "b", *(f"{s}_{c}" for s in ("a", "b") for c in names))

    near = cut(with_columns(pairs, "size", "sketch").mapInArrow(_near(threshold), "a long, b long"))
    return with_columns(near, "tokens").mapInArrow(_verify(threshold), "a long, b long, jaccard double")


def _hottest(cells: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(cell, classes) of the hot cells, in order of the cell: those above the number of classes that FREQUENT cells at
    most reach, which the counts by quarter octave tell, so that no more than these leave their tasks."""
    octave = F.floor(F.log2(F.col("agreed").cast("double")) * 4)
    bound, held = None, 0
    for r in cells.groupBy(octave.alias("octave")).count().orderBy(F.desc("octave")).collect():  # 256 rows at most
        held += r["count"]
        if held > FREQUENT:
            break
        bound = r["octave"]
    if bound is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = cells.where(octave >= bound).select("class", "agreed").collect()
    cell, many = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(cell)
    return cell[order], many[order]


KEPT = f"class long, size long, {', '.join(f'{s} long' for s in BRIEF)}, sketch binary, tokens binary"


def linked_classes(docs: DataFrame, n: int, threshold: float, links: bool = False) -> tuple[DataFrame, DataFrame]:
    """((doc_id, class), (class, rep, comp)): token sets by their hash, and those linked with others;
    with ``links`` also n_links, the number of other classes that each is linked with.

    A bucket is first verified against its least member; only members that this leaves
    in different components are then paired with each other, so groups of thousands
    cost in proportion to their size, not to its square.
    """
    docs, bands = texts(docs).where("doc_id is not null"), size_bands(threshold)
    sets = table(docs.mapInArrow(_classes(n, bands), "doc_id long, class long, size long, spare long"), "sets")
    classes = table(sets.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("spare").alias("spare")), "classes")
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks = "part long, keys binary, owners binary"
    counted = max(12, math.ceil(total / PART_CELLS))
    cells = docs.select("text").mapInArrow(_on_text(_spread(n, counted, bands)), blocks)
    agreed = cells.groupBy("part").applyInArrow(_agreed, "hot boolean, class long, agreed long").groupBy("hot", "class").agg(F.sum("agreed").alias("agreed"))
    agreed = table(agreed, "agreed")
    hot = _hottest(agreed.where("hot"))
    asked = agreed.where("not hot").join(classes, "class").where(F.col("agreed") >= F.ceil(threshold * F.col("size") - 1e-9) - F.col("spare"))
    asked = cut(asked.select(F.col("rep").alias("doc_id"), F.col("class").alias("asked"), "size"))
    count, total = asked.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    wanted = asked.select("doc_id", "asked")
    rows = docs.join(F.broadcast(wanted) if count <= BROADCAST_IDS else wanted, "doc_id").select("doc_id", "text", "asked")
    kept = table(rows.mapInArrow(_kept(n, bands), KEPT), "kept")
    if kept.count() > count:  # rows that repeat a doc_id and its text
        kept = table(kept.groupBy("class").agg(*(F.first(c).alias(c) for c in kept.columns[1:])), "kept")
    parts = max(12, math.ceil(total * (1.05 - threshold) / PART_CELLS))
    met = kept.select("class", "tokens").mapInArrow(_pieces(threshold, parts, counted, hot), blocks).groupBy("part").applyInArrow(_meet, "bucket long, members array<long>")
    met = table(met.groupBy("bucket").agg(F.first("members").alias("members")), "buckets")
    first = cut(met.select(F.col("members")[0].alias("a"), F.explode(F.slice("members", 2, F.size("members") - 1)).alias("b")).distinct())
    edges = cut(_check(first, kept, threshold).select("a", "b"))
    comps = components(edges)
    # two members are one pair, and it is verified
    sided = met.where("size(members) > 2").select("bucket", F.explode("members").alias("class"))
    sided = sided.join(comps.withColumnRenamed("node", "class"), "class", "left").select("bucket", "class", F.coalesce("comp", "class").alias("comp"))
    mixed = sided.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("bucket")
    sided = sided.join(mixed, "bucket").join(kept.select("class", "size", *BRIEF), "class")
    x, y = sided.alias("x"), sided.alias("y")
    most = (1 - threshold) / (1 + threshold) * (F.col("x.size") + F.col("y.size")) + 1e-9
    apart = sum(F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in BRIEF)
    near = (F.col("x.class") < F.col("y.class")) & (F.col("x.comp") != F.col("y.comp")) & (apart <= most)
    fits = F.least("x.size", "y.size") >= threshold * F.greatest("x.size", "y.size") - 1e-9
    second = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & near & fits).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    second = cut(second.join(first, ["a", "b"], "left_anti"))
    drop(met)
    more = _check(second, kept, threshold).select("a", "b")
    found = cut(components(edges.unionByName(more)))
    counts = _count_links(found, kept, threshold) if links else None
    drop(kept)
    linked = classes.select("class", "rep").join(found.select(F.col("node").alias("class"), "comp"), "class", "left")
    linked = linked.select("class", "rep", F.coalesce("comp", "class").alias("comp"))
    if links:
        linked = linked.join(counts, "class", "left").fillna(0, ["n_links"])
    return sets.select("doc_id", "class"), linked


def _on_text(run):
    """A function of (doc_id, text) batches on batches of text alone."""
    return lambda batches: run(pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(0)], ["doc_id", "text"]) for b in batches)


def near_duplicate_groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, class_id, n_links): every document that has an exact or a near copy.

    Documents of one set of word n-grams are a class, named by its least doc_id; classes
    of Jaccard >= threshold are linked; a group is a connected component, named by its
    least doc_id, and n_links is the number of other classes that the document's own is linked
    with, each pair of a group being compared.  Documents without a row have no link.

    Null or word-less texts pair with nothing; a text of fewer than n words is one
    token; rows with a null doc_id are left out; of rows that repeat a doc_id those of
    one class count once, and those of another are documents of their own under that id.
    Pairs exactly at the threshold are linked.  Texts of any length are compared whole.
    Empty tables give no rows.  Other columns are ignored.
    """
    held, linked = linked_classes(docs, n, threshold, links=True)
    held = held.distinct()
    copies = held.groupBy("class").count().where("count > 1").select("class", F.lit(True).alias("copied"))
    group = linked.groupBy("comp").agg(F.min("rep").alias("group_id"))
    named = linked.join(group, "comp").join(copies, "class", "left").where("n_links > 0 or copied")
    return held.join(named, "class").select("doc_id", "group_id", F.col("rep").alias("class_id"), "n_links")


def drop_near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group (that of its least doc_id), all columns as they were.

    Rows with a null doc_id and null, empty or word-less texts stay.  Rows that repeat a
    doc_id are told apart by their texts, so that none is lost for its id alone; of rows
    that agree in doc_id and class the one of the least hash over all columns stays.  An
    empty table stays empty; columns may have any names.
    """
    reach_workers(docs.sparkSession)
    held, linked = linked_classes(docs, n, threshold)
    # the kept class of a group is that of its least doc_id, of ties the least hash
    best = linked.groupBy("comp").agg(F.min(F.struct("rep", "class")).alias("best"))
    kept = linked.join(best, "comp").where(F.col("best.class") != F.col("class")).select("class", F.lit(None).cast("long").alias("rep"))
    again = held.groupBy("class").agg(F.count("*").alias("many"), F.min("doc_id").alias("rep"))
    again = again.where("many > 1").select("class", "rep").join(kept, "class", "left_anti")
    marked = cut(kept.unionByName(again))  # classes of which all rows go, or all but one
    rows = docs.select(whole_rows(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("row", F.xxhash64("row").alias("tie"), "doc_id", "text")
    keyed = rows.mapInArrow(_keyed(n, size_bands(threshold)), Kinds().add("row", docs.schema).add("tie", "long").add("doc_id", "long").add("class", "long"))
    joined = keyed.join(marked.withColumn("marked", F.lit(True)), "class", "left")
    whole = joined.where("marked is null").select("row")
    first = F.row_number().over(Window.partitionBy("class").orderBy("tie"))
    one = joined.where("marked and doc_id = rep").withColumn("first", first).where("first = 1").select("row")
    return whole.unionByName(one).select("row.*")


def _keyed(n: int, bands: np.ndarray):
    """Rows with their class, which is null where no copy is looked for."""

    def run(batches):
        for whole in slices(batches):
            for b in _rows(whole):
                ids, text = b.column(2), b.column(3)
                size, code, _ = _sums(_token_keys(pa.RecordBatch.from_arrays([ids, text], ["doc_id", "text"]), n), b.num_rows, bands)
                none = (size == 0) | ids.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids, pa.array(code, mask=none)], ["row", "tie", "doc_id", "class"])

    return run


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = rf"""
with recursive d as (select doc_id, list_filter(string_split_regex(text, '[\x01-\x20]+'), lambda x: x <> '') as ws from documents),
t as (select distinct doc_id, unnest(case when len(ws) between 1 and {N - 1} then [ws] else [ws[i:i + {N - 1}] for i in range(1, len(ws) - {N - 2})] end) as w from d),
s as (select doc_id, count(*) as n from t group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as i from t x join t y using (w) where x.doc_id < y.doc_id group by 1, 2),
e as (select a, b, i = sa.n and i = sb.n as same from p join s sa on sa.doc_id = a join s sb on sb.doc_id = b where i >= {THRESHOLD} * (sa.n + sb.n - i) - 1e-9),
k as (select s.doc_id, coalesce(min(a), s.doc_id) as class_id from s left join e on b = s.doc_id and same group by s.doc_id),
u as (select a, b, same from e union all select b, a, same from e),
c(node, comp) as (select a, a from u union select u.b, c.comp from c join u on u.a = c.node),
g as (select node as doc_id, min(comp) as group_id from c group by 1),
l as (select a as doc_id, count(distinct class_id) as n from u join k on k.doc_id = b where not same group by 1)
select doc_id, group_id, class_id, coalesce(n, 0) as n_links from g join k using (doc_id) left join l using (doc_id)
"""
