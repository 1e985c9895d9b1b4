
import random

import numpy as np
import pyarrow as pa
import pytest

from querna.llm import bloom_lm, jaccard_join, pii, sentencepiece_scan

from .conftest import make, prose


@pytest.mark.parametrize("text, left", [
    ("my password: Correct!Horse is", "my <SECRET> is"), ('use api_key: "qWeRtYuIoPaSdFgHjKlZ" now', "use <SECRET> now"), ("note: something else", "note: something else"),
])
def test_secrets_without_digits(text, left):
    for kind, b, e, _ in reversed(pii.select(text, *pii.model())):
        text = f"{text[:b]}<{kind.upper()}>{text[e:]}"
    assert text == left


def test_candidates_are_all_that_the_generators_match():
    r = random.Random(3)
    bits = ["password: Correct!Horse", "a" * 200, "é" * 20, "sk-" + "ß" * 18, "x@y.de", "4041894974608795", "+1 (555) 555-2485", "tok  =  v", "::::", " ", "\n", "word", "DE44 1234 5678 9012"]
    texts = [pii._example(r)[0] for _ in range(300)]
    texts += ["".join(r.choice([*bits, "w" * r.randrange(90), " " * r.randrange(60), "lorem ipsum " * r.randrange(15)]) for _ in range(r.randrange(1, 12))) for _ in range(1000)]
    for t in texts:
        assert set(pii.candidates(t)) == {(k, *m.span()) for k, p in pii.GENERATORS + pii.BLOCKS for m in p.finditer(t)}


def test_pii_recall_over_all_generated_spans():
    r, m, found, spans = random.Random(99), pii.model(), 0, 0
    for _ in range(800):
        text, known = pii._example(r)
        got = pii.select(text, *m)
        found += sum(any(k == g[0] and g[1] <= b and e <= g[2] for g in got) for k, b, e in known)
        spans += len(known)
    assert found / spans > 0.97


def test_lm_beyond_the_limit_reads_the_same_filter(spark):
    r = random.Random(7)
    rows = [(i, prose(r, r.randrange(400), 3000)) for i in range(300)] + [(1, "one two"), (None, "two one"), (400, ""), (401, None), (402, prose(r, 900_000, 60_000))]
    for docs in (make(spark, rows).repartition(3), make(spark, []), make(spark, [(1, "")])):
        key = lambda x: (str(x.doc_id), x.n_words, x.log_prob, str(x.perplexity))
        near, far = (sorted(map(key, bloom_lm.score(docs, broadcast_mb=mb).collect())) for mb in (1024, 1e-6))
        assert near == far


@pytest.mark.parametrize("held, trials", [(8, 300), (230, 200), (660, 200), (2800, 60)])
@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("how", ["contained", "equal"])
def test_pairs_at_the_threshold_share_a_piece(held, trials, n, how):
    """Sets exactly at or just above the threshold, of equal sizes or one holding the other: none is missed."""
    r, t = random.Random(held), jaccard_join.THRESHOLD
    for i in range(trials):
        if how == "contained":
            w = [f"{i}.{r.getrandbits(40)}" for _ in range(int(held / t))]
            pair = w[:held], w
        else:
            both = [f"{i}.{r.getrandbits(40)}" for _ in range(held)]
            own = [[f"{s}{i}.{r.getrandbits(40)}" for _ in range(int(held * (1 - t) / 2 / t) - n)] for s in "ab"]
            pair = both + own[0], both + own[1]
        texts = pa.array([" ".join(p) for p in pair])
        key = jaccard_join._token_keys(pa.RecordBatch.from_arrays([pa.array([0, 1]), texts], ["doc_id", "text"]), n)
        sets = [set((key[key >> np.uint64(48) == d] & jaccard_join.TOKEN).tolist()) for d in (0, 1)]
        if len(sets[0] & sets[1]) < t * len(sets[0] | sets[1]) - 1e-9:
            continue
        a, b = (np.array(sorted(x), np.uint64) for x in sets)
        assert len(sets[0] & sets[1]) >= max(jaccard_join.least_shared(np.array([len(a), len(b)]), t))
        assert set(jaccard_join.first_cells(a, t).tolist()) & set(jaccard_join.first_cells(b, t).tolist())
        bands = jaccard_join.size_bands(t)
        low, high = sorted(np.searchsorted(bands, [len(a), len(b)]))
        assert high - low <= 1


def test_op6_decodes_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    p = sentencepiece_scan.pieces(sentencepiece_scan.MODEL)
    got = {r.doc_id: r.decoded for r in sentencepiece_scan.op6_sentencepiece(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {d.doc_id: p.whole.decode(p.whole.encode(d.text or "")) for d in docs}
