"""PII and secrets: generators propose, boosted trees judge, calibrated thresholds select.

High-recall generators propose spans, overlapping ones too.  Boosted trees score
each span from its format and its context; they are fitted here, on texts made
from public formats and look-alikes of them, and calibrated on held-out ones.
A kind's threshold is the one of the best F2 on the held-out texts.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType as Kinds

from querna.session import reach_workers

from .boosting import Boosted
from .common import slices, texts, whole_rows, with_texts

KINDS = ["email", "phone", "ip", "card", "ssn", "iban", "key", "secret"]
#: Every generator's match holds one of these, a key that is all letters the last; regexes then run on their surroundings alone.
ANCHOR = re.compile(r"[\d@=:]|(?<![\w+/-])[\w+/-]{16,}")
#: No match begins further before its first anchor, nor has white space further behind its last one.
REACH = 96
#: Every match holds two colons at least.
IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?:(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9A-Fa-f]{1,4}|:)(?![\w:])|(?<![\w:])[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])")
GENERATORS = [
    ("email", re.compile(r"[\w.+%-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63})*")),
    ("phone", re.compile(r"(?<![\w.])\+?\(?\d(?:[ ().-]{0,2}\d){6,14}(?!\w)")),
    ("phone", re.compile(r"(?<![\w.])\+?(?:\d{1,3}[ .-])?\(?\d{2,4}\)?[ .-]\d{3}[ .-]\d{4}(?!\w)")),
    ("ip", re.compile(r"(?<!\w)\d{1,3}(?:\.\d{1,3}){3,}(?!\w)")),
    ("ip", IPV6),
    ("card", re.compile(r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)")),
    ("card", re.compile(r"(?<!\w)\d{13,19}(?!\w)")),
    ("card", re.compile(r"(?<!\w)\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?!\w)")),
    ("ssn", re.compile(r"(?<!\w)\d{3}[- ]?\d{2}[- ]?\d{4}(?!\w)")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("key", re.compile(r"(?<!\w)(?:(?:AKIA|ASIA)[A-Z0-9]{12,20}|(?:sk|ghp|gho|xox[bp])[_-][\w-]{16,}|[A-Za-z0-9_+/-]{16,}={0,2})(?!\w)")),
    ("secret", re.compile(r"(?<!\w)[\w-]{2,24}\s{0,2}[=:]\s{0,2}[\"']?[^\s\"',;]{4,}[\"']?")),
]
#: Blocks of any length, for which windows would be too short.
BLOCKS = [("key", re.compile(r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\s:,\\-]*?-----END [A-Z ]{0,24}PRIVATE KEY-----"))]
CONTEXT = {
    "phone": "phone tel call mobile fax cell", "card": "card visa credit debit payment", "ssn": "ssn social security", "ip": "ip host server address addr",
    "email": "mail email contact write", "iban": "iban account bank", "secret": "password passwd pwd secret token api key apikey credential auth bearer",
}
SECRET = re.compile(r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|credential|auth|bearer", re.I)


def _luhn(d: str) -> bool:
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of all proposals, each once."""
    out: set[tuple[str, int, int]] = set()
    windows: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        lo, hi = max(0, m.start() - REACH), m.end() + REACH
        if windows and hi <= windows[-1][1]:
            continue
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        if windows and lo <= windows[-1][1]:
            windows[-1][1] = hi
            continue
        end = windows[-1][1] if windows else 0
        while lo > end and not text[lo - 1].isspace():
            lo -= 1
        if windows and lo == end:
            windows[-1][1] = hi
        else:
            windows.append([lo, hi])
    for lo, hi in windows:
        colons = text.count(":", lo, hi)
        for kind, pattern in GENERATORS:
            if pattern is IPV6 and colons < 2:
                continue
            out.update((kind, m.start(), m.end()) for m in pattern.finditer(text, lo, min(hi, len(text))))
    if "PRIVATE KEY-----" in text:
        for kind, pattern in BLOCKS:
            out.update((kind, m.start(), m.end()) for m in pattern.finditer(text))
    return sorted(out, key=lambda c: (c[1], c[2], c[0]))


def features(text: str, kind: str, begin: int, end: int) -> list[float]:
    s = text[begin:end]
    before, after = text[max(0, begin - 28) : begin].lower(), text[end : end + 12]
    words = set(re.findall(r"[a-z]+", before))
    digits = "".join(c for c in s if c.isdigit())
    n, counts = len(s), Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    dots = s.split("@")[-1].split(".")
    octets = [int(x) for x in s.split(".") if x.isdigit()] if kind == "ip" else []
    value = re.split(r"[=:]", s, maxsplit=1)[-1].strip("\"' ") if kind == "secret" else s
    groups = re.findall(r"\d+", s)
    prev, nxt = (text[begin - 1] if begin else " "), (after[:1] or " ")
    return [
        *(float(kind == k) for k in KINDS),
        n, len(digits), len(digits) / n, sum(c.isupper() for c in s) / n, sum(c.islower() for c in s) / n, entropy, len(counts) / n,
        float(_luhn(digits)) if 13 <= len(digits) <= 19 else -1.0, float(digits[:1] in "3456" and digits != ""), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(s.startswith("+")), float("(" in s), s.count("-"), s.count(" "), s.count("."), s.count(":"), float(s.startswith("-----BEGIN")),
        float(len(octets) == 4 and all(x < 256 for x in octets)), max(octets, default=-1),
        float(len(dots) > 1 and dots[-1].isalpha()), len(dots[-1]) if len(dots) > 1 else 0, s.count("@"),
        float(s[:4] in ("AKIA", "ASIA")), float(bool(re.fullmatch(r"[0-9a-f]+", value))), float(bool(SECRET.match(s))) if kind == "secret" else 0.0, float(bool(SECRET.search(before[-16:]))),
        len(value), sum(c.isdigit() for c in value) / max(1, len(value)), float("\"" in s or "'" in s),
        float(bool(words & set(CONTEXT.get(kind, "").split()))), float(prev.isalnum()), float(prev in "-.,:/#$€£"), float(nxt.isalnum()), float(nxt in "-%°"),
    ]


#: Texts to learn from are made here.


def _example(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A text of random words with spans of known kinds and look-alikes."""
    d = lambda n: "".join(r.choice(string.digits) for _ in range(n))
    w = lambda a=2, b=9: "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(a, b)))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))

    def card() -> str:
        s = r.choice("3456") + d(14)
        s = next(s + c for c in string.digits if _luhn(s + c))
        return s if r.random() < 0.6 else " ".join(s[i : i + 4] for i in range(0, 16, 4)) if r.random() < 0.5 else "-".join(s[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = str(r.randint(2, 9)) + d(2), d(3), d(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"+{r.randint(1, 99)} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{a}.{b}.{c}"])

    def pem() -> str:
        kind = r.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "])
        body = "".join("".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(64)) + "\n" for _ in range(r.randint(1, 12)))
        return f"-----BEGIN {kind}PRIVATE KEY-----\n{body}-----END {kind}PRIVATE KEY-----"

    tld = lambda: r.choice(["com", "org", "net", "de", "fr", "es", "io", "edu", "co.uk"])
    good = {
        "email": lambda: w() + r.choice(["", ".", "_", "-", "+"]) + r.choice([w(), d(2), ""]) + "@" + w() + r.choice(["", d(1)]) + "." + r.choice([tld(), w() + "." + tld()]),
        "phone": phone,
        "ip": lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)) if r.random() < 0.75 else r.choice([":".join(hexes(r.randint(1, 4)) for _ in range(8)), f"fe80::{hexes(4)}:{hexes(r.randint(1, 4))}:{hexes(4)}", f"2001:db8:{hexes(r.randint(1, 4))}::{hexes(r.randint(1, 4))}"]),
        "card": card,
        "ssn": lambda: f"{r.randint(100, 899)}-{d(2)}-{d(4)}",
        "iban": lambda: r.choice(["DE", "FR", "ES", "GB", "NL"]) + d(2) + r.choice(["", " "]).join(["", *(d(4) for _ in range(r.randint(3, 5)))]),
        "key": lambda: pem() if r.random() < 0.12 else r.choice([r.choice(["AKIA", "ASIA"]) + "".join(r.choice(string.ascii_uppercase + string.digits) for _ in range(16)), "ghp_" + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(36)), "sk-" + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(32))]),
        "secret": lambda: r.choice(["password", "passwd", "pwd", "token", "secret", "api_key", "PASSWORD", "apikey", "auth"]) + r.choice(["=", " = ", ": ", "="]) + (lambda v, q: q + v + q)(r.choice([hexes(r.choice([16, 18, 32, 40])), d(r.randint(6, 20)), "".join(r.choice("0123456789" * 3 + "abcdef") for _ in range(r.randint(12, 32))), w(6, 10) + d(3), "".join(r.choice(string.ascii_letters + string.digits + "!#%") for _ in range(r.randint(8, 20)))]), r.choice(["", '"'])),
    }
    bad = [
        lambda: f"{r.randint(0, 20)}.{r.randint(0, 30)}.{r.randint(0, 99)}", lambda: f"20{d(2)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{d(2)}",
        lambda: d(r.randint(1, 8)), lambda: d(r.randint(9, 12)), lambda: f"{d(r.randint(1, 3))},{d(3)}.{d(2)}", lambda: f"{r.randint(256, 999)}.{d(3)}.{d(2)}.{d(1)}", lambda: f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}",
        lambda: next(s for s in iter(lambda: str(r.randint(1, 9)) + d(15), None) if not _luhn(s)), lambda: "@" + w(), lambda: w() + "@" + r.choice(["", w()]), lambda: f"{w(1, 6)}={r.choice([w(4, 9), d(4), d(5)])}", lambda: f"{w()}: {w(4, 9)}",
        lambda: f"{r.randint(10, 23)}:{d(2)}:{d(2)}", lambda: f"{r.randint(0, 9)}:{d(2)}:{d(2)}:{d(2)}", lambda: ":".join(hexes(2) for _ in range(6)), lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: "the " + w(16, 30), lambda: "commit " + hexes(40), lambda: w().upper() + "-" + d(5), lambda: f"{d(3)}-{d(3)}", lambda: f"{d(2)} {d(3)} {d(2)}",
        lambda: f"width={d(4)}px", lambda: "-".join(w(4, 8) for _ in range(4)), lambda: "".join(r.choice(string.ascii_uppercase) for _ in range(r.randint(14, 22))), lambda: f"{d(4)}–{d(4)}", lambda: f"{d(2)}%",
    ]
    parts, spans, at = [], [], 0
    for _ in range(r.randint(2, 6)):
        words = "" if at and r.random() < 0.25 else " ".join(r.choice([w, w, w, lambda: w().capitalize()])() + r.choice(["", "", "", ".", ","]) for _ in range(r.randint(1, 6)))
        kind = r.choice(KINDS)
        if words and r.random() < 0.3:
            words += " " + r.choice(CONTEXT.get(kind, "ref").split())
        words += " " if words else ""
        parts.append(words)
        at += len(words)
        if r.random() < 0.5:
            s = good[kind]()
            spans.append((kind, at, at + len(s)))
        else:
            s = r.choice(bad)()
        tail = r.choice([" ", " ", ". ", ", ", "\n"])
        parts.append(s + tail)
        at += len(s) + len(tail)
    return "".join(parts), spans


def examples(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    r, x, y, kinds = random.Random(seed), [], [], []
    for _ in range(n):
        text, spans = _example(r)
        for c in candidates(text):
            x.append(features(text, *c))
            y.append(c in spans)
            kinds.append(c[0])
    return np.array(x), np.array(y, float), kinds


@functools.lru_cache(1)
def model(texts_fitted: int = 4000, texts_held: int = 2000) -> tuple[Boosted, dict[str, float]]:
    x, y, _ = examples(1, texts_fitted)
    hx, hy, hk = examples(2, texts_held)
    m = Boosted().fit(x, y).calibrate(hx, hy)
    p, hk, bounds = m.probability(hx), np.array(hk), {}
    for k in KINDS:
        q, t = p[hk == k], hy[hk == k]
        f2 = {b: 5 * (t[q >= b].sum()) / max(1e-9, 4 * t.sum() + (q >= b).sum()) for b in np.arange(0.05, 0.96, 0.05)}
        best = max(f2.values())
        bounds[k] = float(np.median([b for b, f in f2.items() if f >= best - 1e-3]))
    return m, bounds


def select(text: str, m: Boosted, bounds: dict[str, float]) -> list[tuple[str, int, int, float]]:
    """The spans to redact, none overlapping: the likeliest first, the longer of ties."""
    found = candidates(text)
    if not found:
        return []
    p = m.probability(np.array([features(text, *c) for c in found]))
    ok = sorted((-round(float(q), 4), c[1] - c[2], c[1], c) for q, c in zip(p, found) if q >= bounds[c[0]])
    out: list[tuple[str, int, int, float]] = []
    begins: list[int] = []  # of the spans taken, in order; their ends alongside
    ends: list[int] = []
    for q, _, _, (kind, b, e) in ok:
        i = bisect.bisect_left(ends, b + 1)  # the first span that ends beyond b
        if i == len(begins) or begins[i] >= e:
            begins.insert(i, b), ends.insert(i, e)
            out.append((kind, b, e, -q))
    return sorted(out, key=lambda s: s[1])


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, begin, end, score): the spans to redact, in characters from 0, end excluded.

    Null and empty texts have none; rows with a null doc_id and repeated rows are
    searched like all others; an empty table gives no rows; columns other than
    doc_id and text are ignored.  Texts of any length are searched whole, in time
    that grows with their length.  Of overlapping spans the likeliest is taken, of
    equally likely ones the longest, then the first, then the kind's name decides.
    """
    m, bounds = model()

    def run(batches):
        for b in slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s in select(t, m, bounds):
                    for c, v in zip(out, (i, *s)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()))], ["doc_id", "kind", "begin", "end", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, kind string, begin int, end int, score double")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every selected span replaced by its kind, as in <EMAIL>; n_chars
    follows where there is a numeric or string one.  Row for row, all other columns as they were.

    Null and empty texts, null doc_ids and repeated rows stay rows like all others; an
    empty table stays empty; spans and ties as in ``find_pii``; columns may have any names.
    """
    reach_workers(docs.sparkSession)
    m, bounds = model()

    def run(batches):
        for b in slices(batches):
            new = []
            for t in b.column(1).to_pylist():
                found = select(t, m, bounds) if t else []
                for kind, x, y, _ in reversed(found):
                    t = f"{t[:x]}<{kind.upper()}>{t[y:]}"
                new.append(t if found else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], ["row", "new"])

    rows = docs.select(whole_rows(docs), F.col("text").cast("string").alias("text"))
    return with_texts(rows.mapInArrow(run, Kinds().add("row", docs.schema).add("new", "string")), docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
