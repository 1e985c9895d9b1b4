"""Porter's stemmer (Porter 1980), as an Arrow-batched UDF over distinct tokens."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from querna.session import reach_workers

_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _shape(w: str) -> str:
    """Consonants and vowels of a word, as c and v."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _swap(w: str, rules: list[tuple[str, str]], least: int) -> str:
    for end, to in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(end):
            base = w[: len(w) - len(end)]
            return base + to if _measure(base) > least else w
    return w


@lru_cache(200_000)
def stem(w: str) -> str:
    if len(w) <= 2 or not w.isascii():
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ing", "ed"):
            if w.endswith(end):
                base = w[: -len(end)]
                if "v" in _shape(base):
                    if base.endswith(("at", "bl", "iz")):
                        base += "e"
                    elif len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c" and base[-1] not in "lsz":
                        base = base[:-1]
                    elif _measure(base) == 1 and _cvc(base):
                        base += "e"
                    w = base
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, [tuple(r.split(":")) for r in _STEP2.split()], 0)
    w = _swap(w, [tuple(r.split(":")) for r in _STEP3.split()], 0)
    for end in sorted([*_STEP4.split(), "ion"], key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base)):
            w = base
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@pandas_udf(ArrayType(StringType()))
def _stems(tokens: pd.Series) -> pd.Series:
    known: dict[str, str] = {}  # a batch's distinct words are stemmed once

    def one(x: str) -> str:
        if x not in known:
            known[x] = stem(x)
        return known[x]

    return tokens.map(lambda t: None if t is None else [one(x) for x in t])


def stem_tokens(t: Column) -> Column:
    if spark := SparkSession.getActiveSession():
        reach_workers(spark)
    return _stems(t)
