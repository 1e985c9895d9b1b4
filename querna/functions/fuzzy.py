"""String similarity, typo correction and suggestion scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querna import constants as K


def trigrams(c: Column) -> Column:
    """Distinct 3-grams of the words of letters and digits, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3)))
    return F.array_distinct(F.flatten(grams))


def _jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    return _jaccard(trigrams(a), trigrams(b))


def word_similarity(q: Column, text: Column) -> Column:
    """The greatest similarity of q to any run of neighbouring words of the text."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    n = F.size(words)
    runs = F.flatten(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(words, i, k), " "))))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: similarity(q, r))), F.lit(0.0))


def bounded_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance; a length gap above 3 stands for it."""
    gap = F.abs(F.length(a) - F.length(b))
    return F.when(gap > 3, gap).otherwise(F.levenshtein(a, b))


def characters(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))


def simple_similarity(a: Column, b: Column) -> Column:
    """0.7 of the character sets' Jaccard and 0.3 of the length ratio."""
    x, y = characters(a), characters(b)
    ratio = F.coalesce(F.try_divide(F.least(F.length(a), F.length(b)).cast("double"), F.greatest(F.length(a), F.length(b)).cast("double")), F.lit(0.0))
    return _jaccard(x, y) * 0.7 + ratio * 0.3


def common_characters(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(characters(a), characters(b)))


def deletes(c: Column, depth: int = 2) -> Column:
    """The word and all that deleting up to ``depth`` characters leaves."""

    def once(x: Column) -> Column:
        at = F.when(F.length(x) > 1, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))

    out = level = F.array(c)
    for _ in range(depth):
        level = F.array_distinct(F.flatten(F.transform(level, once)))
        out = F.array_distinct(F.concat(out, level))
    return out


def is_common_typo(q: Column, t: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in sorted(K.COMMON_TYPOS.items()) for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(q)) == F.lower(t), F.lit(False))


def correction_score(q: Column, t: Column, freq: Column, english: Column | None = None) -> Column:
    """Relevance of term t as the correction of q, rounded."""
    q, t = F.lower(q), F.lower(t)
    sim, lev = simple_similarity(q, t), F.levenshtein(q, t)
    longest = F.greatest(F.length(q), F.length(t))
    base = (
        F.when(q == t, 1000.0)
        .when(is_common_typo(q, t), 1500.0)
        .when(english if english is not None else F.lit(False), 1200 + 200 * sim)
        .when(lev <= 2, 1000 + 100 * sim)
        .when(t.startswith(q), 500.0)
        .when(t.contains(q), 600.0)
        .otherwise(400 * sim)
    )
    return F.round(base + 20 * F.log1p(freq) + 100 * F.try_divide(F.least(F.length(q), F.length(t)), longest) + 150 * F.try_divide(common_characters(q, t), longest))


def suggestion_score(q: Column, t: Column, freq: Column) -> Column:
    """Score of a suggestion, never below 0."""
    q, t = F.lower(q), F.lower(t)
    likely = (F.abs(F.length(q) - F.length(t)) <= 2) & (F.levenshtein(q, t) <= 2) & (q != t)
    s = 1000 * similarity(q, t) - 50 * F.levenshtein(q, t) + 100 * F.log1p(freq) + F.when(t.startswith(q), 300).otherwise(0) + F.when(t == q, 600).otherwise(0) + F.when(likely, 200).otherwise(0)
    return F.greatest(F.lit(0.0), s)


def is_relevant(q: Column, t: Column) -> Column:
    return (similarity(q, t) >= 0.1) & (F.levenshtein(q, t) <= 5) & (F.abs(F.length(q) - F.length(t)) <= 3)


def character_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, 0.2 more where one letter is exchanged, 1 at most."""
    lev, longest = F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))
    s = 1 - F.try_divide(lev, longest)
    return F.least(F.lit(1.0), s + F.when((F.length(a) == F.length(b)) & (lev == 1), 0.2).otherwise(0.0))


def word_set_similarity(a: Column, b: Column) -> Column:
    return _jaccard(F.array_distinct(F.split(F.lower(a), r"\s+")), F.array_distinct(F.split(F.lower(b), r"\s+")))


def combined_score(q: Column, t: Column) -> Column:
    return 0.4 * similarity(q, t) + 0.4 * word_set_similarity(q, t) + 0.2 * F.greatest(F.lit(0.0), 1 - F.levenshtein(F.lower(q), F.lower(t)) / 10)


_PHONETIC = "ph:f f:ph c:k k:c s:z z:s ck:k k:ck qu:kw x:ks y:i i:y ee:ea ea:ee ou:oo tion:shun gh:g kn:n wr:r ae:e oe:e".split()


def phonetically_similar(a: Column, b: Column) -> Column:
    """Equal, or one holding the other, after one sound is respelled."""
    a, b = F.lower(a), F.lower(b)
    tries = F.array(*[F.replace(a, F.lit(x), F.lit(y)) for x, y in (r.split(":") for r in _PHONETIC)])
    return F.exists(tries, lambda x: (x != a) & ((x == b) | x.contains(b) | b.contains(x)))


def match_type(q: Column, t: Column) -> Column:
    """How a term matches: the first kind that holds, null where none does."""
    q, t = F.lower(q), F.lower(t)
    return (
        F.when(q == t, "exact").when(t.startswith(q), "prefix").when(similarity(q, t) >= K.TRIGRAM_THRESHOLD, "similarity").when(t.contains(q), "substring")
        .when(F.soundex(q) == F.soundex(t), "soundex").when(F.levenshtein(q, t) <= 3, "fuzzy")
    )


def match_type_score(kind: Column) -> Column:
    out = F.lit(0)
    for k, s in {"exact": 300, "prefix": 150, "similarity": 120, "substring": 80, "soundex": 70, "fuzzy": 60}.items():
        out = F.when(kind == k, s).otherwise(out)
    return out


def relevance_first_score(q: Column, t: Column) -> Column:
    q, t = F.lower(q), F.lower(t)
    lev = F.levenshtein(q, t)
    base = F.when(q == t, 500).when(t.startswith(q), 400).when(t.contains(q), 350).when(lev <= 1, 300).when(lev <= 2, 250).otherwise(150)
    return base + F.when(phonetically_similar(q, t), 200).otherwise(0) - 25 * lev - 5 * F.abs(F.length(q) - F.length(t))


def best_word_score(q: Column, t: Column) -> Column:
    """The best word of a term of several words."""

    def one(w: Column) -> Column:
        s = character_similarity(q, w)
        return F.when(s >= 0.7, 1000).when(s >= 0.5, 800).when(s >= 0.3, 600).when(s >= 0.1, 400).otherwise(0) + F.when(F.soundex(q) == F.soundex(w), 500).otherwise(0)

    return F.array_max(F.transform(F.split(F.lower(t), r"\s+"), one))


def is_valid_term(t: Column) -> Column:
    low = F.lower(t)
    return ~low.isin(sorted(K.DICTIONARY_STOP_WORDS)) & ~low.rlike("^[0-9]+$") & low.rlike("[a-z0-9]") & ~low.contains("@") & ~low.startswith("http")
