"""Quality rules under weak supervision.

Rules vote good (1) or bad (0) on a document or abstain (-1).  Votes are taken
as independent given the unseen quality; expectation-maximisation over the
counts of all vote patterns estimates the prior and, for every rule, how often
it recognises good and bad documents.  The posterior probability of good
quality decides, in place of "all rules must pass".
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, texts, whole_rows

#: rule: (measure, bad if, good if); measures are defined below and in OP8_SQL alike.
RULES = {
    "symbols": ("symbols", "words >= 1 and symbols > 0.02 * chars", "words >= 1 and symbols <= 0.005 * chars"),
    "capitals": ("capitals", "words >= 1 and capitals > 0.2 * chars and words >= 5", "words >= 5 and capitals < 0.08 * chars"),
    "shouting": ("shouts", "words >= 1 and shouts > 0.05 * words", "words >= 20 and shouts = 0"),
    "stutter": ("stutters", "words >= 10 and stutters > 0.1 * words", "words >= 10 and stutters < 0.03 * words"),
    "lines": ("lines", "lines >= 4 and distinct_lines <= 0.5 * lines", "lines >= 2 and distinct_lines > 0.8 * lines"),
    "word_length": ("chars", "words >= 5 and (chars > 13 * words or chars < 3 * words)", "words >= 5 and chars between 4 * words and 9 * words"),
    "size": ("words", "words < 3", "words >= 10"),
    "sentences": ("stops", "words >= 30 and stops = 0", "words >= 5 and stops >= 0.01 * words"),
}
NAMES = list(RULES)
WORD, SYMBOL, CAPITAL, STOP = r"[^\x01-\x20]+", r"[#$%&*|<>{}^~=]", r"[A-ZÀ-ÖØ-Þ]", r"[.!?]"
#: A word followed by itself, found without backtracking.
STUTTER = r"(?<![^\x01-\x20])([^\x01-\x20]++)(?=[\x01-\x20]++\1(?![^\x01-\x20]))"
#: Rounds at most, and the change of a rate below which they end.
ROUNDS, SETTLED = 100, 1e-12
START = {"prior": 0.85, "good": 0.999, "bad": 0.3}
#: Bounds are set where good documents hardly ever fail them.  Without this belief the likeliest
#: two classes may tell apart two kinds of bad documents.  It counts as so many times the votes:
#: three times keep a rule's rate on good documents above 0.75 whatever they say; once is too little.
BELIEF, WEIGHT = 0.999, 3.0


@dataclass(frozen=True)
class Model:
    prior: float
    good: tuple[float, ...]  # P(votes good | good, votes)
    bad: tuple[float, ...]  # P(votes bad | bad, votes)

    def logit(self, votes: tuple[int, ...]) -> float:
        x = math.log(self.prior / (1 - self.prior))
        for v, a, b in zip(votes, self.good, self.bad):
            x += 0 if v < 0 else math.log(a / (1 - b)) if v else math.log((1 - a) / b)
        return x


def measures(text: Column) -> dict[str, Column]:
    return {
        "chars": F.length(text),
        "words": F.regexp_count(text, F.lit(WORD)),
        "symbols": F.regexp_count(text, F.lit(SYMBOL)),
        "capitals": F.regexp_count(text, F.lit(CAPITAL)),
        "shouts": F.regexp_count(text, F.lit("!!")),
        "stutters": F.regexp_count(text, F.lit(STUTTER)),
        "lines": F.size(F.split(text, "\n")),
        "distinct_lines": F.size(F.array_distinct(F.split(text, "\n"))),
        "stops": F.regexp_count(text, F.lit(STOP)),
    }


def _measured(text: Column) -> Column:
    """The measures as generated columns: expressions above a generator aren't merged into
    the scan, so each pass over the texts evaluates every measure once."""
    return F.inline(F.array(F.struct(*(c.alias(k) for k, c in measures(text).items()))))


def _votes() -> list[Column]:
    return [F.expr(f"case when {bad} then 0 when {good} then 1 else -1 end").cast("int").alias(f"v_{r}") for r, (_, bad, good) in RULES.items()]


def with_votes(docs: DataFrame) -> DataFrame:
    """(doc_id, words, v_<rule>...): one vote a rule and document."""
    return texts(docs).select("doc_id", _measured(F.col("text"))).select("doc_id", "words", *_votes())


def fit(voted: DataFrame, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation on the counts of vote patterns, of which there are at most
    3 ** rules however many documents; these counts alone come to the driver."""
    cols = [f"v_{r}" for r in NAMES]
    counts = [(tuple(x[:-1]), x[-1]) for x in voted.where("words > 0").groupBy(*cols).count().collect()]
    k = len(NAMES)
    model = Model(START["prior"], (START["good"],) * k, (START["bad"],) * k)
    for _ in range(rounds):
        post = [(v, n, 1 / (1 + math.exp(-model.logit(v)))) for v, n in counts]
        total = sum(n for _, n, _ in post)
        prior = (sum(n * p for _, n, p in post) + 1) / (total + 2)
        cast = [WEIGHT * sum(n for v, n, _ in post if v[j] >= 0) for j in range(k)]
        good = tuple((sum(n * p for v, n, p in post if v[j] == 1) + BELIEF * cast[j] + 1) / (sum(n * p for v, n, p in post if v[j] >= 0) + cast[j] + 2) for j in range(k))
        bad = tuple((sum(n * (1 - p) for v, n, p in post if v[j] == 0) + 1) / (sum(n * (1 - p) for v, n, p in post if v[j] >= 0) + 2) for j in range(k))
        old, model = model, Model(prior, good, bad)
        if max(abs(a - b) for a, b in zip((old.prior, *old.good, *old.bad), (prior, *good, *bad))) < SETTLED:
            break
    return model


def posterior(model: Model) -> Column:
    x = F.lit(math.log(model.prior / (1 - model.prior)))
    for r, a, b in zip(NAMES, model.good, model.bad):
        v = F.col(f"v_{r}")
        x = x + F.when(v == 1, math.log(a / (1 - b))).when(v == 0, math.log((1 - a) / b)).otherwise(0.0)
    return F.when(F.col("words") > 0, F.round(1 / (1 + F.exp(-x)), 6)).otherwise(0.0)


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, v_<rule>..., quality, keep) for every row of ``docs``.

    Null, empty and word-less texts get quality 0.  Rows with a null doc_id are scored
    and repeated rows repeat; an empty table gives an empty result.  A rule's ties
    (measures equal to its bound) fall as its comparison says; quality equal to the
    threshold keeps.  Columns other than doc_id and text are ignored.
    """
    voted = cut(with_votes(docs))
    model = fit(voted)
    q = voted.select("doc_id", *(f"v_{r}" for r in NAMES), posterior(model).alias("quality"))
    return q.withColumn("keep", F.col("quality") >= threshold)


def filter_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose posterior quality reaches the threshold.

    Null, empty and word-less texts have quality 0 and go; null doc_ids and repeated
    rows are judged like all others; texts of any length are measured whole; an empty
    table stays empty; columns may have any names.
    """
    model = fit(with_votes(docs))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = docs.select(whole_rows(docs), _measured(text))
    return body.select("row", "words", *_votes()).where(posterior(model) >= threshold).select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    n = lambda p: f"len(regexp_extract_all(t, '{p}'))"
    ctes = [
        "d as materialized (select doc_id, coalesce(text, '') as t from documents)",
        f"l as materialized (select doc_id, t, regexp_extract_all(t, '{WORD}') as ws, string_split(t, chr(10)) as ls from d)",
        f"""m as materialized (select doc_id, length(t) as chars, len(ws) as words, {n(SYMBOL)} as symbols, {n(CAPITAL)} as capitals, {n("!!")} as shouts,
 len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) as stutters, len(ls) as lines, len(list_distinct(ls)) as distinct_lines, {n(STOP)} as stops from l)""",
        "v as materialized (select doc_id, words, "
        + ", ".join(f"cast(case when {bad} then 0 when {good} then 1 else -1 end as int) as v_{r}" for r, (_, bad, good) in RULES.items())
        + " from m)",
        "c as materialized (select " + ", ".join(f"v_{r}" for r in NAMES) + ", cast(count(*) as double) as n from v where words > 0 group by all)",
        f"p0 as materialized (select {START['prior']} as prior, " + ", ".join(f"{START['good']} as g_{r}, {START['bad']} as b_{r}" for r in NAMES) + ")",
    ]
    logit = "ln(prior / (1 - prior))" + "".join(f" + case v_{r} when 1 then ln(g_{r} / (1 - b_{r})) when 0 then ln((1 - g_{r}) / b_{r}) else 0 end" for r in NAMES)
    for i in range(ROUNDS):
        ctes.append(f"q{i} as materialized (select c.*, 1 / (1 + exp(-({logit}))) as p from c, p{i})")
        rates = ", ".join(
            f"(coalesce(sum(n * p) filter (v_{r} = 1), 0) + {BELIEF * WEIGHT} * coalesce(sum(n) filter (v_{r} >= 0), 0) + 1) / (coalesce(sum(n * (p + {WEIGHT})) filter (v_{r} >= 0), 0) + 2) as g_{r}, "
            f"(coalesce(sum(n * (1 - p)) filter (v_{r} = 0), 0) + 1) / (coalesce(sum(n * (1 - p)) filter (v_{r} >= 0), 0) + 2) as b_{r}"
            for r in NAMES
        )
        ctes.append(f"p{i + 1} as materialized (select (sum(n * p) + 1) / (sum(n) + 2) as prior, {rates} from q{i})")
    out = "doc_id, " + ", ".join(f"v_{r}" for r in NAMES)
    return f"with {', '.join(ctes)} select {out}, quality, quality >= 0.5 as keep from (select {out}, case when words > 0 then round(1 / (1 + exp(-({logit}))), 6) else 0 end as quality from v, p{ROUNDS})"


OP8_SQL = _sql()
