"""Mixing to target weights: a labelled-table classifier gives each document its domain
posteriors, and projected-gradient least squares fits nonnegative document rates whose
expected domain token totals match the targets.

Domains come from the labels: toxic rows are ``toxic``, other rows of quality 0 ``poor``,
of quality 1 ``good``. The classifier is a naive Bayes one over hashed words, fitted on a
bounded sample of labelled rows, joined by a noisy-or with its decisive words: words whose
labelled documents are toxic for sure, each with the lower confidence bound of that, so
that single strong words count however long the text around them is. What naive Bayes
takes for toxic without such a word counts as far as it is right about labelled rows. With n_i tokens and
posteriors p_ik, rates r_i minimise sum_k (sum_i r_i n_i p_ik - T_k)^2 / N_k,
N_k = sum_i n_i p_ik, from r_i = 1 by steps r_i <- max(0, r_i - sum_k p_ik (sum_j r_j n_j
p_jk - T_k) / N_k); the step is at most one over the greatest curvature in the metric of
n_i, as posteriors add up to 1. A step needs three sums over the token totals of all
different posteriors, and rates follow from the steps, so nothing else is kept. Steps go
on until the totals match or come no closer; MOST_STEPS without either is an error.

A null or empty text has no tokens and the prior as posteriors. Rows that repeat an id are
each a document. Labels with nulls, or without a document, teach nothing; a domain without
labelled rows has the posterior 0; without any labels all documents are ``good``. An empty
table gives an empty table. Columns in ``keep`` with the name of an output column are
replaced. Words of a text are counted within its row, so a very long one must fit a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHARE, let, share_of, table, written
from .quality import split_words

DOMAINS = ("good", "poor", "toxic")
WEIGHTS = {"good": 0.85, "poor": 0.1, "toxic": 0.05}
#: The classifier's hash buckets, smoothing, and a bound of the labelled rows it is fitted on.
BUCKETS, SMOOTHING, SAMPLE_ROWS = 1 << 15, 0.1, 20_000
#: A word is decisive if the lower bound, so many standard deviations below, of the share of toxic rows among those with it is over DECISIVE.
DEVIATIONS, DECISIVE = 2.58, 0.75
MOST_STEPS, TOLERANCE = 2_000, 1e-5
#: Posteriors are whole multiples of 1 / GRAIN, so that there are at most about GRAIN ** 2 / 2 different ones.
GRAIN = 1000


Model = tuple[list[float], list[list[float]], dict[int, float], float]


def _words(text: Column) -> Column:
    """The hashes of a text's words, in lower case."""
    return F.transform(split_words(F.lower(text)), lambda w: F.xxhash64(w))


def _bucket(word: Column) -> Column:
    return F.pmod(word, F.lit(BUCKETS)).cast("int")


def lower_bound(hits: int, rows: int, z: float = DEVIATIONS) -> float:
    """Wilson's lower bound of a share."""
    p, q = hits / rows, z * z / rows
    return (p + q / 2 - z * math.sqrt(p * (1 - p) / rows + q / rows / 4)) / (1 + q)


def domain_of(labels: DataFrame) -> DataFrame:
    """__id, __domain (its number) of labelled rows; an id labelled twice has its worst domain."""
    number = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return labels.select(F.col("doc_id").alias("__id"), number.alias("__domain")).where("__id IS NOT NULL AND __domain IS NOT NULL").groupBy("__id").agg(F.max("__domain").alias("__domain"))


def fit_classifier(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Log priors, log word likelihoods of each domain, decisive words (hash to certainty), and the trust in toxic ones without.

    The driver gets at most one count a bucket and domain, and the words that are decisive,
    of which each takes several toxic rows of the sample.
    """
    named = domain_of(labels)
    sample = named.where(F.pmod(F.xxhash64("__id"), F.lit(SHARE)) < share_of(rows, labels.count()))
    known = docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(sample), "__id").select("__domain", _words(F.col("text")).alias("w"))  # about `rows` ids at most
    known = written(known, "labelled")
    counts = known.select("__domain", F.explode(F.concat(F.array(F.lit(-1)), F.transform("w", _bucket))).alias("b")).groupBy("__domain", "b").count().collect()
    words, documents = [[SMOOTHING] * BUCKETS for _ in DOMAINS], [0] * len(DOMAINS)
    for domain, bucket, n in counts:
        if bucket < 0:
            documents[domain] = n
        else:
            words[domain][bucket] += n
    if not any(documents):
        documents[0] = 1
    prior = [math.log(n / sum(documents)) if n else -math.inf for n in documents]
    toxic = DOMAINS.index("toxic")
    # equal texts count once, as copies tell nothing new
    once = known.groupBy(F.xxhash64("w").alias("text"), "__domain").agg(F.first("w").alias("w")).select("__domain", F.explode(F.array_distinct("w")).alias("h"))
    spread = once.groupBy("h").agg(F.sum((F.col("__domain") == toxic).cast("long")).alias("a"), F.count(F.lit(1)).alias("n")).where(f"2 * a > n AND a >= {DEVIATIONS**2:.3f}").collect()
    sure = {x.h: lower_bound(x.a, x.n) for x in spread}
    model = prior, [[math.log(x / total) for x in row] for row in words for total in [sum(row)]], {h: x for h, x in sorted(sure.items()) if x > DECISIVE}, 1.0
    if prior[toxic] == -math.inf:
        return model
    taken = known.where(~_has(F.col("w"), model[2])).select("__domain", _scored(F.col("w"), model).alias("p")).where(F.col("p")[toxic] > 0.5)
    right, rows = taken.agg(F.coalesce(F.sum((F.col("__domain") == toxic).cast("long")), F.lit(0)), F.count(F.lit(1))).head()
    return *model[:3], right / rows if rows else 1.0


def _longs(values) -> Column:
    """One folded literal, as a long list of expressions would cost seconds of planning."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>") if values else F.array().cast("array<long>")


def _has(words: Column, sure: dict[int, float]) -> Column:
    return F.arrays_overlap(words, _longs(sure))


def _scored(words: Column, model: Model) -> Column:
    """A posterior a domain, of the hashes of a text's words."""
    prior, likelihood, sure, trust = model
    doubles = lambda xs: F.split(F.lit(",".join(f"{x:.6g}" for x in xs)), ",").cast("array<double>")
    live, toxic = [k for k, x in enumerate(prior) if x > -math.inf], DOMAINS.index("toxic")
    clean, tables = [k for k in live if k != toxic], {k: doubles(likelihood[k]) for k in live}

    def softmax(logs: Column) -> Column:
        return let(F.transform(logs, lambda v: F.exp(v - F.array_max(logs))), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda s: F.transform(e, lambda v: v / s)))

    def all_of(logs: Column) -> Column:
        rest = let(F.array(*[logs[live.index(k)] for k in clean]), softmax) if clean else F.array()
        bad = F.lit(0.0)
        if toxic in live:
            hashes, certain = _longs(sure), doubles(sure.values()) if sure else None
            doubt = F.aggregate(F.array_intersect(words, hashes), F.lit(1.0), lambda a, h: a * (1 - F.element_at(certain, F.array_position(hashes, h).cast("int")))) if sure else F.lit(1.0)
            bad = 1 - doubt * (1 - let(logs, softmax)[live.index(toxic)] * trust) if clean else F.lit(1.0)
        return let(bad, lambda t: let(rest, lambda r: F.array(*[t if k == toxic else r[clean.index(k)] * (1 - t) if k in clean else F.lit(0.0) for k in range(len(DOMAINS))])))

    logs = let(F.transform(words, _bucket), lambda b: F.array(*[_summed(b, prior[k], tables[k]) for k in live]))
    return let(logs, all_of)


def posteriors(text: Column, model: Model) -> Column:
    """array<double>, one posterior a domain, in whole parts of 1 / GRAIN."""
    parts = let(let(_words(text), lambda w: _scored(w, model)), lambda p: F.transform(p, lambda v: F.floor(v * GRAIN).cast("int")))

    def whole(q: Column) -> Column:
        rest, top = F.lit(GRAIN) - F.aggregate(q, F.lit(0), lambda a, v: a + v), F.array_position(q, F.array_max(q))
        return F.transform(q, lambda v, k: (v + F.when(k + 1 == top, rest).otherwise(0)) / GRAIN)

    return let(parts, whole)


def _summed(buckets: Column, start: float, values: Column) -> Column:
    return F.aggregate(buckets, F.lit(start), lambda acc, b: acc + values[b])


OUTPUTS = ["n_tokens", *(f"p_{d}" for d in DOMAINS), "rate"]


def memberships(docs: DataFrame, labels: DataFrame, keep: list[str] = ["doc_id"]) -> DataFrame:
    """The columns ``keep``, n_tokens and a posterior a domain, for every document."""
    model, kept = fit_classifier(docs, labels), [F.col(f"`{c}`") for c in keep if c not in OUTPUTS]
    p = docs.select(*kept, F.size(split_words(F.col("text"))).cast("long").alias("n_tokens"), posteriors(F.col("text"), model).alias("__p"))
    return p.select(*kept, "n_tokens", *[F.col("__p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)])


def _rate(steps: list[list[float]], whole: Column) -> Column:
    """The rate that the steps lead to; 1 where ``whole`` holds."""
    if not steps:
        return F.lit(1.0)
    history = F.split(F.lit(";".join(",".join(map(repr, g)) for g in steps)), ";")
    numbers = F.transform(history, lambda g: F.split(g, ",").cast("array<double>"))
    move = lambda g: sum((F.col(f"p_{d}") * g[k] for k, d in enumerate(DOMAINS)), F.lit(0.0))
    return F.when(whole, 1.0).otherwise(F.aggregate(numbers, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - move(g))))


def fit_rates(members: DataFrame, weights: dict[str, float], budget: float | None = None, full: str | None = None) -> tuple[DataFrame, dict[str, float]]:
    """``members`` with rate, and the tokens each domain gets.

    The targets are the weights times ``budget`` tokens; by default as many as there are,
    or with ``full`` as many as give that domain all its tokens. Documents that belong to
    the domain ``full`` rather than not then have the rate 1, and the others are fitted.
    """
    whole = F.col(f"p_{full}") > 0.5 if full else F.lit(False)
    share = {d: weights.get(d, 0.0) / sum(weights.values()) for d in DOMAINS}

    profiles = written(members.groupBy(*[f"p_{d}" for d in DOMAINS]).agg(F.sum("n_tokens").alias("n_tokens")), "profiles")

    def totals(rate: Column) -> list[float]:
        return [x or 0.0 for x in profiles.agg(*[F.sum(rate * F.col("n_tokens") * F.col(f"p_{d}")) for d in DOMAINS]).head()]

    have = totals(F.lit(1.0))
    if full:
        budget = have[DOMAINS.index(full)] / share[full]
    goal = [share[d] * (sum(have) if budget is None else budget) for d in DOMAINS]
    steps: list[list[float]] = []
    got = have
    while True:
        gap = [(g - t) / n if n else 0.0 for g, t, n in zip(got, goal, have)]
        if max(map(abs, gap)) < TOLERANCE:
            break
        if steps and max(abs(a - b) for a, b in zip(gap, steps[-1])) < TOLERANCE:
            break  # the least squares can't come closer
        if len(steps) == MOST_STEPS:
            raise RuntimeError(f"the rates have not converged in {MOST_STEPS} steps: {dict(zip(DOMAINS, gap))}")
        steps.append(gap)
        got = totals(_rate(steps, whole))
    return members.withColumn("rate", _rate(steps, whole)), dict(zip(DOMAINS, got))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, full: str | None = None, keep: list[str] = ["doc_id"]) -> DataFrame:
    """The columns ``keep``, n_tokens, posteriors and rate of every document."""
    return fit_rates(written(memberships(docs, labels, keep), "memberships"), weights, full=full)[0]


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mix(docs, table(spark, sf_dir, "labels"))
