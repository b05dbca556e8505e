"""Operator 2: mixing towards target weights with soft domain membership.

Domains are the quality labels of a labelled table together with the languages of those documents.  A classifier fitted
on the labelled documents (Gaussian naive Bayes over a few text measures, from one grouped aggregation) gives each document a posterior over the domains.  Each
document then gets a nonnegative rate so that the expected tokens of every domain, the sum of rate x tokens x posterior,
meet a target.  Rates come from projected-gradient least squares: rate <- max(0, rate + posterior . step), where the step
is the residual of the domain totals, weighted by the inverse of the domains' token Gram matrix; with that weight the
gradient has Lipschitz constant one, so unit steps converge; they are accelerated by momentum, which starts anew where it
points uphill.  Steps end when the targets are met or the projected gradient is small.  An iteration is one aggregation of
a few numbers a domain; nothing else reaches the driver, and its size depends on the number of domains alone.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, saved

_LOG = logging.getLogger(__name__)

#: Target share of the tokens of each domain, which is quality label and language; domains not listed get none.
TARGETS = {"q1-en": 0.50, "q1-de": 0.17, "q1-fr": 0.17, "q1-es": 0.12, "q0-en": 0.04}
#: Domains at most: those with a target, then the largest; all others are one domain of this name.
DOMAINS, OTHER = 16, "other"
#: The largest miss of a target, or the projected gradient, as a share of all tokens, at which steps end.
CLOSE = 1e-4
#: Steps after which the rates are written, so that the plan does not grow.
WRITE_EVERY = 6
#: The least variance of a measure, and the prior strength of a class.
LEAST_VARIANCE, PRIOR = 1e-4, 1.0

#: Characters whose rates the classifier sees.
RATES = {
    "m_symbols": r"[#*$%&|<>]",
    "m_capitals": r"[A-Z]",
    "m_bangs": r"[!?]",
    "m_th": r"[Tt]h",
    "m_umlauts": r"[äöüßÄÖÜ]",
    "m_graves": r"[èêçàÈÊÇ]",
    "m_tildes": r"[ñóíáÑÓÍ]",
}
MEASURES = ("m_length", *RATES)


def n_tokens(text: Column) -> Column:
    """White-space tokens; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """What the classifier sees of a text: the logarithm of its length and square roots of rates; zeros without text."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    rates = {k: F.sqrt(F.regexp_count(t, F.lit(p)) / chars) for k, p in RATES.items()}
    return {"m_length": F.log1p(F.length(t).cast("double")) / 20, **rates}


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang, tokens, measures), one row per row; the texts themselves are left behind."""
    t = F.col(text)
    return docs.select(F.col(key).alias("doc_id"), F.col("lang"), n_tokens(t).alias("tokens"), *[c.alias(k) for k, c in measures(t).items()])


@dataclass
class Mixture:
    """A fitted mixture: numbers per domain only."""

    domains: list[str]
    log_prior: list[float]
    mean: list[list[float]]
    variance: list[list[float]]
    steps: list[list[float]]  # the step by domain, then the momentum after it
    wanted: list[float]
    reached: list[float]
    gradient: float = 0.0  # the last projected gradient, as a share of all tokens

    def report(self) -> dict[str, tuple[float, float]]:
        """Wanted and reached tokens of each domain."""
        return dict(zip(self.domains, zip(self.wanted, self.reached, strict=True), strict=True))

    def with_posteriors(self, df: DataFrame) -> DataFrame:
        """``df``, which has the measures, with a column loom_p<i> for each domain."""
        scores = []
        for d in range(len(self.domains)):
            s = F.lit(self.log_prior[d] - 0.5 * float(np.log(self.variance[d]).sum()))
            for m, mu, var in zip(MEASURES, self.mean[d], self.variance[d], strict=True):
                s = s - F.pow(F.col(m) - F.lit(mu), 2) / F.lit(2 * var)
            scores.append(s.alias(f"loom_s{d}"))
        rest = [F.col(f"`{c}`") for c in df.columns]
        n = range(len(scores))
        df = df.select(*rest, *scores)
        top = F.greatest(*[F.col(f"loom_s{d}") for d in n]) if len(scores) > 1 else F.col("loom_s0")
        df = df.select(*rest, *[F.col(f"loom_s{d}") for d in n], top.alias("loom_top"))
        df = df.select(*rest, *[F.exp(F.col(f"loom_s{d}") - F.col("loom_top")).alias(f"loom_e{d}") for d in n])
        total = sum((F.col(f"loom_e{d}") for d in n), F.lit(0.0))
        df = df.select(*rest, *[F.col(f"loom_e{d}") for d in n], total.alias("loom_all"))
        return df.select(*rest, *[(F.col(f"loom_e{d}") / F.col("loom_all")).alias(f"loom_p{d}") for d in n])

    def rate(self) -> Column:
        """The rate after all steps from 1, each kept nonnegative, from the columns loom_p<i>."""
        if not self.steps:
            return F.lit(1.0)
        n = len(self.domains)

        def step(at: Column, by: Column) -> Column:
            new = F.greatest(F.lit(0.0), at["y"] + sum((F.col(f"loom_p{d}") * by[d] for d in range(n)), F.lit(0.0)))
            # one element, so that the new rate is computed once
            both = F.transform(F.array(new), lambda r: F.struct(r.alias("r"), (r + by[n] * (r - at["r"])).alias("y")))
            return both[0]

        return F.aggregate(F.lit(self.steps), F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")), step)["r"]


def fit(compact: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> tuple[Mixture, DataFrame]:
    """Fits classifier and rates; also gives (doc_id, tokens, loom_p<i>, loom_rate), saved.

    ``compact`` comes from :func:`measured`; ``labels`` has doc_id and quality (repeated ids: the largest value counts;
    null labels, ids or languages are left out).  Domains beyond DOMAINS are one, so that the plan's size is bounded.  With no
    labelled row there is one domain, ``all``, of rate 1.
    """
    targets = TARGETS if targets is None else targets
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    domain = F.concat(F.lit("q"), F.col("quality"), F.lit("-"), F.col("lang"))
    sums = [F.sum(m).alias(f"s_{m}") for m in MEASURES] + [F.sum(F.col(m) * F.col(m)).alias(f"q_{m}") for m in MEASURES]
    groups = compact.where("lang is not null").join(known, "doc_id").groupBy(domain.alias("domain")).agg(F.count(F.lit(1)).alias("n"), *sums)
    most = max(DOMAINS, len(targets))
    large = groups.orderBy(F.col("domain").isin(*targets).desc() if targets else F.lit(0), F.desc("n"), "domain").limit(most + 1).select("domain").collect()
    if len(large) > most:  # the sums of the others add up
        own = F.when(F.col("domain").isin([r["domain"] for r in large[: most - 1]]), F.col("domain")).otherwise(F.lit(OTHER))
        groups = groups.groupBy(own.alias("domain")).agg(*[F.sum(c).alias(c) for c in groups.columns if c != "domain"])
    groups = sorted(groups.collect(), key=lambda r: r["domain"])
    if groups:
        total = sum(g["n"] for g in groups)
        names = [g["domain"] for g in groups]
        log_prior = [float(np.log((g["n"] + PRIOR) / (total + PRIOR * len(groups)))) for g in groups]
        mean = [[g[f"s_{m}"] / g["n"] for m in MEASURES] for g in groups]
        variance = [
            [max(g[f"q_{m}"] / g["n"] - (g[f"s_{m}"] / g["n"]) ** 2, 0) + LEAST_VARIANCE for m in MEASURES] for g in groups
        ]
    else:
        names, log_prior, mean, variance = ["all"], [0.0], [[0.0] * len(MEASURES)], [[1.0] * len(MEASURES)]
    mixture = Mixture(names, log_prior, mean, variance, [], [], [])
    n = range(len(names))
    p = [F.col(f"loom_p{i}") for i in n]
    member = saved(mixture.with_posteriors(compact).select("doc_id", "tokens", *p))

    first = member.agg(
        F.sum("tokens").alias("all"),
        *[F.sum(F.col("tokens") * p[i]).alias(f"t{i}") for i in n],
        *[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"g{i}_{j}") for i in n for j in n if i <= j],
    ).first()
    everything = float(first["all"] or 0)
    reached = np.array([float(first[f"t{i}"] or 0) for i in n])
    share = np.array([targets.get(d, 0.0) for d in names], dtype=float)
    wanted = share / share.sum() * everything if groups and share.sum() > 0 else reached
    gram = np.array([[float(first[f"g{min(i, j)}_{max(i, j)}"] or 0) for j in n] for i in n])
    weight = np.linalg.pinv(gram, rcond=1e-6, hermitian=True)
    mixture.wanted = wanted.tolist()
    state = member.select("doc_id", "tokens", *p, F.lit(1.0).alias("loom_rate"), F.lit(1.0).alias("loom_y"))
    ahead, pace = reached, 1.0  # totals of loom_y, from which a step goes out
    while everything and np.abs(wanted - reached).max() > CLOSE * everything:
        step = weight @ (wanted - ahead)
        new = F.greatest(F.lit(0.0), F.col("loom_y") + sum((p[i] * F.lit(float(x)) for i, x in enumerate(step)), F.lit(0.0)))
        moved = state.select("*", new.alias("loom_new"))
        row = moved.agg(
            *[F.sum(F.col("loom_new") * F.col("tokens") * p[i]).alias(f"t{i}") for i in n],
            F.sum(F.abs(F.col("loom_new") - F.col("loom_y")) * F.col("tokens")).alias("moved"),
        ).first()
        before, reached = reached, np.array([float(row[f"t{i}"] or 0) for i in n])
        if step @ (reached - before) < 0:
            pace = 1.0
        pace, last = (1 + (1 + 4 * pace * pace) ** 0.5) / 2, pace
        momentum = (last - 1) / pace
        ahead = reached + momentum * (reached - before)
        mixture.steps.append([*step.tolist(), momentum])
        mixture.gradient = float(row["moved"] or 0) / everything
        state = moved.select("doc_id", "tokens", *p, F.col("loom_new").alias("loom_rate"), (F.col("loom_new") + F.lit(momentum) * (F.col("loom_new") - F.col("loom_rate"))).alias("loom_y"))
        if len(mixture.steps) % WRITE_EVERY == 0:
            state = saved(state)
        if mixture.gradient <= CLOSE:
            break
    mixture.reached = reached.tolist()
    _LOG.info("%d steps, projected gradient %.1e; tokens wanted and reached: %s", len(mixture.steps), mixture.gradient, mixture.report())
    return mixture, state.drop("loom_y")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, tokens, posterior (domain -> probability) and rate; one row per row of ``docs``.

    Null and empty texts have 0 tokens and a rate like any other; null ids and repeated rows stay; an empty table gives
    an empty result.
    """
    mixture, member = fit(saved(measured(docs)), labels, targets)
    posterior = F.create_map(*[x for i, d in enumerate(mixture.domains) for x in (F.lit(d), F.col(f"loom_p{i}"))])
    return member.select("doc_id", "tokens", posterior.alias("posterior"), F.col("loom_rate").alias("rate"))


def copies(doc_id: Column, rate: Column) -> Column:
    """Copies of a row so that their expectation is the rate: the whole part, and one more if a hash of the id says so."""
    chance = F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with each row as often as its rate says: the columns stay as they are, no text is shuffled."""
    mixture, _ = fit(saved(measured(docs)), labels, targets)
    # columns go by number meanwhile, so that no name can clash
    columns = [f"c{k}" for k in range(len(docs.columns))]
    at = {c: k for k, c in enumerate(docs.columns)}
    seen = docs.toDF(*columns).select(*columns, *[c.alias(k) for k, c in measures(F.col(f"c{at['text']}")).items()])
    # the row number keeps filters above the rate, which they would otherwise spell out in full down at the scan
    rated = mixture.with_posteriors(seen).select(*columns, F.monotonically_increasing_id().alias("loom_n"), mixture.rate().alias("loom_rate"))
    number = F.when(F.col("loom_n") >= 0, copies(F.col(f"c{at['doc_id']}"), F.col("loom_rate")))
    drawn = rated.select(*columns, number.alias("loom_copies")).where("loom_copies > 0")
    every = drawn.select(*columns, F.explode(F.sequence(F.lit(1), F.col("loom_copies"))).alias("loom_copy"))
    return every.select(*columns).toDF(*docs.columns)
