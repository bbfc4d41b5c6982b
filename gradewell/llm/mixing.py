"""Mixing sources to target weights by soft membership (operator 7, native).

A naive Bayes classifier over hashed words, fitted on half of a bounded sample
of a labelled table and calibrated on the other half, gives every document its
posterior over the domains. Nonnegative document rates are then fitted by
projected gradient, so that the expected tokens of each domain (rate x tokens x
posterior, summed) match target shares of a token budget in the least-squares
sense. A gradient step moves a rate along the document's posteriors, so a rate
follows from the posteriors and the steps: documents whose rounded posteriors
agree share one, and a step is a distributed sum over a table of such cells, of
which the driver sees a number a domain. Everything here is DataFrame
expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.samples import sample_ids
from gradewell.llm.shared import Scratch, sheltered

#: Words are hashed to so many features; the model is a number for each of them and each domain.
FEATURES = 1 << 15
#: The classifier is fitted on at most so many labelled documents a domain.
SAMPLE_PER_DOMAIN = 2000
#: Features whose counts by domain deviate from chance by less than so many standard deviations count for nothing.
SIGNIFICANT = 4.0
#: Each domain is given so many features of the usual kind, so that rare ones aren't overrated.
SMOOTHING = 1000.0
#: Posteriors are rounded to this many digits before rates are fitted and reported, so there are at most so many cells as such
#: posteriors: 5,151 of three domains.
DIGITS = 2
#: A total is reached when it is off by this share of its target; the most steps, and the most for one sum; and the sums in
#: which the squared error has to fall by a share of itself, else it is taken to be the least.
NEAR = 3e-4
STEPS, MOST_AT_ONCE = 400, 16
PATIENCE, STILL = 8, 1e-3
_SLOTS = 1 << 20


@dataclass
class DomainModel:
    domains: list[str]
    prior: list[float]  # log odds against the last domain
    weights: list[dict[int, float]]  # of features that tell, in the same sense


#: Of each projected-gradient step: how far it moves a document wholly in a domain, for each domain, and its momentum.
Steps = list[tuple[list[float], float]]


@dataclass
class Fit:
    steps: Steps
    natural: list[float]  # tokens of each domain at rates of one
    wanted: list[float]
    reached: list[float]
    settled: bool


def words(text: Column) -> Column:
    """Lower-cased runs of anything but space and 09-0D; one empty word if there is none."""
    return F.split(F.lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))), r"[ \t\n\x0B\f\r]+")


def count_words(found: Column) -> Column:
    return F.when(F.element_at(found, 1) == "", 0).otherwise(F.size(found)).cast("long")


def features(found: Column) -> Column:
    """The distinct hashed words."""
    return F.array_distinct(F.transform(found, lambda w: F.xxhash64(w).bitwiseAND(F.lit(FEATURES - 1)).cast("int")))


def _weights(table: list, domains: list[str]) -> list[dict[int, float]]:
    """Log odds of each telling feature against the last domain; ``table`` has f and n<k>, documents of each domain."""
    seen = [sum(r[f"n{k}"] for r in table) for k in range(len(domains))]
    raw: list[dict[int, float]] = [{} for _ in domains]
    for r in table if sum(map(bool, seen)) > 1 else []:
        found = [r[f"n{k}"] for k in range(len(domains))]
        usual = sum(found) / sum(seen)
        expected = [usual * a for a in seen]
        if sum((f - e) ** 2 / e for f, e in zip(found, expected, strict=True) if e) < SIGNIFICANT**2 + len(domains):
            continue
        for k, f in enumerate(found):
            raw[k][r["f"]] = math.log((f + SMOOTHING * usual) / (seen[k] + SMOOTHING) / usual)
    return [{f: raw[k][f] - raw[-1][f] for f in raw[k]} for k in range(len(domains) - 1)]


def calibrate(evidence: list[tuple[int, list[float]]], share: list[float]) -> tuple[float, list[float]]:
    """A factor of the evidence and a log prior for each domain, of held-out labels; (domain, log odds) each.

    Of all factors the one under which the labels are likeliest, each with the
    priors that make the mean posterior the domains' shares. Without any
    evidence 1 and the shares' logarithms.
    """
    prior = np.log(share)
    if not evidence:
        return 1.0, prior.tolist()
    truth, odds, want = np.array([k for k, _ in evidence]), np.array([e for _, e in evidence]), np.array(share)
    weight = (want / np.maximum(np.bincount(truth, minlength=len(share)), 1))[truth]
    weight = weight / weight.sum()

    def posteriors(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    best = (np.inf, 1.0, prior)
    for t in (2.0 ** (k / 4) for k in range(-24, 17)):
        level = prior.copy()
        for _ in range(50):
            level += np.log(want / np.maximum(weight @ posteriors(level + t * odds), 1e-9))
        loss = -float(weight @ np.log(np.maximum(posteriors(level + t * odds)[np.arange(len(truth)), truth], 1e-12)))
        best = min(best, (loss, t, level), key=lambda x: x[0])
    return best[1], best[2].tolist()


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], per_domain: int = SAMPLE_PER_DOMAIN) -> DomainModel:
    """From ``labelled`` (doc_id, label): presence counts of features in one half of the sample, calibrated on the other.

    Only labels of rows that ``docs`` has count, for the sample and for the prior.
    """
    named = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
    rows = named.join(labelled.where(F.col("label").isin(domains)), "doc_id")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row a domain
    total = sum(counts.values())
    share = [(counts.get(d, 0) + 0.5) / (total + 0.5 * len(domains)) for d in domains]
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    # at most per_domain ids a domain, so the broadcast side is bounded
    sampled = text.join(F.broadcast(sample_ids(rows, per_domain)), "doc_id").select("label", features(words(F.col("text"))).alias("f"), F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).alias("half"))
    sampled = Scratch(docs.sparkSession, "mixing-sample").keep(sampled, "rows")
    held = [F.count_if(F.col("label") == d).alias(f"n{k}") for k, d in enumerate(domains)]
    # at most FEATURES rows
    weights = _weights(sampled.where("half = 0").select("label", F.explode("f").alias("f")).groupBy("f").agg(*held).collect(), domains)
    model = DomainModel(domains, [0.0] * len(weights), weights)
    other = sampled.where("half = 1").select("label", scores(model, F.col("f")).alias("s")).collect()  # at most per_domain rows a domain
    t, level = calibrate([(domains.index(r["label"]), r["s"]) for r in other], share)
    return DomainModel(domains, [x - level[-1] for x in level[:-1]], [{f: t * x for f, x in w.items()} for w in weights])


def _numbers(values: list[float]) -> Column:
    """A constant array that the optimizer folds into one literal."""
    return F.split(F.lit(",".join("0" if v == 0 else f"{v:.5g}" for v in values)), ",").cast("array<double>")


def scores(model: DomainModel, found: Column) -> Column:
    """Array of log odds against the last domain: the prior's and the words' over the root of their number.

    Words of one text aren't independent; the root keeps long texts from being sure of everything.
    """
    root = F.sqrt(F.greatest(F.size(found), F.lit(1)))

    def odds(weights: dict[int, float], prior: float) -> Column:
        table = _numbers([weights.get(i, 0.0) for i in range(FEATURES)])
        return F.aggregate(found, F.lit(0.0), lambda s, i: s + F.get(table, i)) / root + F.lit(float(prior))

    return F.array(*[odds(w, prior) for w, prior in zip(model.weights, model.prior, strict=True)], F.lit(0.0))


def _softmax(logs: Column) -> Column:
    """Rounded posteriors; the last is what the others leave of one."""
    top = F.array_max(logs)
    odds = F.transform(logs, lambda s: F.exp(s - top))
    whole = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    first = F.transform(F.slice(odds, 1, F.size(odds) - 1), lambda x: F.round(x / whole, DIGITS))
    return F.concat(first, F.array(F.greatest(F.lit(0.0), F.round(1 - F.aggregate(first, F.lit(0.0), lambda a, x: a + x), DIGITS))))


def membership(docs: DataFrame, model: DomainModel) -> DataFrame:
    """``docs`` with __tokens (words) and __p (posteriors); no column of theirs is touched."""
    split = docs.withColumn("__w", words(F.col("text")))
    hashed = split.withColumns({"__tokens": count_words(F.col("__w")), "__f": features(F.col("__w"))})
    return hashed.withColumn("__s", scores(model, F.col("__f"))).withColumn("__p", _softmax(F.col("__s"))).drop("__w", "__f", "__s")


def _states(p: Column, steps: Steps) -> Column:
    """A document's rate after the steps and the one before it: each step moves it along its posteriors, and no rate falls below zero."""
    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("before"))
    if not steps:
        return start
    history = F.array(*[F.array(*[F.lit(float(v)) for v in (*pull, drift)]) for pull, drift in steps])
    domains = range(len(steps[0][0]))

    def step(state: Column, h: Column) -> Column:
        moved = state["rate"] + F.element_at(h, len(domains) + 1) * (state["rate"] - state["before"])
        moved -= sum((F.element_at(p, k + 1) * F.element_at(h, k + 1) for k in domains), F.lit(0.0))
        return F.struct(F.greatest(F.lit(0.0), moved).alias("rate"), state["rate"].alias("before"))

    return F.aggregate(history, start, step)


def rates(p: Column, steps: Steps) -> Column:
    """The rates after all steps."""
    return _states(p, steps)["rate"]


def fit_rates(cells: DataFrame, targets: list[float], budget: float = 1.0) -> Fit:
    """Nonnegative rates of ``cells`` (p array, tokens) by projected gradient: the least squares of the domain totals' errors.

    ``targets`` are weights of the domains in ``budget`` times the tokens that
    there are. All rates begin at one. A step moves every rate against the
    gradient, divided by its tokens (a diagonal scaling) and by the greatest
    eigenvalue of the domains' Gram matrix, which bounds the curvature. Steps
    begin past the rates by a share of the last step, a momentum that grows until
    an error does. A distributed sum over all cells gives the totals and the Gram
    matrix over the rates that aren't zero; while none becomes zero, the totals
    after further steps follow from it, so a few steps are taken for each sum,
    more as long as the sums agree, and one where they don't.

    The steps end when every total is within NEAR of its target, or when the
    error falls no more: then no nonnegative rates reach the targets (a domain
    without tokens, posteriors that hardly part), and the totals are the
    nearest. After STEPS steps the rates are what they are (``settled`` is false).
    """
    n = range(len(targets))
    pairs = [(j, k) for j in n for k in n if j <= k]

    def at(steps: Steps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals, totals before the last step, Gram matrix: a number a domain or pair of domains."""
        rated = cells.withColumn("s", _states(F.col("p"), steps))
        part = lambda k: F.element_at("p", k + 1) * F.col("tokens")
        sums = [F.sum(part(k) * F.col(f"s.{c}")).alias(f"{c}{k}") for c in ("rate", "before") for k in n]
        sums += [F.sum(F.when(F.col("s.rate") > 0, part(j) * F.element_at("p", k + 1))).alias(f"g{j}_{k}") for j, k in pairs]
        r = rated.agg(*sums).first()
        value = lambda name: float(r[name] or 0.0)
        return np.array([value(f"rate{k}") for k in n]), np.array([value(f"before{k}") for k in n]), np.array([[value(f"g{min(j, k)}_{max(j, k)}") for k in n] for j in n])

    natural, _, gram = at([])
    curve = max(float(np.linalg.eigvalsh(gram)[-1]), 1e-12)
    wanted = np.array(targets) / sum(targets) * budget * natural.sum()
    enough = NEAR * np.maximum(wanted, natural.sum() / 1000)
    steps: Steps = []
    found, before, drift, pace, many, errors, settled = natural, natural, 0.0, 1.0, 1, [float("inf")], False
    while len(steps) < STEPS:
        error = float((found - wanted) @ (found - wanted))
        if error > errors[-1]:
            pace, drift, many = 1.0, 0.0, 1
        errors.append(error)
        still = len(errors) > PATIENCE + 1 and min(errors[:-PATIENCE]) - min(errors[-PATIENCE:]) <= STILL * min(errors)
        if (np.abs(found - wanted) <= enough).all() or still:
            settled = True
            break
        for _ in range(many):
            # totals are linear in the rates, so they are known where the step begins
            pull = found + drift * (found - before) - wanted
            steps.append(([float(x) for x in pull / curve], drift))
            found, before = found + drift * (found - before) - gram @ pull / curve, found
            faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
            drift, pace = (pace - 1) / faster, faster
            if (np.abs(found - wanted) <= enough / 2).all():
                break
        expected = found
        found, before, gram = at(steps)
        many = min(2 * many, MOST_AT_ONCE) if (np.abs(found - expected) <= np.abs(expected - wanted) / 4 + enough / 4).all() else 1
    return Fit(steps, natural.tolist(), wanted.tolist(), found.tolist(), settled)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: list[str], budget: float = 1.0, seed: int = 7) -> tuple[DataFrame, Fit]:
    """The columns ``keep`` of ``docs`` (doc_id, text and any others) with __tokens, __p, __rate and __copies; and the fit.

    ``labelled`` (doc_id, label) names the domains of some documents; labels
    that ``targets`` doesn't name aren't learned. A rate's fraction is settled by
    a hash of id and text, so the expected totals are the fitted ones. Null and
    empty texts have no tokens and the prior's posteriors; texts of any length
    are read whole. Repeated rows get the same copies each. An empty table gives
    an empty result. No column of ``docs`` is touched; names with dots, and those
    that begin with two underscores, are for ``draw`` to shelter.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    # texts are read for their words once; what is kept is written
    chance = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(_SLOTS)) + 0.5) / _SLOTS
    placed = membership(docs.withColumn("__chance", chance), fit(docs, labelled, list(targets)))
    placed = scratch.keep(placed.select(*keep, "__tokens", "__p", "__chance"), "placed")
    cells = scratch.keep(placed.groupBy(F.col("__p").alias("p")).agg(F.sum("__tokens").alias("tokens")).coalesce(8), "cells")
    found = fit_rates(cells, list(targets.values()), budget)
    # a rate for each cell of rounded posteriors, joined back
    of_cell = scratch.keep(cells.select(F.col("p").alias("__cell"), F.round(rates(F.col("p"), found.steps), 6).alias("__rate")), "rates")
    rated = placed.join(of_cell, F.col("__p") == F.col("__cell")).drop("__cell")
    return rated.withColumn("__copies", F.floor(F.col("__rate") + F.col("__chance")).cast("int")).drop("__chance"), found


def domain_rows(labels: DataFrame) -> DataFrame:
    """The labelled table (doc_id, label): toxic rows, and the others by quality; rows that say neither are left out."""
    label = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "poor")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.alias("label")).where("label is not null")


#: Shares of tokens by domain, and all tokens against those that there are: clean text is repeated, toxic and poor text is thinned.
TARGETS = {"clean": 0.82, "toxic": 0.10, "poor": 0.08}
#: The same where poor text has been taken out before.
FILTERED_TARGETS = {"clean": 0.92, "toxic": 0.08}
BUDGET = 1.2


def mix_report(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are not read): doc_id, n_tokens, p_<domain>, rate, copies."""
    targets = targets or TARGETS
    mixed, _ = mix(docs.select("doc_id", "text"), domain_rows(labels), targets, ["doc_id"], budget)
    shares = [F.element_at("__p", k + 1).alias(f"p_{d}") for k, d in enumerate(targets)]
    return mixed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__tokens").alias("n_tokens"), *shares, F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))


def draw(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = BUDGET, spare: bool = False) -> DataFrame:
    """The mixed rows of ``docs``, with all their columns and as many copies as their rates say; odd rows as in ``mix``.

    With ``spare`` a document that is likeliest to be of a domain that isn't to
    be thinned (the first of equally likely ones) has one copy at least, whatever
    its rate: where posteriors hardly part, least squares drop documents of all
    domains, and this keeps those that nothing speaks against.
    """
    inner, named = sheltered(docs)
    mixed, found = mix(inner, domain_rows(labels), targets or FILTERED_TARGETS, inner.columns, budget)
    copies = F.col("__copies")
    if spare:
        whole = [k + 1 for k, (want, have) in enumerate(zip(found.wanted, found.natural, strict=True)) if want >= have]
        copies = F.when(F.array_position("__p", F.array_max("__p")).isin(whole), F.greatest(copies, F.lit(1))).otherwise(copies)
    return named(mixed.withColumn("__copies", copies).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))))
