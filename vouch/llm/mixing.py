"""Mixing to target weights: soft domain membership and fitted document rates.

Column expressions and aggregates only.  The classifier is a table of log-probabilities per
domain, feature and bin; a rate is an expression over a document's posteriors and the
residuals of the fit, so applying a mix needs one scan and no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from vouch.functions.text import let
from vouch.session import materialize

BINS = 32  # bins of each feature
MOST_DOMAINS = 64
N_FEATURES = 9


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"[ \t\n\r\x0b\f]+", " ")), " ")


def _without(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _measured(text: Column) -> tuple[Column, list[Column]]:
    """The number of words, and binned features that depend on no language and no single word."""
    text = F.coalesce(text, F.lit(""))
    words = F.col("_words")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    count = F.when(F.get(words, F.lit(0)) == "", F.lit(0)).otherwise(F.size(words)).cast("bigint")
    shares = [
        n / 16384,
        F.greatest(count, F.lit(1)) / n,
        F.size(F.array_distinct(words)) / F.greatest(count, F.lit(1)),
        _without(text, "\n") / n,
        _without(text, ".") / n,
        _without(text, ",") / n,
        _without(text, "!") / n,
        F.regexp_count(text, F.lit("[A-Z]")) / n,
        F.regexp_count(text, F.lit(r"[^\p{L}\s.,!]")) / n,
    ]
    # two bins for each doubling
    bins = [F.floor(2 * F.log2(F.greatest(s, F.lit(2.0**-12)))) + 24 for s in shares]
    return count, [F.greatest(F.lit(0), F.least(F.lit(BINS - 1), b)).cast("int") for b in bins]


def measure(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """``keep`` columns, ``tokens`` (words) and ``bins`` of each row."""
    split = docs.select(*keep, text.alias("_text"), _words(F.coalesce(text, F.lit(""))).alias("_words"))
    tokens, bins = _measured(F.col("_text"))
    return split.withColumns({"tokens": tokens, "bins": F.array(*bins)}).drop("_text", "_words")


@dataclass(frozen=True)
class Classifier:
    """Naive Bayes over binned features; ``table[d]`` holds one row of bins after the other."""

    domains: list[str]
    prior: list[float]
    table: list[list[float]]

    def posteriors(self) -> Column:
        """An array with one value per domain, from the column ``bins``; they add up to 1."""
        scores = []
        for prior, table in zip(self.prior, self.table, strict=True):
            terms = F.lit(prior)
            values = F.array(*[F.lit(v) for v in table])
            for f in range(len(table) // BINS):
                terms = terms + F.get(values, F.get(F.col("bins"), F.lit(f)) + f * BINS)
            scores.append(terms)
        shares = lambda s: F.transform(s, lambda v: F.exp(v - F.array_max(s)))
        total = lambda p: F.aggregate(p, F.lit(0.0), lambda t, v: t + v)
        return let(let(F.array(*scores), shares), lambda p: F.transform(p, lambda v: v / total(p)))


def train_classifier(measured: DataFrame, labels: DataFrame, domains: list[str]) -> Classifier:
    """Counts over all labelled rows: ``measured(id, bins)`` and ``labels(id, domain)``.

    A domain without labelled rows keeps a prior of about 0, and all posteriors with it.
    """
    labelled = measured.join(labels.where(F.col("domain").isin(domains)), "id")
    counts = (
        labelled.select("domain", F.posexplode("bins").alias("f", "bin"))
        .groupBy("domain", "f", "bin")
        .count()
        .collect()  # at most domains x features x bins rows
    )
    table = {d: [0] * (N_FEATURES * BINS) for d in domains}
    for row in counts:
        table[row["domain"]][row["f"] * BINS + row["bin"]] = row["count"]
    sizes = {d: sum(table[d][:BINS]) for d in domains}
    total = sum(sizes.values())
    prior = [math.log((sizes[d] or 1e-9) / (total or 1)) if total else 0.0 for d in domains]
    logs = [[math.log((c + 0.5) / (sizes[d] + 0.5 * BINS)) for c in table[d]] for d in domains]
    return Classifier(list(domains), prior, logs)


@dataclass(frozen=True)
class Mix:
    """``steps``: the preconditioned residual of each iteration; ``totals``: what the rates give."""

    classifier: Classifier
    min_rate: float
    targets: list[float]
    totals: list[float] = field(default_factory=list)
    steps: list[list[float]] = field(default_factory=list)

    def rate(self, posteriors: Column) -> Column:
        """The rate of a document, from its array of posteriors."""
        return _rate(posteriors, self.steps, self.min_rate)


def _rate(posteriors: Column, steps: list[list[float]], floor: float) -> Column:
    start = F.lit(max(1.0, floor))
    if not steps:
        return start
    values = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps])

    def step(rate: Column, y: Column) -> Column:
        move = F.get(posteriors, F.lit(0)) * F.get(y, F.lit(0))
        for d in range(1, len(steps[0])):
            move = move + F.get(posteriors, F.lit(d)) * F.get(y, F.lit(d))
        return F.greatest(F.lit(floor), rate - move)

    return F.aggregate(values, start, step)


def fit_mix(
    parts: DataFrame,
    classifier: Classifier,
    weights: dict[str, float],
    min_rate: float = 0.0,
    iterations: int = 40,
    tolerance: float = 1e-6,
) -> Mix:
    """Rates ``r >= min_rate`` with ``sum r * tokens * p(domain)`` close to each domain's target.

    ``parts`` has ``tokens`` and ``p`` (array of posteriors).  Least squares by projected
    gradient: an iteration is one aggregate of a row per domain, then every rate moves
    against its posteriors times the residual and back to the bound.  Residuals are
    preconditioned by the ``domains x domains`` matrix ``sum tokens p p'``, which makes 1 a safe step.
    Targets are shares of all tokens; with ``min_rate`` of 1 or more the total grows just so far that no
    domain has to shrink.  Weights must not be negative; they are scaled to a sum of 1.
    """
    domains = classifier.domains
    size = len(domains)
    p = [F.get("p", F.lit(d)) for d in range(size)]
    first = parts.agg(
        *[F.sum(F.col("tokens") * p[a] * p[b]) for a in range(size) for b in range(a + 1)],
        *[F.sum(F.col("tokens") * p[a]) for a in range(size)],
    ).first()
    values = [float(v or 0.0) for v in first]
    matrix = np.zeros((size, size))
    for (a, b), v in zip([(a, b) for a in range(size) for b in range(a + 1)], values, strict=False):
        matrix[a, b] = matrix[b, a] = v
    natural = np.array(values[-size:])
    share = np.array([max(0.0, float(weights[d])) for d in domains])
    total = natural.sum()
    if total == 0 or share.sum() == 0:
        return Mix(classifier, min_rate, [0.0] * size, natural.tolist())
    share = share / share.sum()
    if min_rate >= 1:
        held = min_rate * natural
        needed = [h / s for h, s in zip(held, share, strict=True) if s > 0]
        total = max(needed)
    target = share * total
    matrix += np.eye(size) * 1e-3 * np.trace(matrix) / size  # alike domains don't make rates explode
    steps: list[list[float]] = []
    sums = natural * max(1.0, min_rate)
    for _ in range(iterations):
        gap = sums - target
        if np.abs(gap).max() <= tolerance * total:
            break
        steps.append(np.linalg.solve(matrix, gap).tolist())
        rate = _rate(F.col("p"), steps, min_rate)
        sums = np.array([float(v or 0.0) for v in parts.agg(*[F.sum(rate * F.col("tokens") * q) for q in p]).first()])
    return Mix(classifier, min_rate, target.tolist(), sums.tolist(), steps)


def _fit(rows, labels, weights, min_rate):
    """From measured rows ``id, tokens, bins``: their posteriors, written, and the mix."""
    domains = sorted(weights)
    if not 1 <= len(domains) <= MOST_DOMAINS:
        raise ValueError(f"between 1 and {MOST_DOMAINS} domains")
    one = labels.where("id is not null and domain is not null").groupBy("id").agg(F.min("domain").alias("domain"))
    classifier = train_classifier(rows, one, domains)
    parts = materialize(rows.select("id", "tokens", classifier.posteriors().alias("p")), "parts")
    return parts, fit_mix(parts, classifier, weights, min_rate)


def document_rates(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    min_rate: float = 0.0,
) -> DataFrame:
    """``id_col, tokens, domains, posteriors, rate``: one row per row of ``docs``.

    ``labels(id, domain)`` names the domain of some documents; an id with several counts
    with the alphabetically first one, and ids or domains that are null or unknown to ``weights`` are no
    examples.  Null and empty texts have 0 tokens and don't count towards any total.
    """
    rows = materialize(measure(docs, F.col(text_col), F.col(id_col).alias("id")), "measured")
    parts, mix = _fit(rows, labels, weights, min_rate)
    return parts.select(
        F.col("id").alias(id_col),
        "tokens",
        F.array(*[F.lit(d) for d in mix.classifier.domains]).alias("domains"),
        F.col("p").alias("posteriors"),
        mix.rate(F.col("p")).alias("rate"),
    )


def copies(rate: Column, *key: Column) -> Column:
    """A whole number of copies whose mean is ``rate``: rounded by a hash of ``key``, the same in every run."""
    chance = F.pmod(F.xxhash64(*key), F.lit(2**40)) / F.lit(float(2**40))
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix_documents(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    min_rate: float = 0.0,
) -> DataFrame:
    """``docs`` with every row repeated ``copies`` times (0: left out), its columns unchanged.

    With ``min_rate`` 1 every row stays and scarce domains are repeated; rows equal in id
    and text get equal copies.
    """
    n = len(docs.columns)
    own = docs.toDF(*[f"c{i}" for i in range(n)])  # names may clash with those used here
    key, text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    # written with the texts, so that these are measured once
    rows = materialize(measure(own, F.col(text), *[F.col(f"c{i}") for i in range(n)]), "measured")
    _, mix = _fit(rows.select(F.col(key).alias("id"), "tokens", "bins"), labels, weights, min_rate)
    number = let(let(mix.classifier.posteriors(), mix.rate), lambda rate: copies(rate, F.col(key), F.col(text)))
    repeated = let(number, lambda c: F.when(c > 0, F.sequence(F.lit(1), c)).otherwise(F.array().cast("array<int>")))
    out = rows.select(*[f"c{i}" for i in range(n)], F.explode(repeated).alias("copy")).drop("copy")
    return out.toDF(*docs.columns)
