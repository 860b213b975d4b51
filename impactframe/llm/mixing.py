"""Mixing sources to target weights by soft membership, in DataFrame functions only.

A classifier learnt from the ``labels`` table gives every document a posterior over
domains. Nonnegative document rates are then fitted by projected-gradient least squares so
that the expected token total of each domain, the sum of rate x tokens x posterior, meets
its target. A rate's whole part is a document's number of copies, its fraction the chance
of one more, drawn from a hash.

Scale: the classifier is a table of ``BUCKETS`` word-hash weights for each domain. Texts
are read once to learn and once to predict; the fit reads two narrow columns (tokens and
posteriors) and each step is an aggregation to as many sums as domains and pairs of them, so
the driver holds only those. Nothing is shuffled by document.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import split_words
from .storage import durable

#: Domains from the labels (quality, toxic), with the shares of tokens aimed at.
DOMAINS = ["good", "poor", "toxic"]
TARGETS = {"good": 0.9, "poor": 0.08, "toxic": 0.02}
#: Domains whose documents are not thinned: the total grows until their target is theirs.
PROTECTED = ("good",)
BUCKETS = 4096
TRAIN_ROWS = 20_000
SMOOTHING = 1.0
STEPS = 60
TOLERANCE = 1e-9
#: Share of the tokens by which a domain may miss its aim without a warning.
MISSED = 1e-3


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality == 1, 0)


def _buckets(text: Column) -> Column:
    return F.transform(split_words(text), lambda w: F.pmod(F.hash(F.lower(w)), F.lit(BUCKETS)))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[float], list[list[float]]]:
    """Log prior of each domain, and for each word bucket a log weight for each domain, by
    multinomial naive Bayes on the shares of words in at most ``rows`` labelled documents
    (those with the least hash of doc_id). A domain that no label has gets no weight."""
    chosen = (
        labels.select(labels["doc_id"].alias("label_id"), domain(labels["quality"], labels["toxic"]).alias("domain"))
        .where("domain is not null and label_id is not null")
        .groupBy("label_id")
        .agg(F.max("domain").alias("domain"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(rows)
    )
    read = docs.select(docs["doc_id"].alias("label_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    known = read.join(F.broadcast(chosen), "label_id").select("domain", _buckets(F.col("text")).alias("b"))
    counted = (
        known.select("domain", F.explode(F.concat(F.array(F.lit(-1)), "b")).alias("b"))
        .groupBy("domain", "b")
        .agg(F.count("*").alias("n"))
        .collect()  # at most (BUCKETS + 1) x domains rows
    )
    k = len(DOMAINS)
    count = [[0] * k for _ in range(BUCKETS)]
    held = [0] * k
    for r in counted:
        if r["b"] < 0:
            held[r["domain"]] += r["n"]
        else:
            count[r["b"]][r["domain"]] += r["n"]
    if not sum(held):
        return [0.0] * k, [[0.0] * k for _ in range(BUCKETS)]
    prior = [math.log(h / sum(held)) if h else -1e9 for h in held]
    total = [sum(c[j] for c in count) + SMOOTHING * BUCKETS for j in range(k)]
    weight = [[math.log((c[j] + SMOOTHING) / total[j]) for j in range(k)] for c in count]
    # against the mean, so that words which say nothing weigh nothing
    return prior, [[x - sum(w) / k for x in w] for w in weight]


def with_posteriors(docs: DataFrame, prior: list[float], weight: list[list[float]]) -> DataFrame:
    """``docs`` with ``n_tokens`` (words) and ``posterior`` (one number a domain, sum 1)."""
    k = len(DOMAINS)
    known = [j for j in range(k) if prior[j] > -1e8]
    tables = {j: F.split(F.lit(",".join(repr(w[j]) for w in weight)), ",").cast("array<double>") for j in known}
    words = docs.withColumn("_buckets", _buckets(F.coalesce(F.col("text"), F.lit(""))))
    start = F.struct(*[F.lit(prior[j]).alias(f"s{j}") for j in known])
    scored = words.withColumns(
        {
            "n_tokens": F.size("_buckets").cast("long"),
            "_score": F.aggregate(
                "_buckets",
                start,
                lambda a, b: F.struct(*[(a[f"s{j}"] + F.get(tables[j], b)).alias(f"s{j}") for j in known]),
            ),
        }
    )
    best = F.greatest(*[F.col(f"_score.s{j}") for j in known]) if len(known) > 1 else F.col(f"_score.s{known[0]}")
    raised = [F.exp(F.col(f"_score.s{j}") - best) if j in known else F.lit(0.0) for j in range(k)]
    total = sum(raised[1:], raised[0])
    return scored.withColumn("posterior", F.array(*[r / total for r in raised])).drop("_buckets", "_score")


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Solution of a small positive system; a domain without tokens gets 0."""
    n = len(b)
    scale = max((a[i][i] for i in range(n)), default=0.0)
    m = [[*a[i], b[i]] for i in range(n)]
    for i in range(n):
        m[i][i] += 1e-9 * scale or 1.0
    for i in range(n):
        pivot = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[pivot] = m[pivot], m[i]
        for r in range(n):
            if r != i:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    return [m[i][n] / m[i][i] for i in range(n)]


def _rate(posterior: Column, steps: list[list[float]]) -> Column:
    """A document's rate after the given steps from 1: each adds its posterior's product
    with the step and is projected onto nonnegative numbers."""
    k = len(DOMAINS)
    rate: Column = F.lit(1.0)
    if not steps:
        return rate
    listed = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    return F.aggregate(
        listed,
        rate,
        lambda r, s: F.greatest(
            F.lit(0.0), r + sum((F.get(posterior, j) * F.get(s, j) for j in range(1, k)), F.get(posterior, 0) * F.get(s, 0))
        ),
    )


def aims(natural: list[float], targets: dict[str, float], protected: tuple[str, ...] = PROTECTED) -> list[float]:
    """Token totals to reach: the targets' shares (of domains that have tokens) of a total
    that is the natural one, or so much more that no protected domain has to shrink."""
    share = [targets[d] if natural[j] > 0 else 0.0 for j, d in enumerate(DOMAINS)]
    whole = sum(share)
    if whole <= 0:
        return list(natural)
    share = [s / whole for s in share]
    total = sum(natural)
    for j, d in enumerate(DOMAINS):
        if d in protected and share[j] > 0:
            total = max(total, natural[j] / share[j])
    return [s * total for s in share]


@dataclass
class Fit:
    """Steps of a fit, the token totals aimed at and reached, and the greatest distance of
    one from the other as a share of all tokens aimed at."""

    steps: list[list[float]]
    aims: list[float]
    reached: list[float]
    residual: float


def _largest_eigenvalue(a: list[list[float]]) -> float:
    """Of a small nonnegative symmetric matrix, from above: its greatest row sum."""
    return max((sum(map(abs, row)) for row in a), default=0.0)


def fit(narrow: DataFrame, targets: dict[str, float], steps_at_most: int = STEPS) -> Fit:
    """The least-squares fit on ``narrow(n_tokens, posterior)`` by projected gradient.

    All rates start at 1. A step adds to each rate the posterior's product with a vector and
    projects it onto nonnegative numbers. With the distance to the aims as vector, divided by
    a bound of the Gram matrix's largest eigenvalue, this is the projected gradient of half the
    squared distance in the metric of tokens, and the distance always falls. Longer steps are
    tried before it: the same one in the metric of the Gram matrix of documents in use, taken
    if the squared distance falls by a tenth at least, and a multiple of it that grows while
    it helps. The fit ends when the aims are met, when a step helps no more (targets out of
    reach), or after ``steps_at_most``; a residual above ``MISSED`` is warned of."""
    k = len(DOMAINS)
    p = [F.get(F.col("posterior"), j) for j in range(k)]
    n = F.col("n_tokens")

    def measured(rate: Column) -> tuple[list[float], list[list[float]]]:
        """Token totals at these rates, and the Gram matrix of the documents that have any."""
        used = F.when(F.col("rate") > 0, n)
        sums = [F.sum(F.col("rate") * n * x) for x in p] + [F.sum(used * p[i] * p[j]) for i in range(k) for j in range(k)]
        row = [float(x or 0.0) for x in narrow.withColumn("rate", rate).agg(*sums).first()]
        return row[:k], [row[k + i * k : k + (i + 1) * k] for i in range(k)]

    now, active = measured(F.lit(1.0))
    wanted = aims(now, targets)
    bound = _largest_eigenvalue(active)
    scale = max(sum(wanted), 1.0)
    distance = lambda x: [a - b for a, b in zip(wanted, x, strict=True)]
    square = lambda x: sum(d * d for d in distance(x))
    steps: list[list[float]] = []
    longer = 1.0
    while len(steps) < steps_at_most and max(map(abs, distance(now))) > TOLERANCE * scale:
        plain = [d / bound for d in distance(now)] if bound else [0.0] * k
        tried = [(_solve(active, distance(now)), 0.9, longer), ([longer * x for x in plain], 0.999, 4 * longer)]
        if longer > 1:
            tried.append((plain, 1 - 1e-5, 1.0))
        for step, least, after in tried:
            there, used = measured(_rate(F.col("posterior"), [*steps, step]))
            if square(there) < least * square(now):
                longer = after
                break
        else:
            break
        steps.append(step)
        now, active = there, used
    residual = max(map(abs, distance(now)), default=0.0) / scale
    if residual > MISSED:
        warnings.warn(f"domain token totals miss their aims by {residual:.2%} of all tokens", stacklevel=2)
    return Fit(steps, wanted, now, residual)


def fit_steps(narrow: DataFrame, targets: dict[str, float]) -> tuple[list[list[float]], list[float]]:
    """Steps of ``fit`` and the token totals aimed at."""
    found = fit(narrow, targets)
    return found.steps, found.aims


def rates(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, rows: int = TRAIN_ROWS
) -> DataFrame:
    """(doc_id, n_tokens, posterior, rate, n_copies) for every row of ``docs``.

    Null text has no tokens and the prior as posterior; null doc_ids draw as an empty one;
    repeated rows have equal rates; without usable labels the posterior is even. With an
    empty table, or one without tokens, rates are 1. Other columns are ignored."""
    prior, weight = learn(docs, labels, rows)
    narrow = docs.select(docs["doc_id"], docs["text"])
    judged = durable(with_posteriors(narrow, prior, weight).drop("text"))
    steps, _ = fit_steps(judged, targets or TARGETS)
    return with_rates(judged, steps)


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, rows: int = TRAIN_ROWS
) -> DataFrame:
    """``docs``, each row as often as its number of copies; defined as ``rates`` is."""
    prior, weight = learn(docs, labels, rows)
    own = docs.select(*[docs[c].alias(f"_d{i}") for i, c in enumerate(docs.columns)], docs["doc_id"], docs["text"])
    # the texts are judged once, and written beside their posteriors
    judged = durable(with_posteriors(own, prior, weight).drop("text"))
    steps, _ = fit_steps(judged.select("n_tokens", "posterior"), targets or TARGETS)
    drawn = with_rates(judged, steps).where("n_copies > 0")
    copies = drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    return copies.select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(docs.columns)])


def with_rates(judged: DataFrame, steps: list[list[float]]) -> DataFrame:
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mix")), F.lit(1 << 30))
    rated = judged.withColumn("rate", _rate(F.col("posterior"), steps))
    extra = (draw / float(1 << 30) < F.col("rate") - F.floor("rate")).cast("long")
    return rated.withColumn("n_copies", F.floor("rate") + extra)

