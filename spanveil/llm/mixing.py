"""Mixing sources to target weights, with DataFrame functions only.

A naive Bayes classifier over hashed words, learned from a labelled table, predicts for each document the
posterior of every domain (soft membership).  Nonnegative document rates are then fitted by projected gradient
with momentum so that the expected tokens of each domain, sum of rate * tokens * posterior, match the
targets.  The fit starts from rates of 1 and isn't pulled back to them; each row's step is the reciprocal of its own bound on the curvature,
so that rare domains are met as soon as common ones.  It ends when every domain's total is within TOLERANCE of its target, or when no rate moves any
more: then no rates meet the targets, and a warning gives the totals reached.  A fit that does neither in LIMIT iterations is an error.

The gradient of a document's rate, divided by its tokens, depends on its posteriors alone.  So documents are first summed up by
their posteriors in steps of 1 / STEPS, and each iteration is one aggregation over those sums that returns one
number a domain to the driver.  The rates themselves are never stored between iterations: a row derives its own from the history of
these few numbers.

Domains are the keys of the targets, so the model has BUCKETS rows of one weight a domain: that bounds what is broadcast.
The classifier is learned from at most SAMPLE labelled rows, those with the least hash of doc_id; all else covers every row.

Defined results: null and empty texts have no tokens and the prior as posteriors; rows of equal doc_id (or a null one) are one document
whose tokens add up and whose rows share its rate; labelled rows of other domains are ignored; without labelled rows all domains are alike;
without any token all rates are 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, read_table

#: Shares of tokens by language that the registered query and the pipeline aim at.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
BUCKETS, SAMPLE, STEPS = 4096, 20_000, 1000
#: Smoothing of counts; how sharply the mean log likelihood of a word decides.
SMOOTH, SHARPNESS = 0.5, 12.0
#: The pull to a rate of 1, the most iterations, and the fall of the miss (as a share of all tokens) that ends them.
PULL, ITERATIONS, CLOSE = 0.0005, 40, 1e-5
#: Of the fit to a tolerance: the largest miss of a target, as a share of it; the least move of the rates that goes on; the most iterations.
TOLERANCE, STILL, LIMIT = 0.01, 1e-4, 400
SEED = 20_240_229

log = logging.getLogger(__name__)


def words_of(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \n\t\r]")).alias("word"))


def bucket_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def classifier(labelled: DataFrame, domains: list[str]) -> tuple[DataFrame, list[float]]:
    """From (domain, text): a table of (bucket, w0, w1, ...) with log likelihoods, and the log priors."""
    labelled = labelled.filter(F.col("domain").isin(domains))
    rows = dict(labelled.groupBy("domain").count().collect())
    priors = [math.log((rows.get(d, 0) + 1) / (sum(rows.values()) + len(domains))) for d in domains]
    counts = words_of(labelled, "domain").filter("word != ''").groupBy(bucket_of(F.col("word")).alias("bucket"))
    counts = cut(counts.agg(*[F.sum((F.col("domain") == d).cast("long")).alias(f"c{j}") for j, d in enumerate(domains)]), "counts")
    totals = counts.agg(*[F.coalesce(F.sum(f"c{j}"), F.lit(0)) for j in range(len(domains))]).first()
    all_buckets = labelled.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    weights = [F.log((F.coalesce(f"c{j}", F.lit(0)) + SMOOTH) / (n + SMOOTH * BUCKETS)).alias(f"w{j}") for j, n in enumerate(totals)]
    return cut(all_buckets.join(counts, "bucket", "left").select("bucket", *weights), "model"), priors


def posteriors(docs: DataFrame, model: DataFrame, priors: list[float]) -> DataFrame:
    """doc_id, n_tokens and q, the posteriors in steps of 1 / STEPS that add up to STEPS or nearly so."""
    k = len(priors)
    words = words_of(docs, "doc_id").withColumn("bucket", bucket_of(F.col("word")))
    real = F.col("word") != ""
    sums = words.join(F.broadcast(model), "bucket").groupBy("doc_id").agg(
        F.sum(real.cast("long")).alias("n_tokens"), *[F.sum(F.when(real, F.col(f"w{j}")).otherwise(0.0)).alias(f"s{j}") for j in range(k)]
    )
    logs = [F.lit(priors[j]) + SHARPNESS * F.col(f"s{j}") / F.greatest("n_tokens", F.lit(1)) for j in range(k)]
    sums = sums.select("doc_id", "n_tokens", *[x.alias(f"l{j}") for j, x in enumerate(logs)])
    top = F.greatest(*[F.col(f"l{j}") for j in range(k)]) if k > 1 else F.col("l0")
    parts = [F.exp(F.col(f"l{j}") - F.col("top")) for j in range(k)]
    sums = sums.withColumn("top", top)
    total = sum(parts[1:], parts[0])
    return sums.select("doc_id", "n_tokens", F.array(*[F.round(STEPS * x / total).cast("int") for x in parts]).alias("q"))


def _state(history: list[tuple[list[float], float]], p: list[Column], step: float | Column, pull: float = PULL) -> Column:
    """The rate r and the point y ahead of it, of a row with posteriors p, after the history's steps."""
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    if not history:
        return start
    past = F.array(*[F.struct(*[F.lit(float(x)).alias(f"e{j}") for j, x in enumerate(e)], F.lit(float(b)).alias("b")) for e, b in history])

    def on(s: Column, h: Column) -> Column:
        slope = sum((p[j] * h[f"e{j}"] for j in range(1, len(p))), p[0] * h["e0"]) + pull * (s["y"] - 1.0)
        r = F.greatest(F.lit(0.0), s["y"] - step * slope)
        return F.struct(r.alias("r"), (r + h["b"] * (r - s["r"])).alias("y"))

    return F.aggregate(past, start, on)


def _sums(table: DataFrame, k: int) -> DataFrame:
    """q, tokens and the shares p0, p1, ... of each distinct q."""
    all_q = sum((F.col("q")[j] for j in range(1, k)), F.col("q")[0])
    share = [(F.col("q")[j] / F.greatest(all_q, F.lit(1))).alias(f"p{j}") for j in range(k)]
    return cut(table.groupBy("q").agg(F.sum("n_tokens").alias("tokens")).select("q", "tokens", *share), "sums")


def fit_rates(table: DataFrame, targets: dict[str, float]) -> tuple[DataFrame, list[float]]:
    """q, rate of each distinct q of a table (n_tokens, q), and the expected tokens by domain at those rates: the nearest to the targets that a pull
    to 1 and at most ITERATIONS allow."""
    k, weight = len(targets), sum(targets.values())
    sums = _sums(table, k)
    p = [F.col(f"p{j}") for j in range(k)]
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    history: list[tuple[list[float], float]] = []
    momentum, before, expected, step = 1.0, math.inf, [0.0] * k, 1.0
    for _ in range(ITERATIONS if total else 0):
        row = sums.select("tokens", *p, _state(history, p, step).alias("s")).agg(
            *[F.sum(F.col("tokens") * F.col("s.y") * x) for x in p], *[F.sum(F.col("tokens") * F.col("s.r") * x) for x in p]
        ).first()
        expected = list(row[k:])
        if not history:  # at rates of 1 the largest domain's share bounds the curvature
            step = 1 / (max(row[:k]) / total + PULL)
        off = [row[j] / total - t / weight for j, t in enumerate(targets.values())]
        miss = sum(x * x for x in off)
        if miss > before:  # the momentum has carried it past
            momentum = 1.0
        elif before - miss < CLOSE * CLOSE:
            break
        before, after = miss, (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        history.append((off, (momentum - 1) / after))
        momentum = after
    return sums.select("q", _state(history, p, step)["r"].alias("rate")), expected


def meet_targets(table: DataFrame, targets: dict[str, float], tolerance: float = TOLERANCE) -> tuple[DataFrame, list[float]]:
    """As fit_rates, but without the pull, and until every target is met within the tolerance or no rates come nearer."""
    k, weight = len(targets), sum(targets.values())
    goal = [t / weight for t in targets.values()]
    sums = _sums(table, k)
    p = [F.col(f"p{j}") for j in range(k)]
    first = sums.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * x) for x in p]).first()
    total = first[0] or 0
    if not total:
        return sums.select("q", F.lit(1.0).alias("rate")), [0.0] * k
    # what a row's rate can do to the totals, with all other rows' rates moved alike
    bound = F.greatest(sum((p[j] * F.lit(first[1 + j] / total) for j in range(1, k)), p[0] * F.lit(first[1] / total)), F.lit(1e-12))
    history: list[tuple[list[float], float]] = []
    momentum, before, off = 1.0, math.inf, [0.0] * k
    for _ in range(LIMIT):
        ahead = sums.select("tokens", *p, bound.alias("bound"), _state(history, p, 1 / bound, 0.0).alias("s"))
        row = ahead.agg(*[F.sum(F.col("tokens") * F.col("s.y") * x) for x in p], *[F.sum(F.col("tokens") * F.col("s.r") * x) for x in p]).first()
        expected = list(row[k:])
        if all(abs(e / total - g) <= tolerance * g for e, g in zip(expected, goal, strict=True)):
            log.info("expected tokens %s for targets %s", dict(zip(targets, expected, strict=True)), {d: g * total for d, g in zip(targets, goal, strict=True)})
            break
        off = [x / total - g for x, g in zip(row[:k], goal, strict=True)]
        slope = sum((p[j] * F.lit(off[j]) for j in range(1, k)), p[0] * F.lit(off[0]))
        move = F.greatest(F.lit(0.0), F.col("s.y") - slope / F.col("bound")) - F.col("s.y")
        # asked at every fifth iteration only, since it takes an aggregation of its own
        if len(history) % 5 == 0 and math.sqrt(ahead.agg(F.sum(F.col("tokens") * F.col("bound") * move * move)).first()[0] / total) < STILL:
            log.warning("no rates meet the targets: expected tokens %s, targets %s", dict(zip(targets, expected, strict=True)), {d: g * total for d, g in zip(targets, goal, strict=True)})
            break
        miss = sum(x * x for x in off)
        if miss > before:  # the momentum has carried it past
            momentum = 1.0
        before, after = miss, (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        history.append((off, (momentum - 1) / after))
        momentum = after
    else:
        raise RuntimeError(f"rates not fitted in {LIMIT} iterations: expected tokens {expected}, targets {[g * total for g in goal]}")
    return sums.select("q", _state(history, p, 1 / bound, 0.0)["r"].alias("rate")), expected


def mixing_rates(docs: DataFrame, labelled_ids: DataFrame, targets: dict[str, float] = TARGETS, domain: str = "lang", most: int = SAMPLE) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), posterior (its), rate, and copies: the rate rounded up or down by a hash of doc_id
    so that the mean is the rate.  labelled_ids: doc_id of the documents whose column ``domain`` is a label to learn from."""
    domains = list(targets)
    ids = labelled_ids.select(F.col("doc_id").cast("long")).dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain).alias("domain"), "text").join(F.broadcast(ids), "doc_id")
    model, priors = classifier(labelled.select("domain", "text"), domains)
    table = cut(posteriors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, priors), "posteriors")
    rates, _ = meet_targets(table, targets)
    names = F.array(*[F.lit(d) for d in domains])
    best = F.array_max("q")
    likeliest = names[(F.array_position("q", best) - 1).cast("int")]
    luck = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    rows = table.join(cut(rates, "rates"), "q")
    return rows.select("doc_id", "n_tokens", likeliest.alias("domain"), (best / F.lit(float(STEPS))).alias("posterior"), "rate", F.floor(F.col("rate") + luck).alias("copies"))


def mixed(docs: DataFrame, labelled_ids: DataFrame, targets: dict[str, float] = TARGETS, domain: str = "lang") -> DataFrame:
    """Each row of docs as often as its copies say, with all columns of docs."""
    own_id, n, copy = (free_name(docs, c) for c in ("_id", "_copies", "_copy"))
    copies = mixing_rates(docs, labelled_ids, targets, domain).filter("copies > 0").select(F.col("doc_id").alias(own_id), F.col("copies").alias(n))
    rows = docs.join(cut(copies, "copies"), docs["doc_id"].cast("long").eqNullSafe(F.col(own_id)))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
