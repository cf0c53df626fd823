"""Mixing to target weights by soft membership, with DataFrame functions only.

A classifier learned from a labelled table gives every document posteriors over the
domains; nonnegative rates per document are then fitted so that the expected tokens
of each domain (rate x tokens x posterior, summed) meet the targets.

Classifier: naive Bayes over binned shares of a document (capitals, signs, repeated
words) and, for each domain, the share of words from a lexicon that is learned from
the labelled texts (``size`` words a domain).  The labelled texts may be a bounded sample
(``sample_docs``, drawn by a hash of the id).

Fit: least squares over the rates, to the end; of all rates that come equally near the
targets, those nearest to 1.  A document's gradient depends on its posteriors alone,
and the posteriors on its bins, so documents with equal bins share a rate: the Newton
rounds run over the table of bins (at most ``BINS ** features`` rows, summed over all
documents by Spark), and every round's sums are one aggregation to a few numbers.

Defined results: a null text is empty and has 0 tokens; domains without a target have
target 0; without labelled rows all posteriors are equal; targets that cannot be met
are met as nearly as rates of 0 or more allow; equal texts get equal posteriors and
rates, and repeated rows are answered one by one; texts without words count for no
domain and keep rate 1; an empty table gives an empty result; columns of the input are
kept under any name, and a new column whose name is taken raises ``ValueError``.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BINS = 8
#: Shares below the first value are in bin 0, those from the second on in the last bin; between them bins are even on a log scale.
LEAST, MOST = 0.0005, 0.5
#: More combinations of bins than this are joined without a broadcast; three domains have 8 ** 6 at most.
BROADCAST_CELLS = 8**6
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = "!#$%&*|<>{}[]=+~^@_\\/"
#: What stands between words: white space and ASCII punctuation.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _bin(share: Column) -> Column:
    return F.coalesce(F.width_bucket(F.log2(share), F.lit(log(LEAST, 2)), F.lit(log(MOST, 2)), F.lit(BINS - 2)), F.lit(0)).cast("int")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def _left(text: Column, without: str) -> Column:
    return F.length(F.translate(text, without, ""))


def shapes(df: DataFrame, text_col: str, lexicons: list[list[str]], words_of: str, bins: list[str]) -> DataFrame:
    """Adds ``words_of`` (the number of words) and one column of ``bins`` for each share."""
    t, w, d = (common.free_name(df, f"__{x}") for x in ("t", "w", "d"))
    df = df.withColumn(t, F.coalesce(common.col(text_col), F.lit(""))).withColumn(w, _words(F.col(t)))
    df = df.withColumn(words_of, F.size(w).cast("long")).withColumn(d, F.array_distinct(w))
    long, kinds = F.greatest(F.length(t), F.lit(1)), F.greatest(F.size(d), F.lit(1))
    shares = [
        1 - _left(F.col(t), CAPITALS) / long,
        1 - _left(F.col(t), SIGNS) / long,
        1 - F.size(d) / F.greatest(F.col(words_of), F.lit(1)),
        *[F.size(F.array_intersect(d, F.array(*map(F.lit, lexicon)))) / kinds if lexicon else F.lit(0.0) for lexicon in lexicons],
    ]
    return df.withColumns({b: _bin(s) for b, s in zip(bins, shares)}).drop(t, w, d)


def feature_count(domains: int) -> int:
    return 3 + domains


def learn_lexicons(labelled: DataFrame, domains: list[str], size: int = 100, least: float = 0.01) -> list[list[str]]:
    """For each domain the words most above their share of the other domains' documents, of those in ``least`` of its documents; ``size`` words a domain reach the driver."""
    words = labelled.select("domain", F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("w"))
    sums = words.groupBy("w").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(domains)])
    totals = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()}
    ranked = []
    for k, d in enumerate(domains):
        here = F.col(f"n{k}")
        there = sum((F.col(f"n{j}") for j in range(len(domains)) if j != k), F.lit(0))
        n_here, n_there = totals.get(d, 0), sum(v for x, v in totals.items() if x != d)
        odds = F.log((here + 0.5) / (n_here + 1.0)) - F.log((there + 0.5) / (n_there + 1.0))
        ranked.append(F.when((here >= max(2, least * n_here)) & (odds > 0.7), odds * F.sqrt(here)).alias(f"o{k}"))
    kept = common.stage(sums.select("w", *ranked).where(F.greatest(*[F.col(f"o{k}") for k in range(len(domains))], F.lit(0.0)) > 0), "mixing-words")
    return [sorted(r["w"] for r in kept.where(F.col(f"o{k}").isNotNull()).orderBy(F.desc(f"o{k}"), "w").limit(size).collect()) for k in range(len(domains))]


def learn(labelled: DataFrame, domains: list[str], sample_docs: int = 12_000, id_col: str = "doc_id") -> tuple[list[list[str]], list[list[list[float]]], list[float]]:
    """(lexicons, log P(bin | domain) by feature, log priors) from rows (id, text, domain)."""
    n = labelled.count()
    drawn = common.stage(labelled.where(common.hash_below(F.col(id_col), min(1.0, sample_docs / max(n, 1)), seed=19)), "mixing-sample")
    # the lexicons and the bins' counts are learned from different halves, so that the bins see unseen texts
    half = F.pmod(F.xxhash64(F.lit(23), F.col(id_col)), F.lit(2)) == 0
    lexicons = learn_lexicons(drawn.where(half), domains)
    bins = [f"b{k}" for k in range(feature_count(len(domains)))]
    seen = shapes(drawn.where(~half), "text", lexicons, "n", bins)
    long = seen.select("domain", F.posexplode(F.array(*bins)).alias("f", "b")).groupBy("domain", "f", "b").agg(F.count("*").alias("n"))
    got = {(r["domain"], r["f"], r["b"]): r["n"] for r in long.collect()}  # domains x features x BINS numbers at most
    of = {d: sum(got.get((d, 0, b), 0) for b in range(BINS)) for d in domains}
    total = sum(of.values())
    table = [[[log((got.get((d, f, b), 0) + 0.5) / (of[d] + 0.5 * BINS)) for b in range(BINS)] for d in domains] for f in range(len(bins))]
    return lexicons, table, [log((of[d] + 1.0) / (total + len(domains))) for d in domains]


def posteriors(bins: list[str], table: list, priors: list[float]) -> list[Column]:
    """P(domain | bins) for each domain."""
    logs = []
    for d, prior in enumerate(priors):
        z = F.lit(prior)
        for f, b in enumerate(bins):
            z = z + F.element_at(F.array(*[F.lit(x) for x in table[f][d]]), F.col(b) + 1)
        logs.append(z)
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    parts = [F.exp(z - top) for z in logs]
    return [p / sum(parts[1:], parts[0]) for p in parts]


def rate_of(p: list[Column], push: list[float]) -> Column:
    """A document's rate under the fit's ``push`` on every domain: the nonnegative rate nearest to 1 plus its posteriors' pushes."""
    return F.greatest(F.lit(0.0), sum((q * F.lit(float(v)) for q, v in zip(p, push)), F.lit(1.0)))


def fit_rates(cells: DataFrame, domains: list[str], targets: Mapping[str, float], total: float, rounds: int = 400, close: float = 1e-5) -> list[float]:
    """One number a domain, for `rate_of`: the least-squares rates of 0 or more, of all these those nearest to 1.  ``cells``: columns tokens and p0, p1, ... .

    Minimises the squared gap to the targets plus ``eps`` times the squared distance of the
    rates from 1 (by tokens), for falling ``eps``; the optimum is `rate_of` at gap / eps with
    the sign turned, found by Newton steps.  A step needs the domains' totals and the
    domains x domains sums over the rows with a rate, one aggregation.  Ends when no gap is
    over ``close``, or when the duality gap shows that the squared gap is within a
    thousandth of the least possible.  Where ``rounds`` are too few for that, or ``eps`` falls
    below what doubles can tell apart, the point with the smallest gap that was seen is
    taken, and its gap is logged as a warning.
    """
    size = len(domains)
    weight = sum(targets.get(d, 0.0) for d in domains)
    want = np.array([targets.get(d, 0.0) / weight for d in domains] if weight > 0 else [0.0] * size)
    if not total:
        return []
    counted = cells.where("tokens > 0")
    p = [F.col(f"p{k}") for k in range(size)]
    share = F.col("tokens") / F.lit(float(total))
    # decimals, so that the order of the rows changes nothing
    exact = lambda x: F.sum(x.cast("decimal(38,16)")).cast("double")
    done, best = 0, (float("inf"), np.zeros(size))

    def at(push: np.ndarray, eps: float):
        """Objective, its gradient and curvature, the totals, and the greatest push on a row."""
        nonlocal done, best
        done += 1
        x = rate_of(p, push)
        on = F.when(x > 0, share).otherwise(0.0)
        pairs = [(i, j) for i in range(size) for j in range(i + 1)]
        r = counted.agg(
            exact(share * x * x).alias("s"),
            F.max(sum((q * F.lit(float(v)) for q, v in zip(p, push)), F.lit(0.0))).alias("most"),
            *[exact(share * x * q).alias(f"t{k}") for k, q in enumerate(p)],
            *[exact(on * p[i] * p[j]).alias(f"h{i}_{j}") for i, j in pairs],
        ).first()
        totals, curve = np.array([r[f"t{k}"] for k in range(size)]), eps * np.eye(size)
        for i, j in pairs:
            curve[i, j] += r[f"h{i}_{j}"]
            curve[j, i] = curve[i, j]
        best = min(best, (float(np.abs(totals - want).max()), push), key=lambda b: b[0])
        return eps / 2 * push @ push + r["s"] / 2 - want @ push, eps * push + totals - want, curve, totals, r["most"]

    push, eps = np.zeros(size), 1e-2
    while done < rounds and eps > 1e-16:
        value, slope, curve, totals, most = at(push, eps)
        while np.abs(slope).max() > 1e-12 and done < rounds:
            move, step = -np.linalg.lstsq(curve, slope, rcond=None)[0], 1.0
            while True:
                new = at(push + step * move, eps)
                if new[0] <= value + 1e-4 * step * (slope @ move) or np.abs(new[1]).max() <= np.abs(slope).max() / 2:
                    break
                step /= 2
                if step < 1e-6 or done >= rounds:
                    break
            if step < 1e-6 or not np.isfinite(new[0]):  # as near as doubles allow
                break
            push = push + step * move
            value, slope, curve, totals, most = new
        gap = totals - want
        if np.abs(gap).max() <= close:
            return [float(v) for v in push]
        # the tokens of the best rates are no more than the targets' and the gap's; no row has a steeper way down than eps * most
        mass = want.sum() + size**0.5 * np.linalg.norm(gap)
        if gap @ totals + mass * eps * max(0.0, most) <= 1e-3 * (gap @ gap):
            return [float(v) for v in push]
        eps /= 10
    logging.getLogger(__name__).warning("rates after %d rounds: the largest gap to a target share is %.3g", done, best[0])
    return [float(v) for v in best[1]]


def mix(df: DataFrame, labelled: DataFrame, targets: Mapping[str, float], text_col: str = "text", budget: float | None = None, new: tuple[str, str, str] = ("n_tokens", "membership", "rate"), keep_text: bool = True) -> DataFrame:
    """Adds tokens, posteriors (in the order of the sorted domains) and rate, under the names ``new``, to all rows.

    ``labelled``: doc_id, text, domain.  ``budget``: tokens wanted in all (default: those there are).
    Texts are cut into words once: bins and token counts are written to the shared folder
    with the rows (without the text, if ``keep_text`` is false).
    """
    common.refuse(df, new)
    domains = sorted(targets)
    lexicons, table, priors = learn(labelled, domains)
    bins = [common.free_name(df, f"__b{k}") for k in range(feature_count(len(domains)))]
    seen = shapes(df, text_col, lexicons, new[0], bins)
    seen = common.stage(seen if keep_text else seen.drop(text_col), "mixing-seen")
    p = [f"p{k}" for k in range(len(domains))]
    # one row for each combination of bins; all documents are in its sums
    cells = seen.groupBy(*bins).agg(F.sum(f"`{new[0]}`").alias("tokens"))
    cells = common.stage(cells.select("*", *[x.alias(n) for n, x in zip(p, posteriors(bins, table, priors))]), "mixing-cells")
    size = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    push = fit_rates(cells, domains, targets, float(budget if budget is not None else size["t"]))
    rated = cells.withColumn("x", F.when(F.col("tokens") > 0, rate_of([F.col(x) for x in p], push)).otherwise(1.0))
    rated = rated.select(*bins, F.array(*p).alias(new[1]), F.col("x").alias(new[2]))
    if size["n"] <= BROADCAST_CELLS:
        rated = F.broadcast(rated)
    return seen.join(rated, bins).select(*[common.col(c) for c in seen.columns if c not in bins], *[common.col(c) for c in new[1:]])


def copies(rate: Column, doc_id: Column, seed: int = 5) -> Column:
    """Whole copies of a document: its rate rounded down or up, up with the chance of the remainder (by a hash of the id)."""
    chance = F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1_000_000)) / 1e6
    return F.floor(rate + chance).cast("int")


#: Domains of the labels table and the shares of tokens wanted of them.
TARGETS = {"clean": 0.97, "poor": 0.02, "toxic": 0.01}


def labelled_documents(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, domain) of the labelled rows of ``docs`` (default: all documents)."""
    labels = common.table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() | F.col("toxic").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("clean")
    docs = common.table(spark, sf_dir, "documents") if docs is None else docs
    return docs.select("doc_id", "text").join(labels, "doc_id").select("doc_id", "text", domain.alias("domain"))


def op7_mixing(spark, sf_dir: str, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = mix(docs, labelled_documents(spark, sf_dir), targets, keep_text=False)
    out = [F.round(F.col("membership")[k], 9).alias(f"p_{d}") for k, d in enumerate(sorted(targets))]
    return done.select("doc_id", "n_tokens", *out, F.round("rate", 9).alias("rate"), copies(F.col("rate"), F.col("doc_id")).alias("copies"))
