"""Mixing by soft membership: documents' domain posteriors, and nonnegative rates whose expected domain token totals meet targets.

A naive Bayes classifier learned from a labelled table gives each document a posterior over domains, from binned statistics: how many of each domain's
telling words it has, its shares of odd symbols, capitals and distinct words, its length. The bins make at most CELLS cells, and posterior and
rate depend on the cell alone, so the cells' token totals (one distributed sum) stand for all documents in what follows.

Rates r >= 0 minimise sum_k ((S_k - T_k) / N)^2 + LAMBDA sum_d n_d/N (r_d - 1)^2 with S_k = sum_d n_d p_dk r_d, the expected tokens of domain k. At the minimum
r_d = max(0, 1 - p_d g / LAMBDA), g being the gradient (S - T) / N: so K numbers tell all rates, and Newton's steps find them, each with one distributed sum over the cells.
LAMBDA is a tie-breaker: where posteriors allow it the targets are met; else the least squares remain. A document is taken floor(rate) times, and once more with the fractional part as probability (by
a hash of its id).

DataFrame operations only. Telling words are learned from a bounded sample: at most SAMPLE labelled documents, those with the least hash of the id. All else
covers all documents. What is broadcast are the sample's ids and the cells, both bounded.

Edge cases: null texts are empty and have no tokens; they get a posterior and a rate like any other. Labels of unknown or null domain teach nothing;
without labels posteriors are uniform. A doc_id labelled twice counts twice. Repeated rows share posterior, rate and copies. A null doc_id has a hash like others.
An empty table gives an empty result. Other columns pass through ``mixed`` untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, named, stage

SAMPLE = 20_000
TELLING = 32
STEPS = 60
#: Weight of what keeps rates near one: only a choice among the rates that meet the targets.
LAMBDA = 1e-5
#: Shares of all tokens to which a step's gradient has to be that of its rates.
TOLERANCE = 1e-7
#: Bins of each statistic.
HITS, SYMBOLS, CAPITALS, DISTINCT, LENGTH = 4, 5, 4, 4, 4
ODD = "*#$%&@~^+=<>\\/|!_{}[]"
#: Shares of all tokens that the domains shall have.
TARGETS = {"clean": 0.96, "low": 0.02, "toxic": 0.02}


def labelled_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain from a table of quality and toxic marks."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null and doc_id is not null")


def bag(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")


def telling_words(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE) -> dict[str, list[str]]:
    """Of each domain at most TELLING words that mark it out."""
    some = labelled.orderBy(F.xxhash64("doc_id"), "domain").limit(sample)
    words = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("domain", F.explode(F.array_distinct(bag(F.col("text")))).alias("word")).where("word != ''")
    sizes = {r["domain"]: r["count"] for r in some.groupBy("domain").count().collect()}
    n = sum(sizes.values())
    counts = stage(words.groupBy("word").agg(*(F.count_if(F.col("domain") == d).alias(f"c{i}") for i, d in enumerate(domains))).where(" + ".join(f"c{i}" for i in range(len(domains))) + " >= 3"), "telling")
    out = {}
    for i, d in enumerate(domains):
        own, rest = sizes.get(d, 0), n - sizes.get(d, 0)
        others = sum((F.col(f"c{j}") for j in range(len(domains)) if j != i), F.lit(0))
        odds = F.log((F.col(f"c{i}") + 0.5) / (own + 1.0)) - F.log((others + 0.5) / (rest + 1.0))
        # common enough among the domain's own documents to tell much
        weight = odds * F.sqrt(F.col(f"c{i}"))
        found = counts.where((F.col(f"c{i}") >= max(3, own // 100)) & (odds > 1.5)).orderBy(weight.desc(), "word").limit(TELLING) if own and rest else None
        out[d] = [r["word"] for r in found.select("word").collect()] if found is not None else []
    discard(counts)
    return out


def statistics(words: dict[str, list[str]], docs: DataFrame) -> DataFrame:
    """docs with n_tokens and the binned statistics f0, f1, ..."""
    every = sorted({w for ws in words.values() for w in ws})
    lit = lambda ws: F.array(*map(F.lit, ws)).cast("array<string>")
    text = F.coalesce(F.col("text"), F.lit(""))
    with_bag = docs.withColumns({"_bag": F.filter(bag(F.col("text")), lambda w: w != ""), "_chars": F.length(text), "_odd": F.length(F.translate(text, ODD, "")), "_low": F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))})
    counted = with_bag.withColumns({"n_tokens": F.size("_bag").cast("long"), "_kinds": F.size(F.array_distinct("_bag")), "_hits": F.array_intersect("_bag", lit(every))})
    share = lambda x: x / F.greatest(F.col("_chars"), F.lit(1))
    cut = lambda x, *at: sum(((x >= a).cast("int") for a in at), F.lit(0))
    stats = {f"f{i}": F.least(F.size(F.array_intersect("_hits", lit(ws))), F.lit(HITS - 1)) for i, ws in enumerate(words.values())}
    n = len(stats)
    stats |= {
        f"f{n}": cut(share(F.col("_chars") - F.col("_odd")), 0.005, 0.02, 0.06, 0.12),
        f"f{n + 1}": cut(share(F.col("_chars") - F.col("_low")), 0.06, 0.15, 0.4),
        f"f{n + 2}": cut(F.col("_kinds") / F.greatest(F.col("n_tokens"), F.lit(1)), 0.3, 0.5, 0.7),
        f"f{n + 3}": cut(F.col("n_tokens"), 20, 150, 1000),
    }
    return counted.withColumns(stats).drop("_bag", "_chars", "_odd", "_low", "_kinds", "_hits")


def _bins(domains: int) -> list[int]:
    return [HITS] * domains + [SYMBOLS, CAPITALS, DISTINCT, LENGTH]


def posteriors(stats: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """A row for each cell: its statistics, n (tokens), p0, p1, ... of the domains. Staged in one file, as it has at most the product of _bins rows."""
    names = [f"f{i}" for i in range(len(domains) + 4)]
    cells = stats.groupBy(*names).agg(F.sum("n_tokens").alias("n"))
    known = stats.join(labelled, "doc_id").groupBy(*names).agg(*(F.count_if(F.col("domain") == d).alias(f"l{k}") for k, d in enumerate(domains)))
    both = stage(cells.join(known, names, "left").fillna(0), "cells")
    totals = both.agg(*(F.coalesce(F.sum(f"l{k}"), F.lit(0)) for k in range(len(domains)))).first()
    all_ = sum(totals)
    logs = {}
    for k in range(len(domains)):
        score = F.lit(0.0) + F.log(F.lit((totals[k] + 0.5) / (all_ + 0.5 * len(domains))))
        for f, bins in zip(names, _bins(len(domains))):
            score = score + F.log((F.sum(f"l{k}").over(W.partitionBy(f)) + 0.5) / (totals[k] + 0.5 * bins))
        logs[f"s{k}"] = score
    scored = both.withColumns(logs)
    top = F.greatest(*logs) if len(logs) > 1 else F.col("s0")
    raised = scored.withColumns({f"e{k}": F.exp(F.col(f"s{k}") - top) for k in range(len(domains))})
    out = stage(raised.select(*names, "n", *((F.col(f"e{k}") / sum(F.col(f"e{j}") for j in range(len(domains)))).alias(f"p{k}") for k in range(len(domains)))).coalesce(1), "posteriors")
    discard(both)
    return out


def rate(gradients: list[list[float]], k: int, lam: float = LAMBDA) -> Column:
    """The projection of a full gradient step from a rate of one, for posteriors p0..p(k-1): max(0, 1 - p g / lam) of the last g. At the minimum that is the rate itself."""
    if not gradients:
        return F.lit(1.0)
    return F.greatest(F.lit(0.0), 1.0 - sum((F.col(f"p{i}") * F.lit(float(x) / lam) for i, x in enumerate(gradients[-1])), F.lit(0.0)))


def fit_rates(cells: DataFrame, targets: list[float], steps: int = STEPS, lam: float = LAMBDA) -> list[list[float]]:
    """Gradients g of all steps, until each is that of the rates it gives, to TOLERANCE. targets: shares of all tokens, one a domain.

    Newton's steps on the dual |g|^2 / 2 + g T + lam / 2 sum_d n_d/N r_d^2, which is convex in the K numbers of g; a step that doesn't lower it enough is halved.
    """
    k = len(targets)
    total = cells.agg(F.sum("n")).collect()[0][0] or 0
    if not total:
        return []
    t = np.array(targets)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def at(g):
        """The dual's value, gradient and curvature, from one distributed sum."""
        r, p = F.col("r"), [F.col(f"p{i}") for i in range(k)]
        sums = [F.sum(F.col("n") * r * r), *(F.sum(F.col("n") * x * r) for x in p), *(F.sum(F.when(r > 0, F.col("n") * p[i] * p[j]).otherwise(0.0)) for i, j in pairs)]
        got = np.array(cells.select("n", *(f"p{i}" for i in range(k)), rate([g.tolist()], k, lam).alias("r")).agg(*sums).first(), dtype=float) / total
        curve = np.eye(k)
        for (i, j), x in zip(pairs, got[1 + k :]):
            curve[i, j] += x / lam
            curve[j, i] = curve[i, j]
        return g @ g / 2 + g @ t + lam / 2 * got[0], g + t - got[1 : 1 + k], curve

    g = np.zeros(k)
    out = [g.tolist()]
    value, slope, curve = at(g)
    for _ in range(steps):
        if abs(slope).max() < TOLERANCE:
            break
        move, size = -np.linalg.solve(curve, slope), 1.0
        while True:
            new = at(g + size * move)
            if new[0] <= value + 1e-4 * size * (slope @ move) + 1e-15 or size < 1e-6:
                break
            size /= 2
        g = g + size * move
        value, slope, curve = new
        out.append(g.tolist())
    else:
        if abs(slope).max() >= TOLERANCE:
            raise RuntimeError("rates did not settle")
    return out


def _fitted(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> tuple[dict[str, list[str]], DataFrame, DataFrame]:
    """Telling words, the statistics of docs (staged), and the cells with posteriors and rates."""
    domains = sorted(targets)
    words = telling_words(docs, labelled, domains)
    stats = stage(statistics(words, docs.select("doc_id", "text")).drop("text"), "mix-statistics")
    cells = posteriors(stats, labelled, domains)
    gradients = fit_rates(cells, [targets[d] for d in domains])
    rated = cells.withColumn("rate", rate(gradients, len(domains))).withColumnsRenamed({f"p{i}": f"p_{d}" for i, d in enumerate(domains)}).drop("n")
    return words, stats, rated


def _copies() -> Column:
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) / float(1 << 20)
    return (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int")


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, copies of every document."""
    words, stats, rated = _fitted(docs, labelled, targets)
    names = [f"f{i}" for i in range(len(targets) + 4)]
    joined = stats.join(F.broadcast(rated), names)  # at most the product of _bins rows
    return joined.select("doc_id", "n_tokens", *(f"p_{d}" for d in sorted(targets)), "rate", _copies().alias("copies"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """docs, each row as many times as the mix takes it."""
    words, stats, rated = _fitted(docs, labelled, targets)
    names = [f"f{i}" for i in range(len(targets) + 4)]
    # the statistics are computed anew here, so that texts needn't be shuffled to meet them
    whole = statistics(words, docs.select("doc_id", "text", F.struct(*map(named, docs.columns)).alias("_row"))).join(F.broadcast(rated.select(*names, "rate")), names)
    taken = whole.select("_row", _copies().alias("_n")).where("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"))
    return taken.select("_row.*")
