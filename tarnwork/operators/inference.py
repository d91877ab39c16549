"""Moderated paired inference, detection inference and their integration."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.columns import cascade, exact_binary_p, is_true
from tarnwork.functions.kernels import digamma, student_p, student_t, trigamma, trigamma_inverse
from tarnwork.operators.pairing import moments
from tarnwork.operators.ranking import benjamini_hochberg
from tarnwork.session import stage

#: fixed values of the prior: fewest variances, percentiles at which their logarithms are cut, least excess, most degrees of freedom
LEAST_VARIANCES, CUTS, LEAST_EXCESS, MOST_DF = 20, (0.05, 0.95), 1e-6, 1e6


def variance_priors(stats: DataFrame, scenario: list[str]) -> DataFrame:
    """(scenario, d0, s0): prior degrees of freedom and variance of each scenario, from the spread of its log variances.

    The log variances are cut to their 5th and 95th percentiles; their variance less the mean trigamma(df / 2), at least
    1e-6, gives d0 (at most 1e6) by the inverse trigamma; s0 follows from the mean of the uncut ones less their digamma
    term. Sums go to the driver by number of pairs (as many rows as there are pair counts). Fewer than 20 variances give no prior.
    """
    logs = stats.where((F.col("pairs") > 1) & (F.col("variance") > 0)).select(*scenario, "pairs", F.log("variance").alias("v"))
    edge = logs.groupBy(*scenario).agg(F.percentile("v", F.array(*map(F.lit, CUTS))).alias("e"))
    met = logs.join(edge, scenario) if scenario else logs.join(F.broadcast(edge))
    cut = F.least(F.greatest("v", F.get("e", F.lit(0))), F.get("e", F.lit(1)))
    sums = met.groupBy(*scenario, "pairs").agg(F.count(F.lit(1)).alias("k"), F.sum("v").alias("v"), F.sum(cut).alias("c"), F.sum(cut * cut).alias("cc")).collect()
    by: dict[tuple, list] = {}
    for r in sums:
        by.setdefault(tuple(r[s] for s in scenario), []).append(r)
    out = []
    for key, rows in by.items():
        k = sum(r.k for r in rows)
        if k < LEAST_VARIANCES:
            continue
        c, cc = sum(r.c for r in rows), sum(r.cc for r in rows)
        between = max((cc - c * c / k) / (k - 1) - sum(r.k * trigamma((r.pairs - 1) / 2) for r in rows) / k, LEAST_EXCESS)
        d0 = min(2 * float(trigamma_inverse(between)), MOST_DF)
        level = sum(r.v - r.k * (digamma((r.pairs - 1) / 2) - math.log((r.pairs - 1) / 2)) for r in rows) / k
        out.append((*key, d0, math.exp(level + digamma(d0 / 2) - math.log(d0 / 2))))
    schema = ", ".join([*[f"{s} {stats.schema[s].dataType.simpleString()}" for s in scenario], "d0 double", "s0 double"])
    return stats.sparkSession.createDataFrame(out, schema)


def paired_tests(stats: DataFrame, scenario: list[str]) -> DataFrame:
    """stats (moments with eligible, a row a scenario and feature) with moderated and ordinary standard error, t and p; p where eligible.

    The prior of a scenario comes from its eligible features; posterior variance (d0 s0 + df s2) / (d0 + df). Features without a
    variance have no t.
    """
    prior = variance_priors(stats.where("eligible"), scenario)
    met = stats.join(F.broadcast(prior), scenario, "left") if scenario else stats.join(F.broadcast(prior), F.lit(True), "left")
    df = F.col("pairs") - 1
    met = met.withColumn("posterior", F.try_divide(F.col("d0") * F.col("s0") + df * F.col("variance"), F.col("d0") + df))
    met = met.withColumn("se", F.sqrt(F.try_divide("posterior", "pairs"))).withColumn("moderated_t", F.try_divide("mean", "se")).withColumn("moderated_df", F.col("d0") + df)
    met = met.withColumn("ordinary_se", F.sqrt(F.try_divide("variance", "pairs"))).withColumn("ordinary_t", F.when(F.col("ordinary_se") > 0, F.try_divide("mean", "ordinary_se")))
    tested = F.col("eligible") & F.col("moderated_t").isNotNull()
    return met.withColumn("p", F.when(tested, student_p(F.col("moderated_t"), F.col("moderated_df")))).withColumn("ordinary_p", F.when(F.col("eligible"), student_p(F.col("ordinary_t"), df.cast("double"))))


def abundance_inference(pairs: DataFrame, least_pairs: int = 10, level: float = 0.95, scenario: tuple[str, ...] = ()) -> DataFrame:
    """Moderated and ordinary paired t for every scenario and feature; p, interval and q only from least_pairs pairs on.

    An empty table gives an empty result.
    """
    keys = list(scenario)
    stats = stage(moments(pairs, (*keys, "feature_key")), "inference-moments")
    met = paired_tests(stats.withColumn("eligible", is_true(F.col("pairs") >= least_pairs)), keys)
    half = student_t(level, F.col("moderated_df")) * F.col("se")
    met = met.withColumn("ci_low", F.when(F.col("p").isNotNull(), F.col("mean") - half)).withColumn("ci_high", F.when(F.col("p").isNotNull(), F.col("mean") + half))
    return benjamini_hochberg(met, "p", "q", keys)


def detection_inference(states: DataFrame) -> DataFrame:
    """Exact sign test of N-only against T-only entities per feature; q over the features with a discordant entity."""
    return benjamini_hochberg(states.withColumn("p", exact_binary_p("t_only", "n_only")), "p", "q", [])


def integrate_evidence(abundance: DataFrame, detection: DataFrame, q: float = 0.05, effect: float = 0.5) -> DataFrame:
    """Abundance and detection side by side, with tiers: A both and in one direction, B abundance, C detection, else none.

    Missing evidence stays NULL and supports nothing.
    """
    a = abundance.select("feature_key", "mean", F.col("q").alias("abundance_q"), "consistency")
    d = detection.select("feature_key", "fraction_difference", F.col("q").alias("detection_q"))
    met = a.join(d, "feature_key", "full_outer")
    strong = is_true((F.col("abundance_q") <= q) & (F.abs("mean") >= effect))
    seen = is_true(F.col("detection_q") <= q)
    same = is_true(F.signum("mean") == F.signum("fraction_difference"))
    return met.withColumn("tier", cascade([(strong & seen & same, "A"), (strong, "B"), (seen, "C")], "none"))
