"""Sample profiles, robust scores, flags and pair concordance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.columns import average_rank, clip, is_true
from tarnwork.operators.joins import join_null_safe
from tarnwork.session import stage

MAD_SCALE = 1.4826


def robust_z(df: DataFrame, values: dict[str, str], strata: list[str]) -> DataFrame:
    """df with (value - median) / (1.4826 MAD) within the strata for each value, named as values says; 0 where the MAD is 0, NULL for NULL.

    Exact medians by aggregation, all values at once; df is read three times, so it should be a staged or cheap table.
    """

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return join_null_safe(left, right, strata) if strata else left.join(F.broadcast(right))

    near = met(df, df.groupBy(*strata).agg(*[F.median(v).alias(f"_m_{v}") for v in values]))
    near = met(near, near.groupBy(*strata).agg(*[F.median(F.abs(F.col(v) - F.col(f"_m_{v}"))).alias(f"_d_{v}") for v in values]))
    z = lambda v: F.when(F.col(f"_d_{v}") > 0, (F.col(v) - F.col(f"_m_{v}")) / (F.lit(MAD_SCALE) * F.col(f"_d_{v}"))).otherwise(F.lit(0.0))
    return near.select(*df.columns, *[F.when(F.col(v).isNotNull(), z(v)).alias(out) for v, out in values.items()])


def sample_profiles(cells: DataFrame, features: DataFrame) -> DataFrame:
    """Per sample: observed features and their share of all, quantiles, IQR, MAD and the share outside median +- 5 MAD (0 if MAD is 0)."""
    q = cells.groupBy("sample_id", "entity", "cond").agg(F.count("y").alias("observed"), F.percentile("y", F.array(*[F.lit(x) for x in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)])).alias("q"))
    names = ("p01", "p05", "p25", "median", "p75", "p95", "p99")
    q = q.select("sample_id", "entity", "cond", "observed", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)]).withColumn("iqr", F.col("p75") - F.col("p25"))
    q = stage(q, "qc-quantiles")
    away = F.abs(F.col("y") - F.col("median"))
    met = cells.select("sample_id", "y").join(q.select("sample_id", "median"), "sample_id")
    mad = met.groupBy("sample_id").agg(F.median(away).alias("mad"))
    outside = met.join(mad, "sample_id").groupBy("sample_id").agg(F.avg(F.when((F.col("mad") > 0) & (away > 5 * F.col("mad")), 1.0).otherwise(0.0)).alias("outside"))
    return q.join(mad, "sample_id").join(outside, "sample_id").join(F.broadcast(features)).withColumn("observed_fraction", F.col("observed") / F.col("features"))


def pair_concordance(pairs: DataFrame) -> DataFrame:
    """Per entity with both samples: Jaccard index of detection, median |delta|, and Spearman's rho over the features observed in both."""
    sets = pairs.groupBy("entity").agg(F.count_if(F.col("state") == 3).alias("both"), F.count_if(F.col("state") > 0).alias("either"), F.median(F.abs("delta")).alias("median_change"))
    ranks = pairs.where("state = 3").select("entity", average_rank("n", ["entity"]).alias("rn"), average_rank("t", ["entity"]).alias("rt"))
    rho = ranks.groupBy("entity").agg(F.corr("rn", "rt").alias("rho"))
    return sets.join(rho, "entity", "left").withColumn("jaccard", F.try_divide("both", "either"))


def flag_samples(profiles: DataFrame, concordance: DataFrame, limit: float = 3.5, families: int = 2) -> DataFrame:
    """Samples with `families` or more of the flags coverage, level, spread, tails (robust z within the condition) and concordance
    (low rho among all pairs); pair_flagged if either sample of the entity is."""
    profiles = stage(profiles, "qc-profiles")
    z = robust_z(profiles, {"observed_fraction": "z_coverage", "median": "z_level", "iqr": "z_spread", "outside": "z_tails"}, ["cond"])
    low = robust_z(stage(concordance.where("rho is not null").select("entity", "rho"), "qc-rho"), {"rho": "z_rho"}, [])
    z = z.join(low.select("entity", "z_rho"), "entity", "left")
    flags = [is_true(F.abs(c) > limit).cast("int") for c in ("z_coverage", "z_level", "z_spread", "z_tails")] + [is_true(F.col("z_rho") < -limit).cast("int")]
    z = z.withColumn("flags", sum(flags[1:], flags[0])).withColumn("flagged", F.col("flags") >= families)
    z = stage(z, "qc-flags")
    pair = z.groupBy("entity").agg(F.bool_or("flagged").alias("pair_flagged"))
    return z.join(pair, "entity").select("sample_id", "entity", "cond", "flags", "flagged", "pair_flagged")


def robust_distance(df: DataFrame, key: str, columns: list[str], steps: int = 10, support: float = 0.75, limit: float = 8.0) -> DataFrame:
    """(key, distance): Mahalanobis distance from the centre of the `support` share of rows that lie closest together.

    Columns become robust z, cut at limit, NULL counting as 0. Concentration steps start from the rows nearest the medians:
    mean and covariance of the supported rows (sums of products, one aggregate row a step), distances to these, and the
    rows within their quantile are the next support, until it stays. A ridge of 1e-6 keeps the covariance invertible.
    Deterministic, and no step gathers rows; an empty table gives an empty result.
    """
    z = [f"_z{i}" for i in range(len(columns))]
    rows = stage(df.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(c) for c in columns]), "distance-rows")
    rows = robust_z(rows, dict(zip(columns, z)), [])
    rows = stage(rows.select("_key", *[F.coalesce(clip(F.col(c), -limit, limit), F.lit(0.0)).alias(c) for c in z]), "distance-rows")
    distance = F.sqrt(sum((F.col(c) * F.col(c) for c in z[1:]), F.col(z[0]) * F.col(z[0])))
    last = None
    for _ in range(steps):
        cut = rows.agg(F.percentile(distance, support).alias("cut")).first().cut
        if cut is None:
            break
        inside = rows.where(distance <= F.lit(cut))
        pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
        s = inside.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in z], *[F.covar_pop(z[i], z[j]).alias(f"_c{i}_{j}") for i, j in pairs]).first()
        centre = np.array([s[c] for c in z])
        shape = np.zeros((len(z), len(z)))
        for i, j in pairs:
            shape[i, j] = shape[j, i] = s[f"_c{i}_{j}"]
        inverse = np.linalg.pinv(shape + 1e-6 * np.eye(len(z)))
        if last is not None and np.allclose(centre, last, atol=1e-9):
            break
        last = centre
        terms = [F.lit(float(inverse[i, j])) * (F.col(z[i]) - F.lit(float(centre[i]))) * (F.col(z[j]) - F.lit(float(centre[j]))) for i in range(len(z)) for j in range(len(z))]
        distance = F.sqrt(F.greatest(sum(terms[1:], terms[0]), F.lit(0.0)))
    return rows.select(F.col("_key").alias(key), distance.alias("distance"))
