"""Pareto fronts, groups of redundant features, representatives, and sample sizes."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwork.operators.joins import join_weighted
from tarnwork.session import stage, unstage

MAX_CANDIDATES = 20_000


def pareto_fronts(df: DataFrame, key: str, objectives: list[str], by: list[str], most: int = MAX_CANDIDATES) -> DataFrame:
    """df with front: 1 for rows that no other row of the group beats (at least as good everywhere, better somewhere), then again without them.

    Objectives are maximised; NULL and NaN count as minus infinity; equal rows share a front. Before any comparison rows fall to
    distinct objective tuples; a group may have at most `most` of these (else ValueError), which are peeled in one task.
    """
    low = F.lit(float("-inf"))
    rows = df.select("*", *[F.coalesce(F.when(~F.isnan(F.col(o).cast("double")), F.col(o).cast("double")), low).alias(f"_o{i}") for i, o in enumerate(objectives)])
    cols = [f"_o{i}" for i in range(len(objectives))]
    points = rows.select(*by, *cols).distinct()
    if (points.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) > most:
        raise ValueError("too many distinct candidates in a group")

    def peel(f: pd.DataFrame) -> pd.DataFrame:
        x = f[cols].to_numpy(float)
        order = np.lexsort(x.T[::-1])[::-1]
        front, n = np.zeros(len(x), int), 0
        left = list(order)
        while left:
            n += 1
            kept: list[int] = []
            for i in left:  # in falling lexicographic order only earlier rows can beat a later one
                if not kept or not np.any(np.all(x[kept] >= x[i], axis=1)):
                    kept.append(i)
            front[kept] = n
            gone = set(kept)
            left = [i for i in left if i not in gone]
        return f.assign(front=front)

    schema = ", ".join([*[f"{b} {df.schema[b].dataType.simpleString()}" for b in by], *[f"{c} double" for c in cols], "front int"])
    fronts = points.groupBy(*by).applyInPandas(peel, schema)
    return rows.join(fronts, [*by, *cols]).select(*df.columns, "front")


def label_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(vertex, component): least vertex of the group, by hash-to-min with pointer doubling on staged tables. For graphs of modest size
    and diameter; NULL ends and loops are left out."""
    e = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v))).select(F.col(u).alias("a"), F.col(v).alias("b"))
    both = stage(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "components-edges")
    label = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("deg")), "components-labels")
    while True:
        near = join_weighted(both.select("a", F.col("b").alias("_k")), label.select(F.col("a").alias("_k"), F.col("m").alias("nm"), "deg"), ["_k"], "deg").groupBy("a").agg(F.min("nm").alias("nm"))
        step = label.join(near, "a").select("a", F.least("m", "nm").alias("m"), "deg", (F.col("nm") < F.col("m")).alias("moved"))
        step = stage(step, "components-labels")
        hop = step.join(step.select(F.col("a").alias("m"), F.col("m").alias("mm")), "m", "left").select("a", F.least("m", F.coalesce("mm", "m")).alias("m"), "deg", "moved")
        after = stage(hop, "components-labels")
        unstage(label)
        unstage(step)
        label = after
        if after.where("moved").isEmpty():
            return label.select(F.col("a").alias("vertex"), F.col("m").alias("component"))


def representatives(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """First row of every group in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n = 1").drop("_n")


def mcnemar_pairs(difference: str, discordance: str, alpha: float, power: float) -> Column:
    """Pairs needed to see a difference of paired shares, by the normal approximation; NULL where it can't be (0, or above the discordance)."""
    za, zb = NormalDist().inv_cdf(1 - alpha / 2), NormalDist().inv_cdf(power)
    d, w = F.abs(difference), F.col(discordance)
    n = F.pow(za * F.sqrt(w) + zb * F.sqrt(F.greatest(w - d * d, F.lit(0.0))), F.lit(2.0)) / (d * d)
    return F.when((d > 0) & (d <= w), F.ceil(n).cast("bigint"))


def paired_t_pairs(effect: str, alpha: float, power: float, most: int = 5000) -> Column:
    """Least number of pairs (3..most) with which a two-sided paired t test sees the standardised effect; NULL beyond.

    The power is that of the noncentral t, by quadrature over the chi distribution of the scale; the search bisects, as power grows with n.
    """
    from tarnwork.functions.kernels import student_quantile

    nodes, weights = np.polynomial.legendre.leggauss(80)
    from math import erf, lgamma, sqrt

    normal = np.vectorize(lambda x: 0.5 * (1 + erf(x / sqrt(2))))

    critical: dict[int, float] = {}

    def has_power(n: int, d: float) -> bool:
        df = n - 1
        if n not in critical:
            critical[n] = float(student_quantile(1 - alpha / 2, np.array([float(df)]))[0])
        c = critical[n]
        s = 1 + 8 / sqrt(2 * df) * nodes  # scale around 1, of standard deviation 1 / sqrt(2 df)
        s, w = s[s > 0], weights[s > 0] * 8 / sqrt(2 * df)
        log_density = (1 - df / 2) * np.log(2.0) - lgamma(df / 2) + df * np.log(sqrt(df)) + (df - 1) * np.log(s) - df * s * s / 2
        shift = d * sqrt(n)
        return float((np.exp(log_density) * (1 - normal(c * s - shift) + normal(-c * s - shift))) @ w) >= power

    def need(d: float, low: int = 2, high: int = most) -> int | None:
        if not np.isfinite(d) or d == 0 or not has_power(most, d := abs(d)):
            return None
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if has_power(middle, d) else (middle, high)
        return high

    near: dict[int, int | None] = {}

    def exact(d: float) -> int | None:
        """need(d), searched between the numbers for the next thousandths above and below, which many effects share."""
        above, below = (near.setdefault(k, need(k / 1000)) if k not in near else near[k] for k in (int(abs(d) * 1000) + 1, int(abs(d) * 1000)))
        return above if above == below and above is not None else need(d, (above or 3) - 1, below or most)

    def run(d: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else exact(x) for x in d], dtype="Int64")

    return F.pandas_udf(run, "bigint")(F.col(effect))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
