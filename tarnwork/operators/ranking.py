"""Ranks and false-discovery rates within groups of any size: counts of values, buckets in order, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwork.functions.columns import is_true
from tarnwork.operators.joins import join_null_safe, join_weighted
from tarnwork.session import stage

EDGES = 128


def _whole(by: list[str]) -> Window:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))


def cumulative_counts(values: DataFrame, by: list[str], value: str, bucket: Column) -> DataFrame:
    """values (by, value, _c rows each; a row a distinct value) with _bucket, _upto (rows of the group up to the value) and _m (rows of it).

    bucket must not fall as value rises. Only distinct values of one bucket are sorted in one task, and sums of buckets in another.
    """
    values = values.withColumn("_bucket", bucket)
    sums = values.groupBy(*by, "_bucket").agg(F.sum("_c").alias("_in"))
    sums = sums.withColumn("_before", F.sum("_in").over(_whole(by).orderBy("_bucket")) - F.col("_in")).withColumn("_m", F.sum("_in").over(_whole(by))).drop("_in")
    inside = F.sum("_c").over(Window.partitionBy(*by, "_bucket").orderBy(value))
    return join_null_safe(values.withColumn("_inside", inside), sums, [*by, "_bucket"]).withColumn("_upto", F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def benjamini_hochberg(df: DataFrame, p: str, out: str, family: list[str]) -> DataFrame:
    """df with the false-discovery rate of p within its family, NULL where p is NULL or NaN.

    q = min over p' >= p of p' x m / (rows up to p'), so that it hangs on the value of p alone: it is worked out on the distinct
    values of a family, in buckets (256 of p, below 1/256 by powers of two), and joined to the rows that have a p. A value
    that a third of all rows share is one row until then, and a heavy key of the join. df is written once, as it is read twice.
    """
    ok = is_true(F.col(p).isNotNull() & ~F.isnan(p))
    rows = stage(df, "fdr-rows")
    values = rows.where(ok).groupBy(*family, p).agg(F.count(F.lit(1)).alias("_c"))
    x = F.col(p)
    bucket = F.when(x >= 1 / 256, F.floor(x * 256)).otherwise(-F.floor(-4 * F.log2(F.greatest(x, F.lit(1e-300))))).cast("int")
    values = cumulative_counts(values, family, p, bucket).withColumn("_ratio", x * F.col("_m") / F.col("_upto"))
    least = values.groupBy(*family, "_bucket").agg(F.min("_ratio").alias("_least"))
    above = _whole(family).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    least = least.withColumn("_bound", F.min("_least").over(above)).drop("_least")
    run = F.min("_ratio").over(Window.partitionBy(*family, "_bucket").orderBy(F.desc(p)))
    q = join_null_safe(values.withColumn("_run", run), least, [*family, "_bucket"]).select(*family, p, F.least("_run", F.coalesce("_bound", F.lit(1.0)), F.lit(1.0)).alias(out), "_c")
    found = join_weighted(rows.where(ok), stage(q, "fdr-values"), [*family, p], "_c")
    return found.select(*df.columns, out).unionByName(rows.where(~ok).withColumn(out, F.lit(None).cast("double")))


def average_ranks(df: DataFrame, value: str, out: str, by: list[str]) -> DataFrame:
    """df with the average rank of value within by (ties share theirs, from 1) and out + "_of", the rows ranked; both NULL for NULL.

    Groups of any size: buckets lie between approximate quantiles of all values. df is written once, as it is read three times.
    """
    rows = stage(df, "rank-rows")
    there = rows.where(F.col(value).isNotNull())
    edges = sorted(set(there.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [i / EDGES for i in range(1, EDGES)], 0.002)))
    bucket = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(value))) if edges else F.lit(0)
    values = cumulative_counts(there.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")), by, value, bucket)
    ranks = values.select(*by, value, (F.col("_upto") - (F.col("_c") - 1) / 2).alias(out), F.col("_m").alias(f"{out}_of"), "_c")
    none = [F.lit(None).cast("double").alias(out), F.lit(None).cast("bigint").alias(f"{out}_of")]
    return join_weighted(there, stage(ranks, "rank-values"), [*by, value], "_c").select(*df.columns, out, f"{out}_of").unionByName(rows.where(F.col(value).isNull()).select(*df.columns, *none))
