"""Grouped folds, leakage guards, fold transformers and classification metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_folds(entities: DataFrame, entity: str, folds: int, repeats: int, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, repeat, entity, outer_fold): whole entities dealt to folds in the order of md5(entity:seed), for each repeat and value of `by`.

    The place in that order is found within the 256 buckets of the hash's first byte and from their counts.
    """
    rows = entities.where(F.col(entity).isNotNull()).select(*by, F.col(entity).alias("entity")).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    rows = rows.withColumn("h", F.md5(F.concat_ws(":", F.col("entity").cast("string"), (F.col("repeat") * 1009 + seed).cast("string")))).withColumn("b", F.substring("h", 1, 2))
    before = Window.partitionBy(*by, "repeat").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by, "repeat", "b").count().select(*by, "repeat", "b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*by, "repeat", "b").orderBy("h", "entity")) + F.col("before") - 1
    return rows.join(counts if by else F.broadcast(counts), [*by, "repeat", "b"]).select(*by, "repeat", "entity", (place % folds).cast("int").alias("outer_fold"))


class LeakageError(ValueError):
    """Training and test rows share an entity."""


def guard_split(train: DataFrame, test: DataFrame, entity: str) -> None:
    """Raise LeakageError if an entity is on both sides."""
    if not train.select(entity).join(test.select(entity), entity, "left_semi").isEmpty():
        raise LeakageError("an entity is in training and in test")


def fit_transformer(cells: DataFrame, folds: DataFrame, least_observed: float, least_class: float, most: int, order: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, repeat, outer_fold, feature_rank, feature_key, median, mean, scale, score): for each fold, fitted on the other folds' entities.

    cells has feature_key, entity, cond, y. Features need their observed share overall and in either condition; missing values
    count as the median in mean and scale (population), features of scale 0 are dropped, and the `most` of largest
    standardised difference between conditions stay (order="scale": of largest spread), ties to the smaller key. A fold is fitted from sums: all rows are
    aggregated once per (repeat, fold, feature), with the fold's own entities left out by a join on entity.
    Columns in `by`, which cells and folds both have, name cohorts: each has folds, shares and states of its own.
    """
    count = folds.groupBy(*by, "repeat").agg(F.max("outer_fold").alias("last"))
    held = folds.join(count if by else F.broadcast(count), [*by, "repeat"]).select(*by, "repeat", "entity", F.col("outer_fold").alias("own"), F.explode(F.sequence(F.lit(0), "last")).alias("outer_fold")).where("own <> outer_fold").drop("own")
    sizes = held.join(cells.select(*by, "entity", "cond").distinct(), [*by, "entity"]).groupBy(*by, "repeat", "outer_fold").agg(F.count_if(F.col("cond") == "N").alias("all_n"), F.count_if(F.col("cond") == "T").alias("all_t"))
    keys = [*by, "repeat", "outer_fold", "feature_key"]
    is_t, is_n = F.col("cond") == "T", F.col("cond") == "N"
    s = cells.where(is_t | is_n).join(held, [*by, "entity"]).groupBy(*keys).agg(F.count_if(is_n).alias("n"), F.count_if(is_t).alias("t"), F.median("y").alias("median"), F.sum(F.when(is_n, F.col("y")).otherwise(0.0)).alias("sn"), F.sum(F.when(is_t, F.col("y")).otherwise(0.0)).alias("st"), F.sum(F.col("y") * F.col("y")).alias("ss"))
    s = s.join(sizes if by else F.broadcast(sizes), [*by, "repeat", "outer_fold"]).withColumn("all", F.col("all_n") + F.col("all_t"))
    s = s.where(((F.col("n") + F.col("t")) / F.col("all") >= least_observed) & (F.col("n") / F.col("all_n") >= least_class) & (F.col("t") / F.col("all_t") >= least_class))
    fill_n, fill_t = F.col("all_n") - F.col("n"), F.col("all_t") - F.col("t")
    s = s.withColumn("mean_n", (F.col("sn") + fill_n * F.col("median")) / F.col("all_n")).withColumn("mean_t", (F.col("st") + fill_t * F.col("median")) / F.col("all_t"))
    s = s.withColumn("mean", (F.col("sn") + F.col("st") + (fill_n + fill_t) * F.col("median")) / F.col("all"))
    s = s.withColumn("scale", F.sqrt(F.greatest((F.col("ss") + (fill_n + fill_t) * F.col("median") * F.col("median")) / F.col("all") - F.col("mean") * F.col("mean"), F.lit(0.0))))
    s = s.where(F.col("scale") > 1e-9).withColumn("score", F.abs(F.col("mean_t") - F.col("mean_n")) / F.col("scale"))
    rank = F.row_number().over(Window.partitionBy(*by, "repeat", "outer_fold").orderBy(F.desc(F.round(order, 9)), "feature_key"))
    return s.withColumn("feature_rank", rank).where(F.col("feature_rank") <= most).select(*by, "repeat", "outer_fold", "feature_rank", "feature_key", "median", "mean", "scale", "score")


def transform(cells: DataFrame, folds: DataFrame, states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, repeat, outer_fold, entity, cond, feature_key, z): the held-out entities of each fold, standardised; missing cells are the median's."""
    asked = folds.join(cells.select(*by, "entity", "cond").distinct(), [*by, "entity"]).join(states, [*by, "repeat", "outer_fold"])
    met = asked.join(cells.select(*by, "entity", "cond", "feature_key", "y"), [*by, "entity", "cond", "feature_key"], "left")
    return met.select(*by, "repeat", "outer_fold", "entity", "cond", "feature_key", ((F.coalesce("y", "median") - F.col("mean")) / F.col("scale")).alias("z"))


def roc_auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Area under the curve per group, ties counted half: from the counts of labels at each score, so that no group is ranked row by row."""
    at = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = at.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    return won.groupBy(*by).agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("roc_auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def threshold_metrics(df: DataFrame, probability: str, label: str, threshold: Column, by: list[str]) -> DataFrame:
    """Sensitivity, specificity, balanced accuracy, Brier score and log loss (probabilities cut to 1e-8..1-1e-8) per group; rows without a probability or label don't count."""
    p, y = F.col(probability), F.col(label)
    hit = (p >= threshold).cast("int")
    cut = F.least(F.greatest(p, F.lit(1e-8)), F.lit(1 - 1e-8))
    m = df.where(p.isNotNull() & y.isNotNull()).groupBy(*by).agg(F.avg(F.when(y == 1, hit)).alias("sensitivity"), F.avg(F.when(y == 0, 1 - hit)).alias("specificity"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(-F.when(y == 1, F.log(cut)).otherwise(F.log(1 - cut))).alias("log_loss"))
    return m.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def best_threshold(df: DataFrame, probability: str, label: str) -> DataFrame:
    """(threshold, balanced_accuracy): of 0.5 and all probabilities the one of best balanced accuracy, then nearest 0.5, then largest.

    One cumulative pass over the label counts by probability instead of candidates times rows.
    """
    at = df.groupBy(F.col(probability).alias("t")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    at = at.unionByName(df.sparkSession.createDataFrame([(0.5, 0, 0)], "t double, pos bigint, neg bigint")).groupBy("t").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    w = Window.partitionBy(F.lit(1))
    at = at.withColumn("tp", F.sum("pos").over(w.orderBy(F.desc("t")))).withColumn("fp", F.sum("neg").over(w.orderBy(F.desc("t")))).withColumn("p", F.sum("pos").over(w)).withColumn("n", F.sum("neg").over(w))
    at = at.withColumn("balanced_accuracy", (F.col("tp") / F.col("p") + 1 - F.col("fp") / F.col("n")) / 2)
    return at.orderBy(F.desc(F.round("balanced_accuracy", 12)), F.round(F.abs(F.col("t") - 0.5), 12), F.desc("t")).limit(1).select(F.col("t").alias("threshold"), "balanced_accuracy")


def label_swap_test(pairs: DataFrame, entity: str, difference: str, permutations: int, seed: int) -> DataFrame:
    """(pairs, observed, p): is the mean difference of pairs larger than under swapped labels?

    A permutation swaps the two labels of an entity where the first hex digit of md5(entity:permutation:seed) is odd. Each row
    meets a fixed number of permutations and is summed at once.
    """
    rows = pairs.where(F.col(difference).isNotNull()).select(F.col(entity).alias("e"), F.col(difference).alias("d"))
    drawn = rows.select("e", "d", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("i"))
    odd = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("e").cast("string"), F.col("i").cast("string"), F.lit(str(seed)))), 1, 1), 16, 10).cast("int") % 2 == 1
    null = drawn.groupBy("i").agg(F.avg(F.when(odd, -F.col("d")).otherwise(F.col("d"))).alias("m"))
    seen = rows.agg(F.count(F.lit(1)).alias("pairs"), F.avg("d").alias("observed"))
    met = null.join(F.broadcast(seen))
    return met.groupBy("pairs", "observed").agg(((F.count_if(F.round(F.abs("m"), 12) >= F.round(F.abs("observed"), 12)) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def choose_setting(results: DataFrame, by: list[str]) -> DataFrame:
    """The best row of each group: accuracy (largest), then c, panel (smallest), l1 (largest), k (smallest); missing ones last."""
    order = [F.desc_nulls_last("accuracy"), F.asc_nulls_last("c"), F.asc_nulls_last("panel"), F.desc_nulls_last("l1"), F.asc_nulls_last("k")]
    return results.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def fold_aucs(df: DataFrame, score: str, label: str, by: list[str], view: str) -> DataFrame:
    """(view, folds, least, median, greatest, wins): the area under the curve of each view over the folds that `by` names, and in how
    many of them it is the best (ties to the smaller view). Folds where an area is undefined don't count for that view."""
    areas = roc_auc(df, score, label, [*by, view]).where("roc_auc is not null").withColumn("roc_auc", F.round("roc_auc", 9))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("roc_auc"), view)) == 1
    return areas.withColumn("best", best).groupBy(view).agg(F.count(F.lit(1)).alias("folds"), F.min("roc_auc").alias("least"), F.median("roc_auc").alias("median"), F.max("roc_auc").alias("greatest"), F.count_if("best").alias("wins"))


def overlap_control(universe: DataFrame, key: str, first: str, second: str, draws: int, seed: int) -> DataFrame:
    """(keys, first_size, second_size, observed, null_median, null_max, p): do two flagged subsets of the keys overlap more than random ones?

    Flags that are NULL are false. A draw of random subsets of the same sizes has a hypergeometric overlap, so each draw is one
    number from the three counts, in parallel over draws; p = (1 + draws of at least the observed overlap) / (1 + draws).
    """
    a, b = (F.coalesce(F.col(c), F.lit(False)) for c in (first, second))
    sizes = universe.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("keys"), F.count_if(a).alias("first_size"), F.count_if(b).alias("second_size"), F.count_if(a & b).alias("observed"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["overlap"] = [int(np.random.default_rng([seed, i]).hypergeometric(good, total - good, tried)) if tried else 0 for i, total, good, tried in zip(f["i"], f["keys"], f["first_size"], f["second_size"])]
            yield f

    drawn = sizes.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("i")).mapInPandas(run, "keys bigint, first_size bigint, second_size bigint, observed bigint, i int, overlap bigint")
    p = (F.count_if(F.col("overlap") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)
    return drawn.groupBy("keys", "first_size", "second_size", "observed").agg(F.median("overlap").alias("null_median"), F.max("overlap").alias("null_max"), p.alias("p"))
