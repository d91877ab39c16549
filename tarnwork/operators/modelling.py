"""Models over folds, change components, and the stability of clusters, by MLlib."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwork.operators.evaluation import fit_transformer, guard_split, roc_auc, threshold_metrics
from tarnwork.operators.qc import MAD_SCALE
from tarnwork.session import stage

MAX_FEATURES = 500
COMPONENTS = 5


def fold_vectors(cells: DataFrame, folds: DataFrame, states: DataFrame) -> DataFrame:
    """(repeat, outer_fold, entity, cond, test, x): every entity's samples as vectors in the order of the fold's features,
    standardised by the fold's state, which knows its training entities only."""
    samples = cells.select("entity", "cond").distinct()
    grid = states.select("repeat", "outer_fold").distinct().join(folds.select("repeat", "entity", F.col("outer_fold").alias("own")), "repeat").join(samples, "entity")
    met = grid.join(states, ["repeat", "outer_fold"]).join(cells.select("entity", "cond", "feature_key", "y"), ["entity", "cond", "feature_key"], "left")
    z = (F.coalesce("y", "median") - F.col("mean")) / F.col("scale")
    rows = met.groupBy("repeat", "outer_fold", "entity", "cond").agg((F.first("own") == F.col("outer_fold")).alias("test"), F.array_sort(F.collect_list(F.struct("feature_rank", z.alias("z")))).alias("zs"))
    return rows.select("repeat", "outer_fold", "entity", "cond", "test", array_to_vector(F.transform("zs", lambda s: s["z"])).alias("x"), (F.col("cond") == "T").cast("double").alias("label"))


def _fold_fits(cells: DataFrame, folds: DataFrame, model: str, c: float, l1: float, most: int, only: int | None = None) -> Iterator[tuple]:
    """(fold, fitted, test rows, states) of each fold: one distributed fit each; the number of folds is a setting, not data."""
    if model not in ("elastic_net", "svm", "pca"):
        raise ValueError(f"unknown model {model}")
    states = fit_transformer(cells, folds, 0.5, 0.0, min(most, MAX_FEATURES), "scale") if model == "pca" else fit_transformer(cells, folds, 0.5, 0.35, most)
    states = stage(states if only is None else states.where(F.col("outer_fold") == only), "model-states")
    rows = stage(fold_vectors(cells, folds, states), "model-rows")
    for r in rows.groupBy("repeat", "outer_fold").agg(F.count_if(~F.col("test")).alias("n"), F.first("x").alias("x")).collect():
        own = rows.where((F.col("repeat") == r["repeat"]) & (F.col("outer_fold") == r["outer_fold"]))
        train, test = own.where("not test"), own.where("test")
        guard_split(train, test, "entity")
        kind = {"featuresCol": "x", "labelCol": "label", "regParam": 1 / (c * r["n"]), "standardization": False, "maxIter": 50}
        if model == "pca":
            turned = PCA(k=min(COMPONENTS, r["x"].size), inputCol="x", outputCol="pc").fit(train)
            train, test = turned.transform(train), turned.transform(test)
            kind["featuresCol"] = "pc"
        fitted = LinearSVC(**kind) if model == "svm" else LogisticRegression(elasticNetParam=l1 if model == "elastic_net" else 0.0, **kind)
        yield r, fitted.fit(train), test, states


def outer_predictions(cells: DataFrame, folds: DataFrame, model: str = "elastic_net", c: float = 1.0, l1: float = 0.5, most: int = 50, only: int | None = None) -> DataFrame:
    """(repeat, outer_fold, entity, cond, label, score): each entity's samples judged once a repeat by a model that has not seen the entity.

    model is elastic_net (logistic, score = probability), svm (score = margin) or pca (the baseline: logistic on five components of the `most`
    features of largest spread, at most 500); anything else raises ValueError. C is turned into MLlib's penalty, 1 / (C x
    training rows). With `only`, only that fold is held out.
    """
    parts = []
    for _, fitted, test, _ in _fold_fits(cells, folds, model, c, l1, most, only):
        score = vector_to_array("rawPrediction" if model == "svm" else "probability")[1]
        parts.append(fitted.transform(test).select("repeat", "outer_fold", "entity", "cond", F.col("label").cast("int").alias("label"), score.alias("score")))
    return reduce(DataFrame.unionByName, parts) if parts else cells.sparkSession.createDataFrame([], "repeat int, outer_fold int, entity bigint, cond string, label int, score double")


def heldout_importance(cells: DataFrame, folds: DataFrame, c: float = 1.0, l1: float = 0.5, most: int = 50, top: int = 25, shuffles: int = 5, seed: int = 1) -> DataFrame:
    """(repeat, outer_fold, feature_key, coefficient, drop): how much balanced accuracy the elastic-net model of a fold loses on its held-out
    samples, on average over shuffles, when a feature's values are dealt to other samples; for the `top` coefficients of largest size.

    The model is linear: a shuffled feature moves a sample's margin by coefficient x (dealt value - own value), so nothing is
    predicted again. A shuffle sends the sample of place k in one hash order to place k in another; places come from the ranks
    within 256 hash buckets and the buckets' counts, not from a sort of a whole fold.
    """
    spark, by = cells.sparkSession, ["repeat", "outer_fold"]
    judged, sizes = [], []
    for r, fitted, test, states in _fold_fits(cells, folds, "elastic_net", c, l1, most):
        margin = vector_to_array("rawPrediction")[1]
        judged.append(fitted.transform(test).select(*by, "entity", "cond", F.col("label").cast("int").alias("label"), margin.alias("margin"), vector_to_array("x").alias("x")))
        weights = sorted(enumerate(fitted.coefficients.toArray().tolist()), key=lambda w: (-abs(w[1]), w[0]))[:top]
        sizes += [(r["repeat"], r["outer_fold"], i, w) for i, w in weights if w]
    if not sizes:
        return spark.createDataFrame([], "repeat int, outer_fold int, feature_key string, coefficient double, drop double")
    rows = stage(reduce(DataFrame.unionByName, judged), "importance-rows")
    named = states.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("feature_rank")) - 1)
    chosen = spark.createDataFrame(sizes, "repeat int, outer_fold int, place int, coefficient double").join(named.select(*by, "place", "feature_key"), [*by, "place"])
    dealt = rows.select(*by, "entity", "cond", F.explode(F.sequence(F.lit(0), F.lit(shuffles))).alias("shuffle"))
    dealt = dealt.withColumn("h", F.xxhash64("entity", "cond", "shuffle", F.lit(seed))).withColumn("b", F.pmod("h", F.lit(256)))
    counts = dealt.groupBy(*by, "shuffle", "b").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by, "shuffle").orderBy("b")) - F.col("n")
    at = F.row_number().over(Window.partitionBy(*by, "shuffle", "b").orderBy("h", "entity", "cond")) + F.col("before")
    dealt = dealt.join(counts.select(*by, "shuffle", "b", before.alias("before")), [*by, "shuffle", "b"]).withColumn("k", at).select(*by, "entity", "cond", "shuffle", "k")
    giver = dealt.where("shuffle = 0").drop("shuffle").join(rows.select(*by, "entity", "cond", F.col("x").alias("given")), [*by, "entity", "cond"]).select(*by, "k", "given")
    taker = dealt.where("shuffle > 0").join(rows, [*by, "entity", "cond"])
    met = taker.join(giver, [*by, "k"]).join(F.broadcast(chosen), by)
    moved = F.col("margin") + F.col("coefficient") * (F.get("given", F.col("place")) - F.get("x", F.col("place")))
    hit = lambda m: ((m >= 0).cast("int") == F.col("label")).cast("int")
    part = lambda m, y: F.avg(F.when(F.col("label") == y, hit(m)))
    each = met.groupBy(*by, "feature_key", "coefficient", "shuffle").agg(((part(F.col("margin"), 0) + part(F.col("margin"), 1) - part(moved, 0) - part(moved, 1)) / 2).alias("drop"))
    return each.groupBy(*by, "feature_key", "coefficient").agg(F.avg("drop").alias("drop"))


def learning_curve(cells: DataFrame, folds: DataFrame, last: int, model: str = "elastic_net", c: float = 1.0, l1: float = 0.5, most: int = 50) -> DataFrame:
    """(repeat, parts, train_entities, roc_auc): the model judged on fold 0 after training on folds 1..parts, for parts from 2 to `last`.

    All entities of a fold are used; with six folds the steps are two to five sixths of the entities.
    """
    steps = folds.select("repeat", "entity", "outer_fold", F.explode(F.sequence(F.lit(2), F.lit(last))).alias("parts")).where("outer_fold <= parts")
    steps = stage(steps.select((F.col("repeat") * 100 + F.col("parts")).alias("repeat"), "entity", F.least("outer_fold", F.lit(1)).alias("outer_fold")), "curve-folds")
    sizes = steps.where("outer_fold = 1").groupBy("repeat").agg(F.count(F.lit(1)).alias("train_entities"))
    areas = roc_auc(outer_predictions(cells, steps, model, c, l1, most, only=0), "score", "label", ["repeat"])
    return areas.join(sizes, "repeat").select(F.floor(F.col("repeat") / 100).cast("int").alias("repeat"), (F.col("repeat") % 100).cast("int").alias("parts"), "train_entities", "roc_auc")


def change_vectors(pairs: DataFrame, share: float, features: int, clip: float) -> tuple[DataFrame, int]:
    """(entity, v), staged, and the width to keep: robustly scaled changes of the features of largest MAD; see change_components."""
    rows = stage(pairs.where("delta is not null").select("feature_key", "entity", "delta"), "components-rows")
    n = rows.select("entity").distinct().count()
    near = rows.join(rows.groupBy("feature_key").agg(F.count(F.lit(1)).alias("c"), F.median("delta").alias("m")).where(F.col("c") >= share * n), "feature_key")
    mads = near.groupBy("feature_key", "m").agg((F.median(F.abs(F.col("delta") - F.col("m"))) * MAD_SCALE).alias("s")).where("s > 0")
    top = stage(mads.orderBy(F.desc("s"), F.desc("feature_key")).limit(min(features, MAX_FEATURES)), "components-features")
    grid = rows.select("entity").distinct().join(F.broadcast(top))
    x = F.least(F.greatest((F.coalesce("delta", "m") - F.col("m")) / F.col("s"), F.lit(-clip)), F.lit(clip))
    vectors = grid.join(rows, ["entity", "feature_key"], "left").groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("feature_key", x.alias("x")))).alias("xs"))
    vectors = stage(vectors.select("entity", array_to_vector(F.transform("xs", lambda s: s["x"])).alias("v")), "components-vectors")
    return vectors, min(top.count(), n)


def change_components(pairs: DataFrame, share: float = 0.8, features: int = 200, clip: float = 5.0, k: int = 5) -> tuple[DataFrame, list[float]]:
    """(entity, scores) and the explained variance of k components of paired change.

    The `features` of largest MAD (at most 500), ties to the larger key, among those that `share` of the entities have; missing changes are the
    median's, scaled by median and MAD, cut at clip. Each entity is one vector, so the covariance is of bounded size. Without such a feature the result is empty.
    """
    vectors, widest = change_vectors(pairs, share, features, clip)
    width = min(k, widest)
    if not width:
        return vectors.limit(0).select("entity", vector_to_array("v").alias("scores")), []
    model = PCA(k=width, inputCol="v", outputCol="pc").fit(vectors)
    return model.transform(vectors).select("entity", vector_to_array("pc").alias("scores")), [float(v) for v in model.explainedVariance]


def bootstrap_explained(pairs: DataFrame, resamples: int = 20, share: float = 0.8, features: int = 200, clip: float = 5.0, k: int = 5, seed: int = 1) -> DataFrame:
    """(component, explained, low, median, high): explained variance and its 2.5, 50 and 97.5 percentiles over resamples of whole entities.

    A resample repeats each entity as often as a Poisson draw of mean 1 says, taken from a hash of entity and resample (the
    distributed form of drawing with replacement). Every resample is one distributed fit; their number is a setting.
    """
    vectors, widest = change_vectors(pairs, share, features, clip)
    width, spark = min(k, widest), pairs.sparkSession
    fit = lambda rows: [float(v) for v in PCA(k=width, inputCol="v", outputCol="pc").fit(rows).explainedVariance]
    if not width:
        return spark.createDataFrame([], "component int, explained double, low double, median double, high double")
    whole, drawn = fit(vectors), []
    for i in range(resamples):
        u = (F.pmod(F.xxhash64("entity", F.lit(seed), F.lit(i)), F.lit(2**40)) + 0.5) / float(2**40)
        times = reduce(lambda a, b: a + b, [(u > sum(math.exp(-1) / math.factorial(j) for j in range(t + 1))).cast("int") for t in range(12)])
        again = vectors.select("v", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)))).alias("t"), times.alias("n")).where("t <= n")
        drawn += [(j + 1, v) for j, v in enumerate(fit(again))]
    base = spark.createDataFrame([(j + 1, v) for j, v in enumerate(whole)], "component int, explained double")
    spread = spark.createDataFrame(drawn, "component int, v double").groupBy("component").agg(F.percentile("v", F.lit(0.025)).alias("low"), F.median("v").alias("median"), F.percentile("v", F.lit(0.975)).alias("high"))
    return base.join(spread, "component")


def cluster_stability(vectors: DataFrame, key: str, x: str, ks: list[int], resamples: int, part: float = 0.8, seed: int = 1) -> DataFrame:
    """(k, silhouette, smallest, stability) for each k: stability is the mean, over hash-picked resamples and clusters, of the best
    Jaccard index of a cluster with those of a model fitted on the resample.

    Agreement comes from contingency counts (k x k numbers a resample), never from pairs of rows.
    """
    rows = stage(vectors.select(F.col(key).alias("key"), F.col(x).alias("x")), "clusters-rows")
    spark, out = rows.sparkSession, []
    for k in ks:
        full = KMeans(k=k, seed=seed, featuresCol="x", predictionCol="a", maxIter=20).fit(rows)
        base = full.transform(rows)
        silhouette = ClusteringEvaluator(featuresCol="x", predictionCol="a").evaluate(base)
        smallest = base.groupBy("a").count().agg(F.min("count")).first()[0]
        stable = []
        for i in range(resamples):
            some = rows.where(F.pmod(F.xxhash64("key", F.lit(seed + i)), F.lit(1000)) < int(part * 1000))
            other = KMeans(k=k, seed=seed + i, featuresCol="x", predictionCol="b", maxIter=20).fit(some)
            counts = {(r.a, r.b): r["count"] for r in other.transform(full.transform(some)).groupBy("a", "b").count().collect()}
            size_a = {a: sum(n for (p, _), n in counts.items() if p == a) for a, _ in counts}
            size_b = {b: sum(n for (_, q), n in counts.items() if q == b) for _, b in counts}
            stable += [max(n / (size_a[a] + size_b[b] - n) for (p, b), n in counts.items() if p == a) for a in size_a]
        out.append((k, float(silhouette), int(smallest), float(sum(stable) / len(stable)) if stable else None))
    return spark.createDataFrame(out, "k int, silhouette double, smallest bigint, stability double")


def calibrate(fitted_on: DataFrame, judged: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """judged with probability: a logistic curve of the score (Platt), fitted on other rows, cut to 1e-8..1-1e-8."""
    vector = lambda df: df.withColumn("_s", array_to_vector(F.array(score)))
    model = LogisticRegression(featuresCol="_s", labelCol=label, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y").fit(vector(fitted_on))
    p = F.least(F.greatest(vector_to_array("_p")[1], F.lit(1e-8)), F.lit(1 - 1e-8))
    return model.transform(vector(judged)).withColumn("probability", p).drop("_s", "_p", "_r", "_y")


def tune(cells: DataFrame, folds: DataFrame, grid: list[dict], model: str = "elastic_net") -> DataFrame:
    """(c, l1, k, accuracy) for each setting of the grid: balanced accuracy of its outer predictions over the given (inner) folds."""
    out = []
    for g in grid:
        p = outer_predictions(cells, folds, model, g["c"], g.get("l1", 0.0), g["k"])
        m = threshold_metrics(p, "score", "label", F.lit(0.5 if model == "elastic_net" else 0.0), []).first()
        out.append((float(g["c"]), float(g.get("l1", 0.0)), int(g["k"]), None, float(m.balanced_accuracy)))
    return cells.sparkSession.createDataFrame(out, "c double, l1 double, k int, panel int, accuracy double")
