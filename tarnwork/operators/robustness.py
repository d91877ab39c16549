"""Scenario grids, leave-one-entity-out from sufficient statistics, and agreement between scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.columns import average_rank, is_true
from tarnwork.operators.inference import paired_tests
from tarnwork.operators.pairing import moments
from tarnwork.operators.ranking import average_ranks, benjamini_hochberg
from tarnwork.session import stage


def scenario_pairs(plain: DataFrame, centred: DataFrame, flagged: DataFrame) -> DataFrame:
    """Both representations x both cohorts (all pairs, unflagged pairs) as one long table keyed by representation and cohort.

    flagged has entity: the pairs that the second cohort leaves out as wholes.
    """
    both = plain.withColumn("representation", F.lit("uncentered")).unionByName(centred.withColumn("representation", F.lit("centered")))
    clean = both.join(flagged.select("entity"), "entity", "left_anti").withColumn("cohort", F.lit("unflagged_pairs"))
    return both.withColumn("cohort", F.lit("all_pairs")).unionByName(clean)


def multiverse(pairs: DataFrame, thresholds: list[int], q: float = 0.05, effect: float = 0.5) -> DataFrame:
    """Every scenario (representation, cohort, least pairs, estimator) x feature: effect, statistic, p, q, core and rank of |statistic| in percent.

    Moments are worked out once per representation and cohort; the thresholds are a key of one pass over priors and tests, and
    estimators share its rows.
    """
    stats = moments(pairs, ("representation", "cohort", "feature_key"))
    stats = stats.withColumn("least_pairs", F.explode(F.array(*[F.lit(k) for k in thresholds]))).where(F.col("pairs") >= F.col("least_pairs")).withColumn("eligible", F.lit(True))
    t = paired_tests(stage(stats, "multiverse-moments"), ["representation", "cohort", "least_pairs"])
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("estimator"), F.col(t_).alias("statistic"), F.col(p).alias("p")) for n, t_, p in (("moderated", "moderated_t", "p"), ("ordinary", "ordinary_t", "ordinary_p"))]))
    keys = ["representation", "cohort", "least_pairs", "estimator"]
    every = t.select("representation", "cohort", "least_pairs", "feature_key", "mean", both.alias("e")).select("representation", "cohort", "least_pairs", "e.estimator", "feature_key", "mean", "e.statistic", "e.p")
    every = benjamini_hochberg(every, "p", "q", keys)
    every = every.withColumn("core", is_true((F.col("q") <= q) & (F.abs("mean") >= effect))).withColumn("size", F.abs("statistic"))
    every = average_ranks(every, "size", "_rank", keys).withColumn("rank_percent", F.col("_rank") / F.col("_rank_of")).drop("size", "_rank", "_rank_of")
    return every.withColumn("scenario_id", F.concat_ws("|", "representation", "cohort", F.col("least_pairs").cast("string"), "estimator"))


def leave_one_out(pairs: DataFrame) -> DataFrame:
    """Per feature with at least three pairs: mean over all, least and greatest mean without one entity, the entity whose
    absence changes it most (ties to the smaller one), and whether the sign ever flips.

    A mean without one entity follows from the sums less its own delta, so nothing is fitted again.
    """
    rows = pairs.where("delta is not null")
    sums = rows.groupBy("feature_key").agg(F.count(F.lit(1)).alias("c"), F.sum("delta").alias("s")).where("c >= 3")
    one = rows.join(sums, "feature_key").withColumn("without", (F.col("s") - F.col("delta")) / (F.col("c") - 1)).withColumn("all", F.col("s") / F.col("c"))
    one = one.withColumn("change", F.round(F.abs(F.col("without") - F.col("all")), 12))
    return one.groupBy("feature_key").agg(F.first("all").alias("mean"), F.first("c").alias("pairs"), F.min("without").alias("least"), F.max("without").alias("greatest"), F.min(F.struct((-F.col("change")).alias("c"), "entity")).alias("w"), F.bool_or(F.signum("without") != F.signum("all")).alias("flips")).select("feature_key", "mean", "pairs", "least", "greatest", F.col("w.entity").alias("worst_entity"), (-F.col("w.c")).alias("worst_change"), "flips")


def leave_one_out_tests(pairs: DataFrame, least_pairs: int, q: float = 0.05, effect: float = 0.5) -> DataFrame:
    """(cohort, feature_key, pairs, mean, q, core, runs, retained, flips, worst_q, worst_change) of every feature with least_pairs pairs:
    the moderated test done again without each entity of the cohort in turn, prior and false-discovery rates with it.

    pairs has cohort, feature_key, entity, delta. core is q and |mean| within their limits; runs counts the omissions that leave
    least_pairs pairs, retained those in which the feature is core, flips those in which its mean changes sign; worst_change is the largest
    change of the mean over its ordinary standard error. Moments without an entity are the sums less its own delta, so the
    deltas are aggregated once; the grid of features and entities is that of one cohort. An empty table gives an empty result.
    """
    rows = pairs.where("delta is not null and cohort is not null").select("cohort", "feature_key", "entity", "delta")
    sums = stage(rows.groupBy("cohort", "feature_key").agg(F.count(F.lit(1)).alias("c"), F.sum("delta").alias("s"), F.sum(F.col("delta") * F.col("delta")).alias("ss")), "omission-sums")
    variance = F.when(F.col("pairs") > 1, F.greatest((F.col("ss") - F.col("s") * F.col("s") / F.col("pairs")) / (F.col("pairs") - 1), F.lit(0.0)))

    def tested(sums: DataFrame, keys: list[str]) -> DataFrame:
        stats = sums.withColumnRenamed("c", "pairs").withColumn("mean", F.try_divide("s", "pairs")).withColumn("variance", variance).withColumn("eligible", F.col("pairs") >= least_pairs)
        met = benjamini_hochberg(paired_tests(stage(stats.where("eligible").drop("s", "ss"), "omission-stats"), keys), "p", "q", keys)
        return met.withColumn("core", is_true((F.col("q") <= q) & (F.abs("mean") >= effect)))

    whole = tested(sums, ["cohort"]).select("cohort", "feature_key", "pairs", "mean", "q", "core", "ordinary_se")
    own = rows.withColumnRenamed("entity", "omitted")
    grid = sums.join(own.select("cohort", "omitted").distinct(), "cohort").join(own, ["cohort", "feature_key", "omitted"], "left")
    d, there = F.coalesce("delta", F.lit(0.0)), F.col("delta").isNotNull().cast("int")
    less = grid.select("cohort", "omitted", "feature_key", (F.col("c") - there).alias("c"), (F.col("s") - d).alias("s"), (F.col("ss") - d * d).alias("ss"))
    one = tested(less, ["cohort", "omitted"]).select("cohort", "feature_key", F.col("mean").alias("m1"), F.col("q").alias("q1"), F.col("core").alias("core1"))
    change = F.try_divide(F.abs(F.col("m1") - F.col("mean")), F.col("ordinary_se"))
    return whole.join(one, ["cohort", "feature_key"], "left").groupBy("cohort", "feature_key", "pairs", "mean", "q", "core").agg(F.count("m1").alias("runs"), F.count_if("core1").alias("retained"), F.count_if(F.signum("m1") != F.signum("mean")).alias("flips"), F.max("q1").alias("worst_q"), F.max(change).alias("worst_change"))


def scenario_similarity(universe: DataFrame) -> DataFrame:
    """(scenario_a, scenario_b, features, statistic_rho, effect_rho): Spearman's rho of all pairs of scenarios over the features
    eligible in both, ranked again within each pair (equal to nine digits is a tie). The number of scenarios is a setting; features are joined by key."""
    u = stage(universe.where("statistic is not null").select("scenario_id", "feature_key", F.round("statistic", 9).alias("statistic"), F.round("mean", 9).alias("mean")), "similarity-rows")
    a = u.select("feature_key", F.col("scenario_id").alias("scenario_a"), F.col("statistic").alias("sa"), F.col("mean").alias("ma"))
    b = u.select("feature_key", F.col("scenario_id").alias("scenario_b"), F.col("statistic").alias("sb"), F.col("mean").alias("mb"))
    met = a.join(b, "feature_key").where("scenario_a < scenario_b")
    by = ["scenario_a", "scenario_b"]
    ranks = met.select(*by, *[average_rank(c, by).alias(f"r_{c}") for c in ("sa", "sb", "ma", "mb")])
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("features"), F.corr("r_sa", "r_sb").alias("statistic_rho"), F.corr("r_ma", "r_mb").alias("effect_rho"))
