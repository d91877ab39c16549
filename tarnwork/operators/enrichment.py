"""Set enrichment: collapsed rankings, running-sum scores with their null, set scores of entities with a sign-flip test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwork.functions.columns import clip
from tarnwork.operators.qc import MAD_SCALE
from tarnwork.operators.ranking import benjamini_hochberg
from tarnwork.session import stage


def collapse_ranking(stats: DataFrame, symbol: str, statistic: str, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a symbol (of each ranking that `by` names): that of largest |statistic|, ties to the smaller key; NULL and compound (';') symbols and NULL statistics left out."""
    rows = stats.where(F.col(symbol).isNotNull() & (F.trim(symbol) != "") & ~F.contains(F.col(symbol), F.lit(";")) & F.col(statistic).isNotNull())
    best = rows.groupBy(*by, F.trim(symbol).alias("symbol")).agg(F.min(F.struct((-F.abs(statistic)).alias("a"), F.col(key).alias("key"), F.col(statistic).alias("statistic"))).alias("b"), F.count(F.lit(1)).alias("members"))
    return best.select(*by, "symbol", F.col("b.key").alias("key"), F.col("b.statistic").alias("statistic"), "members")


def ranked(ranking: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """ranking with place (1 = largest statistic, ties by symbol) and n within each value of `by`, by bucket offsets: no sort in one task."""
    ranking = stage(ranking, "ranking")
    edges = ranking.approxQuantile("statistic", [i / 64 for i in range(1, 64)], 0.01)
    bucket = F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges))]), lambda e: e >= F.col("statistic"))) if edges else F.lit(0)
    rows = ranking.withColumn("_b", bucket)
    counts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    one = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = one.orderBy("_b")  # at most 64 rows
    counts = counts.withColumn("_before", F.sum("_c").over(before) - F.col("_c")).withColumn("n", F.sum("_c").over(one))
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(F.desc("statistic"), "symbol"))
    return stage(rows.join(counts, [*by, "_b"]).withColumn("place", place + F.col("_before")).select(*ranking.columns, "place", "n"), "ranking")


def enrichment_scores(places: DataFrame, sets: DataFrame, smallest: int, largest: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Running-sum score of every set over a ranking (symbol, statistic, place, n), looked at where it has its extremes: at the hits.

    sets has set_id, symbol. A hit adds |statistic| / their sum (equal parts if that is 0), a miss takes 1 / (n - size). The
    score is the highest value after a hit, or the lowest before one if that is further from 0. Sets outside
    smallest..largest ranked members, or of all members, are left out. leading counts the hits up to the peak, or from it on if the score is negative.
    """
    hits = sets.select("set_id", "symbol").distinct().join(places.select(*by, "symbol", "statistic", "place", "n"), "symbol")
    own = Window.partitionBy(*by, "set_id")
    size = F.count(F.lit(1)).over(own)
    hits = hits.withColumn("size", size).where((F.col("size") >= smallest) & (F.col("size") <= largest) & (F.col("size") < F.col("n")))
    total = F.sum(F.abs("statistic")).over(own)
    hits = hits.withColumn("w", F.when(total > 0, F.abs("statistic") / total).otherwise(1 / F.col("size")))
    along = own.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("hit", F.row_number().over(own.orderBy("place")))
    after = F.sum("w").over(along) - (F.col("place") - F.col("hit")) / (F.col("n") - F.col("size"))
    hits = hits.withColumn("after", after).withColumn("before", F.col("after") - F.col("w"))
    s = hits.groupBy(*by, "set_id", "size").agg(F.max(F.struct("after", (-F.col("hit")).alias("h"))).alias("up"), F.min(F.struct("before", "hit")).alias("down"))
    high = F.abs(F.col("up.after")) >= F.abs(F.col("down.before"))
    return s.select(*by, "set_id", "size", F.when(high, F.col("up.after")).otherwise(F.col("down.before")).alias("score"), F.when(high, -F.col("up.h")).otherwise(F.col("size") - F.col("down.hit") + 1).alias("leading"))


def enrichment_null(places: DataFrame, scores: DataFrame, permutations: int = 200, seed: int = 1, longest: int = 200_000) -> DataFrame:
    """scores with nes, p and q against random sets of the same size.

    The null depends on a set's size only, so it is drawn once for each size that occurs, in parallel over sizes, with the
    generator seeded by size. The ranking's |statistics| go to each task, at most `longest` of them (else ValueError).
    """
    weights = np.array([abs(r.statistic) for r in places.select("place", "statistic").orderBy("place").limit(longest + 1).collect()])
    if len(weights) > longest:
        raise ValueError("the ranking is too long for one task")
    shared = places.sparkSession.sparkContext.broadcast(weights)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        n = len(w)
        for f in frames:
            rows = []
            for size in f["size"]:
                rng = np.random.default_rng(seed * 1_000_003 + int(size))
                for _ in range(permutations):
                    at = np.sort(rng.choice(n, int(size), replace=False))
                    x = w[at]
                    x = x / x.sum() if x.sum() > 0 else np.full(len(x), 1 / len(x))
                    after = np.cumsum(x) - (at - np.arange(len(at))) / (n - size)
                    before = after - x
                    rows.append((int(size), float(after.max() if abs(after.max()) >= abs(before.min()) else before.min())))
            yield pd.DataFrame(rows, columns=["size", "null_score"])

    null = scores.select("size").distinct().mapInPandas(run, "size bigint, null_score double")
    met = scores.join(null, "size").groupBy(*scores.columns).agg(
        F.avg(F.when(F.signum("null_score") == F.signum("score"), F.abs("null_score"))).alias("same"), F.avg(F.abs("null_score")).alias("any"),
        ((F.count_if(F.abs("null_score") >= F.abs("score")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"),
    )
    met = met.withColumn("nes", F.try_divide("score", F.coalesce("same", "any"))).drop("same", "any")
    return benjamini_hochberg(met, "p", "q", [])


def set_scores(pairs: DataFrame, members: DataFrame, entities: DataFrame, smallest: int) -> DataFrame:
    """(set_id, entity, score, features): mean scaled delta of a set's complete features, without centring.

    members has set_id, feature_key. A feature's scale is its MAD x 1.4826, else its standard deviation, else 1; complete features have a delta for each of
    the entities that have any (entities: one row with `entities`). Sets of fewer than `smallest` complete features are left out.
    """
    rows = pairs.where("delta is not null")
    per = rows.groupBy("feature_key").agg(F.count(F.lit(1)).alias("c"), F.median("delta").alias("m"), F.stddev_samp("delta").alias("sd"))
    whole = per.join(F.broadcast(entities), F.col("c") == F.col("entities"))
    rows = rows.join(whole.select("feature_key", "m", "sd"), "feature_key")
    mad = rows.groupBy("feature_key").agg(F.median(F.abs(F.col("delta") - F.col("m"))).alias("mad"))
    rows = rows.join(mad, "feature_key").withColumn("scaled", F.col("delta") / F.coalesce(F.when(F.col("mad") > 0, F.col("mad") * MAD_SCALE), F.when(F.col("sd") > 0, F.col("sd")), F.lit(1.0)))
    s = members.select("set_id", "feature_key").distinct().join(rows, "feature_key").groupBy("set_id", "entity").agg(F.avg("scaled").alias("score"), F.count(F.lit(1)).alias("features"))
    return s.where(F.col("features") >= smallest)


def sign_flip(scores: DataFrame, flips: int = 2000, seed: int = 1, most: int = 1_000_000) -> DataFrame:
    """(set_id, mean, entities, p, q) of set scores: p = (1 + flips with |mean| >= the observed) / (1 + flips).

    A set's scores are one array a row, one an entity (at most `most`, else ValueError); all sets use the same signs.
    """
    arrays = scores.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("entity", "score"))).alias("v"), F.avg("score").alias("mean"), F.count(F.lit(1)).alias("entities"))
    if (arrays.agg(F.max("entities")).first()[0] or 0) > most:
        raise ValueError("too many entities for one array")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = []
            for v in f["v"]:
                x = np.array([r["score"] for r in v])
                rng, beyond = np.random.default_rng(seed), 0
                for _ in range(0, flips, 200):
                    signs = rng.integers(0, 2, (min(200, flips), len(x))) * 2 - 1
                    beyond += int((np.abs(signs @ x) >= abs(x.sum()) - 1e-12).sum())
                p.append((1 + beyond) / (1 + flips))
            yield f.drop(columns="v").assign(p=p)

    out = arrays.mapInPandas(run, f"set_id {scores.schema['set_id'].dataType.simpleString()}, mean double, entities bigint, p double")
    return benjamini_hochberg(out, "p", "q", [])


def leading_edges(places: DataFrame, sets: DataFrame, scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, set_id, symbol, statistic): the hits up to a set's peak, or from it on for negative scores."""
    own = Window.partitionBy(*by, "set_id").orderBy("place")
    hits = sets.select("set_id", "symbol").distinct().join(places.select(*by, "symbol", "statistic", "place"), "symbol").withColumn("hit", F.row_number().over(own))
    met = hits.join(scores.select(*by, "set_id", "score", "size", "leading"), [*by, "set_id"])
    return met.where(F.when(F.col("score") >= 0, F.col("hit") <= F.col("leading")).otherwise(F.col("hit") > F.col("size") - F.col("leading"))).select(*by, "set_id", "symbol", "statistic")


def scenario_sensitivity(ranking: DataFrame, sets: DataFrame, scenario: str, primary: str, smallest: int, largest: int) -> DataFrame:
    """(scenario, set_id, score, same_direction, edge_jaccard): every set's score over each scenario's ranking, whether its sign is that of
    the primary scenario, and the Jaccard index of the two leading edges; sets that the primary scenario lacks have NULL in both.

    ranking has scenario, symbol, statistic. All scenarios are ranked in one pass.
    """
    by = (scenario,)
    places = ranked(ranking, by)
    scores = stage(enrichment_scores(places, sets, smallest, largest, by), "sensitivity-scores")
    edges = stage(leading_edges(places, sets, scores, by), "sensitivity-edges")
    first = edges.where(F.col(scenario) == primary).select("set_id", "symbol", F.lit(1).alias("in_primary"))
    shared = edges.join(first, ["set_id", "symbol"], "left").groupBy(scenario, "set_id").agg(F.count(F.lit(1)).alias("own"), F.count("in_primary").alias("both"))
    sizes = first.groupBy("set_id").agg(F.count(F.lit(1)).alias("other"))
    reference = scores.where(F.col(scenario) == primary).select("set_id", F.col("score").alias("primary_score"))
    met = scores.join(shared, [scenario, "set_id"], "left").join(reference, "set_id", "left").join(sizes, "set_id", "left")
    jaccard = F.try_divide(F.coalesce("both", F.lit(0)), F.coalesce("own", F.lit(0)) + F.col("other") - F.coalesce("both", F.lit(0)))
    return met.select(scenario, "set_id", "score", (F.signum("score") == F.signum("primary_score")).alias("same_direction"), jaccard.alias("edge_jaccard"))


def integrate_views(ranked_sets: DataFrame, scored_sets: DataFrame, q: float = 0.05) -> DataFrame:
    """Ranked and scored enrichment of sets side by side (full outer): do their directions agree, do both support, and the priority:
    mean of the -log10 q that are there."""
    a = ranked_sets.select("set_id", "nes", F.col("q").alias("ranked_q"))
    met = a.join(scored_sets.select("set_id", "mean", F.col("q").alias("score_q")), "set_id", "full_outer")
    strength = [-F.log10(clip(F.col(c), 1e-300, 1.0)) for c in ("ranked_q", "score_q")]
    there = F.filter(F.array(*strength), lambda x: x.isNotNull())
    both = F.coalesce((F.col("ranked_q") <= q) & (F.col("score_q") <= q), F.lit(False))
    return met.withColumn("same_direction", F.coalesce(F.signum("nes") == F.signum("mean"), F.lit(False))).withColumn("supported_by_both", both).withColumn("priority", F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, x: s + x), F.size(there)))
