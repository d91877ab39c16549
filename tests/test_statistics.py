import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.functions.columns import cascade, exact_binary_p, quantile_bin
from tarnwork.functions.kernels import digamma, polygamma, student_quantile, student_two_sided, trigamma, trigamma_inverse
from tarnwork.operators import enrichment, evaluation, inference, modelling, pairing, qc, robustness, selection
from tarnwork.operators.ranking import average_ranks, benjamini_hochberg


def test_kernels():
    assert abs(1 - student_two_sided([2.228139], [10])[0] / 2 - 0.975) < 1e-6 and student_two_sided([0], [10])[0] == pytest.approx(1)
    assert 0 < student_two_sided([50], [40])[0] < 1e-30 and math.isnan(student_two_sided([float("nan")], [4])[0])
    assert student_two_sided([12.706], [1])[0] == pytest.approx(0.05, abs=1e-4) and student_two_sided([1.96], [1e6])[0] == pytest.approx(0.05, abs=1e-4)
    assert student_quantile(0.975, np.array([10.0]))[0] == pytest.approx(2.228139, abs=1e-5)
    assert digamma(1) == pytest.approx(-0.5772156649) and trigamma(1) == pytest.approx(math.pi**2 / 6) and trigamma_inverse(trigamma(3.3)) == pytest.approx(3.3)


def test_exact_binary(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (10, 0), (5, 5), (3, 9), (4000, 4400)], "a long, b long")
    got = [r.p for r in df.select(exact_binary_p("a", "b").alias("p")).collect()]
    want = lambda a, b: min(1.0, 2 * sum(math.comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b))
    assert got[0] is None and got[1:5] == pytest.approx([1.0, 2 / 1024, 1.0, want(3, 9)]) and got[5] == pytest.approx(want(4000, 4400), rel=1e-6)


def test_false_discovery_rates(spark):
    rnd = random.Random(1)
    p = [0.01, 0.04, 0.03, None, float("nan"), 1.0, 1e-20, 0.0, 0.5, 0.5] + [rnd.random() ** 3 for _ in range(200)]
    df = spark.createDataFrame([(f, i, x) for f in ("a", None) for i, x in enumerate(p)], "fam string, i int, p double")
    ok = sorted(x for x in p if x is not None and x == x)
    m = len(ok)
    want = {x: min(1.0, min(y * m / (r + 1) for r, y in enumerate(ok) if y >= x)) for x in ok}
    rows = benjamini_hochberg(df, "p", "q", ["fam"]).collect()
    assert len(rows) == 2 * len(p)
    for r in rows:
        assert r.q is None if r.p is None or r.p != r.p else r.q == pytest.approx(want[r.p])


def test_cascade_and_bins(spark):
    df = spark.createDataFrame([(None,), (1.0,), (5.0,)], "x double")
    assert [r.c for r in df.select(cascade([(F.col("x") > 3, "high"), (F.col("x") > 0, "low")], "none").alias("c")).collect()] == ["none", "low", "high"]
    assert [r.b for r in df.select(quantile_bin("x", F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0))).alias("b")).collect()] == [None, 1, 2]


def measurements(spark, features=40, entities=35, shift=2.0):
    rng = np.random.default_rng(17)
    rows = []
    for f in range(features):
        for e in range(entities):
            base, move = rng.normal(10, 1), rng.normal(shift if f == 0 else 0, 0.5)
            rows += [(f"F{f:03d}", f"P{e}N", e, "N", float(base)), (f"F{f:03d}", f"P{e}T", e, "T", float(base + move))]
    return spark.createDataFrame([r for i, r in enumerate(rows) if i % 17 or r[0] == "F000"], "feature_key string, sample_id string, entity long, cond string, y double")


def test_planted_effect_and_leave_one_out(spark):
    pairs = pairing.paired(measurements(spark))
    got = {r.feature_key: r for r in inference.abundance_inference(pairs, 10).collect()}
    hit = got["F000"]
    assert hit.mean > 1.5 and hit.q < 1e-3 and hit.ci_low > 0 and sum(r.q < 0.05 for r in got.values()) < 6
    assert hit.posterior == pytest.approx((hit.d0 * hit.s0 + 34 * hit.variance) / (hit.d0 + 34)) and hit.moderated_df == pytest.approx(hit.d0 + 34)
    one = {r.feature_key: r for r in robustness.leave_one_out(pairs).collect()}
    d = {r.entity: r.delta for r in pairs.where("feature_key = 'F001' and delta is not null").collect()}
    without = {e: (sum(d.values()) - x) / (len(d) - 1) for e, x in d.items()}
    assert one["F001"].least == pytest.approx(min(without.values())) and one["F001"].greatest == pytest.approx(max(without.values()))
    mean = sum(d.values()) / len(d)
    assert one["F001"].worst_entity == max(without, key=lambda e: abs(without[e] - mean))
    assert inference.abundance_inference(pairs.limit(0), 10).count() == 0


def test_latest_cells_and_states(spark):
    rows = [(1, "f", "P1N", 4.0, 1), (2, "f", "P1N", 8.0, 2), (3, "f", "P1N", float("nan"), 3), (4, "f", "P1T", -1.0, 1), (5, "f", "P2T", 2.0, 1), (6, "g", "P1N", None, 1), (7, "f", "P3N", 2.0, 1), (8, "f", "P3T", 4.0, 1), (9, "g", "P3N", float("inf"), 1)]
    df = spark.createDataFrame(rows, "row_id long, feature_key string, sample_id string, x_raw double, loaded_at int")
    cells = pairing.latest_cells(df)
    assert {(r.sample_id, r.value) for r in cells.collect()} == {("P1N", 8.0), ("P2T", 2.0), ("P3N", 2.0), ("P3T", 4.0)}
    s = pairing.state_counts(pairing.paired(cells), pairing.count_entities(cells)).collect()
    assert [(r.n_only, r.t_only, r.both, r.neither) for r in s] == [(1, 1, 1, 0)]
    assert [r.delta for r in pairing.paired(cells).where("delta is not null").collect()] == [1.0]


def test_robust_z(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 4.0, 100.0)] + [("b", 5.0), ("b", 5.0), ("b", None), (None, 1.0)], "g string, x double")
    got = {(r.g, r.x): r.z for r in qc.robust_z(df, {"x": "z"}, ["g"]).collect()}
    assert got["a", 100.0] == pytest.approx(97 / 1.4826) and got["b", 5.0] == 0 and got["b", None] is None and got[None, 1.0] == 0


def test_enrichment_direction_and_null(spark):
    ranking = spark.createDataFrame([(f"s{i}", f"k{i}", float(w)) for i, w in enumerate([5, 4, 3, 2, 1, -1, -2, -3, -4, -5])], "symbol string, key string, statistic double")
    places = enrichment.ranked(ranking)
    assert [r.place for r in places.orderBy("place").collect()] == list(range(1, 11))
    sets = spark.createDataFrame([(n, f"s{i}") for n, at in (("up", (0, 1, 2)), ("down", (7, 8, 9)), ("all", range(10)), ("tiny", (1,))) for i in at], "set_id string, symbol string")
    scores = enrichment.enrichment_scores(places, sets, 2, 100)
    got = {r.set_id: r for r in scores.collect()}
    assert set(got) == {"up", "down"} and got["up"].score == pytest.approx(1) and got["down"].score == pytest.approx(-1) and got["up"].leading == 3 == got["down"].leading
    null = {r.set_id: r for r in enrichment.enrichment_null(places, scores, 100).collect()}
    assert null["up"].p < 0.1 and null["up"].nes > 1


def test_sign_flips_keep_a_shift(spark):
    rng = np.random.default_rng(7)
    pairs = spark.createDataFrame([(f"F{f}", e, float(rng.normal(1.5, 0.2))) for f in range(5) for e in range(42)], "feature_key string, entity long, delta double")
    members = spark.createDataFrame([("s", f"F{f}") for f in range(5)], "set_id string, feature_key string")
    scores = enrichment.set_scores(pairs, members, pairs.agg(F.count_distinct("entity").alias("entities")), 5)
    assert scores.count() == 42 and scores.agg(F.min("score")).first()[0] > 0 and enrichment.sign_flip(scores, 1000).first().p < 0.01


def test_folds_guards_metrics(spark):
    folds = evaluation.hash_folds(spark.range(42), "id", 6, 2, 123).collect()
    assert len(folds) == 84 and all(sum(r.outer_fold == f and r.repeat == 0 for r in folds) == 7 for f in range(6))
    a, b = spark.range(5), spark.range(4, 9)
    with pytest.raises(evaluation.LeakageError):
        evaluation.guard_split(a, b, "id")
    evaluation.guard_split(a, spark.range(6, 9), "id")
    rows = [(0.9, 1), (0.8, 1), (0.8, 0), (0.3, 0), (0.2, 1), (0.1, 0)]
    df = spark.createDataFrame(rows, "p double, y int")
    wins = sum((a > b) + (a == b) / 2 for a, y in rows if y for b, z in rows if not z)
    assert evaluation.roc_auc(df, "p", "y", []).first().roc_auc == pytest.approx(wins / 9)
    best = evaluation.best_threshold(df, "p", "y").first()
    assert best.balanced_accuracy == pytest.approx(2 / 3) and best.threshold == 0.5


def test_outer_predictions_see_a_planted_effect(spark):
    cells = measurements(spark, features=8, entities=18, shift=4.0)
    folds = evaluation.hash_folds(cells, "entity", 3, 1, 5)
    got = modelling.outer_predictions(cells, folds, most=4)
    assert got.count() == 36 and evaluation.roc_auc(got, "score", "label", []).first().roc_auc > 0.8
    with pytest.raises(ValueError):
        modelling.outer_predictions(cells, folds, model="forest")


def test_pareto_fronts(spark):
    df = spark.createDataFrame([("x", 1, 2.0, 2.0), ("x", 2, 1.0, 1.0), ("x", 3, 2.0, 1.0), ("x", 4, None, float("nan")), ("y", 5, 0.0, 0.0), ("x", 6, 2.0, 2.0)], "g string, id int, a double, b double")
    assert {r.id: r.front for r in selection.pareto_fronts(df, "id", ["a", "b"], ["g"]).collect()} == {1: 1, 6: 1, 3: 2, 2: 3, 4: 4, 5: 1}
    rnd = random.Random(2)
    points = [("z", i, float(rnd.randrange(8)), float(rnd.randrange(8))) for i in range(60)]
    left, front, n = dict((p[1], p[2:]) for p in points), {}, 0
    while left:
        n += 1
        best = [i for i, x in left.items() if not any(y[0] >= x[0] and y[1] >= x[1] and y != x for y in left.values())]
        front |= dict.fromkeys(best, n)
        left = {i: x for i, x in left.items() if i not in best}
    got = selection.pareto_fronts(spark.createDataFrame(points, df.schema), "id", ["a", "b"], ["g"]).collect()
    assert {r.id: r.front for r in got} == front


def test_sample_sizes(spark):
    df = spark.createDataFrame([(0.3,), (0.5,), (0.8,), (1.0,), (None,), (0.0,)], "d double")
    got = [r.n for r in df.select(selection.paired_t_pairs("d", 0.05 / 12, 0.8).alias("n")).collect()]
    assert got == [157, 60, 26, 18, None, None]


def test_label_components(spark):
    df = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("q", "q"), (None, "a")] + [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)], "u string, v string")
    got = {r.vertex: r.component for r in selection.label_components(df, "u", "v").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"} | {f"n{i:02d}": "n00" for i in range(13)}


def test_cluster_stability(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(10 * (i % 2), 0.5, 3)]) for i in range(60)]
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame(rows, "id int, x array<double>").select("id", array_to_vector("x").alias("x"))
    got = modelling.cluster_stability(df, "id", "x", [2], 2).first()
    assert got.stability == 1.0 and got.silhouette > 0.9 and got.smallest == 30


def test_robust_distance_finds_the_outlier(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.multivariate_normal([0, 0], [[1, 0.9], [0.9, 1]]))) for i in range(80)] + [(99, 2.0, -2.0), (100, None, 0.0)]
    got = {r.id: r.distance for r in qc.robust_distance(spark.createDataFrame(rows, "id int, a double, b double"), "id", ["a", "b"]).collect()}
    assert len(got) == 82 and max(got, key=got.get) == 99 and got[99] > 5


def test_views_edges_similarity(spark):
    a = spark.createDataFrame([("s", 1.5, 0.01), ("t", -1.0, 0.2)], "set_id string, nes double, q double")
    b = spark.createDataFrame([("s", 0.5, 0.02), ("u", 0.1, 0.001)], "set_id string, mean double, q double")
    got = {r.set_id: r for r in enrichment.integrate_views(a, b).collect()}
    assert got["s"].supported_by_both and got["s"].same_direction and not got["t"].supported_by_both and got["u"].priority == pytest.approx(3)
    u = spark.createDataFrame([(s, f"f{i}", float(i if s != "c" else -i), 1.0 * i) for s in "abc" for i in range(5)], "scenario_id string, feature_key string, statistic double, mean double")
    sim = {(r.scenario_a, r.scenario_b): r for r in robustness.scenario_similarity(u).collect()}
    assert len(sim) == 3 and sim["a", "b"].statistic_rho == pytest.approx(1) and sim["a", "c"].statistic_rho == pytest.approx(-1)


def test_tuning_calibration_and_choice(spark):
    cells = measurements(spark, features=6, entities=12, shift=4.0)
    tuned = modelling.tune(cells, evaluation.hash_folds(cells, "entity", 2, 1, 3), [{"c": 1.0, "l1": 0.5, "k": 2}])
    assert tuned.first().accuracy > 0.7
    grid = spark.createDataFrame([(1, 0.9, 1.0, 5, 0.5, 10), (1, 0.9, 0.1, 5, 0.5, 10), (1, None, 0.01, 1, 1.0, 1), (2, 0.5, 1.0, None, 0.1, 3)], "g int, accuracy double, c double, panel int, l1 double, k int")
    assert {r.g: r.c for r in evaluation.choose_setting(grid, ["g"]).collect()} == {1: 0.1, 2: 1.0}
    rows = spark.createDataFrame([(float(x), int(x + (i % 3 - 1) * 2 > 0)) for i, x in enumerate(range(-20, 20))], "score double, label int")
    p = [r.probability for r in modelling.calibrate(rows, rows).orderBy("score").collect()]
    assert p == sorted(p) and p[0] < 0.05 and p[-1] > 0.95


def _planted(spark, entities=60, features=8, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(1, entities + 1):
        for c in ("N", "T"):
            rows += [(f"F{j}", e, c, f"P{e}{c}", float(rng.normal(2.0 if c == "T" and j == 0 else 0.0, 1.0))) for j in range(features)]
    return spark.createDataFrame(rows, "feature_key string, entity bigint, cond string, sample_id string, y double")


def test_importance_baseline_and_curve(spark):
    cells = _planted(spark)
    folds = evaluation.hash_folds(cells, "entity", 3, 1, 1)
    drops = modelling.heldout_importance(cells, folds, most=8, shuffles=6).toPandas().groupby("feature_key")["drop"].mean()
    assert drops.idxmax() == "F0" and drops["F0"] > 0.1 and (drops.drop("F0").abs() < 0.1).all()
    base = modelling.outer_predictions(cells, folds, "pca", most=8)
    assert base.count() == 120
    curve = {r.parts: r for r in modelling.learning_curve(cells, folds, 2, most=8).collect()}
    assert curve[2].train_entities == 40 and curve[2].roc_auc > 0.8
    none = cells.limit(0)
    assert modelling.outer_predictions(none, folds.limit(0), "pca").count() == 0 and modelling.heldout_importance(none, folds.limit(0)).count() == 0
    with pytest.raises(ValueError):
        modelling.outer_predictions(cells, folds, "tree")


def test_view_wins_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(f, v, int(rng.integers(2)), float(rng.integers(5))) for f in range(4) for v in "ab" for _ in range(30)]
    got = {r.view: r for r in evaluation.fold_aucs(spark.createDataFrame(rows, "fold int, view string, label int, score double"), "score", "label", ["fold"], "view").collect()}
    areas = {}
    for f in range(4):
        for v in "ab":
            pos = [s for g, w, y, s in rows if (g, w, y) == (f, v, 1)]
            neg = [s for g, w, y, s in rows if (g, w, y) == (f, v, 0)]
            areas[v, f] = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    for v in "ab":
        assert got[v].least == pytest.approx(min(areas[v, f] for f in range(4))) and got[v].folds == 4
    assert got["a"].wins == sum(areas["a", f] >= areas["b", f] for f in range(4)) and got["a"].wins + got["b"].wins == 4


def test_overlap_control(spark):
    rows = [(f"F{i}", i < 30 or None, i < 25 or 190 <= i) for i in range(200)] + [(None, True, True)]
    r = evaluation.overlap_control(spark.createDataFrame(rows, "k string, a boolean, b boolean"), "k", "a", "b", 400, 1).first()
    assert (r["keys"], r.first_size, r.second_size, r.observed) == (200, 30, 35, 25)
    assert r.p == pytest.approx(1 / 401) and 3 <= r.null_median <= 8
    assert evaluation.overlap_control(spark.createDataFrame([], "k string, a boolean, b boolean"), "k", "a", "b", 5, 1).first().p == 1.0


def test_bootstrap_variance_holds_the_estimate(spark):
    pairs = _planted(spark, 80, 6).where("cond = 'T'").select("feature_key", "entity", F.col("y").alias("delta"))
    rows = {r.component: r for r in modelling.bootstrap_explained(pairs, 12, k=2).collect()}
    assert set(rows) == {1, 2} and all(r.low <= r.median <= r.high and 0 < r.explained < 1 for r in rows.values())
    assert abs(rows[1].explained - rows[1].median) < 0.1
    assert modelling.bootstrap_explained(pairs.limit(0), 2).count() == 0 and modelling.change_components(pairs.limit(0))[0].count() == 0


def test_scenario_sensitivity(spark):
    up = [("one", f"S{i}", float(10 - i)) for i in range(20)]
    down = [("two", f"S{i}", float(i - 10)) for i in range(20)]
    sets = spark.createDataFrame([("top", f"S{i}") for i in range(4)] + [("end", f"S{i}") for i in range(16, 20)], "set_id string, symbol string")
    ranking = spark.createDataFrame(up + down, "sc string, symbol string, statistic double")
    got = {(r.sc, r.set_id): r for r in enrichment.scenario_sensitivity(ranking, sets, "sc", "one", 3, 10).collect()}
    assert got["one", "top"].score > 0 > got["one", "end"].score and got["one", "top"].edge_jaccard == 1.0
    assert got["two", "top"].score < 0 and not got["two", "top"].same_direction and got["two", "top"].edge_jaccard == 1.0
    alone = enrichment.enrichment_scores(enrichment.ranked(ranking.where("sc = 'two'")), sets, 3, 10)
    assert {r.set_id: round(r.score, 9) for r in alone.collect()} == {s: round(r.score, 9) for (c, s), r in got.items() if c == "two"}


def test_polygamma_against_sums_and_known_values():
    x = np.array([0.05, 0.5, 1.0, 2.5, 7.0, 40.0, 1e5])
    assert polygamma(0, np.array([1.0, 0.5])) == pytest.approx([-0.57721566490153286, -1.9635100260214235], rel=1e-13)
    assert polygamma(1, np.array([1.0, 0.5])) == pytest.approx([math.pi**2 / 6, math.pi**2 / 2], rel=1e-13)
    assert polygamma(2, np.array([1.0])) == pytest.approx([-2.4041138063191886], rel=1e-13)
    # recurrences, and the inverse over its range
    assert polygamma(1, x) - polygamma(1, x + 1) == pytest.approx(1 / x**2, rel=1e-4) and polygamma(0, x + 1) - polygamma(0, x) == pytest.approx(1 / x, rel=1e-4)
    assert trigamma_inverse(polygamma(1, x)) == pytest.approx(x, rel=1e-9)


def test_ranks_of_large_groups(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 0.0, -1.5, 3.0, rnd.gauss(0, 1)]), i) for i in range(600)] + [("hot", 1.0, -1)] * 300
    df = spark.createDataFrame(rows, "g string, x double, _c int")
    got = average_ranks(df, "x", "r", ["g"]).collect()
    assert len(got) == len(rows)
    for r in got:
        of = [x for g, x, _ in rows if g == r.g and x is not None]
        assert (r.r, r.r_of) == ((None, None) if r.x is None else (sum(x < r.x for x in of) + (sum(x == r.x for x in of) + 1) / 2, len(of)))
    assert average_ranks(df.limit(0), "x", "r", ["g"]).count() == 0


def test_leave_one_out_tests_find_what_hangs_on_one_entity(spark):
    rnd = random.Random(6)
    rows = [(sheet, f"{sheet}{f:02d}", e, rnd.gauss(0, 0.5) + (2.0 if f == 0 else 0.0) + (9.0 if f == 1 and e == 7 else 0.0)) for sheet in "ab" for f in range(30) for e in range(12)]
    rows += [("a", "few", e, 1.0) for e in range(4)] + [("a", "a00", 99, None), (None, "x", 1, 1.0)]
    got = {r.feature_key: r for r in robustness.leave_one_out_tests(spark.createDataFrame(rows, "cohort string, feature_key string, entity int, delta double"), 10).collect()}
    assert len(got) == 60 and "few" not in got
    assert got["a00"].core and got["a00"].runs == got["a00"].retained == 12 and got["a00"].flips == 0 and got["a00"].worst_q < 0.01
    assert got["a01"].retained < 12 and got["a01"].worst_change > 0.5
    empty = spark.createDataFrame([], "cohort string, feature_key string, entity int, delta double")
    assert robustness.leave_one_out_tests(empty, 10).count() == 0
