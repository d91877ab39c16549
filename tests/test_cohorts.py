import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import cohorts, evaluation, modelling


def planted(spark, sheets=3, entities=24, features=10, seed=3, missing=0.2):
    """Cohorts without a common entity or feature; feature 0 of each is raised under T."""
    rng = np.random.default_rng(seed)
    rows = [(f"S{s}", f"S{s}F{j}", s * 1000 + e, c, float(rng.normal(2.5 if c == "T" and j == 0 else 0.0, 1.0))) for s in range(sheets) for e in range(entities) for c in "NT" for j in range(features) if rng.random() > missing]
    return spark.createDataFrame(rows, "cohort string, feature_key string, entity bigint, cond string, y double").cache()


def test_every_cohort_has_models(spark):
    cells = planted(spark)
    folds = evaluation.hash_folds(cells, "entity", 3, 1, 5, ("cohort",))
    assert evaluation.fit_transformer(cells, evaluation.hash_folds(cells, "entity", 3, 1, 5), 0.5, 0.35, 50).isEmpty()  # no feature is in half of all samples
    states = evaluation.fit_transformer(cells, folds, 0.5, 0.35, 50, by=("cohort",))
    z = evaluation.transform(cells, folds, states, ("cohort",))
    assert z.groupBy("cohort").agg(F.count_distinct("entity").alias("n")).collect() and {r.cohort: r.n for r in z.groupBy("cohort").agg(F.count_distinct("entity").alias("n")).collect()} == {f"S{s}": 24 for s in range(3)}
    for model in ("elastic_net", "svm", "pca"):
        got = cohorts.outer_predictions(cells, folds, model, most=10)
        areas = {r.cohort: r.roc_auc for r in evaluation.roc_auc(got, "score", "label", ["cohort"]).collect()}
        assert got.count() == 3 * 48 and len(areas) == 3 and (model == "pca" or min(areas.values()) > 0.7)
    drops = cohorts.heldout_importance(cells, folds, most=10).groupBy("cohort", "feature_key").agg(F.avg("drop").alias("d")).toPandas()
    assert set(drops.sort_values("d").groupby("cohort").tail(1)["feature_key"]) == {"S0F0", "S1F0", "S2F0"}
    curve = cohorts.learning_curve_scores(cells, folds, 2, most=10)
    assert curve.count() == 3 * 16 and {r.train_entities for r in curve.collect()} == {16}


def test_task_and_cluster_agree(spark):
    cells = planted(spark, sheets=2)
    folds = evaluation.hash_folds(cells, "entity", 3, 1, 5, ("cohort",))
    states = evaluation.fit_transformer(cells, folds, 0.5, 0.35, 6, by=("cohort",)).toPandas().set_index(["cohort", "outer_fold", "feature_rank"]).sort_index()
    s = cohorts.samples_of(cells.where("cohort = 'S1'").toPandas())
    for fold, train, _ in cohorts.outer_splits(s, folds.where("cohort = 'S1'").toPandas()):
        own, want = cohorts.fit_state(s, train, "abundance", 6), states.loc["S1", fold]
        assert [n[2:] for n in own.names] == list(want["feature_key"])
        assert np.allclose(own.median, want["median"]) and np.allclose(own.mean, want["mean"]) and np.allclose(own.scale, want["scale"])
    key = ["cohort", "entity", "cond"]
    small = cohorts.outer_predictions(cells, folds, most=6).toPandas().set_index(key)["score"].sort_index()
    large = cohorts.outer_predictions(cells, folds, most=6, task_cells=1).toPandas().set_index(key)["score"].sort_index()
    assert len(small) == 96 and np.abs(small - large).max() < 0.01  # MLlib ends after 50 steps


def test_solvers_reach_the_optimum():
    rng = np.random.default_rng(1)
    x, n = rng.normal(size=(60, 8)), 60
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
    w, b = cohorts.elastic_net(x, y, [0.1, 1.0, 1.0], [1.0, 0.0, 0.5], 20_000, 1e-9)
    for i, (c, l1) in enumerate([(0.1, 1.0), (1.0, 0.0), (1.0, 0.5)]):
        g = c * x.T @ (cohorts.sigmoid(x @ w[:, i] + b[i]) - y) + (1 - l1) * w[:, i]
        on = w[:, i] != 0
        assert np.allclose(g[on], -l1 * np.sign(w[on, i]), atol=1e-4) and (np.abs(g[~on]) <= l1 + 1e-4).all()
    v, a = cohorts.linear_svm(x, y, 1.0)
    s = 2 * y - 1
    assert np.allclose(v - 2 * x.T @ (s * np.maximum(0, 1 - s * (x @ v + a))), 0, atol=1e-6)
    with pytest.raises(ValueError):
        cohorts.fit_state(cohorts.Samples(np.arange(2), np.array(["N", "T"]), np.array([0, 1]), np.array(["F"]), np.ones((2, 1))), np.arange(2), "sound", 5)


def test_shares_are_of_training_samples(spark):
    cells = planted(spark, 1)
    assert modelling.MAX_FEATURES == 500
    s = cohorts.samples_of(cells.toPandas())
    state = cohorts.fit_state(s, np.arange(len(s.label)), "combined", 100)
    assert {n[:2] for n in state.names} == {"A:", "D:"} and len(state.names) == 20
    z = cohorts.apply_state(s, state, np.arange(len(s.label)))
    assert np.allclose(z.mean(axis=0), 0) and np.allclose(z.std(axis=0), 1)


def test_every_cohort_has_components(spark):
    pairs = planted(spark, missing=0.0).where("cond = 'T'").select("cohort", "feature_key", "entity", F.col("y").alias("delta")).where("feature_key not like '%F9' or entity % 1000 <> 3")
    assert modelling.change_components(pairs, 0.5)[0].isEmpty()  # no feature is in half of all entities
    got, k = cohorts.change_components(pairs, k=4).toPandas(), {"cohort", "component"}
    assert got.groupby("cohort").size().to_dict() == {"S0": 24, "S1": 24, "S2": 24}
    _, z = cohorts.robust_matrix(pairs.where("cohort = 'S1'").toPandas(), 1.0, 500, 5.0)
    assert z.shape == (24, 9)  # F9 isn't in all entities
    want = np.linalg.svd(z, full_matrices=False)
    own = np.array(got[got["cohort"] == "S1"].sort_values("entity")["scores"].tolist())
    assert np.allclose(np.abs(own), np.abs((want[0] * want[1])[:, :4]))
    spread = cohorts.bootstrap_explained(pairs, 40, k=4).toPandas()
    assert k <= set(spread.columns) and len(spread) == 12 and (spread["low"] <= spread["median"]).all() and (spread["median"] <= spread["high"]).all()
    assert np.allclose(spread[spread["cohort"] == "S1"].sort_values("component")["explained"], (want[1] ** 2 / (want[1] ** 2).sum())[:4])
    large = cohorts.change_components(pairs.where("cohort = 'S1'"), k=4, task_cells=1).toPandas().sort_values("entity")
    assert np.allclose(np.abs(np.array(large["scores"].tolist())), np.abs(own), atol=1e-6)


def test_cohorts_without_a_usable_feature_are_left_out(spark):
    cells = planted(spark, 2, 12)
    cells = cells.where("cohort = 'S0' or feature_key = 'S1F' || entity % 10")  # every feature of S1 is in a tenth of its samples
    folds = evaluation.hash_folds(cells, "entity", 3, 1, 5, ("cohort",))
    assert {r.cohort for r in cohorts.outer_predictions(cells, folds).collect()} == {"S0"}
    pairs = cells.where("cond = 'T'").withColumnRenamed("y", "delta")
    assert {r.cohort for r in cohorts.change_components(pairs, 0.5).collect()} == {r.cohort for r in cohorts.bootstrap_explained(pairs, 5, 0.5).collect()} == {"S0"}


def test_nested_results_of_every_view_and_model(spark):
    cells = planted(spark, 1, 12, 5)
    folds = evaluation.hash_folds(cells, "entity", 3, 1, 5, ("cohort",))
    got = cohorts.nested_results(cells, folds, False, inner=3).toPandas()
    assert got.groupby(["view", "model"]).size().to_dict() == {(v, m): 24 for v in ("abundance", "detection", "combined") for m in ("elastic_net", "svm")}
    grid = cohorts.nested_results(cells, folds, True, ("abundance",), inner=3).toPandas()
    assert grid.groupby("model").size().to_dict() == {"elastic_net": 3 * 28, "svm": 3 * 21} and (grid.groupby(["outer_fold", "model"])["chosen"].sum() == 1).all()
    part = grid[grid["model"] == "elastic_net"]
    assert (part[part["chosen"]].set_index("outer_fold")["accuracy"] == part.groupby("outer_fold")["accuracy"].max()).all()


def test_every_setting_of_a_grid_is_settled():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(57, 100)), np.arange(57) % 2
    x[:, 0] += y
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    w, b = cohorts.fit_grid("elastic_net", x, y, cohorts.GRIDS["elastic_net"])
    for i, (c, l1, _) in enumerate(cohorts.GRIDS["elastic_net"]):
        g = (x.T @ (cohorts.sigmoid(x @ w[:, i] + b[i]) - y) + (1 - l1) / c * w[:, i]) / 57
        off = np.where(w[:, i] != 0, np.abs(g + l1 / c / 57 * np.sign(w[:, i])), np.maximum(np.abs(g) - l1 / c / 57, 0))
        assert off.max() < 1e-8, (c, l1)  # 3,000 proximal steps of the whole grid ended before C = 100 was settled
    v, a = cohorts.fit_grid("svm", x, y, cohorts.GRIDS["svm"])
    for i, (c, _, k) in enumerate(cohorts.GRIDS["svm"]):
        one = cohorts.linear_svm(x[:, :k], y, c)
        assert np.allclose(v[:k, i], one[0], atol=1e-8) and abs(a[i] - one[1]) < 1e-8 and not v[k:, i].any()


def test_nested_predictions_are_of_settled_fits(monkeypatch):
    rng = np.random.default_rng(5)
    y = rng.normal(size=(60, 80)) + 0.8 * (np.arange(60) % 2)[:, None] * (np.arange(80) < 3)
    s = cohorts.Samples(np.arange(60) // 2, np.array(["N", "T"] * 30), np.arange(60) % 2, np.array([f"F{j:02d}" for j in range(80)]), y)
    folds = pd.DataFrame({"entity": range(30), "outer_fold": np.arange(30) % 3})
    monkeypatch.setitem(cohorts.GRIDS, "elastic_net", [(100.0, 0.9, 100)])
    probability = {}
    for fold, _, _, test, p, _ in cohorts.nested(s, folds, 0, "abundance", ("elastic_net",), 3, 43, False):
        probability[fold] = (test, p)
    assert len(probability) == 3
    for fold, train, test in cohorts.outer_splits(s, folds):
        state = cohorts.fit_state(s, train, "abundance", 100)
        x, label = cohorts.apply_state(s, state, train), s.label[train]
        a, share, penalty = np.column_stack([x, np.ones(len(x))]), np.array([0.9]), np.array([1 / (100 * len(x))])
        w = cohorts.proximal_steps(a, label.astype(float), penalty, share, np.zeros((len(state.names) + 1, 1)), 200_000, 1e-10)
        want = cohorts.sigmoid(cohorts.apply_state(s, state, test) @ w[:-1, 0] + w[-1, 0])
        assert np.array_equal(test, probability[fold][0]) and np.abs(want - probability[fold][1]).max() < 1e-5


def inner_rows(rng, shift, n=48, p=30):
    """Rows of three inner folds of 24 pairs, 3 of p features being raised by shift."""
    x, label, fold = rng.normal(size=(n, p)), np.arange(n) % 2, np.arange(n) // 2 % 3
    x[:, :3] += shift * label[:, None]
    return label, [(x[fold != k], label[fold != k], x[fold == k], np.flatnonzero(fold == k)) for k in range(3)]


def test_bounded_tuning_chooses_as_the_whole_grid(monkeypatch):
    rng, fits = np.random.default_rng(6), []
    each = cohorts.fit_grids
    monkeypatch.setattr(cohorts, "fit_grids", lambda model, jobs: fits.append(sum(len(j[2]) for j in jobs)) or each(model, jobs))
    met = set()
    for shift in (0.0, 0.0, 0.5, 1.0, 4.0):
        label, rows = inner_rows(rng, shift)
        for model, size in (("elastic_net", 28), ("svm", 21)):
            (whole,), (some,) = cohorts.judge_grids(model, [rows], label, True), cohorts.judge_grids(model, [rows], label, False)
            assert whole.best == some.best and np.allclose(whole.oof[:, whole.best], some.oof[:, some.best], atol=1e-7)
            assert not np.isnan(whole.oof).any() and abs(whole.accuracy()[whole.best] - some.top) < 1e-9
            met.add(cohorts.GRIDS[model][some.best])
            assert shift < 4 or sum(fits[1:]) < 3 * size  # clear cases end before the whole grid is fitted
            assert fits[0] == 3 * size
            fits.clear()
    assert len(met) > 3


def test_fits_side_by_side_are_those_of_one(monkeypatch):
    rng = np.random.default_rng(7)
    sizes = [(40, 12), (57, 30), (31, 45)]
    jobs = [(x, np.arange(n) % 2) for n, p in sizes for x in [rng.normal(size=(n, p)) + 0.4 * (np.arange(n) % 2)[:, None]]]
    for model in ("elastic_net", "svm"):
        grid = cohorts.GRIDS[model]
        all_ = cohorts.fit_grids(model, [(x, y, grid, {}) for x, y in jobs])
        monkeypatch.setattr(cohorts, "BATCH_VALUES", 1)
        for (x, y), (w, b) in zip(jobs, all_):
            v, a = cohorts.fit_grid(model, x, y, grid)
            assert w.shape == (x.shape[1], len(grid)) and np.allclose(w, v, atol=1e-6) and np.allclose(b, a, atol=1e-6)
            for i, (c, l1, k) in enumerate(grid if model == "elastic_net" else ()):
                g = x.T @ (cohorts.sigmoid(x @ w[:, i] + b[i]) - y) / len(x) + (1 - l1) / c / len(x) * w[:, i]
                assert np.where(w[:, i] != 0, np.abs(g + l1 / c / len(x) * np.sign(w[:, i])), np.abs(g) - l1 / c / len(x)).max() < 1e-8, (c, l1)
        monkeypatch.undo()


def test_large_cohorts_go_fold_by_fold(monkeypatch):
    label, rows = inner_rows(np.random.default_rng(8), 1.0)
    y = np.zeros((48, 30))
    for _, _, z, at in rows:
        y[at] = z
    s = cohorts.Samples(np.arange(48) // 2, np.array(["N", "T"] * 24), label, np.array([f"F{j:02d}" for j in range(30)]), y)
    folds = pd.DataFrame({"entity": range(24), "outer_fold": np.arange(24) % 3})
    row = lambda r: (r[1], r[0], r[3].tolist(), np.round(r[4], 6).tolist(), round(r[5], 6))
    want = sorted(map(row, cohorts.nested(s, folds, 0, "abundance", ("elastic_net", "svm"), 3, 43, False)))
    monkeypatch.setattr(cohorts, "BATCH_VALUES", 1)
    assert len(want) == 6 and want == sorted(map(row, cohorts.nested(s, folds, 0, "abundance", ("elastic_net", "svm"), 3, 43, False)))
