"""Models of cohorts: each cohort's samples are judged against each other only, and all fits of a cohort run inside one task."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.operators import modelling
from tarnwork.operators.evaluation import LeakageError
from tarnwork.operators.qc import MAD_SCALE
from tarnwork.session import stage

TASK_CELLS = 5_000_000
CUT = 1e-8
BATCH_VALUES = 2_000_000


class Samples(NamedTuple):
    """A cohort in one task: y has NaN where a feature has no value."""

    entity: np.ndarray
    cond: np.ndarray
    label: np.ndarray
    features: np.ndarray
    y: np.ndarray


class State(NamedTuple):
    names: np.ndarray
    column: np.ndarray
    median: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    detected: np.ndarray


def samples_of(f: pd.DataFrame) -> Samples:
    f = f[f["cond"].isin(["N", "T"]) & f["entity"].notna()]
    wide = f.groupby(["entity", "cond", "feature_key"])["y"].max().unstack().sort_index().sort_index(axis=1)
    cond = wide.index.get_level_values("cond").to_numpy(str)
    return Samples(wide.index.get_level_values("entity").to_numpy(np.int64), cond, (cond == "T").astype(int), wide.columns.to_numpy(str), wide.to_numpy(float))


def medians(y: np.ndarray) -> np.ndarray:
    """The median of each column's values, of which it has one at least."""
    n = (~np.isnan(y)).sum(axis=0)
    y = np.sort(y, axis=0)  # NaN last
    return (np.take_along_axis(y, (n - 1)[None] // 2, 0)[0] + np.take_along_axis(y, n[None] // 2, 0)[0]) / 2


def fit_state(s: Samples, train: np.ndarray, view: str, most: int, order: str = "score", least_observed: float = 0.5, least_class: float = 0.35, parts: dict | None = None) -> State:
    """What evaluation.fit_transformer says of one fold, for the view abundance (names A:), detection (D:) or combined: detection takes
    features that some but not all training samples have. order is score or scale. parts keeps what views of the same fold have in common."""
    if view not in ("abundance", "detection", "combined"):
        raise ValueError(f"unknown view {view}")
    rows, parts = [], {} if parts is None else parts
    for kind in [k for k in "AD" if view != {"A": "detection", "D": "abundance"}[k]]:
        if kind not in parts:
            parts[kind] = state_part(s, train, kind, order, least_observed, least_class)
        rows.append(parts[kind])
    col = [np.concatenate(c) for c in zip(*rows)]
    first = np.lexsort((col[2], col[1], col[0]))[:most]
    _, detected, _, at, median, mean, scale = (c[first] for c in col)
    return State(np.array([("D:" if d else "A:") + f for d, f in zip(detected.tolist(), s.features[at].tolist())], str), at, median, mean, scale, detected)


def state_part(s: Samples, train: np.ndarray, kind: str, order: str, least_observed: float, least_class: float) -> tuple[np.ndarray, ...]:
    """(mark, detected, rank of the name, place, median, mean, scale) of the eligible features of one kind, the best having the least mark."""
    t, y = s.label[train] == 1, s.y[train]
    seen, size = ~np.isnan(y), np.array([t.sum(), len(t) - t.sum()])
    of = np.array([t, ~t], float) @ seen  # samples of T and N that have the feature
    part, share = of / np.maximum(size, 1)[:, None], of.sum(axis=0) / max(len(t), 1)
    if kind == "D":
        at = np.flatnonzero((share > 0) & (share < 1))
        median, mean, scale, means = np.zeros(len(at)), share[at], np.sqrt(share[at] * (1 - share[at])), part[:, at]
    else:
        at = np.flatnonzero((share >= least_observed) & (part >= least_class).all(axis=0) & (share > 0))
        median = medians(y[:, at]) if len(at) else np.zeros(0)
        filled = np.where(seen[:, at], y[:, at], median)
        mean, scale, means = filled.mean(axis=0), filled.std(axis=0), np.array([t, ~t], float) @ filled / np.maximum(size, 1)[:, None]
    gap = np.abs(means[0] - means[1]) if size.all() else np.zeros(len(at))
    some = scale > 1e-9
    at, median, mean, scale, gap = at[some], median[some], mean[some], scale[some], gap[some]
    return -np.round(gap / scale if order == "score" else scale, 9), np.full(len(at), kind == "D"), np.argsort(np.argsort(s.features))[at], at, median, mean, scale


def apply_state(s: Samples, state: State, at: np.ndarray) -> np.ndarray:
    y = s.y[at[:, None], state.column]
    missing = np.isnan(y)
    return (np.where(state.detected, ~missing, np.where(missing, state.median, y)) - state.mean) / state.scale


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -500, 500)))


def elastic_net(x: np.ndarray, label: np.ndarray, c: list[float], l1: list[float], steps: int = 3000, tol: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(features x settings, intercepts) of C sum(log loss) + l1 |w| + (1 - l1) w² / 2, the intercept free (see elastic_nets)."""
    return elastic_nets([(x, label, [(g, r, x.shape[1]) for g, r in zip(c, l1)], {})], steps, tol)[0]


def elastic_nets(jobs: list[tuple], steps: int = 3000, tol: float = 1e-5) -> list[tuple[np.ndarray, np.ndarray]]:
    """elastic_net of every job (rows, labels, settings (C, l1, first features), last): Newton steps over the weights that are or should be other than
    0, from the solution of the next smaller C, for which last keeps the latest one between calls with the same rows, all jobs at once; what these
    leave open goes on by proximal steps (see proximal_steps)."""
    out, todo, width, most = [], {}, max(x.shape[1] for x, *_ in jobs) + 1, max(len(x) for x, *_ in jobs)
    for j, (x, label, settings, last) in enumerate(jobs):
        n, none, rate = len(x), np.zeros(width), np.clip(label.mean(), CUT, 1 - CUT)
        none[-1] = np.log(rate / (1 - rate))
        if "slopes" not in last:
            last["slopes"] = np.abs(x.T @ (rate - label)) / n
        slopes = last["slopes"]
        out.append(np.repeat(none[:, None], len(settings), axis=1))
        for i, (c, l1, k) in enumerate(settings):
            if l1 / (c * n) < slopes[:k].max(initial=0.0) or not 0 < label.sum() < n:  # else a penalty that leaves every weight at 0
                todo.setdefault((c, l1 < 0.5, k), []).append((j, i, l1))  # a small l1 leaves many weights: larger steps
    for (c, _, k), group in sorted(todo.items(), key=lambda g: g[0]):
        some = max(1, BATCH_VALUES // (width * most))
        for part in (group[i : i + some] for i in range(0, len(group), some)):
            share, penalty = np.array([l1 for *_, l1 in part]), np.array([1 / (c * len(jobs[j][0])) for j, *_ in part])
            a, y, weight, start = (np.zeros((len(part), *size)) for size in ((width, most), (most,), (most,), (width,)))  # the intercept comes last
            for r, (j, i, l1) in enumerate(part):
                x, label, _, last = jobs[j]
                n, before = len(x), last.get((l1, k), out[j][:, i])
                a[r, : min(k, x.shape[1]), :n], a[r, -1, :n], y[r, :n], weight[r, :n] = x.T[:k], 1.0, label, 1 / n
                start[r, : len(before) - 1], start[r, -1] = before[:-1], before[-1]
            w, settled = newton_steps(a, y, weight, penalty * share, penalty * (1 - share), start)
            for (j, i, l1), own, penal, done in zip(part, w, penalty, settled):
                x, label = jobs[j][:2]
                p = min(k, x.shape[1])
                if not done:
                    full = proximal_steps(np.column_stack([x[:, :p], np.ones(len(x))]), label.astype(float), np.array([penal]), np.array([l1]), own[[*range(p), -1], None], steps, tol)[:, 0]
                    own = np.concatenate([full[:p], np.zeros(width - 1 - p), full[p:]])
                out[j][:, i] = own
                jobs[j][3][l1, k] = np.append(own[: x.shape[1]], own[-1])
    return [(w[: x.shape[1]], w[-1]) for (x, *_), w in zip(jobs, out)]


def newton_steps(a: np.ndarray, y: np.ndarray, weight: np.ndarray, lasso: np.ndarray, ridge: np.ndarray, w: np.ndarray, steps: int = 100, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(weights, did they settle) of the weighted log loss + lasso |w| + ridge w² / 2 of every fit, the last weight being the free intercept. a is
    fits x weights x samples; rows and samples that a fit lacks are 0.

    A step solves for the weights that are not 0 and those at 0 whose slope is more than half as far over lasso as the farthest, each kept
    on its side of 0; one that would leave 0 to the wrong side stays there. Settled: no slope is off by more than tol.
    """
    out, settled, live, turned = w.copy(), np.zeros(len(w), bool), np.arange(len(w)), 1 - 2 * y
    loss = lambda m, v, on: (np.logaddexp(0, turned[on] * m) * weight[on]).sum(axis=1) + lasso[on] * np.abs(v).sum(axis=1) + 0.5 * ridge[on] * np.square(v).sum(axis=1)
    m = (w[:, None] @ a)[:, 0]
    now = loss(m, w[:, :-1], slice(None))
    for _ in range(steps):
        q = sigmoid(m)
        g = (a @ ((q - y) * weight)[:, :, None])[:, :, 0]
        g[:, :-1] += ridge[:, None] * w[:, :-1]
        there, side, bound = w != 0, np.sign(w), np.repeat(lasso[:, None], w.shape[1], axis=1)
        there[:, -1], side[:, -1], bound[:, -1] = True, 0.0, 0.0
        off = np.abs(g + bound * side)
        over = np.where(there, 0.0, off - bound)
        worst = over.max(axis=1)
        open_ = np.maximum(worst, np.where(there, off, 0.0).max(axis=1)) > tol
        ended = ~open_ & ~settled[live]
        out[live[ended]], settled[live[ended]] = w[ended], True
        open_ &= ~settled[live]
        if not open_.any():
            break
        if 2 * open_.sum() <= len(open_):  # until then copies cost more than steps that nobody needs
            live, a, y, weight, turned, lasso, ridge, w, m, now, q, g, there, side, bound, over, worst = (v[open_] for v in (live, a, y, weight, turned, lasso, ridge, w, m, now, q, g, there, side, bound, over, worst))
        use = there | (over > np.maximum(worst / 2, tol)[:, None])
        count = use.sum(axis=1)
        at = np.argsort(~use, axis=1, kind="stable")[:, : count.max()]
        valid, free, each = np.arange(at.shape[1]) < count[:, None], at == a.shape[1] - 1, np.arange(len(at))[:, None]
        some, old = a[each, at] * valid[:, :, None], w[each, at]
        f, s = g[each, at], side[each, at]
        s = np.where(free | ~valid, 0.0, np.where(old != 0, s, -np.sign(f)))
        f = (f + bound[each, at] * s) * valid
        h = (some * (q * (1 - q) * weight)[:, None]) @ some.transpose(0, 2, 1)
        diagonal = np.arange(at.shape[1])
        h[:, diagonal, diagonal] += np.where(valid, np.where(free, 0.0, ridge[:, None]) + 1e-13, 1.0)
        try:
            d, wrong = np.linalg.solve(h, -f[:, :, None])[:, :, 0], np.arange(len(h))
            while True:
                left = (old[wrong] == 0) & (d[wrong] * s[wrong] < 0)
                if not left.any():
                    break
                again = left.any(axis=1)
                wrong, left = wrong[again], left[again]
                part = np.where(left[:, :, None] | left[:, None, :], 0.0, h[wrong])
                part[:, diagonal, diagonal] += left
                f[wrong], s[wrong], h[wrong] = np.where(left, 0.0, f[wrong]), np.where(left, 0.0, s[wrong]), part
                d[wrong] = np.linalg.solve(part, -f[wrong][:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            break
        t, after, v, on, stuck = np.ones(len(at)), now.copy(), old.copy(), np.arange(len(at)), np.zeros(len(at), bool)
        while len(on):
            v[on] = old[on] + t[on, None] * d[on]
            v[on] = np.where(v[on] * s[on] < 0, 0.0, v[on])
            m[on] = (v[on][:, None] @ some[on])[:, 0]
            after[on] = loss(m[on], np.where(free[on], 0.0, v[on]), on)
            on = on[after[on] > now[on] + 1e-4 * (f[on] * (v[on] - old[on])).sum(axis=1) + 1e-14 * now[on]]
            t[on] /= 2
            stuck[on[t[on] <= 1e-12]] = True
            on = on[t[on] > 1e-12]
        fresh = np.zeros_like(w)
        np.put_along_axis(fresh, at, v, 1)
        if stuck.any():
            lost, move = stuck & ~settled[live], ~stuck
            out[live[lost]] = w[lost]
            live, a, y, weight, turned, lasso, ridge, fresh, m, after = (v[move] for v in (live, a, y, weight, turned, lasso, ridge, fresh, m, after))
        w, now = fresh, after
        if settled[live].all():
            break
    rest = ~settled[live]
    out[live[rest]] = w[rest]
    return out, settled


def proximal_steps(a: np.ndarray, label: np.ndarray, penalty: np.ndarray, share: np.ndarray, out: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """elastic_net from the weights `out`: accelerated proximal steps with restarts for all settings at once; a setting stops when a step moves it by less than tol."""
    n, p, y = len(a), a.shape[1] - 1, label[:, None]
    size = 1 / (0.25 * np.linalg.norm(a, 2) ** 2 / n + penalty * (1 - share))
    live, out = np.arange(len(share)), out.copy()
    w, v, momentum = out.copy(), out.copy(), np.ones(len(share))
    for i in range(steps):
        g = a.T @ (sigmoid(a @ v) - y) / n
        g[:p] += penalty * (1 - share) * v[:p]
        new = v - size * g
        new[:p] = np.sign(new[:p]) * np.maximum(np.abs(new[:p]) - size * penalty * share, 0)
        d = new - w
        back = ((v - new) * d).sum(axis=0) > 0
        after = np.where(back, 1.0, (1 + np.sqrt(1 + 4 * momentum**2)) / 2)
        v, w = new + np.where(back, 0.0, (momentum - 1) / after) * d, new
        momentum = after
        if i % 10 == 9:
            out[:, live] = w
            still = np.abs(d).max(axis=0) > tol * np.maximum(np.abs(w).max(axis=0), 1e-3)
            if not still.any():
                break
            if not still.all():
                live, w, v, momentum, size, penalty, share = live[still], w[:, still], v[:, still], momentum[still], size[still], penalty[still], share[still]
    out[:, live] = w
    return out


def linear_svm(x: np.ndarray, label: np.ndarray, c: float, steps: int = 100) -> tuple[np.ndarray, float]:
    """Weights and intercept of w² / 2 + C sum(max(0, 1 - margin)²), the intercept being one of the weights: Newton steps, halved until they help."""
    a, s = np.column_stack([x, np.ones(len(x))]), 2.0 * label - 1
    loss = lambda w: 0.5 * w @ w + c * np.square(np.maximum(0, 1 - s * (a @ w))).sum()
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        gap = np.maximum(0, 1 - s * (a @ w))
        on = a[gap > 0]
        g = w - 2 * c * a.T @ (s * gap)
        if np.abs(g).max() < 1e-8 * (1 + c):
            break
        d, t = np.linalg.solve(np.eye(len(w)) + 2 * c * on.T @ on, g), 1.0
        while loss(w - t * d) > loss(w) - 1e-4 * t * (g @ d) and t > 1e-10:
            t /= 2
        w = w - t * d
    return w[:-1], float(w[-1])


def linear_svms(jobs: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features x settings, intercepts) of linear_svm for every job (rows, labels, settings (C, None, first features), last): the weights are sums of
    samples, so a step (see margin_steps) solves for one number a sample, for all jobs at once, from the solution of the next smaller C."""
    out, todo, most = [(np.zeros((x.shape[1], len(settings))), np.zeros(len(settings))) for x, _, settings, _ in jobs], {}, max(len(x) for x, *_ in jobs)
    for j, (x, _, settings, _) in enumerate(jobs):
        for i, (c, _, k) in enumerate(settings):
            todo.setdefault(c, []).append((j, i, min(k, x.shape[1])))
    for c, group in sorted(todo.items()):
        some = max(1, BATCH_VALUES // most**2)
        for part in (group[i : i + some] for i in range(0, len(group), some)):
            kernel, s, alpha = np.zeros((len(part), most, most)), np.zeros((len(part), most)), np.zeros((len(part), most))
            for r, (j, _, k) in enumerate(part):
                x, label, _, last = jobs[j]
                if k not in last:
                    last[k] = x[:, :k] @ x[:, :k].T + 1, np.zeros(len(x))
                kernel[r, : len(x), : len(x)], alpha[r, : len(x)] = last[k]
                s[r, : len(x)] = 2.0 * label - 1
            alpha = margin_steps(kernel, s, c, alpha)
            for own, (j, i, k) in zip(alpha, part):
                x, last = jobs[j][0], jobs[j][3]
                last[k] = last[k][0], own[: len(x)]
                out[j][0][:k, i], out[j][1][i] = last[k][1] @ x[:, :k], own.sum()
    return out


def margin_steps(kernel: np.ndarray, s: np.ndarray, c: float, alpha: np.ndarray, steps: int = 100) -> np.ndarray:
    """The samples' numbers of every fit by Newton steps from alpha, halved until they help; a fit ends when a whole step leaves the samples within
    the margin the same. Samples that a fit lacks have s 0."""
    out, live = alpha.copy(), np.arange(len(alpha))
    m = (kernel @ alpha[:, :, None])[:, :, 0]
    room = lambda m, s: np.where(s != 0, np.maximum(0, 1 - s * m), 0.0)
    loss = lambda alpha, m, gap: 0.5 * (alpha * m).sum(axis=1) + c * np.square(gap).sum(axis=1)
    gap = room(m, s)
    now = loss(alpha, m, gap)
    for _ in range(steps):
        count = (gap > 0).sum(axis=1)
        at = np.argsort(gap <= 0, axis=1, kind="stable")[:, : count.max()]
        valid, each, diagonal = np.arange(at.shape[1]) < count[:, None], np.arange(len(at))[:, None], np.arange(at.shape[1])
        h = kernel[each[:, :, None], at[:, :, None], at[:, None]]
        if not valid.all():
            h *= valid[:, :, None] & valid[:, None]
        h[:, diagonal, diagonal] += np.where(valid, 0.5 / c, 1.0)
        new = np.zeros_like(alpha)
        np.put_along_axis(new, at, np.linalg.solve(h, (s[each, at] * valid)[:, :, None])[:, :, 0], 1)
        ahead = (kernel @ new[:, :, None])[:, :, 0]
        gap_ahead = room(ahead, s)
        open_ = ((gap_ahead > 0) != (gap > 0)).any(axis=1)
        if not open_.all():
            out[live[~open_]] = new[~open_]
            if not open_.any():
                return out
            live, kernel, s, alpha, m, gap, now, new, ahead, gap_ahead = (v[open_] for v in (live, kernel, s, alpha, m, gap, now, new, ahead, gap_ahead))
        d, move, t, after = new - alpha, ahead - m, np.ones(len(live)), loss(new, ahead, gap_ahead)
        fall = ((alpha - 2 * c * s * gap) * move).sum(axis=1)
        while (short := (after > now + 1e-4 * t * fall + 1e-13 * np.abs(now)) & (t > 1e-10)).any():
            t[short] /= 2
            new, ahead = alpha + t[:, None] * d, m + t[:, None] * move
            gap_ahead = room(ahead, s)
            after = loss(new, ahead, gap_ahead)
        alpha, m, gap, now = new, ahead, gap_ahead, after
    out[live] = alpha
    return out


def balanced_accuracy(label: np.ndarray, hit: np.ndarray) -> float:
    """Mean of the labels' shares of hits; NaN without both labels."""
    return float((hit[label == 1].mean() + hit[label == 0].mean()) / 2) if 0 < label.sum() < len(label) else float("nan")


def outer_splits(s: Samples, folds: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(fold, places of training samples, places of test samples) of one repeat; folds whose training lacks a condition make none."""
    own = dict(zip(folds["entity"], folds["outer_fold"]))
    at = np.array([own.get(e, -1) for e in s.entity])
    for k in sorted(set(at[at >= 0])):
        train, test = np.flatnonzero((at >= 0) & (at != k)), np.flatnonzero(at == k)
        if set(s.entity[train]) & set(s.entity[test]):
            raise LeakageError("an entity is in training and in test")
        if 0 < s.label[train].sum() < len(train):
            yield int(k), train, test


def fit_margins(s: Samples, train: np.ndarray, test: np.ndarray, model: str, c: float, l1: float, most: int, view: str = "abundance") -> tuple[State, np.ndarray, np.ndarray, float] | None:
    """(state, weights, test rows, intercept) of one fit; None if no feature is eligible. The test rows of pca are components."""
    state = fit_state(s, train, view, min(most, modelling.MAX_FEATURES), "scale", 0.5, 0.0) if model == "pca" else fit_state(s, train, view, most)
    if not len(state.names):
        return None
    x, z = apply_state(s, state, train), apply_state(s, state, test)
    if model == "pca":
        turn = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][: min(modelling.COMPONENTS, len(x) - 1)].T
        x, z = x @ turn, z @ turn
    if model == "svm":
        w, b = linear_svm(x, s.label[train], c)
        return state, w, z, b
    w, b = elastic_net(x, s.label[train], [c], [l1 if model == "elastic_net" else 0.0])
    return state, w[:, 0], z, float(b[0])


def in_tasks(cells: DataFrame, folds: DataFrame, work: Callable[[Samples, pd.DataFrame, int], Iterator[tuple]], columns: str) -> DataFrame:
    """The rows of work(samples, folds of the repeat, repeat) for every cohort and repeat, with cohort and repeat before them.

    cells has cohort, feature_key, entity, cond, y; folds has cohort, repeat, entity, outer_fold. One task holds one cohort.
    """
    kind = cells.schema["cohort"].dataType.simpleString()
    schema = f"cohort {kind}, repeat int, {columns}"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    repeats = folds.select("cohort", F.col("repeat").cast("bigint").cast("int").alias("repeat")).distinct()  # a column of its own, as folds is met again below
    units = cells.select("cohort", "feature_key", "entity", "cond", "y").join(repeats, "cohort")
    parts = max(1, min(repeats.count(), 10_000))

    def run(key: tuple, f: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        rows = [(key[0], int(key[1]), *r) for r in work(samples_of(f), k, int(key[1]))] if len(f) and len(k) else []
        return pd.DataFrame(rows, columns=names) if rows else pd.DataFrame()

    by = ["cohort", "repeat"]
    return units.repartition(parts, *by).groupBy(*by).cogroup(folds.select(*by, "entity", "outer_fold").repartition(parts, *by).groupBy(*by)).applyInPandas(run, schema)


def split_cohorts(cells: DataFrame, folds: DataFrame, task_cells: int) -> tuple[DataFrame, DataFrame, list]:
    """cells and folds (staged) of the cohorts that fit a task, and (cohort, cells, folds) of each larger one: at most cells / task_cells of these."""
    cells, folds = stage(cells, "cohort-cells"), stage(folds, "cohort-folds")
    large = [r.cohort for r in cells.groupBy("cohort").count().where(F.col("count") > task_cells).collect()]
    if not large:
        return cells, folds, []
    small = ~F.col("cohort").isin(large)
    return cells.where(small), folds.where(small), [(c, cells.where(F.col("cohort") == c).drop("cohort"), folds.where(F.col("cohort") == c).drop("cohort")) for c in large]


def outer_predictions(cells: DataFrame, folds: DataFrame, model: str = "elastic_net", c: float = 1.0, l1: float = 0.5, most: int = 50, task_cells: int = TASK_CELLS) -> DataFrame:
    """modelling.outer_predictions of every cohort, with cohort; cohorts of more than task_cells cells are fitted by MLlib, one after another."""
    if model not in ("elastic_net", "svm", "pca"):
        raise ValueError(f"unknown model {model}")

    def work(s: Samples, k: pd.DataFrame, repeat: int) -> Iterator[tuple]:
        for fold, train, test in outer_splits(s, k):
            if fit := fit_margins(s, train, test, model, c, l1, most):
                _, w, z, b = fit
                score = z @ w + b if model == "svm" else sigmoid(z @ w + b)
                yield from zip([fold] * len(test), s.entity[test].tolist(), s.cond[test].tolist(), s.label[test].tolist(), score.tolist())

    cells, folds, large = split_cohorts(cells, folds, task_cells)
    out = in_tasks(cells, folds, work, "outer_fold int, entity bigint, cond string, label int, score double")
    return reduce(DataFrame.unionByName, [modelling.outer_predictions(x, k, model, c, l1, most).withColumn("cohort", F.lit(name)) for name, x, k in large], out)


def seeded(*parts: object) -> np.random.Generator:
    return np.random.default_rng(int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16))


def heldout_importance(cells: DataFrame, folds: DataFrame, c: float = 1.0, l1: float = 0.5, most: int = 50, top: int = 25, shuffles: int = 5, seed: int = 1, task_cells: int = TASK_CELLS) -> DataFrame:
    """modelling.heldout_importance of every cohort, with cohort; a shuffle is drawn by a generator seeded by repeat, fold, feature and shuffle."""

    def work(s: Samples, k: pd.DataFrame, repeat: int) -> Iterator[tuple]:
        for fold, train, test in outer_splits(s, k):
            if fit := fit_margins(s, train, test, "elastic_net", c, l1, most):
                state, w, z, b = fit
                margin, label = z @ w + b, s.label[test]
                hits = lambda m: balanced_accuracy(label, (m >= 0) == (label == 1))
                for i in [i for i in sorted(range(len(w)), key=lambda i: (-abs(w[i]), i))[:top] if w[i]]:
                    drops = [hits(margin) - hits(margin + w[i] * (z[seeded(seed, repeat, fold, state.names[i], j).permutation(len(z)), i] - z[:, i])) for j in range(shuffles)]
                    yield fold, state.names[i][2:], float(w[i]), float(np.mean(drops))

    cells, folds, large = split_cohorts(cells, folds, task_cells)
    out = in_tasks(cells, folds, work, "outer_fold int, feature_key string, coefficient double, drop double")
    return reduce(DataFrame.unionByName, [modelling.heldout_importance(x, k, c, l1, most, top, shuffles, seed).withColumn("cohort", F.lit(name)) for name, x, k in large], out)


def learning_curve_scores(cells: DataFrame, folds: DataFrame, last: int, c: float = 1.0, l1: float = 0.5, most: int = 50) -> DataFrame:
    """(cohort, repeat, parts, train_entities, entity, label, score): fold 0 judged after training on folds 1..parts, for parts from 2 to last."""

    def work(s: Samples, k: pd.DataFrame, repeat: int) -> Iterator[tuple]:
        for parts in range(2, last + 1):
            some = k[k["outer_fold"] <= parts]
            for fold, train, test in outer_splits(s, some):
                if fold == 0 and (fit := fit_margins(s, train, test, "elastic_net", c, l1, most)):
                    score = sigmoid(fit[2] @ fit[1] + fit[3])
                    n = int((some["outer_fold"] > 0).sum())
                    yield from zip([parts] * len(test), [n] * len(test), s.entity[test].tolist(), s.label[test].tolist(), score.tolist())

    return in_tasks(stage(cells, "cohort-cells"), stage(folds, "cohort-folds"), work, "parts int, train_entities bigint, entity bigint, label int, score double")


def robust_matrix(f: pd.DataFrame, share: float, features: int, clip: float) -> tuple[np.ndarray, np.ndarray]:
    """(entities, centred matrix) of modelling.change_vectors for one cohort: its features in `share` of its own entities, those of largest MAD
    (ties to the larger key), missing ones the median's, scaled by median and MAD, cut at clip."""
    wide = f.groupby(["entity", "feature_key"])["delta"].max().unstack().sort_index()
    wide = wide.loc[:, wide.notna().sum() >= share * len(wide) - 1e-9]
    x = wide.to_numpy(float)
    if not x.size:
        return wide.index.to_numpy(), np.zeros((len(wide), 0))
    median = np.nanmedian(x, axis=0)
    mad = np.nanmedian(np.abs(x - median), axis=0) * MAD_SCALE
    order = sorted((i for i in range(x.shape[1]) if mad[i] > 0), key=lambda i: (mad[i], wide.columns[i]), reverse=True)[: min(features, modelling.MAX_FEATURES)]
    z = np.clip((np.where(np.isnan(x), median, x)[:, order] - median[order]) / mad[order], -clip, clip)
    return wide.index.to_numpy(), z - z.mean(axis=0)


def explained(z: np.ndarray) -> np.ndarray:
    z = z - z.mean(axis=0)
    v = np.square(np.linalg.svd(z, compute_uv=False))
    return v / v.sum() if v.sum() > 0 else np.zeros(len(v))


def split_changes(pairs: DataFrame, task_cells: int) -> tuple[DataFrame, list[tuple]]:
    """Rows of the cohorts that fit a task, spread one cohort a group, and (cohort, rows) of each larger one."""
    rows = stage(pairs.where("delta is not null").select("cohort", "feature_key", "entity", "delta"), "cohort-changes")
    counts = rows.groupBy("cohort").count().collect()
    large = [r["cohort"] for r in counts if r["count"] > task_cells]
    small = rows.where(~F.col("cohort").isin(large)) if large else rows
    return small.repartition(max(1, min(len(counts), 10_000)), "cohort"), [(c, rows.where(F.col("cohort") == c).drop("cohort")) for c in large]


def change_components(pairs: DataFrame, share: float = 1.0, features: int = 500, clip: float = 5.0, k: int = 10, task_cells: int = TASK_CELLS) -> DataFrame:
    """(cohort, entity, scores): components of change within every cohort, each turned so that its largest loading is positive; centred.

    pairs has cohort, feature_key, entity, delta. A cohort without a usable feature has no rows. Larger cohorts than task_cells go to MLlib, one after another.
    """
    rows, large = split_changes(pairs, task_cells)
    schema = f"cohort {rows.schema['cohort'].dataType.simpleString()}, entity {rows.schema['entity'].dataType.simpleString()}, scores array<double>"

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        entities, z = robust_matrix(f, share, features, clip)
        turn = np.linalg.svd(z, full_matrices=False)[2][: min(k, z.shape[1])].T if z.size else np.zeros((0, 0))
        turn = turn * np.array([np.sign(t[np.abs(t).argmax()]) for t in turn.T]) if turn.size else turn
        return pd.DataFrame({"cohort": [key[0]] * len(entities), "entity": entities, "scores": list((z @ turn).tolist())}) if turn.size else pd.DataFrame()

    out = rows.groupBy("cohort").applyInPandas(run, schema)
    for name, x in large:
        scores = stage(modelling.change_components(x, share, features, clip, k)[0], "cohort-scores")
        mean = scores.select(F.posexplode("scores").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda m: m["v"]).alias("m"))
        out = out.unionByName(scores.join(F.broadcast(mean)).select(F.lit(name).alias("cohort"), "entity", F.zip_with("scores", "m", lambda a, b: a - b).alias("scores")))
    return out


def bootstrap_explained(pairs: DataFrame, resamples: int = 200, share: float = 1.0, features: int = 500, clip: float = 5.0, k: int = 10, seed: int = 1, task_cells: int = TASK_CELLS) -> DataFrame:
    """(cohort, component, explained, low, median, high): shares of every cohort's components with their 2.5, 50 and 97.5 percentiles over
    resamples of its entities, drawn with replacement. Larger cohorts than task_cells go to MLlib, one after another."""
    rows, large = split_changes(pairs, task_cells)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        _, z = robust_matrix(f, share, features, clip)
        names = ["cohort", "component", "explained", "low", "median", "high"]
        if not z.size:
            return pd.DataFrame()
        rng, n = seeded(seed, key[0]), len(z)
        drawn = np.array([explained(z[rng.integers(0, n, n)])[:k] for _ in range(resamples)])
        low, middle, high = np.quantile(drawn, [0.025, 0.5, 0.975], axis=0)
        whole = explained(z)[:k]
        return pd.DataFrame(list(zip([key[0]] * len(whole), range(1, len(whole) + 1), whole, low, middle, high)), columns=names)

    out = rows.groupBy("cohort").applyInPandas(run, f"cohort {rows.schema['cohort'].dataType.simpleString()}, component int, explained double, low double, median double, high double")
    return reduce(DataFrame.unionByName, [modelling.bootstrap_explained(x, resamples, share, features, clip, k, seed).withColumn("cohort", F.lit(name)) for name, x in large], out)


C_GRID = (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
GRIDS = {"elastic_net": [(c, l1, 100) for c in C_GRID for l1 in (0.1, 0.5, 0.9, 1.0)], "svm": [(c, None, k) for c in C_GRID for k in (25, 50, 100)]}


def best_cut(probability: np.ndarray, label: np.ndarray) -> float:
    """Of 0.5, the probabilities and the middles between them the threshold of best balanced accuracy, then nearest 0.5, then largest."""
    seen = np.unique(probability)
    tried = np.unique(np.concatenate([[0.5], seen, (seen[:-1] + seen[1:]) / 2]))
    below = lambda y: np.searchsorted(np.sort(probability[label == y]), tried) / max((label == y).sum(), 1)
    return max(zip(np.round((1 - below(1) + below(0)) / 2, 12).tolist(), (-np.abs(tried - 0.5)).tolist(), tried.tolist()))[2]


def fit_grid(model: str, x: np.ndarray, label: np.ndarray, grid: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(features x settings, intercepts) of a grid; a setting of k features has zeros after the first k."""
    return fit_grids(model, [(x, label, grid, {})])[0]


def fit_grids(model: str, jobs: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    """fit_grid of every job (rows, labels, grid, last), all at once; last is a dict of the solutions to start from."""
    if model != "svm":
        return elastic_nets(jobs)
    narrow = {j: [i for i, g in enumerate(grid) if len(x) > 4 * g[2]] for j, (x, _, grid, _) in enumerate(jobs)}
    out = linear_svms([(x, label, [g for g in grid if len(x) <= 4 * g[2]], last) for x, label, grid, last in jobs])
    for j, at in narrow.items():
        if at:
            x, label, grid, _ = jobs[j]
            w, b, rest = np.zeros((x.shape[1], len(grid))), np.zeros(len(grid)), [i for i in range(len(grid)) if i not in at]
            w[:, rest], b[rest] = out[j]
            for i in at:
                w[: grid[i][2], i], b[i] = linear_svm(x[:, : grid[i][2]], label, grid[i][0])
            out[j] = w, b
    return out


class Surface:
    """What is known of a grid's settings over inner folds, `rows` being their (training rows, labels, held-out rows, places)."""

    def __init__(self, grid: list[tuple], rows: list[tuple], label: np.ndarray):
        self.grid, self.rows = grid, rows
        self.oof, self.panels, self.last = np.full((len(label), len(grid)), np.nan), np.zeros((len(rows), len(grid))), [{} for _ in rows]
        self.both = np.array([0 < label[judged].sum() < len(judged) for *_, judged in rows])
        self.marks, self.times = np.where(self.both[:, None], np.ones(len(grid)), 0.0), int(self.both.sum())  # 1 until it is known
        self.best, self.top, self.order, self.open = -1, -np.inf, list(range(len(rows))), np.zeros(0, int)
        sides = [label[judged] == 1 for *_, judged in rows]
        self.truth, self.sides = [t[:, None] for t in sides], [np.array([t, ~t], float) for t in sides]

    def accuracy(self) -> np.ndarray:
        """At most, as far as folds are still to come."""
        return self.marks.sum(axis=0) / self.times if self.times else np.full(len(self.grid), -1.0)

    def narrow(self) -> None:
        if len(self.open) and self.best >= 0:
            self.open = self.open[np.round(self.accuracy()[self.open], 12) > self.top]

    def learn(self, j: int, w: np.ndarray, b: np.ndarray) -> None:
        _, _, unseen, judged = self.rows[j]
        self.oof[judged[:, None], self.open] = m = unseen @ w + b
        if self.both[j]:
            t, n = self.sides[j] @ ((m >= 0) == self.truth[j]), self.sides[j].sum(axis=1)
            self.marks[j, self.open] = (t[0] / n[0] + t[1] / n[1]) / 2
        self.panels[j, self.open] = (np.abs(w) > 1e-12).sum(axis=0)

    def choose(self) -> None:
        """The best accuracy, then least C, panel, largest l1, least k, of the open settings and the best so far, which has a smaller C."""
        self.narrow()
        if len(self.open):
            accuracy, panel = np.round(self.accuracy(), 12), self.panels.mean(axis=0)
            self.best = min(self.open.tolist(), key=lambda i: (-accuracy[i], self.grid[i][0], panel[i], -(self.grid[i][1] or 0), self.grid[i][2]))
            self.top, self.order = accuracy[self.best], sorted(self.order, key=lambda j: self.marks[j, self.best])  # others err where it errs


def judge_grids(model: str, folds: list[list[tuple]], label: np.ndarray, whole: bool) -> list[Surface]:
    """The surface of every outer fold's inner folds (see Surface). If not whole, settings are met by C, and one that would not be chosen with
    every held-out sample right in the folds still to come isn't fitted in these: the choice and its held-out scores are those of the whole grid,
    the rest of the surface isn't."""
    grid = GRIDS[model]
    out = [Surface(grid, rows, label) for rows in folds]
    for c in [None] if whole else sorted({g[0] for g in grid}):
        for x in out:
            x.open = np.array([i for i, g in enumerate(grid) if (whole or g[0] == c) and x.top < 1], int)
        steps = max(len(x.rows) for x in out)
        for at in [range(steps)] if out[0].best < 0 else [[i] for i in range(steps)]:
            for x in out:
                x.narrow()
            met = [(x, j) for x in out if len(x.open) for j in [x.order[i] for i in at if i < len(x.rows)]]
            fits = fit_grids(model, [(*x.rows[j][:2], [grid[i] for i in x.open], x.last[j]) for x, j in met]) if met else []
            for (x, j), (w, b) in zip(met, fits):
                x.learn(j, w, b)
        for x in out:
            x.choose()
    return out


def nested(s: Samples, folds: pd.DataFrame, repeat: int, view: str, models: tuple[str, ...], inner: int, seed: int, tuning: bool, parts: dict | None = None) -> Iterator[tuple]:
    """(fold, model, surface, test, probability, threshold) of every outer fold and model: the grid is judged over inner folds of the training
    entities, and the chosen setting (see judge_grids), its threshold and, for svm, its calibration judge the test samples; with tuning the surface of
    the whole grid is worked out instead. Folds, states and rows are the same for all models, and fits of several folds go side by side.
    parts keeps what states of several views have in common."""
    outer, most, parts = [], max(g[2] for m in models for g in GRIDS[m]), {} if parts is None else parts
    for fold, train, test in outer_splits(s, folds):
        order = sorted(set(s.entity[train].tolist()), key=lambda e: (hashlib.md5(f"{e}:{repeat * 1009 + seed}:{fold}".encode()).hexdigest(), e))
        dealt = {"entity": order, "outer_fold": [i % inner for i in range(len(order))]}
        state = fit_state(s, train, view, most, parts=parts.setdefault((fold, None), {}))
        if not len(state.names):
            continue
        rows = []
        for k, fit, judged in outer_splits(s, pd.DataFrame(dealt)):
            own = fit_state(s, fit, view, most, parts=parts.setdefault((fold, k), {}))
            if len(own.names):
                z = apply_state(s, own, np.concatenate([fit, judged]))
                rows.append((z[: len(fit)], s.label[fit], z[len(fit) :], judged))
        if rows:
            outer.append((fold, train, test, state, rows))
        if sum(x.size + z.size for *_, rows in outer for x, _, z, _ in rows) > 5 * BATCH_VALUES:
            yield from tuned(s, outer, models, tuning)
            outer = []
    yield from tuned(s, outer, models, tuning)


def tuned(s: Samples, outer: list[tuple], models: tuple[str, ...], tuning: bool) -> Iterator[tuple]:
    """The rows of nested for outer folds (fold, train, test, state, inner folds), all of which are in memory."""
    for model in models if outer else ():
        grid, judged = GRIDS[model], judge_grids(model, [rows for *_, rows in outer], s.label, tuning)
        if tuning:
            for (fold, _, test, *_), own in zip(outer, judged):
                accuracy, panel = own.accuracy(), own.panels.mean(axis=0)
                yield fold, model, [(*g, float(accuracy[i]) if own.times else None, float(panel[i]), i == own.best) for i, g in enumerate(grid)], test, None, None
            continue
        final = fit_grids(model, [(apply_state(s, state, train), s.label[train], [grid[own.best]], {}) for (_, train, _, state, _), own in zip(outer, judged)])
        known = [(own.oof[train, own.best], s.label[train]) for (_, train, *_), own in zip(outer, judged)]
        known = [(out[there], label[there]) for out, label in known for there in [~np.isnan(out)]]
        scores = [apply_state(s, state, test) @ w[:, 0] + b[0] for (_, _, test, state, _), (w, b) in zip(outer, final)]
        if model == "svm":
            turns = elastic_nets([(out[:, None], label, [(1.0, 0.0, 1)], {}) for out, label in known], 20_000, 1e-8)
            known = [(out * w[0, 0] + b[0], label) for (out, label), (w, b) in zip(known, turns)]
            scores = [score * w[0, 0] + b[0] for score, (w, b) in zip(scores, turns)]
        cut = lambda m: np.clip(sigmoid(m), CUT, 1 - CUT)
        for (fold, _, test, *_), (out, label), score in zip(outer, known, scores):
            yield fold, model, None, test, cut(score), best_cut(cut(out), label)


def nested_results(cells: DataFrame, folds: DataFrame, tuning: bool, views: tuple[str, ...] = ("abundance", "detection", "combined"), models: tuple[str, ...] = ("elastic_net", "svm"), inner: int = 5, seed: int = 43) -> DataFrame:
    """Every cohort, repeat, outer fold, view and model: with tuning the grid (c, l1, k, accuracy, panel, chosen), else the held-out samples'
    probability and the threshold, both of the setting chosen inside the fold. One task holds a cohort."""

    def work(s: Samples, k: pd.DataFrame, repeat: int) -> Iterator[tuple]:
        parts: dict = {}
        for view in views:
            for fold, model, surface, test, probability, threshold in nested(s, k, repeat, view, models, inner, seed, tuning, parts):
                if tuning:
                    yield from ((fold, view, model, *r) for r in surface)
                else:
                    yield from ((fold, view, model, int(s.entity[i]), str(s.cond[i]), int(s.label[i]), float(p), threshold) for i, p in zip(test, probability))

    columns = "c double, l1 double, k int, accuracy double, panel double, chosen boolean" if tuning else "entity bigint, cond string, label int, score double, threshold double"
    return in_tasks(stage(cells, "cohort-cells"), stage(folds, "cohort-folds"), work, f"outer_fold int, view string, model string, {columns}")
