"""Missing values filled from similar rows, by models with group and time effects; every filled cell is marked."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.joins import HEAVY_ROWS, join_null_safe, join_weighted
from tarnwork.session import stage

ROUNDS = 8
SETTLED = 1e-2  # change of the fitted effects, against their noise, at which the rounds end


def _levels(group: list[str]) -> Column:
    return F.lit(True) if not group else ~F.greatest(*[F.col(g).isNull().cast("int") for g in group], F.lit(0)).cast("boolean")


def group_time_cells(df: DataFrame, group: list[str], time: str, value: str | None, label: str | None, classes: list[str]) -> DataFrame:
    """Sums by group and time, on which both models run: rows, n, sum and sum of squares of value, and count of each class."""
    sums = [F.count(F.lit(1)).alias("rows")]
    if value:
        sums += [F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col(value) * F.col(value)), F.lit(0.0)).alias("ss")]
    sums += [F.count_if(F.col(label) == F.lit(c)).alias(f"k{i}") for i, c in enumerate(classes)]
    return stage(df.where(_levels(group)).groupBy(*group, time).agg(*sums), "fill-cells")


def _chances(classes: list[str], a: list[float]) -> list[Column]:
    """Probability of every class but the first by the effects g<i> of the group and t<i> of the time."""
    odds = [F.exp(F.least(F.greatest(F.lit(a[i]) + F.col(f"g{i}") + F.col(f"t{i}"), F.lit(-30.0)), F.lit(30.0))) for i in range(1, len(classes))]
    return [o / sum(odds, F.lit(1.0)) for o in odds]


def mixed_effects(cells: DataFrame, group: list[str], time: str, value: bool, classes: list[str], rounds: int = ROUNDS) -> tuple[float, list[float], DataFrame, DataFrame]:
    """(mean, a, groups, times): two models with random effects of group and time, fitted together on the cells.

    value = mean + b + c + noise; b and c are means of residuals times n / (n + noise variance / variance of the effect). Classes
    follow a multinomial logit with odds exp(a<i> + g<i> + t<i>) against the first class, whose g and t have a normal prior:
    Newton steps on their penalised likelihood, the prior's variance being the mean of effect^2 + its posterior variance.
    Groups and times take turns until no effect moves, at most `rounds` times. A turn is one join of the cells with both tables
    of effects (a group has one cell a time at most; times are joined by weight, as one may own most cells) and one aggregation.
    groups has group, n (usable values), k (labels) and the effects, times has time and the effects.
    """
    ks = [f"k{i}" for i in range(len(classes))]
    named = cells.withColumn("k", sum((F.col(k) for k in ks), F.lit(0))) if classes else cells.withColumn("k", F.lit(0))
    named = named if value else named.withColumns({"n": F.lit(0), "s": F.lit(0.0), "ss": F.lit(0.0)})
    named = named.where("n > 0 or k > 0")
    per = named.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), *[F.sum(k).alias(k) for k in ks])
    square = F.try_divide(F.col("s") * F.col("s"), F.col("n"))
    o = per.agg(F.count_if(F.col("n") > 0).alias("g"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("ss") - square).alias("within"), F.sum(square).alias("between"), F.sum(F.col("n") * F.col("n")).alias("nn"), *[F.sum(k).alias(k) for k in ks]).first()
    total = o.n or 0
    mean = o.s / total if total else 0.0
    noise = max((o.within or 0.0) / max(total - o.g, 1), 1e-9)
    spread = max((o.between - total * mean * mean - (o.g - 1) * noise) / max(total - o.nn / total, 1e-9), 1e-9) if total and o.g > 1 else 1e-9
    a = [math.log(((o[k] or 0) + 0.5) / ((o[ks[0]] or 0) + 0.5)) for k in ks]
    counts = named.groupBy(time).agg(F.count(F.lit(1)).alias("_cells"))
    sides = {"g": ("b", group, spread), "t": ("c", [time], noise)}
    state: dict[str, DataFrame | None] = {"g": None, "t": None}
    variance = {(side, i): 1.0 for side in "gt" for i in range(1, len(classes))}
    linear = {side: of for side, (_, _, of) in sides.items()}
    effects = {side: [name, *[f"{side}{i}" for i in range(1, len(classes))]] for side, (name, _, _) in sides.items()}
    for _ in range(rounds):
        moved = 0.0
        for side, (name, keys, _) in sides.items():
            met = named
            if state["g"] is not None:
                met = join_null_safe(met, state["g"].select(*group, *effects["g"]), group)
            if state["t"] is not None:
                met = join_weighted(met, state["t"], [time], "_cells")
            met = met.withColumns({e: F.lit(0.0) for s, es in effects.items() if state[s] is None for e in es})
            other = "c" if name == "b" else "b"
            sums = [F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("s") - F.col("n") * (F.lit(mean) + F.col(other))).alias("r"), F.first(name).alias("old")]
            for i, p in enumerate(_chances(classes, a), 1):
                sums += [F.sum(F.col(f"k{i}") - F.col("k") * p).alias(f"u{i}"), F.sum(F.col("k") * p * (1 - p)).alias(f"h{i}"), F.first(f"{side}{i}").alias(f"{side}{i}")]
            at = met.groupBy(*keys).agg(*sums)
            new = [F.coalesce(F.try_divide(F.col("r"), F.col("n") + F.lit(noise / linear[side])), F.lit(0.0)).alias(name)]
            checks = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.sum(F.try_divide(F.col("r") * F.col("r"), F.col("n"))).alias("between"), F.count_if(F.col("n") > 0).alias("with_n"), F.max(F.abs(F.col(name) - F.col("old"))).alias("moved")]
            for i in range(1, len(classes)):
                tau = 1 / variance[side, i]
                step = (F.col(f"u{i}") - F.col(f"{side}{i}") * F.lit(tau)) / (F.col(f"h{i}") + F.lit(tau))
                step = F.least(F.greatest(step, F.lit(-2.0)), F.lit(2.0))
                new += [(F.col(f"{side}{i}") + step).alias(f"{side}{i}"), step.alias(f"d{i}"), (1 / (F.col(f"h{i}") + F.lit(tau))).alias(f"v{i}")]
                checks += [F.max(F.abs(f"d{i}")).alias(f"d{i}"), F.avg(F.col(f"{side}{i}") * F.col(f"{side}{i}") + F.col(f"v{i}")).alias(f"v{i}")]
            at = stage(at.select(*keys, "n", "k", "r", "old", *new), "fill-effects")
            seen = at.agg(*checks).first()
            if seen.rows:
                moved = max(moved, seen.moved / math.sqrt(noise), *[seen[f"d{i}"] for i in range(1, len(classes))])
                for i in range(1, len(classes)):
                    variance[side, i] = max(seen[f"v{i}"], 1e-6)
            if side == "t" and seen.n:
                linear["t"] = max((seen.between - seen.with_n * noise) / seen.n, 1e-9)
            kept = at.select(*keys, "n", "k", *effects[side])
            state[side] = kept if side == "g" else join_null_safe(kept.drop("n", "k"), counts, [time])
        if moved <= SETTLED:
            break
    return mean, a, state["g"], state["t"].drop("_cells")


def fill_cells(df: DataFrame, key: str, group: list[str], time: str, value: str | None = None, need_value: str | None = None, label: str | None = None, need_label: str | None = None, classes: list[str] | None = None, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(row_key, field, number, text) for every needed cell that rows of the same group can fill.

    value and label hold the usable observations (NULL elsewhere), need_value and need_label say where a value is wanted.
    A cell is filled if its group has any usable observation: numbers by the mixed-effects prediction, labels by the
    likeliest class of the multinomial model (ties: the first listed). Rows with a NULL in the group columns are filled from nothing and fill
    nothing; a NULL time is a time of its own; times without usable rows have no effect. Repeated rows count as
    delivered. Empty tables give an empty result.

    One aggregation by group and time (map-side first) feeds the models; after it only the rows to be filled are joined,
    with groups and times of more than heavy_rows rows broadcast.
    """
    classes = classes or []
    cells = group_time_cells(df, group, time, value, label, classes)
    weight = cells.groupBy(*group).agg(F.sum("rows").alias("_rows"))
    mean, a, groups, times = mixed_effects(cells, group, time, value is not None, classes)
    groups = stage(groups.join(weight, group), "fill-groups")
    times = join_null_safe(cells.groupBy(time).agg(F.sum("rows").alias("_at")), times, [time], "left")
    times = stage(times.select(time, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in times.columns if c not in (time, "_at")], "_at"), "fill-times")
    out = []
    for field, need, enough in ((value, need_value, "n"), (label, need_label, "k")):
        if field:
            wanted = df.where(F.coalesce(F.col(need), F.lit(False)) & _levels(group)).select(F.col(key).alias("row_key"), *group, time)
            met = join_weighted(wanted, groups.where(F.col(enough) > 0), group, "_rows", heavy_rows)
            met = join_weighted(met, times, [time], "_at", heavy_rows)
            number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
            if enough == "n":
                number = F.lit(mean) + F.col("b") + F.col("c")
            else:
                odds = [F.lit(0.0), *[F.lit(a[i]) + F.col(f"g{i}") + F.col(f"t{i}") for i in range(1, len(classes))]]
                text = F.greatest(*[F.struct(x.alias("x"), F.lit(-i).alias("i"), F.lit(c).alias("text")) for i, (x, c) in enumerate(zip(odds, classes))])["text"] if len(classes) > 1 else F.lit(classes[0])
            out.append(met.select("row_key", F.lit(field).alias("field"), number.alias("number"), text.alias("text")))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def fill_open_class(df: DataFrame, key: str, group: list[str], time: str, label: str, need: str, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(row_key, field, number, text): labels of an open set of classes, filled from the same group.

    The likeliest of the classes seen in the group under a Dirichlet-multinomial model: a class has its count in the group plus
    alpha times its share at the group's times; ties go to the smaller label. alpha is fitted by moments: two rows of a
    group share their label in (1 + alpha x H) / (1 + alpha) of all cases, where H is that chance for rows of different
    groups. NULL group columns and groups without any label fill nothing.
    """
    seen = df.where(_levels(group)).groupBy(*group, time, label).agg(F.count(F.lit(1)).alias("k"))
    seen = stage(seen, "fill-labels")
    named = seen.where(F.col(label).isNotNull())
    by = named.groupBy(*group, label).agg(F.sum("k").cast("double").alias("k")).groupBy(*group).agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1)).alias("pairs"))
    by = by.agg(F.sum("pairs").alias("same"), F.sum(F.col("n") * (F.col("n") - 1)).alias("all")).first()
    over = named.groupBy(label).agg(F.sum("k").cast("double").alias("k")).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("kk")).first()
    chance, same = (over.kk / over.n**2, by.same / by.all) if by.all else (0.0, 1.0)
    alpha = min(max((1 - same) / max(same - chance, 1e-6), 1e-6), 1e6)
    at = named.groupBy(time, label).agg(F.sum("k").alias("at"), F.count(F.lit(1)).alias("_cells"))
    at = join_null_safe(at, at.groupBy(time).agg(F.sum("at").alias("of")), [time]).select(time, label, (F.col("at") / F.col("of")).alias("share"), "_cells")
    scored = join_weighted(named, at, [time, label], "_cells", heavy_rows).groupBy(*group, label).agg(F.sum("k").alias("k"), F.max("share").alias("share"))
    # the greatest score, then the smaller label
    best = scored.groupBy(*group).agg(F.min(F.struct((-(F.col("k") + F.lit(alpha) * F.col("share"))).alias("score"), F.col(label).alias("text"))).alias("best"))
    best = stage(best.join(seen.groupBy(*group).agg(F.sum("k").alias("weight")), group), "fill-best")
    wanted = df.where(F.coalesce(F.col(need), F.lit(False)) & _levels(group)).select(F.col(key).alias("row_key"), *group)
    return join_weighted(wanted, best, group, "weight", heavy_rows).select("row_key", F.lit(label).alias("field"), F.lit(None).cast("double").alias("number"), F.col("best.text").cast("string").alias("text"))


def apply_fills(df: DataFrame, key: str, cells: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the cells put in, and <column>_filled, true for every filled cell.

    columns says for each field of cells, by its column in df, how number and text give the value. Rows without a filled cell keep what they have.
    """
    wide = cells.groupBy("row_key").agg(*[F.first(F.when(F.col("field") == c, x), ignorenulls=True).alias(f"_fill_{c}") for c, x in columns.items()])
    met = df.join(wide, df[key] == wide["row_key"], "left")
    return met.select(*[F.coalesce(f"_fill_{c}", df[c]).alias(c) if c in columns else df[c] for c in df.columns], *[F.col(f"_fill_{c}").isNotNull().alias(f"{c}_filled") for c in columns])
