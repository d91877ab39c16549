"""Column builders: strict logarithms, rule cascades, exact binomial tests, ranks of small groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def is_true(c: Column) -> Column:
    """A failed or unknown comparison counts as false."""
    return F.coalesce(c, F.lit(False))


def usable(c: str) -> Column:
    """Finite and strictly positive; never NULL, as NULL already fails the first term. Plain terms, so that scans can take them."""
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))


def log2_strict(c: str) -> Column:
    """log2 of usable values, else NULL; no pseudocount."""
    return F.when(usable(c), F.log2(c))


def clip(c: Column, low: float, high: float) -> Column:
    """c cut to low..high; NULL stays NULL, which greatest and least alone would turn into a bound."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def cascade(rules: list[tuple[Column, Column | str]], default: Column | str) -> Column:
    """The value of the first rule that holds; unknown conditions don't hold."""
    out = None
    for condition, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(is_true(condition), v) if out is None else out.when(is_true(condition), v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def exact_binary_p(a: str, b: str) -> Column:
    """Two-sided exact sign test of two counts: 2 x P(X <= min) with X binomial(a + b, 1/2), at most 1; NULL without counts.

    The tail is summed in logarithms from its largest term down, so that counts of many thousands don't underflow.
    """
    n, k = F.col(a) + F.col(b), F.least(a, b)
    # log of C(n, k) / 2^n, then each lower term by the ratio i / (n - i + 1)
    start = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.when(i <= k, F.log((n - k + i).cast("double")) - F.log(i.cast("double"))).otherwise(F.lit(0.0))) - n * F.lit(0.6931471805599453)
    step = lambda acc, j: F.struct((acc["t"] * (k - j + 1) / (n - k + j)).alias("t"), (acc["s"] + acc["t"] * (k - j + 1) / (n - k + j)).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda acc, j: F.when(j <= k, step(acc, j)).otherwise(acc), lambda acc: acc["s"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * F.exp(start + F.log(tail))))


def average_rank(value: str, by: list[str]) -> Column:
    """Average rank of ties, from 1; NULL for NULL. For groups of bounded size (the features of one entity), which one task sorts;
    ranks in one group share an exchange. operators.ranking.average_ranks ranks groups of any size."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(value))
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def quantile_bin(value: str, edges: Column) -> Column:
    """Right-closed bin of value between distinct quantile edges, the lowest edge belonging to bin 1."""
    inner = F.array_distinct(edges)
    return F.when(F.col(value).isNotNull(), F.greatest(F.size(F.filter(inner, lambda e: e < F.col(value))), F.lit(1)))
