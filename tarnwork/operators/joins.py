"""Joins that hold when one key owns a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_ROWS = 2_000_000
MOST_HEAVY = 100_000


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on the keys, which both sides name alike; NULL equals NULL. The keys of the left side remain."""
    other = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_right_{k}" for k in keys])


def join_weighted(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Inner join of rows with a lookup of unique keys whose `weight` counts at least the rows of the key; NULL equals NULL.

    Keys of more than heavy_rows rows are joined by broadcast and so never meet in one task. There are at most
    (all rows / heavy_rows) of them: 50,000 in a table of 10^11 rows. Should there be more than MOST_HEAVY, they are too many
    to broadcast, and as many also to be spread by a shuffle: Spark's own join takes all, with its splitting of skewed
    partitions. All other keys take Spark's own join, where no key has more than heavy_rows rows. The weight column is
    dropped. Empty sides give an empty result.
    """
    heavy = lookup.where(F.col(weight) > heavy_rows).drop(weight)
    light = lookup.where(F.col(weight) <= heavy_rows).drop(weight)
    n = heavy.limit(MOST_HEAVY + 1).count()
    if not n:
        return join_null_safe(rows, light, keys)
    if n > MOST_HEAVY:
        return join_null_safe(rows, lookup.drop(weight), keys)
    few = F.broadcast(heavy)
    return join_null_safe(rows, few, keys).unionByName(join_null_safe(join_null_safe(rows, F.broadcast(heavy.select(*keys)), keys, "left_anti"), light, keys))
