"""Pairwise matches to groups: union-find over a grid of block pairs, with exchange of representatives."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.joins import HEAVY_ROWS, join_weighted
from tarnwork.session import stage, unstage

CELL_EDGES = 500_000
LEAST_SIDE = 4  # blocks of vertices that even the smallest graph is cut into in the first round
TASK_CELLS = 4


def _local_forest(pairs: pd.DataFrame) -> pd.DataFrame:
    """Union-find over the edges of one cell, of bounded size: each vertex with the least vertex it is linked to here."""
    names, codes = np.unique(np.concatenate([pairs["u"].to_numpy(dtype=object), pairs["v"].to_numpy(dtype=object)]), return_inverse=True)
    a, b = codes[: len(pairs)], codes[len(pairs) :]
    parent = np.arange(len(names))
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return pd.DataFrame({"vertex": names, "rep": names[parent]})


def connected_groups(edges: DataFrame, u: str, v: str, cell_edges: int = CELL_EDGES, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(component_key, vertex) for every vertex with an edge to another one; the key is the group's smallest vertex.

    Ends are compared as strings, in byte order. Edges with a NULL end or equal ends link nothing; repeats and both
    orders count once; an empty table gives an empty result; other columns are ignored.

    Method: vertices are hashed into blocks, edges into the cells of the block-pair grid, each of about cell_edges
    edges (the grid has at least 4 x 4 cells in the first round, 2 x 2 in the second, and grows with the edges; a cell that a hub overfills is cut further by a hash
    of the edge, which union-find may do at will). Union-find runs in each cell; a task takes its cells one after another,
    so that it holds at most some 2 x cell_edges edges at a time, however many cells it is given. The vertices of a row and of a column then exchange their
    representatives: a vertex hangs on the least of them, and the others become edges between representatives, on which
    the next round runs. It ends when no edges are left. In a round every vertex but the least of its
    neighbourhood leaves the graph, so few rounds are needed and the grid shrinks with it.
    """
    spark = edges.sparkSession
    a, b = F.col(u).cast("string"), F.col(v).cast("string")
    live = stage(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "grid-edges")
    maps: list[DataFrame] = []
    while (n := live.count()) > 0:
        side = max(LEAST_SIDE >> len(maps), math.ceil(math.sqrt(n / cell_edges)))
        cells = live.withColumn("i", F.pmod(F.xxhash64("u"), F.lit(side)).cast("int")).withColumn("j", F.pmod(F.xxhash64("v"), F.lit(side)).cast("int"))
        # cells of more than twice the wished edges, at most n / (2 x cell_edges) of them, are cut by a hash of the edge
        full = cells.groupBy("i", "j").count().where(F.col("count") > 2 * cell_edges).select("i", "j", F.ceil(F.col("count") / cell_edges).cast("int").alias("cuts"))
        cells = cells.join(F.broadcast(full), ["i", "j"], "left").withColumn("cut", F.pmod(F.xxhash64("u", "v", F.lit(7)), F.coalesce("cuts", F.lit(1))).cast("int"))
        cells = cells.select("u", "v", "i", "j", "cut").repartition(-(-side * side // TASK_CELLS), "i", "j", "cut")
        local = stage(cells.groupBy("i", "j", "cut").applyInPandas(_local_forest, "vertex string, rep string"), "grid-local")
        least = local.groupBy("vertex").agg(F.min("rep").alias("parent"), F.count(F.lit(1)).alias("weight"))
        up = stage(least, "grid-up")
        met = join_weighted(local, up, ["vertex"], "weight", heavy_rows)
        after = stage(met.where("rep <> parent").select(F.least("rep", "parent").alias("u"), F.greatest("rep", "parent").alias("v")).distinct(), "grid-edges")
        unstage(live)
        unstage(local)
        live = after
        maps.append(up.select("vertex", "parent"))
    if not maps:
        return spark.createDataFrame([], "component_key string, vertex string")
    labels = maps[-1]
    for lower in reversed(maps[:-1]):
        counts = lower.groupBy("parent").agg(F.count(F.lit(1)).alias("weight"))
        higher = counts.join(labels.select(F.col("vertex").alias("parent"), F.col("parent").alias("top")), "parent", "left").select("parent", F.coalesce("top", "parent").alias("top"), "weight")
        labels = join_weighted(lower, higher, ["parent"], "weight", heavy_rows).select("vertex", F.col("top").alias("parent"))
    return labels.select(F.col("parent").alias("component_key"), "vertex")
