"""Splits that keep related records together: spanning forest by contraction, roots dealt to the splits by size band."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwork.operators.joins import HEAVY_ROWS, join_weighted
from tarnwork.session import stage, unstage

DEALING_DIGITS = 3  # hex digits of the hash that make a bucket


def spanning_forest(edges: DataFrame, u: str, v: str, heavy_rows: int = HEAVY_ROWS) -> tuple[DataFrame, DataFrame]:
    """(labels, forest) of an undirected graph: labels has vertex, root for every vertex with an edge to another one;
    forest has u, v, the edges of a spanning forest, kept as a table in the shared folder.

    Ends are compared as strings; edges with a NULL end or two equal ends join nothing; repeats and both orders count
    once. An empty table gives two empty ones. Which vertex is the root carries no meaning; it is the same on every run.

    Method: in each round every component picks its least edge in one total order (hash, then ends), so that the
    picked edges hold no ring but pairs that pick each other; components hang on the one picked, chains are halved until
    all point at a root, and the edges are written again between roots, without those inside one and with only the
    least of parallel ones. Each round at least halves the components. Components with more than heavy_rows edges are
    looked up by broadcast, so that no task gets all edges of one.
    """
    a, b = F.col(u).cast("string"), F.col(v).cast("string")
    links = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), a.isNotNull().alias("_a"), b.isNotNull().alias("_b")).where("_a and _b and u <> v").select("u", "v").distinct()
    live = stage(links.select(F.col("u").alias("cu"), F.col("v").alias("cv"), F.xxhash64("u", "v").alias("w"), "u", "v"), "forest-edges")
    maps: list[DataFrame] = []
    picks: list[DataFrame] = []
    while not live.isEmpty():
        ends = live.select(F.col("cu").alias("c"), F.struct("w", "u", "v", F.col("cv").alias("o")).alias("e")).unionByName(live.select(F.col("cv").alias("c"), F.struct("w", "u", "v", F.col("cu").alias("o")).alias("e")))
        picked = stage(ends.groupBy("c").agg(F.min("e").alias("e"), F.count(F.lit(1)).alias("deg")).select("c", F.col("e.o").alias("o"), F.col("e.u").alias("u"), F.col("e.v").alias("v"), "deg"), "forest-picked")
        picks.append(picked.select("u", "v"))
        back = picked.select(F.col("c").alias("o"), F.col("o").alias("back"), "deg")
        up = stage(join_weighted(picked.drop("deg"), back, ["o"], "deg", heavy_rows).select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("p")), "forest-up")
        degree = picked.select("c", "deg")
        while True:
            over = join_weighted(up, up.join(degree, "c").select(F.col("c").alias("p"), F.col("p").alias("pp"), "deg"), ["p"], "deg", heavy_rows)
            higher = stage(over.select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "forest-up")
            unstage(up)
            still = not higher.where("moved").isEmpty()
            up = higher
            if not still:
                break
        up = up.select("c", "p")
        maps.append(up)
        at = up.join(degree, "c")
        moved = join_weighted(live, at.select(F.col("c").alias("cu"), F.col("p").alias("ru"), "deg"), ["cu"], "deg", heavy_rows)
        moved = join_weighted(moved, at.select(F.col("c").alias("cv"), F.col("p").alias("rv"), "deg"), ["cv"], "deg", heavy_rows).where("ru <> rv")
        moved = moved.select(F.least("ru", "rv").alias("cu"), F.greatest("ru", "rv").alias("cv"), F.struct("w", "u", "v").alias("e")).groupBy("cu", "cv").agg(F.min("e").alias("e"))
        after = stage(moved.select("cu", "cv", "e.*"), "forest-edges")
        unstage(live)
        live = after
    if not maps:
        return live.select(F.col("u").alias("vertex"), F.col("v").alias("root")), live.select("u", "v")
    labels = maps[-1]
    for lower in reversed(maps[:-1]):
        counts = lower.groupBy("p").agg(F.count(F.lit(1)).alias("weight"))
        higher = counts.join(labels.select(F.col("c").alias("p"), F.col("p").alias("top")), "p", "left").select("p", F.coalesce("top", "p").alias("top"), "weight")
        labels = join_weighted(lower, higher, ["p"], "weight", heavy_rows).select("c", F.col("top").alias("p"))
    forest = stage(reduce(DataFrame.unionByName, picks).distinct(), "forest")
    return stage(labels.select(F.col("c").alias("vertex"), F.col("p").alias("root")), "forest-labels"), forest


def deal_roots(roots: DataFrame, root: str, size: str, targets: dict[str, float]) -> DataFrame:
    """(root, split): whole roots dealt to the splits. roots has one row a root and its size.

    Roots fall into bands of size (powers of two). Within a band they are ranked by a hash and dealt by systematic
    sampling, so that of every run of roots each split gets its share to within one. The rank, by md5 of the root, is found
    without sorting a band in one task: rows are ranked within 4,096 hash buckets, and the buckets' counts give each an
    offset (at most 64 bands x 4,096 buckets rows, a fixed bound). Large bands come first to the split of the largest share. NULL sizes count
    as one. Targets need not sum to 1; splits of share 0 get nothing.
    """
    total = sum(targets.values())
    names = sorted(targets, key=lambda s: (-targets[s], s))
    rows = roots.select(F.col(root).alias("root"), F.floor(F.log2(F.greatest(F.coalesce(F.col(size), F.lit(1)), F.lit(1)).cast("double"))).cast("int").alias("band"))
    rows = rows.withColumn("h", F.md5(F.col("root").cast("string"))).withColumn("bucket", F.substring("h", 1, DEALING_DIGITS))
    order = Window.partitionBy("band").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("band", "bucket").count().select("band", "bucket", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("before"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("band", "bucket").orderBy("h", "root"))).join(F.broadcast(offsets), ["band", "bucket"])
    # at each split in turn, of the roots left over k gets in if the whole part of (k + 1) x share exceeds that of k x share
    k = F.col("before") + F.col("n") - 1
    split, left = F.lit(names[-1]), total
    chosen: list[tuple] = []
    for name in names[:-1]:
        share = targets[name] / left if left > 0 else 0.0
        whole = F.ceil(k * F.lit(share) - F.lit(1e-9))
        chosen.append((F.ceil((k + 1) * F.lit(share) - F.lit(1e-9)) > whole, name))
        k, left = k - whole, left - targets[name]
    for inside, name in reversed(chosen):
        split = F.when(inside, F.lit(name)).otherwise(split)
    return ranked.select("root", "band", split.alias("split"))


def keep_together_splits(records: DataFrame, entity: str, links: DataFrame, link_entity: str, link_key: str, targets: dict[str, float], heavy_rows: int = HEAVY_ROWS) -> tuple[DataFrame, DataFrame]:
    """(entities, forest). entities has entity, root, records, split: one row for every entity of records.

    Entities that share a link_key in links, directly or through others, get one root (the smallest entity) and one
    split. Entities are whole numbers. NULL entities get no row, NULL keys link nothing, entities without a link are
    their own root, and repeated rows count as records but link once. Empty tables give an empty result.
    """
    bridge = links.where(F.col(link_entity).isNotNull() & F.col(link_key).isNotNull()).select(F.concat(F.lit("e"), F.col(link_entity).cast("string")).alias("u"), F.concat(F.lit("k"), F.col(link_key).cast("string")).alias("v"))
    labels, forest = spanning_forest(bridge, "u", "v", heavy_rows)
    known = labels.where("vertex like 'e%'").select(F.substring("vertex", 2, 40).cast("bigint").alias("entity"), F.col("root").alias("label"))
    least = known.groupBy("label").agg(F.min("entity").alias("root"), F.count(F.lit(1)).alias("weight"))
    person = join_weighted(known, least, ["label"], "weight", heavy_rows).select("entity", "root")
    sizes = records.where(F.col(entity).isNotNull()).groupBy(F.col(entity).cast("bigint").alias("entity")).agg(F.count(F.lit(1)).alias("records"))
    whole = stage(sizes.join(person, "entity", "left").select("entity", F.coalesce("root", "entity").alias("root"), "records"), "splits-entities")
    roots = whole.groupBy("root").agg(F.sum("records").alias("size"), F.count(F.lit(1)).alias("weight"))
    dealt = stage(deal_roots(roots, "root", "size", targets).join(roots.select("root", "weight"), "root"), "splits-dealt")
    return join_weighted(whole, dealt.drop("band"), ["root"], "weight", heavy_rows).select("entity", "root", "records", "split"), forest


def torn_entities(records: DataFrame, entity: str, fold_keys: list[str], fold: str, roots: DataFrame) -> DataFrame:
    """(fold_keys, root, folds): roots whose records name two or more folds under one fold_keys value. NULL folds don't count.

    roots has entity, root. Aggregated by entity first, so that only sums travel.
    """
    seen = records.where(F.col(fold).isNotNull() & F.col(entity).isNotNull()).groupBy(*fold_keys, F.col(entity).cast("bigint").alias("entity"), F.col(fold).alias("fold")).agg(F.count(F.lit(1)).alias("n"))
    return seen.join(roots.select("entity", "root"), "entity").groupBy(*fold_keys, "root").agg(F.count_distinct("fold").alias("folds")).where("folds > 1")
