import random

from pyspark.sql import functions as F

from tarnwork.llm.components import connected_groups
from tarnwork.llm.splits import deal_roots, keep_together_splits, spanning_forest, torn_entities
from tarnwork.llm.topn import top_n_per_group


def brute_groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {(find(x), x) for x in root}


def graph():
    rnd = random.Random(5)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    hub = [("hub", f"h{i}") for i in range(80)]
    some = [(f"r{rnd.randrange(60)}", f"r{rnd.randrange(60)}") for _ in range(45)]
    return [*chain, *hub, *some, *chain[:5], ("a", "a"), (None, "a"), ("b", None), ("y", "x"), ("x", "y")]


def test_connected_groups_against_union_find(spark):
    pairs = graph()
    df = spark.createDataFrame([(a, b, "clash") for a, b in pairs], "u string, v string, vertex string")
    for cell in (500_000, 70):  # one cell, and a grid with heavy cells
        got = {(r.component_key, r.vertex) for r in connected_groups(df, "u", "v", cell_edges=cell, heavy_rows=20).collect()}
        assert got == brute_groups(pairs)
    assert connected_groups(df.limit(0), "u", "v").count() == 0


def test_spanning_forest_is_a_forest_with_the_same_groups(spark):
    pairs = graph()
    df = spark.createDataFrame(pairs, "u string, v string")
    labels, forest = spanning_forest(df, "u", "v", heavy_rows=20)
    want = brute_groups(pairs)
    roots = {r.vertex: r.root for r in labels.collect()}
    assert set(roots) == {x for _, x in want}
    assert len({(k, roots[x]) for k, x in want}) == len({k for k, _ in want}) == len(set(roots.values()))
    edges = [(r.u, r.v) for r in forest.collect()]
    assert len(edges) == len(roots) - len(set(roots.values())) and brute_groups(edges) == want
    assert spanning_forest(df.limit(0), "u", "v")[0].count() == 0


def test_splits_keep_persons_whole_and_near_the_shares(spark):
    rows = [(i, i % 3) for i in range(2000)] + [(None, 1)] + [(5, 1), (5, 2)]
    records = spark.createDataFrame(rows, "who int, fold int")
    links = spark.createDataFrame([(i, f"k{i // 2}") for i in range(0, 400)] + [(7, None), (None, "k1")], "who int, key string")
    entities, forest = keep_together_splits(records, "who", links, "who", "key", {"train": 0.7, "validation": 0.15, "test": 0.15})
    got = entities.toPandas()
    assert len(got) == 2000 and got.groupby("root").split.nunique().max() == 1
    assert (got.root[got.entity < 400] == got.entity[got.entity < 400] // 2 * 2).all()
    share = got.groupby("split").records.sum() / got.records.sum()
    assert abs(share["train"] - 0.7) < 0.02 and abs(share["test"] - 0.15) < 0.02
    torn = torn_entities(records, "who", [], "fold", entities)
    assert 4 in {r.root for r in torn.collect()} and forest.count() > 0
    assert keep_together_splits(records.limit(0), "who", links.limit(0), "who", "key", {"train": 1.0})[0].count() == 0


def test_dealing_is_systematic(spark):
    roots = spark.range(1000).select(F.col("id").alias("root"), F.lit(None).cast("long").alias("size"))
    got = deal_roots(roots, "root", "size", {"a": 0.7, "b": 0.15, "c": 0.15, "none": 0.0}).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"a": 700, "b": 150, "c": 150}


def test_top_n_against_sorting(spark):
    rnd = random.Random(3)
    rows = []
    for g in [None, 1, 2, 3, 4]:
        for _ in range({None: 9, 1: 3, 2: 400, 3: 1000, 4: 150}[g]):
            rows.append((g, "x" if g == 4 else rnd.choice("xy"), rnd.choice(["k", "key", "k\0"]) + str(rnd.randrange(300)), rnd.choice([1.0, -1.0, 2.5, -2.5, 0.0, -0.0, 1e-300, float("inf"), float("nan"), None, rnd.gauss(0, 1)]), 1))
    rows += [(5, "x", f"{'long' * 4}{i:04d}", 1.0, 0) for i in range(300)] + [(5, "x", None, 9.0, 0)]
    df = spark.createDataFrame(rows, "g int, h string, item string, value double, score int")
    for score, key in ((F.abs("value"), abs), (F.col("value"), lambda x: x)):
        best = {}
        for g, h, item, value, _ in rows:
            if item is not None and value is not None and value == value:
                best[g, h, item] = max(best.get((g, h, item), float("-inf")), key(value) + 0.0)
        want = {}
        for (g, h, item), s in best.items():
            want.setdefault((g, h), []).append((-s, item.encode()))
        want = {(g, h, i.decode()) for (g, h), x in want.items() for _, i in sorted(x)[:10]}
        got = [(r.g, r.h, r["item"]) for r in top_n_per_group(df, ["g", "h"], "item", score, 10, heavy_rows=100).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert top_n_per_group(df.limit(0), ["g"], "item", "value", 3).count() == 0
