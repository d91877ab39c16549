import math
import random

from pyspark.sql import functions as F

from tarnwork.operators.fill import apply_fills, fill_cells, fill_open_class
from tarnwork.operators.packed import resolve, split_packed


def values(spark, text, known=None):
    df = spark.createDataFrame([(1, text, "x")], "id bigint, packed string, atoms string")
    return [r.item_value for r in split_packed(df, "id", "packed", known).orderBy("item_position").collect()]


def test_packed_cases(spark):
    known = ["L01", "L08", "L08.1", "none declared", "age, sex", "O/E ratio", "low n; no replicate", "R&D reagent"]
    cases = {
        'a.b, "c, ""d"" e";\'f|g\'\n“h” ': ["a.b", 'c, "d" e', "f|g", "h"],
        " [x; y] ": ["x", "y"],
        "last row\trho=0.80,,": ["last row", "rho=0.80"],
        "f(a, b); g(": ["f(a, b)", "g("],
        'it\'s | "open': ["it's", '"open'],
        ";;": [],
        "   ": [],
        '""': [],
    }
    coded = {
        'L01 and L08.1 & L08/L01': ["L01", "L08.1", "L08", "L01"],
        '"L01;none declared"': ["L01", "none declared"],
        '{"age, sex"|L01}': ["age, sex", "L01"],
        '"\'L01\'\n""L08"""': ["L01", "L08"],
        "L08·O/E ratio·low n; no replicate·R&D reagent": ["L08", "O/E ratio", "low n; no replicate", "R&D reagent"],
        "L01 L08 L08.1": ["L01", "L08", "L08.1"],
        "L01; some thing; L081": ["L01", "some thing", "L081"],
    }
    rows = [(i, t) for i, t in enumerate([*cases, *coded, None])]
    for known_values, want, first in ((None, cases, 0), (known, coded, len(cases))):
        df = spark.createDataFrame([r for r in rows if first <= r[0] < first + len(want)] + [(99, None)], "id bigint, atoms string")
        got = {}
        for r in split_packed(df, "id", "atoms", known_values).orderBy("row_key", "item_position").collect():
            got.setdefault(r.row_key, []).append(r.item_value)
            assert r.item_position == len(got[r.row_key])
        for i, (text, expected) in enumerate(want.items()):
            assert got.get(first + i, []) == expected, text


def test_packed_long_empty_and_repeated(spark):
    long = ";".join(f"v{i}" for i in range(20_000))
    df = spark.createDataFrame([(1, long), (1, "a;a"), (None, "b")], "id bigint, f string")
    got = split_packed(df, "id", "f").groupBy("row_key").count().collect()
    assert {r.row_key: r["count"] for r in got} == {1: 20_002, None: 1}
    assert split_packed(df.limit(0), "id", "f").count() == 0


def test_resolve_round_trip():
    assert resolve('"a;a"|a', False) == [(2, 3, '"'), (7, 1, "")]
    assert resolve("[v;v]", True) == [(2, 1, ""), (4, 1, "")]


def test_numeric_fill_follows_group_and_time(spark):
    rows = [(g * 100 + t * 10 + k, g, t, 10.0 * g + t + 0.01 * k, False) for g in range(5) for t in range(4) for k in range(3)]
    rows += [(1001, 2, 3, None, True), (1002, 4, None, None, True), (1003, 77, 1, None, True), (1004, None, 1, None, True), (1005, 1, 1, None, None)]
    df = spark.createDataFrame(rows, "id bigint, g int, t int, y double, need boolean")
    got = {r.row_key: r.number for r in fill_cells(df, "id", ["g"], "t", "y", "need").collect()}
    assert set(got) == {1001, 1002} and abs(got[1001] - 23.0) < 0.1 and abs(got[1002] - 41.5) < 0.1
    heavy = {r.row_key: r.number for r in fill_cells(df, "id", ["g"], "t", "y", "need", heavy_rows=5).collect()}
    assert all(math.isclose(heavy[k], got[k]) for k in got)
    filled = apply_fills(df, "id", fill_cells(df, "id", ["g"], "t", "y", "need"), {"y": F.col("number")})
    assert {r.id for r in filled.where("y_filled").collect()} == {1001, 1002} and filled.count() == len(rows)
    assert fill_cells(df.limit(0), "id", ["g"], "t", "y", "need").count() == 0


def test_class_fill(spark):
    rows = [(i, i % 2, 0, "true" if i % 2 else "false", False) for i in range(40)] + [(100, 1, 0, None, True), (101, 0, 5, None, True), (102, 9, 0, None, True)]
    df = spark.createDataFrame(rows, "id bigint, g int, t int, c string, need boolean")
    got = {r.row_key: r.text for r in fill_cells(df, "id", ["g"], "t", label="c", need_label="need", classes=["true", "false"]).collect()}
    assert got == {100: "true", 101: "false"}
    free = {r.row_key: r.text for r in fill_open_class(df, "id", ["g"], "t", "c", "need", heavy_rows=3).collect()}
    assert free == {100: "true", 101: "false"}
    assert fill_open_class(df.limit(0), "id", ["g"], "t", "c", "need").count() == 0


def test_multinomial_follows_group_and_time(spark):
    # group and time both move the odds; the model must find classes that neither the group's nor the overall majority has
    rnd = random.Random(2)
    effect = {(g, t): 1 / (1 + math.exp(-(g - 4) - 3 * (t - 1))) for g in range(9) for t in range(3)}
    rows = [(i, g, t, "b" if rnd.random() < effect[g, t] else "a", False) for i, (g, t) in enumerate([(g, t) for g in range(9) for t in range(3)] * 60)]
    rows += [(10_000 + 10 * g + t, g, t, None, True) for g in range(9) for t in range(3)]
    df = spark.createDataFrame(rows, "id bigint, g int, t int, c string, need boolean")
    for heavy in (2_000_000, 40):
        got = {r.row_key: r.text for r in fill_cells(df, "id", ["g"], "t", label="c", need_label="need", classes=["a", "b"], heavy_rows=heavy).collect()}
        assert len(got) == 27 and all((got[10_000 + 10 * g + t] == "b") == (p > 0.5) for (g, t), p in effect.items() if abs(p - 0.5) > 0.15)
    three = df.select("id", "g", "t", F.when(F.col("c") == "a", "a").when(F.col("id") % 2 == 0, "b").otherwise("z").alias("c"), "need")
    assert fill_cells(three, "id", ["g"], "t", label="c", need_label="need", classes=["a", "b", "z"]).count() == 27
