import os
import subprocess
import sys
import textwrap

from tarnwork.operators.joins import join_null_safe, join_weighted
from tarnwork.session import shared_dir, stage, unstage


def test_heavy_keys_and_nulls(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("a", 1), (None, 2), ("lost", 3)], "k string, v int")
    lookup = spark.createDataFrame([("hot", "H", 50), ("a", "A", 1), (None, "N", 1)], "k string, x string, w int")
    want = sorted([("H", i) for i in range(50)] + [("A", 1), ("N", 2)])
    for heavy in (10, 1000):
        got = join_weighted(rows, lookup, ["k"], "w", heavy)
        assert got.columns == ["k", "v", "x"] and sorted((r.x, r.v) for r in got.collect()) == want
    assert join_null_safe(rows, lookup, ["k"], "left").where("x is null").count() == 1
    assert join_weighted(rows.limit(0), lookup, ["k"], "w").count() == 0 == join_weighted(rows, lookup.limit(0), ["k"], "w").count()


def test_staged_tables(spark):
    kept = stage(spark.range(3), "test")
    assert kept.count() == 3 and any(f.startswith("tarnwork-test-") for f in os.listdir(shared_dir(spark).removeprefix("file:")))
    unstage(kept)
    assert not any(f.startswith("tarnwork-test-") for f in os.listdir(shared_dir(spark).removeprefix("file:")))


def test_the_named_folder_is_used(tmp_path):
    code = f"""
    from pyspark.sql import SparkSession
    from tarnwork.session import shared_dir
    spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.ui.enabled", "false").getOrCreate()
    print("AT", shared_dir(spark))
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert f"AT file://{tmp_path}/shared" in out.stdout
