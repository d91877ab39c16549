"""Top N items of every group, by bisection of all groups at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwork.operators.joins import HEAVY_ROWS, join_weighted
from tarnwork.session import stage, unstage

SECTIONS = 64
CHUNK = 6  # bytes of the identifier in one limb of the code


def _score_bits(score: Column) -> Column:
    """The double as a long of the same order: its IEEE bits, those of negative numbers turned round."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), score + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(bits)


def _limb(level: str, longest: int) -> Column:
    """Limb `level` of the score-plus-identifier code of a row, always below 2^48 in size: two limbs of the score, then
    six bytes of the identifier each (turned, so that the smaller one is above), at last the identifier's length."""
    last = 2 + -(-longest // CHUNK)
    chunk = f"(281474976710655 - cast(conv(rpad(hex(substring(cast(_item as binary), 1 + {CHUNK} * ({level} - 2), {CHUNK})), {2 * CHUNK}, '0'), 16, 10) as bigint))"
    return F.expr(f"case when {level} = 0 then shiftright(_bits, 16) when {level} = 1 then _bits & 65535 when {level} >= {last} then {longest} - octet_length(_item) else {chunk} end")


def top_n_per_group(df: DataFrame, group_cols: list[str], item_col: str, score_col: str | Column, n: int, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The n items of largest score of every group: columns group_cols, item, score.

    An item counts once per group, with its largest score; ties go to the smaller item (by bytes); groups of n items or
    fewer are kept whole. NULL and NaN scores and NULL items don't count; a NULL group value is a group of its own;
    infinite scores are ordinary; an empty table gives an empty result; other columns, whatever their names, are ignored.

    Method: every row gets an order-preserving code of score and identifier. All groups are bisected at once: a round
    cuts the open interval of each group into 64 sections, counts the rows of each section (map-side), takes the
    sections above the one where the n-th row lies and goes on with that section alone, until it holds exactly the rows
    still needed. Only rows of open sections are read again. No group is ever sorted or brought into one task; the
    window below runs over at most 64 counts of a group.
    """
    by = [f"_g{i}" for i in range(len(group_cols))]
    score = F.col(score_col) if isinstance(score_col, str) else score_col
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(group_cols, by)], F.col(item_col).cast("string").alias("_item"), score.cast("double").alias("_score"))
    rows = rows.where(F.col("_item").isNotNull() & F.col("_score").isNotNull() & ~F.isnan("_score"))
    rows = rows.groupBy(*by, "_item").agg(F.max("_score").alias("_score"))
    best = stage(rows.withColumn("_bits", _score_bits(F.col("_score"))), "topn-best")
    low, high, longest = best.agg(F.min(F.shiftright("_bits", 16)), F.max(F.shiftright("_bits", 16)), F.max(F.octet_length("_item"))).first()
    named = [*[F.col(k).alias(g) for g, k in zip(group_cols, by)], F.col("_item").alias("item"), F.col("_score").alias("score")]
    if low is None:
        return best.select(*named)
    active = best.select("*", F.lit(0).alias("_level"), F.lit(low).cast("bigint").alias("_lo"), F.lit(high).cast("bigint").alias("_hi"), F.lit(n).cast("bigint").alias("_need"))
    out: list[DataFrame] = []
    while not out or not active.isEmpty():
        cut = active.withColumn("_code", _limb("_level", longest)).withColumn("_bin", F.expr(f"((_code - _lo) * {SECTIONS}) div (_hi - _lo + 1)"))
        after = _limb("(_level + 1)", longest)
        counts = cut.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_c"), F.min("_code").alias("_min"), F.max("_code").alias("_max"), F.min(after).alias("_min2"), F.max(after).alias("_max2"), F.first("_need").alias("_want"))
        whole = Window.partitionBy(*by)
        counts = counts.withColumn("_cum", F.sum("_c").over(whole.orderBy(F.desc("_bin")))).withColumn("_all", F.sum("_c").over(whole))
        few = F.col("_all") <= F.col("_want")
        # the section of the n-th row; groups that are needed whole end at their lowest section
        edge = counts.where((few & (F.col("_cum") == F.col("_all"))) | (~few & (F.col("_cum") >= F.col("_want")) & (F.col("_cum") - F.col("_c") < F.col("_want"))))
        edge = edge.select(*by, F.col("_bin").alias("_edge"), few.alias("_few"), (F.col("_want") - F.col("_cum") + F.col("_c")).alias("_left"), F.col("_c").alias("_in"), "_min", "_max", "_min2", "_max2", "_all")
        edge = stage(edge, "topn-edge")
        met = join_weighted(cut, edge, by, "_all", heavy_rows)
        taken = F.col("_few") | (F.col("_bin") > F.col("_edge")) | ((F.col("_bin") == F.col("_edge")) & (F.col("_in") == F.col("_left")))
        done = F.col("_min") == F.col("_max")
        step = stage(
            met.where(taken | (F.col("_bin") == F.col("_edge"))).select(*by, "_item", "_score", "_bits", taken.alias("_taken"), (F.col("_level") + done.cast("int")).alias("_level"), F.when(done, F.col("_min2")).otherwise(F.col("_min")).alias("_lo"), F.when(done, F.col("_max2")).otherwise(F.col("_max")).alias("_hi"), F.col("_left").alias("_need")),
            "topn-step",
        )
        unstage(edge)
        if not out:
            unstage(best)
        out.append(step.where("_taken"))
        active = step.where("not _taken").drop("_taken")
    return reduce(DataFrame.unionByName, [x.select(*named) for x in out])
