"""The general data problems on the given tables: packed fields and missing values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators.fill import apply_fills, fill_cells, fill_open_class
from tarnwork.operators.packed import split_packed
from tarnwork.plans import oracles
from tarnwork.session import stage
from tarnwork.sources.tables import table

BATCH = r"(?i)^\s*(?:b(?:atch)?)?[\s_-]*0*([1-9][0-9]{0,8})\s*$"


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = table(spark, sf_dir, "claim_ledger")
    codes = [r[0] for r in table(spark, sf_dir, "limitation_register").select("limitation_id").where("limitation_id is not null").collect()]  # fixed: 37 rows; split_packed checks the bound
    parts = split_packed(ledger, "ledger_id", "limitation_ids", codes).unionByName(split_packed(ledger, "ledger_id", "evidence_locator"))
    return parts.withColumnRenamed("row_key", "ledger_id")


def finite(column: str) -> Column:
    c = F.col(column)
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def measurement_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """measurement with what the models read: y (log2 of a usable x_raw), flag, batch, tissue, week."""
    m = table(spark, sf_dir, "measurement")
    usable = finite("x_raw") & (F.col("x_raw") > 0)
    return m.select(
        "row_id", "feature_key", F.upper(F.substring(F.trim("sample_id"), -1, 1)).alias("tissue"), "sample_id", "injection", F.floor(F.datediff(F.to_date(F.coalesce("acquired_at", "loaded_at")), F.lit("1970-01-05")) / 7).cast("int").alias("week"),
        F.when(usable, F.log2("x_raw")).alias("x_raw"), (~usable & F.coalesce("detected", F.lit(False))).alias("need_x"), F.col("detected").cast("string").alias("detected"), F.col("detected").isNull().alias("need_flag"),
        F.nullif(F.regexp_extract("run_batch", BATCH, 1), F.lit("")).cast("int").alias("run_batch"),
    )


def measurement_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills_of(stage(measurement_view(spark, sf_dir), "measurement-view"))  # measurement is scanned once


def fills_of(view: DataFrame) -> DataFrame:
    cells = fill_cells(view, "row_id", ["feature_key", "tissue"], "week", "x_raw", "need_x", "detected", "need_flag", ["true", "false"])
    named = view.withColumn("need_batch", F.col("run_batch").isNull())
    return cells.unionByName(fill_open_class(named, "row_id", ["sample_id", "injection"], "week", "run_batch", "need_batch"))


def transformer_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fold_transformer")
    view = f.select("state_id", "feature_key", "view_name", F.concat_ws("/", "repeat", "outer_fold").alias("fold"), F.when(finite("medians"), F.col("medians")).alias("medians"), ((F.col("kind") == "A") & ~finite("medians")).alias("need"))
    return fill_cells(view, "state_id", ["feature_key", "view_name"], "fold", "medians", "need")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, cells: cells.select(F.lit(name).alias("table_name"), F.col("row_key").cast("bigint"), F.col("field").alias("field_name"))
    return of("measurement", measurement_fills(spark, sf_dir)).unionByName(of("fold_transformer", transformer_fills(spark, sf_dir)))


def p5_measurement_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """measurement with filled cells and their marks; a filled batch is written B and three digits."""
    values = {"x_raw": F.pow(F.lit(2.0), F.col("number")), "detected": F.col("text") == "true", "run_batch": F.concat(F.lit("B"), F.lpad("text", 3, "0"))}
    return apply_fills(table(spark, sf_dir, "measurement"), "row_id", measurement_fills(spark, sf_dir), values)


def p5_transformer_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_fills(table(spark, sf_dir, "fold_transformer"), "state_id", transformer_fills(spark, sf_dir), {"medians": F.col("number")})


def p5_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fills are worth: a twentieth of the known cells of measurement, picked by hash, is hidden and filled.

    error is the root mean square error of log2 x_raw, or the share of wrong labels; baseline that of the group's mean, or of the
    group's commonest label (ties to the smaller one).
    """
    view = stage(measurement_view(spark, sf_dir), "measurement-view")
    fields = {"x_raw": "need_x", "detected": "need_flag", "run_batch": "need_batch"}
    hide = {f: F.col(f).isNotNull() & (F.pmod(F.xxhash64("row_id", F.lit(f)), F.lit(20)) == 0) for f in fields}
    masked = view.drop("need_x", "need_flag").withColumns({n: hide[f] for f, n in fields.items()}).withColumns({f: F.when(~hide[f], F.col(f)) for f in fields})
    masked = stage(masked, "measurement-masked")
    filled = fills_of(masked)
    parts = []
    for f, group in (("x_raw", ["feature_key", "tissue"]), ("detected", ["feature_key", "tissue"]), ("run_batch", ["sample_id", "injection"])):
        known = masked.where(F.col(f).isNotNull())
        if f == "x_raw":
            base = known.groupBy(*group).agg(F.avg(f).alias("base"))
            miss = lambda c: F.pow(F.col(c) - F.col("truth"), F.lit(2.0))
        else:
            each = known.groupBy(*group, F.col(f).cast("string").alias("text")).agg(F.count(F.lit(1)).alias("n"))
            base = each.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("n"), "text")).alias("m")).select(*group, F.col("m.text").alias("base"))
            miss = lambda c: (F.col(c) != F.col("truth")).cast("double")
        truth = view.where(hide[f]).select(F.col("row_id").alias("row_key"), *group, (F.col(f) if f == "x_raw" else F.col(f).cast("string")).alias("truth"))
        got = filled.where(F.col("field") == f).select("row_key", F.col("number" if f == "x_raw" else "text").alias("fill"))
        met = truth.join(got, "row_key").join(base, group).agg(F.count(F.lit(1)).alias("cells"), F.avg(miss("fill")).alias("error"), F.avg(miss("base")).alias("baseline"))
        root = (lambda c: F.sqrt(c)) if f == "x_raw" else F.col
        parts.append(met.select(F.lit(f).alias("field"), "cells", root("error").alias("error"), root("baseline").alias("baseline")))
    return reduce(DataFrame.unionByName, parts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p4_found": p4_found, "p5_found": p5_found, "p5_measurement_filled": p5_measurement_filled, "p5_transformer_filled": p5_transformer_filled, "p5_heldout": p5_heldout}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": oracles.PACKED,
        "p5_found": r"""with m as (select row_id, feature_key, upper(right(trim(sample_id), 1)) as tissue, sample_id, injection, detected, coalesce(isfinite(x_raw) and x_raw > 0, false) as usable,
                regexp_matches(coalesce(run_batch, ''), '(?i)^\s*(?:b(?:atch)?)?[\s_-]*0*([1-9][0-9]{0,8})\s*$') as named from measurement),
            g as (select feature_key, tissue, bool_or(usable) as any_x, bool_or(detected is not null) as any_flag from m where feature_key is not null and tissue is not null group by all),
            r as (select sample_id, injection, bool_or(named) as any_batch from m where sample_id is not null and injection is not null group by all)
            select 'measurement' as table_name, row_id as row_key, 'x_raw' as field_name from m join g using (feature_key, tissue) where detected and not usable and any_x
            union all select 'measurement', row_id, 'detected' from m join g using (feature_key, tissue) where detected is null and any_flag
            union all select 'measurement', row_id, 'run_batch' from m join r using (sample_id, injection) where not named and any_batch
            union all select 'fold_transformer', state_id, 'medians' from fold_transformer f where kind = 'A' and not coalesce(isfinite(medians), false)
                and exists (select 1 from fold_transformer o where o.feature_key = f.feature_key and o.view_name = f.view_name and isfinite(o.medians))""",
    }
