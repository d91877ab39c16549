"""Paired views of a long measurement table: entity x feature with a baseline (N) and a case (T) value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.columns import usable


def latest_cells(measurement: DataFrame) -> DataFrame:
    """(feature_key, sample_id, entity, cond, value, y): of each feature and sample the usable value loaded last.

    y is log2 of value. Unusable values (NULL, NaN, infinite, not above 0) make no cell; repeated deliveries make one.
    """
    cells = measurement.where(usable("x_raw")).groupBy("feature_key", "sample_id").agg(F.max_by("x_raw", F.struct("loaded_at", "row_id")).alias("value"))
    return cells.select("feature_key", "sample_id", F.expr("try_cast(nullif(regexp_extract(sample_id, '([0-9]+)', 1), '') as bigint)").alias("entity"), F.upper(F.substring(F.trim("sample_id"), -1, 1)).alias("cond"), "value", F.log2("value").alias("y"))


def centered(cells: DataFrame) -> DataFrame:
    """cells with y less the exact median of its sample."""
    middle = cells.groupBy("sample_id").agg(F.median("y").alias("_middle"))
    return cells.join(middle, "sample_id").withColumn("y", F.col("y") - F.col("_middle")).select(*cells.columns)


def paired(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, feature_key, entity, n, t, delta, state): delta only where both are there; state = [N there] + 2 x [T there].

    Pairs with neither value have no row: their number follows from the number of entities, so no dense grid is built.
    """
    both = cells.groupBy(*keys, "feature_key", "entity").agg(F.max(F.when(F.col("cond") == "N", F.col("y"))).alias("n"), F.max(F.when(F.col("cond") == "T", F.col("y"))).alias("t"))
    return both.withColumn("delta", F.col("t") - F.col("n")).withColumn("state", F.col("n").isNotNull().cast("int") + 2 * F.col("t").isNotNull().cast("int"))


def moments(pairs: DataFrame, keys: tuple[str, ...] = ("feature_key",)) -> DataFrame:
    """Count, mean, median, variance and signs of delta, NULLs skipped; direction consistency without zeros."""
    d = F.col("delta")
    m = pairs.groupBy(*keys).agg(F.count("delta").alias("pairs"), F.avg("delta").alias("mean"), F.median("delta").alias("median"), F.var_samp("delta").alias("variance"), F.count_if(d > 0).alias("positive"), F.count_if(d < 0).alias("negative"))
    return m.withColumn("consistency", F.try_divide(F.greatest("positive", "negative"), F.col("positive") + F.col("negative")))


def state_counts(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Per feature the number of entities in each detection state; entities is one row with `entities`, their number."""
    s = pairs.groupBy("feature_key").agg(*[F.count_if(F.col("state") == k).alias(n) for k, n in ((1, "n_only"), (2, "t_only"), (3, "both"))])
    return s.join(F.broadcast(entities)).withColumn("neither", F.col("entities") - F.col("n_only") - F.col("t_only") - F.col("both")).withColumn("discordant", F.col("n_only") + F.col("t_only")).withColumn("fraction_difference", (F.col("t_only") - F.col("n_only")) / F.col("entities"))


def count_entities(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count_distinct("entity").alias("entities"))
