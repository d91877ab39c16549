"""File sources and sinks: wide tables, gene-set files, checked reads, compressed exports and content manifests."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A source does not keep its contract."""


def read_wide(spark: SparkSession, path: str, id_column: str, value_pattern: str = "^P[0-9]+[NT]$") -> DataFrame:
    """(id, sample_id, text): a wide CSV, one column a sample, unpivoted; all as text, for strict coercion after it.

    Raises ContractError if the id column is missing or no column matches value_pattern.
    """
    wide = spark.read.option("header", True).csv(path)
    samples = [c for c in wide.columns if re.fullmatch(value_pattern.strip("^$"), c)]
    if id_column not in wide.columns or not samples:
        raise ContractError(f"{path} needs the column {id_column} and columns like {value_pattern}")
    return wide.select(F.col(id_column).alias("id"), *[F.col(f"`{c}`") for c in samples]).unpivot("id", samples, "sample_id", "text")


def coerce_numbers(df: DataFrame, text: str) -> DataFrame:
    """df with value (NULL for blank) and failed: text that is there but is no number."""
    number = F.trim(text).try_cast("double")
    return df.withColumn("value", number).withColumn("failed", F.coalesce((F.trim(text) != "") & number.isNull(), F.lit(False)))


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(name, stable_id, genes): tab-separated gene sets; lines of fewer than three fields are skipped, members kept once in order."""
    f = F.split("value", "\t")
    fields = spark.read.text(path).select(f.alias("f")).where("size(f) >= 3")
    genes = F.array_distinct(F.filter(F.transform(F.slice("f", F.lit(3), F.size("f") - 2), F.trim), lambda g: g != ""))
    return fields.select(F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).alias("stable_id"), genes.alias("genes"))


def content_manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.upper(F.sha2("content", 256)).alias("sha256"))


def checked_read(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The text of a file whose checksum is the frozen one; ContractError otherwise."""
    got = content_manifest(spark, path).agg(F.max("sha256")).first()[0]
    if got != sha256.upper():
        raise ContractError(f"{path} has another checksum")
    return spark.read.text(path)


def content_hash(df: DataFrame) -> str:
    """A hash of a table's rows, whatever their order: the same for the same content on every run."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")).first()
    return f"{r.n}-{r.s}-{r.x}"


def export_csv(df: DataFrame, path: str, compressed: bool = False) -> None:
    """CSV with a header, lists joined by ';', gzip on demand."""
    flat = df.select(*[F.array_join(c, ";").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes])
    w = flat.write.mode("overwrite").option("header", True)
    (w.option("compression", "gzip") if compressed else w).csv(path)
