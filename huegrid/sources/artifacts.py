"""Staged writing, ledgers of files and comparisons of tables and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), bytes, sha256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", F.lit("\\Q" + folder.rstrip("/").split("/")[-1] + "/\\E")), -1)
    return files.select(name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def inventory_difference(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """path, status (missing, unexpected, changed) of two ledgers; nothing where they agree."""
    a = actual.select("path", F.struct("bytes", "sha256").alias("a"))
    e = expected.select("path", F.struct("bytes", "sha256").alias("e"))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("a") != F.col("e"), "changed")
    return a.join(e, "path", "full_outer").select("path", status.alias("status")).where("status IS NOT NULL")


def table_difference(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of either table that the other one lacks, with their side."""
    left = actual.exceptAll(expected).withColumn("side", F.lit("unexpected"))
    return left.unionByName(expected.exceptAll(actual).withColumn("side", F.lit("missing")))


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(*keys).distinct().withColumn("l", F.lit(1)), right.select(*keys).distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only")
    return a.join(b, keys, "full_outer").select(*keys, side.alias("side")).where("side IS NOT NULL")


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write once: Spark's committer makes the folder visible with its _SUCCESS file; an existing folder is an error."""
    df.write.mode("errorifexists").partitionBy(*partition_by).option("compression", "zstd").parquet(path)


def require_empty(violations: DataFrame, what: str) -> None:
    """Raise with the first rows of a table of violations, if it has any."""
    some = violations.limit(5).collect()
    if some:
        raise ValueError(f"{what}: {[r.asDict() for r in some]}")
