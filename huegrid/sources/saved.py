"""Saved samples in a layout sorted by sample and row, and scans of selected rows that skip what holds none of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["sample_id", "hdf5_row"]


def save_samples(rows: DataFrame, path: str, group_rows: int = 2048) -> None:
    """Parquet files that each hold a range of (sample_id, hdf5_row) in order, in row groups of ``group_rows`` rows at most."""
    ranged = rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    ranged.write.option("parquet.block.row.count.limit", group_rows).option("parquet.page.row.count.limit", group_rows).parquet(path)


def row_ranges(selection: DataFrame, chunk: int) -> DataFrame:
    """sample_id, low, high: the runs of neighbouring chunks (of ``chunk`` rows) that hold a selected row, one row a run."""
    chunks = selection.select("sample_id", F.floor(F.col("hdf5_row") / chunk).alias("c")).distinct()
    run = F.col("c") - F.row_number().over(W.partitionBy("sample_id").orderBy("c"))
    runs = chunks.withColumn("run", run).groupBy("sample_id", "run").agg(F.min("c").alias("a"), F.max("c").alias("b"))
    return runs.select("sample_id", (F.col("a") * chunk).alias("low"), ((F.col("b") + 1) * chunk - 1).alias("high"))


def range_filter(selection: DataFrame, chunk: int, most: int) -> Column | None:
    """A condition for the scan that no selected row fails: the runs of chunks if there are ``most`` at most, else the samples and the least
    and greatest row, else (too many samples, too) the latter alone; None for an empty selection. At most ``most`` rows are collected."""
    found = row_ranges(selection, chunk).limit(most + 1).collect()
    if not found:
        return None
    either = lambda some: reduce(lambda a, b: a | b, some)
    if len(found) <= most:
        by: dict = {}
        for r in found:
            by.setdefault(r.sample_id, []).append((F.col("hdf5_row") >= r.low) & (F.col("hdf5_row") <= r.high))
        return either((F.col("sample_id") == sample) & either(rows) for sample, rows in by.items())
    span = selection.agg(F.min("hdf5_row").alias("low"), F.max("hdf5_row").alias("high")).first()
    rows = F.col("hdf5_row").between(span.low, span.high)
    samples = [r.sample_id for r in selection.select("sample_id").distinct().limit(most + 1).collect()]
    return rows & F.col("sample_id").isin(samples) if len(samples) <= most else rows


def selected(spark: SparkSession, path: str, selection: DataFrame, chunk: int = 2048, most: int = 200) -> DataFrame:
    """The saved rows of a selection (sample_id, hdf5_row, pixel_row, pixel_col), with all their columns.

    The selection's rows are small keys; their ranges become a filter that Parquet checks against the bounds of its row groups and
    pages, so those without a chosen row are not read, and a join then keeps the chosen rows alone. A row whose coordinates are not the
    selection's raises; so does a spectrum (column x) with a band that is not finite or with nothing but zeros."""
    stored = spark.read.parquet(path)
    ranges = range_filter(selection, chunk, most)
    stored = stored.where(ranges if ranges is not None else F.lit(False))
    want = selection.select(*KEY, F.col("pixel_row").alias("_row"), F.col("pixel_col").alias("_col")).distinct()
    both = stored.join(want, KEY)
    where = F.concat_ws(" ", F.lit("sample"), F.col("sample_id").cast("string"), F.lit("row"), F.col("hdf5_row").cast("string"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    wrong = (
        F.when(~(F.col("pixel_row").eqNullSafe(F.col("_row")) & F.col("pixel_col").eqNullSafe(F.col("_col"))), "coordinate mismatch")
        .when(~F.coalesce(finite, F.lit(False)), "non-finite spectrum")
        .when(~F.exists("x", lambda v: v != 0), "zero spectrum")
    )
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat_ws(": ", where, wrong)).cast("array<double>")).otherwise(F.col("x"))
    return both.withColumn("x", checked).drop("_row", "_col")


def missing(spark: SparkSession, path: str, selection: DataFrame) -> DataFrame:
    """sample_id, hdf5_row of the selection that are not saved; reads no spectra."""
    return selection.select(*KEY).distinct().join(spark.read.parquet(path).select(*KEY), KEY, "left_anti")
