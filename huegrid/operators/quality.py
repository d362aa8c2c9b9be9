"""Band quality, cut-off, band statistics, top-k and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from huegrid.operators.quantiles import exact_quantiles


def reference_quality(refs: DataFrame, floor: float = 1.0, snr_limit: float = 10.0) -> DataFrame:
    """Statistics of white - dark for each band over its spatial pixels; standard deviations divide by n."""
    d = F.col("white") - F.col("dark")
    q = refs.withColumn("d", d).groupBy("band").agg(
        F.avg("d").alias("denominator_mean"),
        F.stddev_pop("d").alias("denominator_std"),
        F.min("d").alias("denominator_min"),
        F.percentile("d", F.array(F.lit(0.01), F.lit(0.05))).alias("q"),
        F.avg((F.col("d") <= 0).cast("double")).alias("nonpositive_fraction"),
        F.avg((F.col("d") <= floor).cast("double")).alias("below_floor_fraction"),
        F.max("white").alias("white_max"),
        F.max("dark").alias("dark_max"),
    )
    snr = F.col("denominator_mean") / (F.col("denominator_std") + 1e-12)
    q = q.withColumns({"denominator_q01": F.col("q")[0], "denominator_q05": F.col("q")[1], "snr_proxy": snr}).drop("q")
    return q.withColumn("low_snr", F.col("snr_proxy").isNull() | F.isnan("snr_proxy") | (F.col("snr_proxy") <= snr_limit))


def terminal_cutoff(quality: DataFrame) -> DataFrame:
    """quality with ``retained``: all bands before the trailing run of low ones; ``interior_low`` marks low bands inside."""
    last_good = F.max(F.when(~F.col("low_snr"), F.col("band"))).over(W.partitionBy())
    rows = quality.withColumn("_last", last_good)
    return rows.withColumns({"retained": F.col("band") <= F.col("_last"), "interior_low": F.col("low_snr") & (F.col("band") < F.col("_last"))}).drop("_last")


def band_statistics(bands: DataFrame) -> DataFrame:
    """For each sample and band: finite count, moments, quantiles by linear interpolation, fractions out of 0..1."""
    finite = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))), F.col("value"))
    levels = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    names = ["q01", "q05", "q25", "median", "q75", "q95", "q99"]
    out = (
        bands.withColumn("v", finite)
        .groupBy("sample_id", "band")
        .agg(
            F.count(F.lit(1)).alias("pixels"),
            F.count("v").alias("finite_count"),
            F.avg("v").alias("mean"),
            F.stddev_pop("v").alias("std"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
            F.percentile("v", F.array(*map(F.lit, levels))).alias("q"),
            F.avg((F.col("v") < 0).cast("double")).alias("negative_fraction"),
            F.avg((F.col("v") > 1).cast("double")).alias("above_one_fraction"),
        )
    )
    out = out.withColumns({n: F.col("q")[i] for i, n in enumerate(names)}).drop("q")
    return out.withColumn("nonfinite_fraction", 1 - F.col("finite_count") / F.col("pixels"))


def band_summary(statistics: DataFrame) -> DataFrame:
    """Each band over the samples, every sample weighing the same."""
    p = lambda c, q: F.percentile(c, F.lit(q))
    return statistics.groupBy("band").agg(
        F.count(F.lit(1)).alias("sample_count"),
        p("negative_fraction", 0.5).alias("median_negative_fraction"),
        p("negative_fraction", 0.9).alias("q90_negative_fraction"),
        F.max("negative_fraction").alias("max_negative_fraction"),
        p("q01", 0.5).alias("median_sample_q01"),
        p("median", 0.5).alias("median_sample_median"),
        p("q99", 0.5).alias("median_sample_q99"),
        p("median", 0.1).alias("q10_sample_median"),
        p("median", 0.9).alias("q90_sample_median"),
    )


def top_per_group(rows: DataFrame, group: list[str], value: str, k: int, ties: list[str]) -> DataFrame:
    """The k greatest finite values of each group, ranked; ties go by the given columns."""
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(value), *ties))
    return good.withColumn("rank", rank).where(F.col("rank") <= k)


def top(rows: DataFrame, value: str, k: int, ties: list[str]) -> DataFrame:
    """The k greatest of all rows. Spark keeps k rows of each task, so only those meet."""
    best = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).orderBy(F.desc(value), *ties).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(value), *ties)))


def robust_limits(bands: DataFrame, by: str) -> DataFrame:
    """Pooled q01 and q99; (0, 1) without values, and low + 1 where both are equal."""
    q = exact_quantiles(bands, [by], "value", {"_low": 0.01, "_high": 0.99})
    low, high = F.coalesce("_low", F.lit(0.0)), F.coalesce("_high", F.lit(1.0))
    return q.select(by, low.alias("low"), F.when(high > low, high).otherwise(low + 1).alias("high"))


def feasibility(counts: DataFrame, q: int) -> DataFrame:
    """What share of a sample's pixels q is, and how many it lacks."""
    n = F.col("pixels")
    return counts.select(
        "sample_id",
        "pixels",
        F.when(n > 0, 100.0 * q / n).alias("requested_percent"),
        F.greatest(F.lit(q) - n, F.lit(0)).cast("long").alias("shortfall"),
        F.when(n >= q, "OK").otherwise("INSUFFICIENT").alias("status"),
    )


def quantile_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, mean, q05, median, q95, max."""
    plain = rows.groupBy(by).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
    q = exact_quantiles(rows, [by], value, {"q05": 0.05, "median": 0.5, "q95": 0.95})
    return plain.join(q.withColumnRenamed(by, "_by"), plain[by].eqNullSafe(F.col("_by"))).select(by, "mean", "q05", "median", "q95", "max")
