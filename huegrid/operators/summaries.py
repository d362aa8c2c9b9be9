"""Complete-case summaries of repeated scores: condition, sample_id, repeat, value (null if undefined), reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def contract_violations(scores: DataFrame, repeats: int, low: float, high: float) -> DataFrame:
    """Scores out of range, undefined without a reason, defined with one, given twice, or missing."""
    twice = F.count(F.lit(1)).over(W.partitionBy("condition", "sample_id", "repeat")) > 1
    rule = (
        F.when(twice, "duplicate")
        .when(F.col("value").isNull() & F.col("reason").isNull(), "undefined_without_reason")
        .when(F.col("value").isNotNull() & F.col("reason").isNotNull(), "defined_with_reason")
        .when(F.isnan("value") | ~F.col("value").between(low, high), "out_of_range")
    )
    bad = scores.withColumn("rule", rule).where("rule IS NOT NULL").select("condition", "sample_id", "rule")
    missing = scores.groupBy("condition", "sample_id").agg(F.countDistinct("repeat").alias("n")).where(F.col("n") != repeats)
    return bad.unionByName(missing.select("condition", "sample_id", F.lit("missing_repeat").alias("rule")))


def availability(scores: DataFrame) -> DataFrame:
    """Defined scores and the samples without one, for each condition and repeat."""
    gone = F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.col("sample_id"))))
    return scores.groupBy("condition", "repeat").agg(F.count(F.lit(1)).alias("total"), F.count("value").alias("defined"), F.array_join(gone.cast("array<string>"), ";").alias("unavailable"))


def complete(rows: DataFrame, by: list[str], repeats: int) -> DataFrame:
    """Rows of the samples that are defined in every repeat of every condition there is in ``by``'s complement."""
    n = F.count("value").over(W.partitionBy(*by, "sample_id"))
    return rows.withColumn("_n", n).where(F.col("_n") == repeats).drop("_n")


def repeat_summary(rows: DataFrame, by: list[str], repeats: int = 3) -> DataFrame:
    """common_samples, mean, sample_sd (of sample means), repeat_sd (of repeat macro means), all with n - 1."""
    common = complete(rows, by, repeats)
    per_sample = common.groupBy(*by, "sample_id").agg(F.avg("value").alias("m"))
    samples = per_sample.groupBy(*by).agg(F.count(F.lit(1)).alias("common_samples"), F.stddev_samp("m").alias("sample_sd"))
    macro = common.groupBy(*by, "repeat").agg(F.avg("value").alias("m")).groupBy(*by).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("repeat_sd"))
    return samples.join(macro, by)


def combined(scores: DataFrame, weights: dict[str, int]) -> DataFrame:
    """The weighted sum of conditions for each sample and repeat, null where any of them is undefined or missing."""
    factor: Column | None = None
    for condition, weight in weights.items():
        hit = F.col("condition") == condition
        factor = F.when(hit, float(weight)) if factor is None else factor.when(hit, float(weight))
    rows = scores.where(F.col("condition").isin(*weights)).withColumn("w", factor)
    sums = rows.groupBy("sample_id", "repeat").agg(F.count("value").alias("n"), F.sum(F.col("w") * F.col("value")).alias("s"))
    return sums.select("sample_id", "repeat", F.when(F.col("n") == len(weights), F.col("s")).alias("value"))


def paired_difference(scores: DataFrame, condition: str, reference: str, repeats: int = 3) -> DataFrame:
    rows = combined(scores, {condition: 1, reference: -1}).withColumn("contrast", F.lit(f"{condition}-{reference}"))
    return repeat_summary(rows, ["contrast"], repeats)


def interaction(scores: DataFrame, both: str, first: str, second: str, neither: str, repeats: int = 3) -> DataFrame:
    """(both - first) - (second - neither) over the samples that all four define."""
    rows = combined(scores, {both: 1, first: -1, second: -1, neither: 1}).withColumn("contrast", F.lit("interaction"))
    return repeat_summary(rows, ["contrast"], repeats)


def macro(values: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the samples' means of defined values, and their spread."""
    per = values.groupBy(*by, "sample_id").agg(F.avg("ari").alias("m")).where("m IS NOT NULL")
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sample_sd"))


def complete_pairs(pairs: DataFrame, group: str, planned: int) -> DataFrame:
    """For each sample and group of pairs: defined, complete, mean of complete groups and the partial mean apart."""
    c = pairs.groupBy("sample_id", group).agg(F.count("ari").alias("defined"), F.avg("ari").alias("partial_mean"))
    full = F.col("defined") == planned
    return c.select("sample_id", group, "defined", full.alias("complete"), F.when(full, F.col("partial_mean")).alias("mean"), "partial_mean")


def seed_interval(rows: DataFrame, by: str, seed: str, value: str, t: float) -> DataFrame:
    """Mean and spread over seeds and the half-width t * sd / sqrt(n)."""
    per = rows.groupBy(by, seed).agg(F.avg(value).alias("m"))
    out = per.groupBy(by).agg(F.count(F.lit(1)).alias("seeds"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))
    return out.withColumn("half_width", F.lit(t) * F.col("sd") / F.sqrt("seeds"))


def wide(scores: DataFrame, repeats: list[int]) -> DataFrame:
    """One row for each condition and sample, one column for each repeat."""
    out = scores.groupBy("condition", "sample_id").pivot("repeat", repeats).agg(F.first("value", ignorenulls=True))
    return out.select("condition", "sample_id", *(F.col(str(r)).alias(f"repeat_{r}") for r in repeats))


def paired_tables(scores: DataFrame, condition: str, reference: str, repeats: int = 3) -> DataFrame:
    """Summaries of two conditions and their difference over the samples that both define in every repeat, with the samples left out."""
    two = scores.where(F.col("condition").isin(condition, reference))
    defined = two.groupBy("sample_id").agg(F.count("value").alias("n"))
    common = two.join(defined.where(F.col("n") == 2 * repeats), "sample_id", "left_semi").select("condition", "sample_id", "repeat", "value")
    difference = combined(common, {condition: 1, reference: -1}).withColumn("condition", F.lit(f"{condition}-{reference}"))
    samples = F.count_if(F.col("n") < 2 * repeats).alias("excluded_samples")
    return repeat_summary(common.unionByName(difference), ["condition"], repeats).crossJoin(F.broadcast(defined.agg(samples)))  # one row


def flat_summary(summary: DataFrame, by: list[str], unit: str) -> DataFrame:
    """One row for each statistic of a summary: by, statistic, value, unit."""
    return summary.unpivot(by, ["mean", "sample_sd", "repeat_sd"], "statistic", "value").withColumn("unit", F.lit(unit))


def best_variant(scores: DataFrame, order: list[str]) -> DataFrame:
    """condition, mean: the condition of the greatest mean, not rounded; the first in ``order`` on ties; others don't take part."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("condition"))
    means = scores.where(F.col("condition").isin(*order)).groupBy("condition").agg(F.avg("value").alias("mean")).where("mean IS NOT NULL")
    return means.agg(F.max_by(F.struct("condition", "mean"), F.struct("mean", -place)).alias("b")).where("b IS NOT NULL").select("b.*")
