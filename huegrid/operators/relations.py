"""Checks on keys: look-ups that must match, complements, partitions, composed mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def looked_up(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of right; a row of left without one in right ends the job, a key twice in right is the caller's choice."""
    marked = right.withColumn("__there", F.lit(True))
    there = F.coalesce("__there", F.raise_error(F.concat(F.lit("no match for "), F.to_json(F.struct(*keys)))).cast("boolean"))
    return left.join(marked, keys, "left").where(there).drop("__there")


def complement(whole: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    return whole.join(chosen.select(*keys), keys, "left_anti")


def partition_violations(parts: DataFrame, whole: DataFrame, part: str, key: str) -> DataFrame:
    """rule, n: keys in several parts, keys of the whole in no part, and keys that the whole doesn't have."""
    of = parts.select(key, part).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = of.join(whole.select(key).distinct().withColumn("w", F.lit(1)), key, "full")
    rules = {"overlap": F.col("n") > 1, "missing": F.col("n").isNull(), "unknown": F.col("w").isNull()}
    counts = both.agg(*(F.count_if(rule).alias(name) for name, rule in rules.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules))))


def composed(first: DataFrame, second: DataFrame) -> DataFrame:
    """source, target: the mapping ``second`` after ``first`` (both source, target); what second doesn't map is null."""
    a, b = first.toDF("source", "middle"), second.toDF("middle", "target")
    return a.join(b, "middle", "left").select("source", "target")
