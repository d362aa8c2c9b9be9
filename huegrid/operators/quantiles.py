"""Exact quantiles of groups of any size, by selection: a histogram finds the bins that hold the ranks, and only these are sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bins of each factor e of the magnitude: a bin spans values within 1/64 of each other, relative to their size.
FINE = 64


def bin_of(value: Column) -> Column:
    """A whole number that never falls as the value rises: 0 for 0, and the logarithm of the magnitude, mirrored below 0."""
    size = F.floor(F.log(F.abs(value)) * FINE) + (1 << 20)  # logarithms of doubles lie within -745 and 710
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, size).otherwise(-size)


def exact_quantiles(rows: DataFrame, by: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """by, and a column for each level (name to probability): quantiles by linear interpolation, null without values.

    Nulls, NaN and infinities are not values. The first pass counts values by group and bin, which adds up inside tasks; ranks follow
    from running counts over a group's bins. The second pass reads the values again, keeps those in the bins that hold a rank, and counts
    equal ones; no task holds more of a group than the distinct values of one bin."""
    if not levels or any(not 0 <= p <= 1 for p in levels.values()):
        raise ValueError("levels are probabilities, one at least")
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__all"))
    v = F.col(value).cast("double")
    good = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    keyed = good.select(F.struct(*by, F.lit(0).alias("__0")).alias("__g"), (v + 0.0).alias("__v")).withColumn("__b", bin_of(F.col("__v")))
    counts = keyed.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(W.partitionBy("__g").orderBy("__b").rowsBetween(W.unboundedPreceding, 0))
    counts = counts.select("__g", "__b", upto.alias("__upto"), "__n", F.sum("__n").over(W.partitionBy("__g")).alias("__total"))
    ranks = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("__total") - 1)).alias("at")) for name, p in levels.items()))
    wanted = counts.select("*", F.inline(ranks)).select("*", F.inline(F.array(*(F.struct(F.lit(high).alias("high"), f("at").cast("long").alias("rank")) for high, f in ((False, F.floor), (True, F.ceil))))))
    wanted = wanted.where((F.col("rank") < F.col("__upto")) & (F.col("rank") >= F.col("__upto") - F.col("__n")))
    held = wanted.select("__g", "__b", "name", "at", "high", (F.col("rank") - F.col("__upto") + F.col("__n")).alias("rank"))  # in its bin
    bins = held.select("__g", "__b").distinct()
    values = keyed.join(bins, ["__g", "__b"], "left_semi").groupBy("__g", "__b", "__v").agg(F.count(F.lit(1)).alias("__k"))
    until = F.sum("__k").over(W.partitionBy("__g", "__b").orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    found = values.withColumn("__until", until).join(held, ["__g", "__b"]).where((F.col("rank") < F.col("__until")) & (F.col("rank") >= F.col("__until") - F.col("__k")))
    side = lambda name, high: F.max(F.when((F.col("name") == name) & (F.col("high") == high), F.col("__v")))
    part = lambda name: F.max(F.when(F.col("name") == name, F.col("at") - F.floor("at")))
    out = found.groupBy("__g").agg(*(((1 - part(n)) * side(n, False) + part(n) * side(n, True)).alias(n) for n in levels))
    return groups.withColumn("__g", F.struct(*by, F.lit(0).alias("__0"))).join(out, "__g", "left").select(*by, *levels)
