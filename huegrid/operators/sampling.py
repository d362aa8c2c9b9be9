"""Seeds, folds, samples and plans. Whatever is random is a hash of a seed and a key, so it never depends on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def purpose_seed(namespace: str, root: int, purpose: str, *context: Column) -> Column:
    """The first four bytes of the SHA-256 of the compact JSON array [namespace, root, purpose, *context]."""
    text = F.concat(F.lit(f'["{namespace}",{root},"{purpose}"'), *(x for c in context for x in (F.lit(","), c.cast("string"))), F.lit("]"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")


def seed_plan(spark: SparkSession, purposes: list[str], folds: int, repeats: int, namespace: str = "huegrid", root: int = 1) -> DataFrame:
    grid = spark.range(1, folds + 1).toDF("fold").crossJoin(spark.range(1, repeats + 1).toDF("repeat"))
    cases = [F.struct(F.lit(p).alias("purpose"), purpose_seed(namespace, root, p, F.col("fold"), F.col("repeat")).alias("seed")) for p in purposes]
    return grid.select("fold", "repeat", F.inline(F.array(*cases)))


def collisions(plan: DataFrame) -> DataFrame:
    return plan.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _order(seed: int, *keys: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)), 256)


def balanced_folds(samples: DataFrame, folds: int, seed: int) -> DataFrame:
    """Samples in hash order dealt to folds whose sizes differ by one at most (a list of samples, not of pixels)."""
    order = W.orderBy(_order(seed, "sample_id"), "sample_id")
    return samples.select("sample_id", F.ntile(folds).over(order).cast("long").alias("test_fold"))


def sample_rows(rows: DataFrame, group: list[str], key: str, q: int, seed: int) -> DataFrame:
    """q rows of each group without replacement: the first q by hash."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(_order(seed, *group, key), key))
    return rows.withColumn("_r", rank).where(F.col("_r") <= q).drop("_r")


def stratified_split(rows: DataFrame, label: str, key: str, parts: list[tuple[str, float]], seed: int) -> DataFrame:
    """rows with ``split``: within each class, shares in hash order with exact counts (rounded down, the last takes the rest)."""
    by = W.partitionBy(label)
    place = F.row_number().over(by.orderBy(_order(seed, key), key))
    n = F.count(F.lit(1)).over(by)
    rows, share, split = rows.withColumns({"_p": place, "_n": n}), 0.0, None
    for name, part in parts[:-1]:
        share += part
        inside = F.col("_p") <= F.floor(F.col("_n") * F.lit(round(share, 9)))
        split = F.when(inside, name) if split is None else split.when(inside, name)
    last = F.lit(parts[-1][0])
    return rows.withColumn("split", last if split is None else split.otherwise(last)).drop("_p", "_n")


def pair_plan(spark: SparkSession, encoders: int, kmeans: int) -> DataFrame:
    """All pairs of maps, within an encoder or between; ``initial`` pairs hold the map (1, 1)."""
    m = spark.range(encoders * kmeans).select((F.expr(f"id div {kmeans}") + 1).alias("e"), (F.col("id") % kmeans + 1).alias("k"))
    a, b = m.toDF("encoder_a", "kmeans_a"), m.toDF("encoder_b", "kmeans_b")
    left, right = F.struct("encoder_a", "kmeans_a"), F.struct("encoder_b", "kmeans_b")
    pairs = a.crossJoin(b).where(left < right)  # of a fixed plan
    return pairs.withColumns(
        {
            "pair_group": F.when(F.col("encoder_a") == F.col("encoder_b"), "within").otherwise("between"),
            "initial": (F.col("encoder_a") == 1) & (F.col("kmeans_a") == 1),
        }
    )


def selection_violations(chosen: DataFrame, folds: DataFrame, q: int) -> DataFrame:
    """rule, n: how many rows of a fold plan break each rule (fold, sample_id, hdf5_row chosen for training)."""
    rule = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
    leak = chosen.join(folds.select("sample_id", F.col("test_fold").alias("fold")), ["sample_id", "fold"], "left_semi")
    counts = chosen.groupBy("fold", "sample_id").agg(F.count(F.lit(1)).alias("c"))
    twice = chosen.groupBy("fold", "sample_id", "hdf5_row").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    unknown = chosen.join(folds, "sample_id", "left_anti")
    sizes = folds.groupBy("test_fold").agg(F.count(F.lit(1)).alias("c")).agg((F.max("c") - F.min("c")).alias("d")).where("d > 1")
    parts = [rule(leak, "leakage"), rule(counts.where(F.col("c") != q), "wrong_count"), rule(twice, "duplicate_row"), rule(unknown, "unknown_sample"), rule(sizes, "unbalanced_folds")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
