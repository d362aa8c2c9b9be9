"""Statistics of label maps: sample_id, pixel_row, pixel_col, label. A missing row is background.

Neighbours are found by shifted coordinates: counts in windows inside blocks of the image with their rims, pairs by equi joins in
which each pixel is sent to half of its window. Boundaries of several maps are compared in ``reproducibility``.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

PIXEL = ["sample_id", "pixel_row", "pixel_col"]
BLOCK = 128  # pixels along one side of a block; a wider window takes its own width


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def _moved(df: DataFrame, offsets: Iterable[tuple[int, int]], row: str = "pixel_row", col: str = "pixel_col") -> DataFrame:
    at = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets)))
    return df.withColumn("_at", at).withColumns({row: F.col(row) + F.col("_at.dr"), col: F.col(col) + F.col("_at.dc")}).drop("_at")


def half_window(width: int) -> list[tuple[int, int]]:
    r = width // 2
    return [(a, b) for a in range(0, r + 1) for b in range(-r, r + 1) if a > 0 or b > 0]


def neighbour_pairs(labels: DataFrame, width: int) -> DataFrame:
    """sample_id, label, other: each pair of pixels within the window, once."""
    moved = _moved(labels.withColumnRenamed("label", "other"), half_window(width))
    return labels.join(moved, PIXEL).select("sample_id", "label", "other")


def _around(keys: np.ndarray, at: np.ndarray, span: int, r: int) -> np.ndarray:
    """How many keys (row * span + column) are within r rows and columns of each place, without those at the place itself."""
    keys = np.sort(keys)
    upto = lambda k, side: np.searchsorted(keys, k, side)
    total = upto(at, "left") - upto(at, "right")
    for d in range(-r, r + 1):
        total += upto(at + d * span + r, "right") - upto(at + d * span - r, "left")
    return total


def window_counts(labels: DataFrame, width: int) -> DataFrame:
    """sample_id, others, alike: for each pixel, the other pixels within its window and those of its label.

    Each pixel is sent to the block of the image that owns it, and to a neighbouring one where a window reaches it, in one shuffle
    and one sort; inside a block, a row of a window is a range of the sorted places, of all pixels and of those of one label. A
    null label is like no other, a pixel with a null coordinate is left out, copies at one place are no neighbours of each other."""
    r, block = width // 2, max(BLOCK, width)
    reached = lambda c: F.explode(F.sequence(F.floor((F.col(c) - r) / block), F.floor((F.col(c) + r) / block)))
    kind = "long" if isinstance(labels.schema["label"].dataType, IntegralType) else "string"
    known = F.col("label").isNotNull().alias("known")
    label = F.coalesce(F.col("label").cast(kind), F.lit(0).cast(kind)).alias("label")
    rows = labels.dropna(subset=PIXEL).select("sample_id", *(F.col(c).cast("long").alias(c) for c in PIXEL[1:]), label, known)
    rows = rows.withColumn("block_row", reached("pixel_row")).withColumn("block_col", reached("pixel_col"))

    def count(group: pd.DataFrame) -> pd.DataFrame:
        row, col = (group[c].to_numpy() for c in PIXEL[1:])
        own = (row // block == group["block_row"].to_numpy()) & (col // block == group["block_col"].to_numpy())
        row, col = row - row.min() + r, col - col.min() + r
        span, area = int(col.max()) + r + 1, (int(row.max()) + r + 1) * (int(col.max()) + r + 1)
        place, known = row * span + col, group["known"].to_numpy()
        others, alike = _around(place, place[own], span, r), np.zeros(own.sum(), np.int64)
        named = pd.factorize(group["label"])[0].astype(np.int64) * area + place
        alike[known[own]] = _around(named[known], named[own & known], span, r)
        return pd.DataFrame({"sample_id": pd.Series([group["sample_id"].iloc[0]] * len(others), dtype=object), "others": others, "alike": alike})

    schema = f"sample_id {labels.schema['sample_id'].dataType.simpleString()}, others long, alike long"
    return rows.groupBy("sample_id", "block_row", "block_col").applyInPandas(count, schema)


def occupancy(labels: DataFrame) -> DataFrame:
    """sample_id, label, pixels, fraction."""
    counts = labels.groupBy("sample_id", "label").agg(F.count(F.lit(1)).alias("pixels"))
    return counts.withColumn("fraction", F.col("pixels") / F.sum("pixels").over(W.partitionBy("sample_id")))


def used_clusters(labels: DataFrame) -> DataFrame:
    return occupancy(labels).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("used"), F.max("fraction").alias("max_fraction"), (F.count(F.lit(1)) == 1).alias("single_cluster")
    )


def lla(labels: DataFrame, width: int) -> DataFrame:
    """Local label agreement of each sample: pairs and matches (directed), lla, adjusted_lla, reasons."""
    pairs = window_counts(labels, width).groupBy("sample_id").agg(F.sum("others").alias("pairs"), F.sum("alike").alias("matches"))
    counts = labels.groupBy("sample_id", "label").agg(F.count(F.lit(1)).alias("n"))
    chance = counts.groupBy("sample_id").agg(F.sum("n").alias("pixels"), F.sum(_exact(F.col("n") * (F.col("n") - 1))).alias("e"))
    rows = chance.join(pairs, "sample_id", "left").fillna(0, ["pairs", "matches"])
    t = _exact(F.col("pixels") * (F.col("pixels") - 1))
    p, m, e = _exact("pairs"), _exact("matches"), F.col("e").cast("decimal(19,0)")
    few, none, single = F.col("pixels") < 2, F.col("pairs") == 0, (t == e) & (F.col("pixels") >= 1)
    reasons = F.concat_ws(";", F.when(few, "fewer_than_two_valid_pixels"), F.when(none, "no_valid_neighbor_pairs"), F.when(single, "single_cluster"))
    return rows.select(
        "sample_id",
        "pixels",
        "pairs",
        "matches",
        _ratio(F.col("matches"), F.col("pairs")).alias("lla"),
        F.when(~(few | none | single), _ratio((m * t) - (p * e), p * (t - e).cast("decimal(19,0)"))).alias("adjusted_lla"),
        F.when(reasons != "", reasons).alias("reasons"),
    )


def contingency(pairs: DataFrame, left: str = "l1", right: str = "l2", by: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    return pairs.groupBy(*by, left, right).agg(F.count(F.lit(1)).alias("n"))


def _choose(n: Column) -> Column:
    return F.sum(_exact(n * (n - 1) / 2))


def adjusted_rand(table: DataFrame, left: str = "l1", right: str = "l2", by: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Adjusted Rand index from contingency rows; 1 where its denominator is 0, null below two pixels."""
    cells = table.groupBy(*by).agg(_choose(F.col("n")).alias("c"), F.sum("n").alias("pixels"))
    for side, name in ((left, "a"), (right, "b")):
        margin = table.groupBy(*by, side).agg(F.sum("n").alias("n")).groupBy(*by).agg(_choose(F.col("n")).alias(name), F.count(F.lit(1)).alias(f"used_{name}"))
        cells = cells.join(margin, list(by))
    c, a, b = (F.col(x).cast("double") for x in "cab")
    t = F.col("pixels") * (F.col("pixels") - 1) / 2
    bottom = (a + b) * t - 2 * a * b
    value = F.when(F.col("pixels") < 2, None).when(bottom == 0, 1.0).otherwise(F.try_divide(2 * (c * t - a * b), bottom))
    return cells.select(*by, "pixels", F.col("used_a"), F.col("used_b"), value.alias("ari"))


def repeat_ari(repeats: DataFrame) -> DataFrame:
    """Adjusted Rand index of each sample and pair of repeats: sample_id, repeat_a, repeat_b, ari."""
    a = repeats.select(*PIXEL, F.col("repeat").alias("repeat_a"), F.col("label").alias("l1"))
    b = repeats.select(*PIXEL, F.col("repeat").alias("repeat_b"), F.col("label").alias("l2"))
    by = ("sample_id", "repeat_a", "repeat_b")
    pairs = a.join(b, PIXEL).where("repeat_a < repeat_b")
    return adjusted_rand(contingency(pairs, by=by), by=by).select(*by, "ari")


def entropies(table: DataFrame, left: str = "l1", right: str = "l2") -> DataFrame:
    """H(right | left), H(left | right) and their sum, in bits."""
    rows = table.withColumns(
        {x: F.sum("n").over(W.partitionBy("sample_id", *k)) for x, k in (("nl", [left]), ("nr", [right]), ("total", []))}
    )
    part = F.col("n") / F.col("total")
    h = rows.groupBy("sample_id").agg(F.sum(part * F.log2(F.col("nl") / F.col("n"))).alias("h_b_given_a_bits"), F.sum(part * F.log2(F.col("nr") / F.col("n"))).alias("h_a_given_b_bits"))
    return h.withColumn("vi_bits", F.col("h_b_given_a_bits") + F.col("h_a_given_b_bits"))


def edges(labels: DataFrame) -> DataFrame:
    """Internal edges to the right and downward: sample_id, i, j (doubled coordinates of the midpoint), boundary."""
    other = _moved(labels.withColumn("r0", F.col("pixel_row")).withColumn("c0", F.col("pixel_col")).withColumnRenamed("label", "other"), [(0, 1), (1, 0)])
    return labels.join(other, PIXEL).select(
        "sample_id", (F.col("pixel_row") + F.col("r0")).alias("i"), (F.col("pixel_col") + F.col("c0")).alias("j"), (F.col("label") != F.col("other")).alias("boundary")
    )


def boundary(labels: DataFrame) -> DataFrame:
    return edges(labels).where("boundary").select("sample_id", "i", "j")


def diagnostics(labels: DataFrame) -> DataFrame:
    """valid_pixels, valid_edges, boundary_edges, boundary_density of each sample."""
    found = edges(labels).groupBy("sample_id").agg(F.count(F.lit(1)).alias("valid_edges"), F.count_if("boundary").alias("boundary_edges"))
    rows = labels.groupBy("sample_id").agg(F.count(F.lit(1)).alias("valid_pixels")).join(found, "sample_id", "left").fillna(0)
    return rows.withColumn("boundary_density", _ratio(F.col("boundary_edges"), F.col("valid_edges")))


def silhouette(points: DataFrame, label: str = "label", x: str = "z") -> DataFrame:
    """points with ``silhouette``: the exact cosine silhouette over all points, from one sum vector for each cluster."""
    sums = points.select(label, F.posexplode(x).alias("k", "v")).groupBy(label, "k").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    clusters = sums.groupBy(label).agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda e: e["s"]).alias("s"))
    # As many rows as there are clusters, each as long as one vector.
    all_clusters = clusters.agg(F.collect_list(F.struct(F.col(label).alias("label"), "n", "s")).alias("clusters"))
    to = lambda z, s: F.aggregate(F.zip_with(z, s, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    rows = points.crossJoin(F.broadcast(all_clusters))
    own = F.filter("clusters", lambda c: c["label"] == F.col(label))[0]
    rows = rows.withColumn("_own", own).withColumn(
        "_b", F.array_min(F.transform(F.filter("clusters", lambda c: c["label"] != F.col(label)), lambda c: F.greatest(F.lit(0.0), 1 - to(F.col(x), c["s"]) / c["n"])))
    )
    a = F.greatest(F.lit(0.0), 1 - F.try_divide(to(F.col(x), F.col("_own.s")) - 1, F.col("_own.n") - 1))
    value = F.when((F.col("_own.n") == 1) | (F.greatest(a, F.col("_b")) == 0), 0.0).otherwise((F.col("_b") - a) / F.greatest(a, F.col("_b")))
    return rows.withColumn("silhouette", F.when(F.col("_b").isNotNull(), F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0)))).drop("clusters", "_own", "_b")


def violations(labels: DataFrame, clusters: int) -> DataFrame:
    """Rows that break the rules of a label map: label out of range, or a pixel given twice."""
    twice = F.count(F.lit(1)).over(W.partitionBy(*PIXEL)) > 1
    rule = F.when(F.col("label").isNull() | ~F.col("label").between(1, clusters), "label_out_of_range").when(twice, "duplicate_pixel")
    return labels.withColumn("rule", rule).where("rule IS NOT NULL")
