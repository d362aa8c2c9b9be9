"""Records of samples and masks, selections by place, matching of clusters by their spectra, checks of counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from huegrid.functions import spectra as S
from huegrid.operators import masks
from huegrid.operators.maps import PIXEL
from huegrid.operators.models import best_assignment, vector_means
from huegrid.operators.sampling import _order


def sample_quality(rows: DataFrame, x: str = "x") -> DataFrame:
    """One record for each sample: why rows are excluded, roughness of the kept SNV spectra, errors of their invariants.

    A sample without a kept row has null roughness and errors."""
    reason, y, value = S.exclusion_reason(F.col(x)), F.col("y"), F.col(x)
    rows = rows.select("sample_id", x, reason.alias("reason"), F.when(reason == 0, S.snv(value)).alias("y"))
    d = S.differences(y)
    rows = rows.withColumns({"rms": S.rms(d), "curve": S.largest(S.differences(d)), "norm": S.l2_norm(y)})
    whole = F.col("reason") != 1
    out = rows.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("pixels"),
        *(F.count_if(F.col("reason") == k).alias(name) for k, name in ((1, "nonfinite"), (2, "flat"), (3, "negative"), (0, "saved"))),
        F.count_if(whole & F.exists(x, lambda v: v < 0)).alias("any_negative"),
        F.count_if(whole & F.exists(x, lambda v: v > 1)).alias("any_above_one"),
        F.percentile("rms", F.lit(0.99)).alias("rms_q99"),
        F.percentile("curve", F.lit(0.99)).alias("curve_q99"),
        F.max("curve").alias("curve_max"),
        F.max(F.abs(S.mean(y))).alias("mean_error"),
        F.max(F.abs(S.sample_sd(y) - 1)).alias("sd_error"),
        F.max(F.abs(F.col("norm") - F.sqrt(F.size(y) - 1.0))).alias("norm_error"),
    )
    return out.withColumn("excluded_fraction", 1 - F.col("saved") / F.col("pixels"))


def dataset_summary(records: DataFrame) -> DataFrame:
    """All samples' records in one row: totals, the excluded fraction and the greatest errors."""
    names = ["pixels", "nonfinite", "flat", "negative", "saved"]
    sums = records.agg(F.count(F.lit(1)).alias("samples"), *(F.sum(n).alias(n) for n in names), *(F.max(n).alias(n) for n in ("mean_error", "sd_error", "norm_error")))
    return sums.withColumn("excluded_fraction", 1 - F.try_divide(F.col("saved"), F.col("pixels")))


def mask_records(pixels: DataFrame, low: float, high: float, height: int, width: int, radius: int = 1, least: int = 2) -> DataFrame:
    """Of pixels with a value: counts of three classes (up to low, up to high, above), then what erosion and small components take
    from the two upper classes, what is left, and its share of the image."""
    v = F.col("value")
    classes = pixels.groupBy("sample_id").agg(
        F.count_if(v <= low).alias("background"), F.count_if((v > low) & (v <= high)).alias("dark"), F.count_if(v > high).alias("bright")
    )
    inner = masks.components(masks.eroded(pixels.where(v > low), height, width, radius), 8)
    sizes = inner.groupBy("sample_id", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("sample_id")
    sizes = sizes.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") < least, F.col("n")).otherwise(0)).alias("small"))
    n, small = (F.coalesce(c, F.lit(0)) for c in ("n", "small"))
    out = classes.join(sizes, "sample_id", "left").withColumns({"eroded": F.col("dark") + F.col("bright") - n, "removed_small": small, "kept": n - small})
    return out.drop("n", "small").withColumn("fraction", F.col("kept") / float(height * width))


def ranked(rows: DataFrame, group: list[str], coarse: str, order: list[str], name: str) -> DataFrame:
    """rows with their place (from 0) in the group by (coarse, *order): places inside a coarse value, plus the rows before it.

    A task sorts the rows of one coarse value; of a group only one count for each coarse value meets. Keys must not be null."""
    inside = F.row_number().over(W.partitionBy(*group, coarse).orderBy(*order)) - 1
    counts = rows.groupBy(*group, coarse).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*group).orderBy(coarse).rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(*group, coarse, F.coalesce(before, F.lit(0)).alias("__b"))
    return rows.withColumn("__i", inside).join(starts, [*group, coarse]).withColumn(name, F.col("__b") + F.col("__i")).drop("__i", "__b")


def masked_rows(pixels: DataFrame, mask: Column) -> DataFrame:
    """The pixels of the mask with ``hdf5_row``: their number in the image, row by row."""
    return ranked(pixels.where(mask), ["sample_id"], "pixel_row", ["pixel_col"], "hdf5_row")


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int, seed: int) -> DataFrame:
    """rows with ``fold`` 1..folds: each class is dealt in hash order, so that its folds differ by one row at most."""
    hashed = rows.withColumn("__h", _order(seed, key)).withColumn("__c", F.substring("__h", 1, 3))
    return ranked(hashed, [label], "__c", ["__h", key], "__p").withColumn("fold", F.col("__p") % folds + 1).drop("__h", "__c", "__p")


def evenly_spaced(rows: DataFrame, group: list[str], place: str, count: int) -> DataFrame:
    """Rows at the places floor(i (n - 1) / (count - 1)) of each group of n rows, numbered from 0 without gaps.

    All of a group that has no more than ``count`` rows."""
    n = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    i = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    wanted = n.where(F.col("__n") > 0).select(*group, "__n", i.alias("__i"))
    at = F.when(F.col("__n") <= count, F.col("__i").cast("long")).otherwise(F.expr(f"(__i * (__n - 1)) div {max(1, count - 1)}"))
    return rows.join(wanted.select(*group, at.alias(place)).distinct(), [*group, place], "left_semi")


def typical_rows(rows: DataFrame, key: str, x: str = "x") -> DataFrame:
    """Of each sample the row nearest its bandwise median, by root mean square; the smallest key on ties."""
    bands = rows.select("sample_id", F.posexplode(x).alias("k", "v")).groupBy("sample_id", "k").agg(F.percentile("v", F.lit(0.5)).alias("m"))
    middle = bands.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda e: e["m"]).alias("__m"))
    distance = S.rms(F.zip_with(x, "__m", lambda a, b: a - b))
    best = F.min(F.struct(distance.alias("distance"), F.col(key).alias("key")))
    return rows.join(middle, "sample_id").groupBy("sample_id").agg(best.alias("b")).select("sample_id", F.col("b.key").alias(key), F.col("b.distance").alias("distance"))


def diverse_triple(rows: DataFrame, x: str = "x", most: int = 2000) -> DataFrame:
    """Of rows with sample_id (one a sample) and a spectrum, the three with the greatest least distance (root mean square) between two
    of them, then the greatest sum of the three; ties go to the smallest samples. With ``least_distance`` of the choice.

    The rows are representatives, ``most`` of them at most (more raise); pairs are taken from the farthest down until three close a
    triangle, so no triples are listed. Fewer than three rows raise, as do spectra that are not finite."""
    found = sorted(rows.select("sample_id", x).limit(most + 1).collect(), key=lambda r: r.sample_id)
    if not 3 <= len(found) <= most:
        raise ValueError(f"three rows are needed and {most} allowed; there are {len(found)}" + " or more" * (len(found) > most))
    values = np.array([r[x] for r in found], np.float64)
    if not np.isfinite(values).all() or len({r.sample_id for r in found}) < len(found):
        raise ValueError("spectra must be finite, and one of each sample")
    i, j = np.triu_indices(len(found), 1)
    apart = np.concatenate([np.sqrt(((values[a] - values[a + 1 :]) ** 2).mean(1)) for a in range(len(found) - 1)])
    order, joined, best, limit = np.argsort(-apart, kind="stable"), [0] * len(found), None, None
    length = {}
    for at in order.tolist():
        if limit is not None and apart[at] < limit:
            break
        a, b = int(i[at]), int(j[at])
        length[a, b] = float(apart[at])
        both = joined[a] & joined[b]
        while both:
            c = (both & -both).bit_length() - 1
            both &= both - 1
            three = tuple(sorted((a, b, c)))
            total = sum(length[p] for p in ((three[0], three[1]), (three[0], three[2]), (three[1], three[2])))
            limit = float(apart[at])
            if best is None or (-total, three) < best:
                best = (-total, three)
        joined[a] |= 1 << b
        joined[b] |= 1 << a
    chosen = [found[k].sample_id for k in best[1]]
    return rows.where(F.col("sample_id").isin(chosen)).withColumn("least_distance", F.lit(limit))


def coordinate_violations(chosen: DataFrame, mask: DataFrame, height: int, width: int) -> DataFrame:
    """rule, n: chosen pixels out of the image, chosen more than once, or not in the mask (the last two of those inside)."""
    inside = F.col("pixel_row").between(0, height - 1) & F.col("pixel_col").between(0, width - 1)
    pixels = chosen.groupBy(*PIXEL).agg(F.count(F.lit(1)).alias("c")).withColumn("inside", F.coalesce(inside, F.lit(False)))
    marked = pixels.join(mask.select(*PIXEL).distinct().withColumn("m", F.lit(True)), PIXEL, "left")
    rules = {
        "out_of_bounds": F.sum(F.when(~F.col("inside"), F.col("c")).otherwise(0)),
        "chosen_twice": F.count_if(F.col("inside") & (F.col("c") > 1)),
        "outside_mask": F.count_if(F.col("inside") & F.col("m").isNull()),
    }
    counts = marked.agg(*(F.coalesce(n, F.lit(0)).alias(rule) for rule, n in rules.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("n")) for rule in rules))))


def fold_summary(pixels: DataFrame, folds: DataFrame, batch: int) -> DataFrame:
    """Samples, pixels and whole batches of each fold."""
    n = pixels.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).join(folds, "sample_id")
    return n.groupBy("test_fold").agg(F.count(F.lit(1)).alias("samples"), F.sum("n").alias("pixels"), F.floor(F.sum("n") / batch).alias("batches"))


def count_differences(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """sample_id, label, mapped, recorded: where the pixels of a map and the recorded counts (sample_id, label, pixels) differ."""
    mapped = labels.groupBy("sample_id", "label").agg(F.count(F.lit(1)).alias("mapped"))
    both = mapped.join(counts.select("sample_id", "label", F.col("pixels").alias("recorded")), ["sample_id", "label"], "full")
    return both.fillna(0, ["mapped", "recorded"]).where("mapped <> recorded")


def centroids(rows: DataFrame, label: str, a: Column, b: Column, labels: int) -> DataFrame:
    """label 1..labels, pixels, and the means of two coordinates; null for a label without rows."""
    all_ = rows.sparkSession.range(1, labels + 1).select(F.col("id").alias("label"))
    found = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("pixels"), F.avg(a).alias("a"), F.avg(b).alias("b"))
    return all_.join(found, "label", "left").fillna(0, ["pixels"])


def density(rows: DataFrame, a: Column, b: Column, bins: int) -> DataFrame:
    """Counts on bins x bins squares over the smallest square that starts at the least of both coordinates: bin_a, bin_b, n.

    Points that are all the same, and nulls, count in square 0."""
    points = rows.select(a.alias("a"), b.alias("b"))
    ends = points.agg(F.min("a").alias("a0"), F.min("b").alias("b0"), F.greatest(F.max("a") - F.min("a"), F.max("b") - F.min("b")).alias("side"))
    at = lambda v, low: F.least(F.coalesce(F.floor(F.try_divide((F.col(v) - F.col(low)) * bins, F.col("side"))), F.lit(0)), F.lit(bins - 1)).cast("long")
    return points.crossJoin(F.broadcast(ends)).groupBy(at("a", "a0").alias("bin_a"), at("b", "b0").alias("bin_b")).agg(F.count(F.lit(1)).alias("n"))  # one row


def spectral_matching(rows: DataFrame, reference: str, target: str, labels: int, x: str = "x") -> DataFrame:
    """All pairs of clusters 1..labels of two labelings: cosine of their mean SNV spectra (every sample weighing the same), whether
    the one-to-one matching with the greatest sum has the pair, and the best other target of the reference.

    labels x bands means come to the driver. A cluster without rows is an error."""
    kept = rows.select("sample_id", reference, target, S.snv(F.col(x)).alias("y")).where("y IS NOT NULL")

    def curves(label: str) -> np.ndarray:
        means = vector_means(vector_means(kept, ["sample_id", label], "y", "m"), [label], "m", "m").collect()
        found = {r[label]: np.array(r.m) for r in means}
        if sorted(found) != list(range(1, labels + 1)):
            raise ValueError(f"{label}: every cluster of 1..{labels} needs rows, and there may be no other")
        y = np.stack([found[k] for k in range(1, labels + 1)])
        return y / np.linalg.norm(y, axis=1, keepdims=True)

    cosine = np.clip(curves(reference) @ curves(target).T, -1, 1)
    match = best_assignment(cosine)
    out = [(i + 1, j + 1, float(cosine[i, j]), match[i] == j, float(np.delete(cosine[i], j).max())) for i in range(labels) for j in range(labels)]
    return rows.sparkSession.createDataFrame(out, "reference long, target long, similarity double, assigned boolean, best_other double")
