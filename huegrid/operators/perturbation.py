"""Label-flip rates: how often a label changes when a spectrum is perturbed and assigned again."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huegrid.functions import spectra
from huegrid.operators.models import assigned


def unit_hash(*keys: Column) -> Column:
    """A number in 0..1 from the SHA-256 of the keys: the same on every engine and for any partitioning."""
    text = F.concat_ws("|", *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def shift_draws(rows: DataFrame, key: str, draws: int, reach: float, x: str = "x") -> DataFrame:
    """Each row ``draws`` times (column draw), its spectrum shifted by -reach..reach bands, recentred, its norm kept."""
    out = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("draw", F.col("draw").cast("long"))
    delta = (unit_hash(F.lit("shift"), F.col(key), F.col("draw")) * 2 - 1) * reach
    norm = F.sqrt(spectra.dot(F.col(x), F.col(x)))
    return out.withColumn("_d", delta).withColumn(x, spectra.recentred(spectra.shifted(F.col(x), F.col("_d")), norm)).drop("_d")


KINDS = ("noise", "shift", "both")


def normal_noise(key: str, bands: Column) -> Column:
    """Independent standard normal numbers, one a band, from the SHA-256 of key, draw and band (Box and Muller)."""

    def one(b: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit("noise"), F.col(key).cast("string"), F.col("draw").cast("string"), b.cast("string")).cast("binary"), 256)
        part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("double")
        return F.sqrt(-2 * F.log((part(1) + 1) / 4294967297.0)) * F.cos(2 * math.pi * part(9) / 4294967296.0)

    return F.transform(F.sequence(F.lit(0), bands - 1), one)


def perturbed(rows: DataFrame, key: str, draws: int = 5, reach: float = 2.0, angles: tuple[float, float] = (0.5, 3.0), x: str = "x") -> DataFrame:
    """Each row ``draws`` times for each of KINDS (columns kind, draw): turned by an angle (degrees) towards normal noise,
    shifted by -reach..reach bands, or turned and then shifted; mean zero and the norm are kept."""
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)).cast("array<long>")))
    theta = F.radians(unit_hash(F.lit("angle"), F.col(key), F.col("draw")) * (angles[1] - angles[0]) + angles[0])
    delta = (unit_hash(F.lit("shift"), F.col(key), F.col("draw")) * 2 - 1) * reach
    moved = lambda v, p: spectra.recentred(spectra.shifted(v, p["d"]), p["n"])

    def cases(p: Column) -> Column:
        """All kinds of a draw, from noise that is made once."""
        each = lambda t: F.array(*(F.struct(F.lit(k).alias("kind"), v.alias(x)) for k, v in zip(KINDS, (t, moved(F.col(x), p), moved(t, p)), strict=True)))
        return spectra.let(spectra.rotated(F.col(x), p["e"], theta), each)

    given = F.struct(normal_noise(key, F.size(x)).alias("e"), delta.alias("d"), F.sqrt(spectra.dot(F.col(x), F.col(x))).alias("n"))
    kept = [c for c in drawn.columns if c != x]
    return drawn.select(*kept, F.inline(spectra.let(given, cases)))


def flip_counts(clean: DataFrame, draws: Callable[[DataFrame], DataFrame], centers: DataFrame, x: str = "x", by: tuple[str, ...] = ("sample_id", "draw")) -> DataFrame:
    """``by``, pixels, flips: labels of the perturbed rows against their own before, for the same fixed centres; no join."""
    before = assigned(clean, centers, x).withColumnRenamed("label", "clean_label")
    return assigned(draws(before), centers, x).groupBy(*by).agg(F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("label") != F.col("clean_label")).alias("flips"))


def flip_rates(counts: DataFrame, draws: int) -> DataFrame:
    """Mean flip rate over draws; null where a draw is missing."""
    out = counts.groupBy("sample_id").agg(F.avg(F.col("flips") / F.col("pixels")).alias("m"), F.count(F.lit(1)).alias("draws"))
    return out.select("sample_id", "draws", F.when(F.col("draws") == draws, F.col("m")).alias("flip_rate"))


def perturbation(rows: DataFrame, change: Callable[[Column], Column], x: str = "x") -> DataFrame:
    """rows with the angle, RMS and greatest difference that ``change`` makes."""
    out = rows.withColumn("_y", change(F.col(x)))
    d = F.zip_with("_y", x, lambda a, b: a - b)
    return out.withColumns({"angle_degrees": spectra.angle_degrees(F.col(x), F.col("_y")), "rms_difference": spectra.rms(d), "max_difference": spectra.largest(d)}).drop("_y")
