"""Column functions on spectra (arrays of doubles). All stay in the JVM and give null where a value is undefined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, and not again for every element of a function in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def finite_count(x: Column) -> Column:
    return F.size(F.filter(x, _finite))


def l2_norm(x: Column) -> Column:
    """The norm, only where every band is finite."""
    return F.when(finite_count(x) == F.size(x), F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)))


def calibrated(intensity: Column, white: Column, dark: Column) -> Column:
    """(I - D) / (W - D), null where the denominator is not a positive number."""
    span = white - dark
    return F.when(_finite(span) & (span > 0), (intensity - dark) / span)


def calibrated_spectrum(intensity: Column, white: Column, dark: Column) -> Column:
    parts = F.arrays_zip(intensity.alias("i"), white.alias("w"), dark.alias("d"))
    return F.transform(parts, lambda p: calibrated(p["i"], p["w"], p["d"]))


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def sample_sd(x: Column) -> Column:
    return let(mean(x), lambda m: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / (F.size(x) - 1)))


def snv(x: Column) -> Column:
    """(x - mean) / sd with n - 1; null if a band is not finite or the sd is not a positive number."""
    good = (finite_count(x) == F.size(x)) & (F.size(x) > 1)
    scaled = lambda p: F.when(p["s"] > 0, F.transform(x, lambda v: (v - p["m"]) / p["s"]))
    return F.when(good, let(F.struct(mean(x).alias("m"), sample_sd(x).alias("s")), scaled))


def unit(x: Column, eps: float = 1e-6) -> Column:
    return let(l2_norm(x), lambda n: F.when(n >= eps, F.transform(x, lambda v: v / n)))


def regridded(x: Column, source: int, target: int) -> Column:
    """Linear interpolation of an even grid of ``source`` bands to ``target`` bands; the last one has weight one."""
    step = (source - 1) / (target - 1)

    def at(j: Column) -> Column:
        t = j * F.lit(step)
        k = F.least(F.floor(t + 1e-12), F.lit(source - 2)).cast("int")
        return F.element_at(x, k + 1) * (1 - (t - k)) + F.element_at(x, k + 2) * (t - k)

    return F.transform(F.sequence(F.lit(0), F.lit(target - 1)), at)


def exclusion_reason(x: Column) -> Column:
    """1 a band is not finite, 2 the spread is not a positive number, 3 a band is negative, 0 none of these."""
    flat = let(sample_sd(x), lambda s: s.isNull() | F.isnan(s) | (s <= 0))
    return F.when(finite_count(x) < F.size(x), 1).when(flat, 2).when(F.exists(x, lambda v: v < 0), 3).otherwise(0)


def differences(x: Column) -> Column:
    n = F.size(x) - 1
    return F.zip_with(F.slice(x, F.lit(2), n), F.slice(x, F.lit(1), n), lambda b, a: b - a)


def rms(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))


def largest(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def second_derivative(x: Column, bands: int, delta: float) -> Column:
    """Savitzky-Golay of window 7 and order 2. The second derivative of the fitted quadratic is constant, so each end
    takes the value of its last full window."""
    weights = F.array(*(F.lit(w / (42.0 * delta * delta)) for w in (5, 0, -3, -4, -3, 0, 5)))

    def at(j: Column) -> Column:
        start = F.least(F.greatest(j - 3, F.lit(0)), F.lit(bands - 7))
        return dot(F.slice(x, start + 1, F.lit(7)), weights)

    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), at)


def pseudo_absorbance(x: Column) -> Column:
    """-log10 of each band, where all bands are positive."""
    return F.when(F.forall(x, lambda v: v > 0), F.transform(x, lambda v: -F.log10(v)))


def recentred(x: Column, norm: Column) -> Column:
    """Mean zero and the given norm."""
    def scaled(c: Column) -> Column:
        return let(F.struct(F.sqrt(dot(c, c)).alias("n"), norm.alias("to")), lambda p: F.when(p["n"] > 1e-8, F.transform(c, lambda v: v / p["n"] * p["to"])))

    return let(let(mean(x), lambda m: F.transform(x, lambda v: v - m)), scaled)


def shifted(x: Column, delta: Column) -> Column:
    """Values at j - delta by linear interpolation, clamped to the ends."""

    def moved(p: Column) -> Column:
        def at(_: Column, j: Column) -> Column:
            z = F.least(F.greatest(j - p["d"], F.lit(0.0)), p["last"])
            k = F.least(F.floor(z), p["before"]).cast("int")
            return F.element_at(p["x"], k + 1) * (1 - (z - k)) + F.element_at(p["x"], k + 2) * (z - k)

        return F.transform(p["x"], at)

    sized = lambda v: F.struct(v.alias("x"), delta.alias("d"), (F.size(v) - 1).cast("double").alias("last"), (F.size(v) - 2).cast("long").alias("before"))
    return let(let(x, sized), moved)


def rotated(x: Column, noise: Column, theta: Column) -> Column:
    """x turned by theta towards the part of ``noise`` that has mean zero and is orthogonal to x; the norm is kept."""
    centred = let(mean(noise), lambda m: F.transform(noise, lambda v: v - m))
    direction = let(F.sqrt(dot(x, x)), lambda r: F.transform(x, lambda v: v / r))

    def apart(p: Column) -> Column:
        return let(dot(p["e"], p["n"]), lambda along: F.struct(p["n"].alias("n"), F.zip_with(p["e"], p["n"], lambda a, b: a - along * b).alias("q")))

    def turned(p: Column) -> Column:
        lengths = F.struct(F.sqrt(dot(p["q"], p["q"])).alias("q"), F.sqrt(dot(x, x)).alias("r"), F.cos(theta).alias("cos"), F.sin(theta).alias("sin"))
        return let(lengths, lambda s: F.when(s["q"] > 1e-8, F.zip_with(p["n"], p["q"], lambda a, b: s["r"] * (s["cos"] * a + s["sin"] * b / s["q"]))))

    return let(let(F.struct(centred.alias("e"), direction.alias("n")), apart), turned)


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def angle_degrees(x: Column, y: Column) -> Column:
    return F.degrees(F.acos(F.least(F.greatest(cosine(x, y), F.lit(-1.0)), F.lit(1.0))))
