"""Column functions on sorted grids of any spacing: places, interpolation plans, wavenumbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from huegrid.functions.spectra import let


def wavenumber(wavelength_nm: Column) -> Column:
    """Waves in a centimetre."""
    return F.lit(1e7) / wavelength_nm


def increasing(grid: Column) -> Column:
    """True where all values are finite and each is greater than the one before."""
    finite = F.forall(grid, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return finite & F.forall(F.zip_with(F.slice(grid, F.lit(2), F.greatest(F.size(grid) - 1, F.lit(0))), F.slice(grid, F.lit(1), F.greatest(F.size(grid) - 1, F.lit(0))), lambda b, a: b > a), lambda v: v)


def place_right(grid: Column, value: Column) -> Column:
    """How many values of an ascending array are not greater than ``value``, by bisection."""

    def halved(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        right = (s["low"] < s["high"]) & (F.get(grid, middle) <= value)
        low = F.when(right, middle + 1).otherwise(s["low"])
        return F.struct(low.alias("low"), F.when((s["low"] < s["high"]) & ~right, middle).otherwise(s["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(grid) + 1.0)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(grid).alias("high")), halved, lambda s: s["low"])


def grid_plan(grid: Column, target: int) -> Column:
    """Linear interpolation of an ascending grid to ``target`` evenly spaced bands between its ends, without extrapolation.

    One struct a band: target_band_index, target_wavelength_nm, left_source_band, right_source_band, right_source_weight. The
    right neighbour is the first source band beyond the target (the last one at the end). A grid of fewer than two bands, one
    that isn't finite or doesn't ascend, raises; so does ``target`` below two."""
    if target < 2:
        raise ValueError("at least two bands are needed")

    def plan(g: Column) -> Column:
        first, last = F.get(g, F.lit(0)), F.element_at(g, -1)
        step = (last - first) / (target - 1)

        def band(j: Column) -> Column:
            at = F.when(j == target - 1, last).otherwise(first + j * step)

            def near(t: Column) -> Column:
                right = F.least(F.greatest(place_right(g, t), F.lit(1)), F.size(g) - 1)

                def weighted(r: Column) -> Column:
                    left = F.get(g, r - 1)
                    return F.struct(j.alias("target_band_index"), t.alias("target_wavelength_nm"), (r - 1).alias("left_source_band"), r.alias("right_source_band"), ((t - left) / (F.get(g, r) - left)).alias("right_source_weight"))

                return let(right, weighted)

            return let(at, near)

        return F.when((F.size(g) > 1) & increasing(g), F.transform(F.sequence(F.lit(0), F.lit(target - 1)), band)).otherwise(F.raise_error(F.lit("source wavelengths must be finite and strictly increasing, and two at least")))

    return let(grid, plan)


def regridded_by(x: Column, plan: Column) -> Column:
    """A spectrum on the plan's target grid."""
    return F.transform(plan, lambda p: F.get(x, p["left_source_band"]) * (1 - p["right_source_weight"]) + F.get(x, p["right_source_band"]) * p["right_source_weight"])


def interpolated(x: Column, grid: Column, value: Column) -> Column:
    """x, given on an ascending grid, at ``value``; the ends beyond it."""

    def near(r: Column) -> Column:
        left, right = F.get(grid, r - 1), F.get(grid, r)
        a, b = F.get(x, r - 1), F.get(x, r)
        return F.when(value <= F.get(grid, F.lit(0)), F.get(x, F.lit(0))).when(value >= F.element_at(grid, -1), F.element_at(x, -1)).otherwise(a + (b - a) / (right - left) * (value - left))

    return let(F.least(F.greatest(place_right(grid, value), F.lit(1)), F.size(grid) - 1), near)
