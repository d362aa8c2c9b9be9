"""Masks of whole patches of bands, drawn without replacement by hash order, and errors inside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from huegrid.functions.spectra import let


def masked_patches(key: Column, seed: str, patches: int, masked: int) -> Column:
    """The numbers (0..patches-1, ascending) of exactly ``masked`` patches: those whose SHA-256 of seed, key and number is least.

    The same on every engine and for any partitioning; another key or seed draws anew."""
    if not 0 <= masked <= patches or patches < 1:
        raise ValueError("as many patches may be masked as there are")
    digest = lambda k: F.sha2(F.concat_ws("|", F.lit(seed), key.cast("string"), k.cast("string")).cast("binary"), 256)
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(patches - 1)), lambda k: F.struct(digest(k).alias("h"), k.alias("k"))))
    return F.array_sort(F.transform(F.slice(drawn, 1, masked), lambda s: s["k"]))


def visible(patches: Column, bands: Column, size: int) -> Column:
    """For each band whether its patch (of ``size`` bands, counted from 0) is not among the masked ``patches``."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: ~F.array_contains(patches, F.floor(b / size).cast("int")))


def whole_patches(shown: Column, size: int, masked: int) -> Column:
    """Whether a mask is made of whole patches, of which exactly ``masked`` are hidden."""
    count = F.size(shown) / size
    parts = F.transform(F.sequence(F.lit(0), F.floor(count).cast("int") - 1), lambda k: F.aggregate(F.slice(shown, k * size + 1, F.lit(size)), F.lit(0), lambda n, v: n + F.when(v, 0).otherwise(1)))
    return (F.size(shown) % size == 0) & (F.size(shown) > 0) & let(parts, lambda p: F.forall(p, lambda n: n.isin(0, size)) & (F.aggregate(p, F.lit(0), lambda a, n: a + n) == masked * size))


def squared_error(x: Column, y: Column, shown: Column, everywhere: bool = False) -> Column:
    """struct(total, bands): the sum of squared differences over the hidden bands (or all), and how many these are.

    The mean over rows is the sum of totals over the sum of bands, which adds up inside tasks."""
    each = F.zip_with(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), shown, lambda d, v: F.when(F.lit(everywhere) | ~v, d))
    counted = lambda p: F.struct(F.aggregate(p, F.lit(0.0), lambda a, d: a + d).alias("total"), F.size(p).cast("long").alias("bands"))
    return let(F.filter(each, lambda d: d.isNotNull()), counted)
