"""Records, selections and matchings on small tables that are worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from huegrid.operators import records, summaries


def test_quality_counts_each_reason(spark):
    rows = [(1, [0.1, 0.4, 0.3]), (1, [0.5, 0.5, 0.5]), (1, [0.2, -0.1, 1.5]), (1, [math.inf, 0.1, 0.2]), (1, [0.2, None, 0.1]), (2, [0.5, 0.5, 0.5])]
    got = {r.sample_id: r for r in records.sample_quality(spark.createDataFrame(rows, "sample_id long, x array<double>")).collect()}
    one = got[1]
    assert (one.pixels, one.nonfinite, one.flat, one.negative, one.saved, one.any_negative, one.any_above_one) == (5, 2, 1, 1, 1, 1, 1)
    assert one.sd_error < 1e-9 and one.norm_error < 1e-9 and got[2].rms_q99 is None and got[2].excluded_fraction == 1.0


def test_summary_of_nothing(spark):
    none = records.sample_quality(spark.createDataFrame([], "sample_id long, x array<double>"))
    row = records.dataset_summary(none).first()
    assert row.samples == 0 and row.pixels is None and row.excluded_fraction is None


def test_places_equal_a_plain_sort(spark):
    rows = [(i % 3 // 2, i * 7 % 50, i) for i in range(300)]
    got = records.ranked(spark.createDataFrame(rows, "g long, c long, o long"), ["g"], "c", ["o"], "place").collect()
    for g in (0, 1):
        mine = sorted((r.c, r.o, r.place) for r in got if r.g == g)
        assert [p for _, _, p in mine] == list(range(len(mine)))


def test_evenly_spaced_and_small_groups(spark):
    rows = spark.createDataFrame([(1, i) for i in range(10)] + [(2, i) for i in range(3)], "g long, p long")
    got = sorted((r.g, r.p) for r in records.evenly_spaced(rows, ["g"], "p", 4).collect())
    assert got == [(1, 0), (1, 3), (1, 6), (1, 9), (2, 0), (2, 1), (2, 2)]


def test_folds_differ_by_one(spark):
    rows = spark.createDataFrame([(i, "a" if i % 5 else "b") for i in range(103)], "key long, label string")
    counts = records.stratified_folds(rows, "label", "key", 4, 3).groupBy("label", "fold").count().collect()
    for label in "ab":
        sizes = [r["count"] for r in counts if r.label == label]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


def test_coordinates_out_twice_and_unmasked(spark):
    place = "sample_id long, pixel_row long, pixel_col long"
    chosen = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, 9, 0), (1, None, 0), (1, 1, 1)], place)
    got = {r.rule: r.n for r in records.coordinate_violations(chosen, spark.createDataFrame([(1, 0, 0)], place), 2, 2).collect()}
    assert got == {"out_of_bounds": 2, "chosen_twice": 1, "outside_mask": 1}
    empty = records.coordinate_violations(chosen.limit(0), spark.createDataFrame([(1, 0, 0)], place), 2, 2).collect()
    assert {r.n for r in empty} == {0}


def test_masks_lose_small_parts(spark):
    full = [(1, r, c, 2.0) for r in range(4) for c in range(4)] + [(2, 0, 0, 0.5)]
    got = {r.sample_id: r for r in records.mask_records(spark.createDataFrame(full, "sample_id long, pixel_row long, pixel_col long, value double"), 1.0, 3.0, 4, 4).collect()}
    assert (got[1].dark, got[1].eroded, got[1].kept, got[1].fraction) == (16, 0, 16, 1.0) and (got[2].background, got[2].kept) == (1, 0)


def test_density_of_one_point_and_of_none(spark):
    rows = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert [tuple(r) for r in records.density(rows, F.col("a"), F.col("b"), 5).collect()] == [(0, 0, 1)]
    assert records.density(rows.limit(0), F.col("a"), F.col("b"), 5).count() == 0


def test_matching_needs_every_cluster(spark):
    rows = spark.createDataFrame([(1, 1, 2, [1.0, 2.0, 0.0]), (1, 2, 1, [3.0, 1.0, 2.0])], "sample_id long, a long, b long, x array<double>")
    got = {(r.reference, r.target): r for r in records.spectral_matching(rows, "a", "b", 2).collect()}
    assert {k for k, r in got.items() if r.assigned} == {(1, 2), (2, 1)} and abs(got[1, 2].similarity - 1) < 1e-9
    with pytest.raises(ValueError):
        records.spectral_matching(rows, "a", "b", 3)


def test_the_first_variant_wins_ties(spark):
    rows = spark.createDataFrame([("x", 1.0), ("y", 1.0), ("z", 9.0), ("w", None)], "condition string, value double")
    assert tuple(summaries.best_variant(rows, ["y", "x", "w"]).first()) == ("y", 1.0)
    assert summaries.best_variant(rows, ["w"]).count() == 0
