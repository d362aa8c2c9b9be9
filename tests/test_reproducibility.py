"""Distances to boundaries against brute force, blocks of any size, pair records and held-out scores."""

import numpy as np
import pytest

from huegrid.operators import agreement, models
from huegrid.operators import reproducibility as R

STACK = "sample_id string, pixel_row int, pixel_col int, labels array<long>, label int, window int, block_row string"


def test_distances_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        shape = (2, *rng.integers(1, 10, 2))
        _, cut = R.boundaries(rng.integers(1, 3, shape), rng.random(shape) < 0.8)
        near = R.distances(cut, 4)
        for m in range(2):
            points = np.argwhere(cut[m])
            for i, j in np.ndindex(*near.shape[1:]):
                assert near[m, i, j] == min([5, *(max(abs(i - a), abs(j - b)) for a, b in points)])


@pytest.fixture(scope="module")
def stacks(spark):
    """Two samples of 30 x 41 and one pixel alone; holes, rows given twice, a null place, null labels, clashing columns."""
    rng, rows = np.random.default_rng(5), []
    for sample, corner in (("a", -7), ("b", 0)):
        for r, c in np.ndindex(30, 41):
            if rng.random() < 0.95:
                labels = [int(1 + (r // 9 + c // (7 + m)) % 3) if rng.random() < 0.98 else None for m in range(3)]
                rows.append((sample, r + corner, c + corner, labels, 1, 2, "x"))
    rows += rows[:3] + [("a", None, 3, [1, 2, 3], 1, 2, "x"), ("a", 2, 2, None, 1, 2, "x"), ("alone", 5, 5, [1, 1, None], 1, 2, "x")]
    return spark.createDataFrame(rows, STACK)


def test_blocks_of_any_size_give_the_same_counts(stacks):
    whole = sorted(R.boundary_matches(stacks, 3, block=1000).collect())
    assert len(whole) == 3 * 27 and any(0 < r.matched < r.boundary for r in whole)
    assert all(r.matched == r.boundary for r in whole if r.source == r.target)
    assert whole == sorted(R.boundary_matches(stacks, 3, block=8).collect()) == sorted(R.boundary_matches(stacks, 3, block=1).collect())
    cover = sorted(R.boundary_cover(stacks, 3, 5, block=1000).collect())
    assert cover == sorted(R.boundary_cover(stacks, 3, 5, block=7).collect())
    assert len({r[:3] for r in cover}) == len(cover)


def test_counts_equal_brute_force(stacks):
    rows = [r for r in stacks.collect() if r.sample_id == "b" and r.pixel_row is not None and r.labels]
    cuts = []
    for m in range(3):
        at = {(r.pixel_row, r.pixel_col): r.labels[m] for r in rows if r.labels[m] is not None}
        near = [((a, b), (a + d, b + e)) for a, b in at for d, e in ((0, 1), (1, 0)) if (a + d, b + e) in at]
        cuts.append({(p[0] + q[0], p[1] + q[1]) for p, q in near if at[p] != at[q]})
    for r in R.boundary_matches(stacks.where("sample_id = 'b'"), 3, block=16).collect():
        hits = sum(any(max(abs(i - a), abs(j - b)) < r.window for a, b in cuts[r.target]) for i, j in cuts[r.source])
        assert (r.boundary, r.matched) == (len(cuts[r.source]), hits)


def test_pair_records_keep_their_rules(stacks):
    records = R.pair_records(stacks, 3).cache()
    assert records.count() == 3 * 3 * 3
    assert not R.pair_violations(records, 3).head(1)
    alone = records.where("sample_id = 'alone'").collect()
    assert {r.reasons for r in alone} == {"no_valid_adjacent_edges"} and all(r.lower is None for r in alone)
    broken = {r.rule for r in R.pair_violations(records.where("window <> 5").withColumn("lower", records.upper + 1), 3).collect()}
    assert broken == {"missing", "derived"}


def test_empty_maps_give_no_records(stacks):
    assert not R.pair_records(stacks.limit(0), 3).head(1)
    assert not R.boundary_cover(stacks.limit(0), 3, 3).head(1)


def test_scores_come_from_rows_that_taught_nothing(spark):
    train = spark.createDataFrame([([1.0, 0.1],), ([1.0, 0.0],), ([0.0, 1.0],), ([0.0, 0.0],), (None,)], "x array<double>")
    first = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.1, 1.0]), (2, [-1.0, -1.0])], "cluster long, center array<double>")
    model = models.fitted_centers(train, first)
    assert [(r.cluster, r["rows"]) for r in model.orderBy("cluster").collect()] == [(0, 2), (1, 1), (2, 0)]
    test = spark.createDataFrame([(1, [2.0, 0.3]), (1, [5.0, 0.1]), (2, [0.1, 3.0]), (2, [4.0, 0.0])], "label long, x array<double>")
    (score,) = agreement.held_out_scores(test, model, 3).collect()
    assert (score.train_rows, score.test_rows, score.acc) == (3, 4, 75.0)
    with pytest.raises(ValueError):
        agreement.held_out_scores(test.selectExpr("CAST(NULL AS LONG) AS label", "x"), model, 3)
    with pytest.raises(ValueError):
        models.fitted_centers(train, first.where("cluster > 0"))
