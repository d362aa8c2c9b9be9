"""Small maps with known results."""

import itertools

import pytest

from huegrid.operators import maps as M
from huegrid.operators import reproducibility as R


def image(spark, *lines, sample=1):
    rows = [(sample, r, c, v) for r, line in enumerate(lines) for c, v in enumerate(line) if v]
    return spark.createDataFrame(rows, "sample_id long, pixel_row long, pixel_col long, label long")


def one(df):
    (row,) = df.collect()
    return row


def naive_lla(lines, r):
    cells = {(i, j): v for i, line in enumerate(lines) for j, v in enumerate(line) if v}
    pairs = [(a, b) for a, b in itertools.permutations(cells, 2) if max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= r]
    n, m = len(cells), sum(cells[a] == cells[b] for a, b in pairs)
    t = n * (n - 1)
    e = sum(k * (k - 1) for k in (list(cells.values()).count(v) for v in set(cells.values())))
    return len(pairs), m, (m * t - len(pairs) * e) / (len(pairs) * (t - e))


@pytest.mark.parametrize("width", [3, 5, 9])
def test_lla_equals_all_pairs(spark, width):
    lines = [[1, 1, 1, 2], [0, 2, 1, 2], [3, 3, 0, 1]]
    row = one(M.lla(image(spark, *lines), width))
    pairs, matches, adjusted = naive_lla(lines, width // 2)
    assert (row.pairs, row.matches) == (pairs, matches)
    assert row.adjusted_lla == pytest.approx(adjusted) and row.reasons is None


def test_lla_can_be_negative(spark):
    assert one(M.lla(image(spark, [1, 2, 1]), 3)).adjusted_lla < 0


def test_lla_reasons(spark):
    assert one(M.lla(image(spark, [2]), 3)).reasons == "fewer_than_two_valid_pixels;no_valid_neighbor_pairs;single_cluster"
    assert one(M.lla(image(spark, [1, 0, 0, 2, 0, 0, 1]), 3)).reasons == "no_valid_neighbor_pairs"
    assert one(M.lla(image(spark, [1, 1]), 3)).reasons == "single_cluster"


def pairs_of(spark, a, b):
    return M.contingency(spark.createDataFrame([(1, x, y) for x, y in zip(a, b, strict=True)], "sample_id long, l1 long, l2 long"))


@pytest.mark.parametrize(("a", "b", "want"), [([1, 1, 2, 2], [4, 4, 3, 3], 1.0), ([1, 1, 2, 2], [1, 2, 1, 2], -0.5), ([1, 1], [2, 2], 1.0), ([1], [1], None)])
def test_adjusted_rand(spark, a, b, want):
    assert one(M.adjusted_rand(pairs_of(spark, a, b))).ari == (want if want is None else pytest.approx(want))


def test_adjusted_rand_of_many_pixels(spark):
    table = spark.createDataFrame([(1, 1, 1, 5_000_000), (1, 2, 2, 5_000_000)], "sample_id long, l1 long, l2 long, n long")
    assert one(M.adjusted_rand(table)).ari == pytest.approx(1.0)


def test_boundary_lattice(spark):
    found = {(r.i, r.j) for r in M.boundary(image(spark, [1, 2, 0], [1, 1, 3])).collect()}
    assert found == {(0, 1), (1, 2), (2, 3)}


def test_coverage_directions(spark):
    a, b = image(spark, [1] * 3 + [2] * 9), image(spark, [5] * 3 + [6] * 5 + [7] * 4)
    row = one(R.compare(a, b, 3))
    assert (row.a_to_b, row.b_to_a, row.lower, row.upper) == (1.0, 0.5, 0.5, 1.0)


def test_empty_source_is_null_and_empty_target_is_zero(spark):
    flat, edge = image(spark, [1, 1, 1]), image(spark, [1, 1, 2])
    assert one(R.coverage(flat, edge, 3)).value is None
    assert one(R.coverage(edge, flat, 3)).value == 0.0


def test_silhouette_of_two_orthogonal_pairs(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "label long, z array<double>")
    values = {(r.label, r.silhouette) for r in M.silhouette(rows).collect()}
    assert (3, 0.0) in values
    assert all(v > 0 for label, v in values if label < 3)


def test_violations(spark):
    bad = image(spark, [1, 9]).union(image(spark, [1]))
    assert sorted(r.rule for r in M.violations(bad, 8).collect()) == ["duplicate_pixel", "duplicate_pixel", "label_out_of_range"]


@pytest.mark.parametrize("width", [3, 9])
def test_window_counts_are_twice_the_pairs_that_meet(spark, width):
    rows = [(s, (7 * k * s) % 23, (5 * k) % 19, k % 3 if k % 11 else None) for s in (1, 2) for k in range(150)]
    rows += rows[:20] + [(1, None, 3, 1), (1, 4, None, 1), (None, 1, 1, 1), (3, 0, 0, 1)]  # copies, null places, a lone pixel
    for kind in ("int", "long"):
        labels = spark.createDataFrame(rows, f"sample_id {kind}, pixel_row {kind}, pixel_col {kind}, label long")
        got = {}
        for r in M.window_counts(labels, width).collect():
            others, alike = got.get(r.sample_id, (0, 0))
            got[r.sample_id] = others + r.others, alike + r.alike
        want = {1: [0, 0], 2: [0, 0], 3: [0, 0]}
        for r in M.neighbour_pairs(labels, width).collect():
            want[r.sample_id][0] += 2
            want[r.sample_id][1] += 2 * (r.label is not None and r.label == r.other)
        assert got == {s: tuple(v) for s, v in want.items()}
    assert M.window_counts(labels.limit(0), width).count() == 0


def test_window_counts_send_a_pixel_to_its_block_and_not_to_every_row_of_a_window(spark):
    """Blocks on both sides of their borders, negative places, a window wider than a block, labels that are no numbers."""
    rows = [(1, a, b, "xyz"[(a * b + a) % 3]) for a in (*range(-3, 4), *range(125, 131), 300) for b in (-129, -128, -127, -1, 0, 1, 127, 128, 129, 255, 257)]
    labels = spark.createDataFrame(rows, "sample_id long, pixel_row long, pixel_col long, label string")
    for width in (9, 301):
        found = M.window_counts(labels, width)
        want = M.neighbour_pairs(labels, width).selectExpr("2 * count(*)", "2 * count_if(label = other)").first()
        assert found.count() == len(rows) and found.selectExpr("sum(others)", "sum(alike)").first() == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Sort ") <= 2  # initial and final plan: one sort by block, not two of each row of a window
