"""Cubes by blocks of rows."""

import numpy as np
import pytest

from huegrid.sources import envi_blocks as E

AXES = {"bip": (0, 1, 2), "bil": (0, 2, 1), "bsq": (2, 0, 1)}


def write(folder, name, cube, interleave="bip", extra="", kind="<i2", code=2, offset=7):
    lines, samples, bands = cube.shape
    waves = ", ".join(str(900 + 10 * b) for b in range(bands))
    head = f"ENVI\nsamples = {samples}\nlines = {lines}\nbands = {bands}\nheader offset = {offset}\ndata type = {code}\ninterleave = {interleave}\nbyte order = 0\nwavelength = {{{waves}}}\n{extra}"
    (folder / f"{name}.hdr").write_text(head)
    (folder / f"{name}.raw").write_bytes(b"\0" * offset + cube.astype(kind).transpose(AXES[interleave]).tobytes())


@pytest.fixture
def folder(tmp_path):
    for k, (name, interleave) in enumerate((("030hz_a", "bip"), ("030hz_b", "bil"), ("030hz_c", "bsq"), ("200hz_a", "bip"))):
        write(tmp_path, name, np.arange(10 * 3 * 4).reshape(10, 3, 4) + 1000 * k, interleave)
    write(tmp_path, "030hz_white", np.full((1, 3, 4), 5000))
    write(tmp_path, "030hz_dark", np.zeros((1, 3, 4)))
    return tmp_path


def test_every_interleave_reads_the_same_rows(spark, folder):
    rows = E.read_blocks(spark, str(folder), "030", rows=4).orderBy("sample_id", "pixel_row", "pixel_col").collect()
    got = np.array([r.intensity for r in rows]).reshape(3, 10, 3, 4)
    assert (got == np.arange(120).reshape(10, 3, 4) + 1000 * np.arange(3).reshape(3, 1, 1, 1)).all()
    assert [(r.pixel_row, r.pixel_col) for r in rows[:4]] == [(0, 0), (0, 1), (0, 2), (1, 0)]


@pytest.mark.parametrize(("where", "blocks", "rows"), [("true", 9, 90), ("sample_id = 'b'", 3, 30), ("sample_id IN ('a', 'c') AND pixel_row >= 8", 2, 12), ("pixel_row > 3 AND pixel_row < 8", 3, 36), ("pixel_row = 4", 3, 9), ("pixel_row = 99", 0, 0), ("pixel_col = 1", 9, 30)])
def test_a_filter_reads_only_its_blocks(spark, folder, where, blocks, rows):
    found = E.read_blocks(spark, str(folder), "030", rows=4).where(where)
    assert found.rdd.getNumPartitions() == max(blocks, found.rdd.getNumPartitions() if not blocks else 0)
    assert found.count() == rows


def test_a_block_beyond_two_gigabytes_is_found_by_its_place():
    class Sparse:
        def read_at(self, size, offset):
            self.asked = size, offset
            return np.full(size // 2, 7, "<i2").tobytes()

    cube, file = E.Cube("big", "big.raw", 100_000, 320, 256, "<i2", (0, 2, 1), 32, (), 0), Sparse()
    values = E.block_values(file, cube, 99_000, 99_002)
    assert cube.bytes > 2**33 and file.asked == (2 * 320 * 256 * 2, 32 + 99_000 * 320 * 256 * 2) and values.shape == (2, 320, 256)


def test_calibration_by_the_columns_references(spark, folder):
    rows = E.read_calibrated(spark, str(folder), "030", width=3, bands=4, rows=4).where("sample_id = 'a' AND pixel_row = 9").orderBy("pixel_col").collect()
    assert np.allclose([r.reflectance for r in rows], (np.arange(12).reshape(3, 4) + 108) / 5000)
    most = {r.dtype_max for r in E.read_references(spark, str(folder), "030").collect()}
    assert most == {32767.0}


@pytest.mark.parametrize(
    ("name", "cube", "extra", "message"),
    [
        ("030hz_d", np.zeros((2, 5, 4)), "", "width 5 instead of 3"),
        ("030hz_d", np.zeros((2, 3, 6)), "", "bands 6 instead of 4"),
        ("030hz_d", np.zeros((2, 3, 4)), "fps = 200\n", "frames a second"),
        ("030hz_d", np.zeros((2, 3, 4)), "x start = 5\n", "x start of d"),
        ("030hz_white", np.zeros((2, 3, 4)), "", "shape"),
    ],
)
def test_what_does_not_fit_is_refused(spark, folder, name, cube, extra, message):
    write(folder, name, cube, extra=extra)
    with pytest.raises(ValueError, match=message):
        E.read_calibrated(spark, str(folder), "030", width=3, bands=4)


def test_missing_and_short_files_are_refused(folder):
    (folder / "030hz_a.raw").write_bytes(b"\0" * 9)
    with pytest.raises(ValueError, match="bytes 9 instead of 247"):
        E.discovered(str(folder), "030")
    (folder / "030hz_a.raw").unlink()
    with pytest.raises(ValueError, match="no raw file"):
        E.discovered(str(folder), "030")
    with pytest.raises(ValueError, match="no cubes"):
        E.discovered(str(folder), "999")


# ---- grids, intervals, alignment ----------------------------------------------


def test_plans_equal_interpolation_by_numpy(spark):
    from pyspark.sql import functions as F

    from huegrid.functions import grids

    chance = np.random.default_rng(4)
    rows = [(k, np.cumsum(chance.uniform(0.1, 5, n)).tolist(), chance.normal(size=n).tolist()) for k, n in enumerate((2, 3, 7, 64))]
    for target in (2, 5, 96):
        plan = grids.grid_plan(F.col("g"), target)
        got = spark.createDataFrame(rows, "k int, g array<double>, x array<double>").select("k", "g", "x", plan.alias("p")).select("*", grids.regridded_by(F.col("x"), F.col("p")).alias("y")).collect()
        for r in got:
            at = np.linspace(r.g[0], r.g[-1], target)
            right = np.clip(np.searchsorted(r.g, at, side="right"), 1, len(r.g) - 1)
            assert [p.right_source_band for p in r.p] == right.tolist() and [p.left_source_band for p in r.p] == (right - 1).tolist()
            assert np.allclose([p.target_wavelength_nm for p in r.p], at) and np.allclose(r.y, np.interp(at, r.g, r.x))


@pytest.mark.parametrize("grid", [[1.0], [], [1.0, 1.0], [2.0, 1.0], [1.0, float("nan")], [1.0, float("inf")]])
def test_a_grid_must_ascend(spark, grid):
    from pyspark.sql import functions as F

    from huegrid.functions import grids

    with pytest.raises(Exception, match="strictly increasing"):
        spark.createDataFrame([(grid,)], "g array<double>").select(grids.grid_plan(F.col("g"), 3)).collect()
    with pytest.raises(ValueError, match="two bands"):
        grids.grid_plan(F.col("g"), 1)


def test_intervals_meet_their_points_without_a_nested_loop(spark):
    from huegrid.operators import intervals

    points = spark.createDataFrame([(k, v) for k, v in enumerate((-3.0, 0.0, 2.5, 9.99, 10.0, 25.0, None, float("nan")))], "id int, x double")
    spans = spark.createDataFrame([("a", -3.0, 2.5), ("b", 10.0, 10.0), ("c", 2.6, 30.0), ("d", 5.0, 4.0), ("e", None, 9.0)], "name string, lower double, upper double")
    want = {(k, n) for k, x in [tuple(r) for r in points.collect()] for n, a, b in [tuple(r) for r in spans.collect()] if x is not None and a is not None and a <= x <= b}
    for width in (0.5, 4.0, 1000.0):
        found = intervals.annotated(points, spans, "x", "lower", "upper", width)
        assert {(r.id, r.name) for r in found.collect()} == want and found.count() == len(want)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="both sides"):
        intervals.annotated(points, points, "x", "x", "x", 1.0)


def test_intervals_of_all_lengths_meet_each_point_once_and_are_not_broadcast(spark):
    """Interval ends on the borders of cells and buckets, several rows of intervals in one place, copies, and no table sent whole to every task."""
    import numpy as np

    from huegrid.operators import intervals

    random = np.random.default_rng(5)
    xs = [*random.uniform(-300, 300, 80).tolist(), *(float(k) for k in range(-64, 65, 4)), 0.0, 0.0]
    low = [*random.integers(-300, 300, 150).tolist(), *range(-64, 64, 4), *[8] * 2100, -32]
    spans = [(k, float(a), float(a + (k * k) % 97 if k < 190 else a + 9)) for k, a in enumerate(low)] + [(-1, -1e4, 1e4), (-2, 16.0, 32.0), (-2, 16.0, 32.0)]
    want = sorted((i, n) for i, x in enumerate(xs) for n, a, b in spans if a <= x <= b)
    points = spark.createDataFrame(list(enumerate(xs)), "id int, x double")
    found = intervals.annotated(points, spark.createDataFrame(spans, "n int, lower double, upper double"), "x", "lower", "upper", 64.0)
    rows = found.collect()
    assert found.columns == ["id", "x", "n", "lower", "upper"] and sorted((r.id, r.n) for r in rows) == want
    assert all(r.lower <= r.x <= r.upper for r in rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_points_and_intervals_are_shuffled_once_and_crowded_buckets_dealt_out(spark, monkeypatch):
    """One shuffle a side, also for a bucket that holds most rows of both sides, which several tasks share; empty sides give no rows."""
    from pyspark.sql import functions as F

    from huegrid.operators import intervals

    monkeypatch.setattr(intervals, "SHARE", 64, raising=False)
    monkeypatch.setattr(intervals, "RUN", 8)
    random = np.random.default_rng(6)
    xs = [*random.uniform(0, 400, 150).tolist(), *[100.0] * 250, *random.uniform(96, 104, 50).tolist()]
    low = [*random.integers(0, 400, 100).tolist(), *[90] * 200]
    spans = [(k, float(a), float(a + (k * 37) % 120)) for k, a in enumerate(low)]
    points = spark.createDataFrame(list(enumerate(xs)), "id int, x double")
    ranges = spark.createDataFrame(spans, "n int, lower double, upper double")
    found = intervals.annotated(points, ranges, "x", "lower", "upper", 64.0)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 2
    assert sorted((r.id, r.n) for r in found.collect()) == sorted((i, n) for i, x in enumerate(xs) for n, a, b in spans if a <= x <= b)
    assert found.where("x = 100.0").select(F.spark_partition_id()).distinct().count() > 1
    for some, others in ((points.limit(0), ranges), (points, ranges.limit(0))):
        assert intervals.annotated(some, others, "x", "lower", "upper", 64.0).count() == 0


def test_pairs_of_points_and_intervals_are_written_in_few_bytes(spark, tmp_path):
    """The points of a run follow each other for each interval that holds them, which files write as repeats."""
    from huegrid.operators import intervals

    random = np.random.default_rng(7)
    points = spark.createDataFrame([(k, float(x)) for k, x in enumerate(random.uniform(0, 1024, 8192))], "id long, x double")
    spans = spark.createDataFrame([(k, float(a), float(a + n)) for k, (a, n) in enumerate(random.integers((0, 10), (1000, 500), (2000, 2)))], "n long, lower double, upper double")
    intervals.annotated(points, spans, "x", "lower", "upper", 256.0).select("id", "n").write.parquet(str(tmp_path / "pairs"))
    rows = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert rows > 3_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.25 * rows


def test_assignment_is_exact_and_takes_the_smallest_of_equals():
    import itertools

    from huegrid.operators import models

    chance = np.random.default_rng(5)
    for rows, cols in ((1, 1), (2, 4), (3, 3), (5, 7), (7, 7), (8, 8)):
        w = chance.integers(0, 4, (rows, cols))
        best = max(sum(w[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(cols), rows))
        first = next(list(p) for p in itertools.permutations(range(cols), rows) if sum(w[i, c] for i, c in enumerate(p)) == best)
        assert models.best_assignment(w) == first
    big = chance.normal(size=(60, 60))
    got = models.best_assignment(big)
    assert sorted(got) == list(range(60))
    total = big[np.arange(60), got].sum()
    for a, b in itertools.combinations(range(60), 2):  # no exchange of two is better
        assert big[a, got[b]] + big[b, got[a]] <= big[a, got[a]] + big[b, got[b]] + 1e-12
    assert total <= big.max(1).sum() and models.best_assignment(np.zeros((3, 5))) == [0, 1, 2]


def test_absent_labels_take_what_is_left(spark):
    from huegrid.operators import models

    counts = spark.createDataFrame([("m", 1, 3, 9), ("m", 2, 1, 4), ("m", 2, 3, 5), ("n", 3, 3, 1)], "map string, l1 int, l2 int, n long")
    rows = sorted(tuple(r) for r in models.aligned_labels(counts, 4, ["map"]).collect())
    assert rows == [("m", 1, 2, 4, 4, 9), ("m", 2, 3, 0, 0, 0), ("m", 3, 1, 9, 14, 9), ("m", 4, 4, 0, 0, 0), ("n", 1, 1, 0, 0, 0), ("n", 2, 2, 0, 0, 0), ("n", 3, 3, 1, 1, 1), ("n", 4, 4, 0, 0, 0)]


def test_quantiles_equal_numpy(spark):
    from huegrid.operators.quantiles import bin_of, exact_quantiles
    from pyspark.sql import functions as F

    chance = np.random.default_rng(6)
    groups = {"wide": chance.normal(size=300) * 10.0 ** chance.integers(-300, 300, 300), "ties": chance.integers(-2, 3, 200).astype(float), "one": np.array([7.0]), "zeros": np.array([0.0, -0.0, 0.0]), None: chance.normal(size=50)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("ties", None), ("ties", float("nan")), ("wide", float("inf")), ("empty", None)]
    levels = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.77, "e": 1.0}
    got = {r.g: [r[n] for n in levels] for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", levels).collect()}
    assert set(got) == {*groups, "empty"} and got["empty"] == [None] * 5
    for g, values in groups.items():
        assert got[g] == pytest.approx(np.quantile(values, list(levels.values())).tolist(), rel=1e-12)
    values = sorted(groups["wide"].tolist()) + [float(np.finfo(float).max)]
    bins = [r.b for r in spark.createDataFrame([(k, v) for k, v in enumerate([-values[-1], -5e-324, 0.0, 5e-324, *values])], "k int, v double").orderBy("v").select(bin_of(F.col("v")).alias("b")).collect()]
    assert bins == sorted(bins)
    whole = exact_quantiles(spark.createDataFrame(rows, "g string, v double").where("g = 'ties'"), [], "v", {"m": 0.5}).collect()
    assert [r.m for r in whole] == [np.quantile(groups["ties"], 0.5)]


# ---- saved samples and fingerprints ---------------------------------------------


def scanned_rows(df):
    """Rows that the scan handed on; a row group or page that is skipped has none."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture
def store(spark, tmp_path):
    from pyspark.sql import functions as F

    from huegrid.sources import saved

    rows = spark.range(4000).select((F.col("id") % 4).alias("sample_id"), F.expr("id div 4").alias("hdf5_row"))
    rows = rows.select("*", F.expr("hdf5_row div 10").alias("pixel_row"), (F.col("hdf5_row") % 10).alias("pixel_col"), F.array(F.col("hdf5_row") + 1.0, F.lit(-1.0)).alias("x"))
    saved.save_samples(rows, str(tmp_path / "saved"), 100)
    return str(tmp_path / "saved")


def manifest(spark, keys, off=0):
    return spark.createDataFrame([(s, r, r // 10, r % 10 + off) for s, r in keys], "sample_id long, hdf5_row long, pixel_row long, pixel_col long")


def test_a_selection_reads_only_groups_with_its_rows(spark, store):
    from huegrid.sources import saved

    keys = [(1, 5), (1, 7), (1, 950), (3, 450), (3, 450)]
    got = sorted((r.sample_id, r.hdf5_row, r.x[0]) for r in saved.selected(spark, store, manifest(spark, keys), chunk=100).collect())
    assert got == [(1, 5, 6.0), (1, 7, 8.0), (1, 950, 951.0), (3, 450, 451.0)]
    for most, least, largest in ((200, 300, 300), (2, 950, 2000), (1, 950, 4000)):  # three runs; two samples; too many of both
        pruned = spark.read.parquet(store).where(saved.range_filter(manifest(spark, keys), 100, most))
        assert least <= scanned_rows(pruned) <= largest
        assert saved.selected(spark, store, manifest(spark, keys), 100, most).count() == 4
    assert saved.selected(spark, store, manifest(spark, keys).where("false")).count() == 0
    assert [tuple(r) for r in saved.missing(spark, store, manifest(spark, [(1, 5), (9, 1), (2, 5000)])).orderBy("sample_id").collect()] == [(2, 5000), (9, 1)]


def test_what_the_manifest_does_not_say_is_refused(spark, store):
    from huegrid.sources import saved

    with pytest.raises(Exception, match="sample 1 row 5: coordinate mismatch"):
        saved.selected(spark, store, manifest(spark, [(1, 5)], off=1)).collect()


@pytest.mark.parametrize(("x", "message"), [([0.0, 0.0], "zero spectrum"), ([1.0, float("nan")], "non-finite"), ([1.0, None], "non-finite")])
def test_unusable_spectra_are_refused(spark, tmp_path, x, message):
    from huegrid.sources import saved

    saved.save_samples(spark.createDataFrame([(1, 5, 0, 5, x)], "sample_id long, hdf5_row long, pixel_row long, pixel_col long, x array<double>"), str(tmp_path / "s"))
    with pytest.raises(Exception, match=message):
        saved.selected(spark, str(tmp_path / "s"), manifest(spark, [(1, 5)])).collect()


def test_fingerprints_see_rows_but_no_order(spark):
    from huegrid.sources import fingerprints

    rows = [(1, "a", None), (2, None, 0.5), (2, None, 0.5), (None, "c", float("nan"))]
    of = lambda some: fingerprints.fingerprint(spark.createDataFrame(some, "k long, `odd name` string, v double").repartition(3))
    assert sorted(of(rows).collect(), key=str) == sorted(of(rows[::-1]).collect(), key=str)
    changes = lambda some: {tuple(r) for r in fingerprints.changed_columns(of(some), of(rows)).collect()}
    assert changes(rows) == set()
    assert changes([*rows[:3], (None, "d", float("nan"))]) == {(None, "changed"), ("odd name", "changed")}
    assert {c for c, _ in changes(rows[1:])} == {None, "k", "odd name", "v"}
    swapped = [(1, None, None), (2, "a", 0.5), *rows[2:]]  # the columns' values are the same, their rows are not
    assert changes(swapped) == {(None, "changed")}
    retyped = fingerprints.fingerprint(spark.createDataFrame(rows, "k long, `odd name` string, v double").selectExpr("cast(k AS int) AS k", "`odd name`", "v", "1 AS more"))
    assert {("k", "retyped"), ("more", "added")} <= {tuple(r) for r in fingerprints.changed_columns(retyped, of(rows)).collect()}
    assert {r.rows for r in of([]).collect()} == {0}


def test_a_second_write_of_the_same_rows_writes_nothing(spark, tmp_path):
    import os

    from huegrid.sources import fingerprints

    path, rows = str(tmp_path / "t"), spark.range(100)
    files = lambda: sorted(os.listdir(path))
    assert fingerprints.write_if_changed(rows.repartition(3), path)
    first = files()
    assert not fingerprints.write_if_changed(rows.repartition(7).orderBy("id"), path) and files() == first
    assert fingerprints.write_if_changed(rows.where("id <> 5"), path) and spark.read.parquet(path).count() == 99


def test_three_that_differ_most_equal_all_triples(spark):
    import itertools

    from huegrid.operators import records

    chance = np.random.default_rng(8)
    for n, values in ((3, chance.normal(size=(3, 2))), (12, chance.normal(size=(12, 4))), (9, chance.integers(0, 2, (9, 2)).astype(float)), (5, np.zeros((5, 2)))):
        apart = lambda a, b: float(np.sqrt(((values[a] - values[b]) ** 2).mean()))  # noqa: B023, E731
        score = lambda three: (min(apart(*p) for p in itertools.combinations(three, 2)), round(sum(apart(*p) for p in itertools.combinations(three, 2)), 12))
        want = max(itertools.combinations(range(n), 3), key=score)
        got = records.diverse_triple(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(values)], "sample_id int, x array<double>")).collect()
        assert tuple(sorted(r.sample_id for r in got)) == want and {round(r.least_distance, 12) for r in got} == {round(score(want)[0], 12)}
    rows = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "sample_id int, x array<double>")
    with pytest.raises(ValueError, match="there are 2"):
        records.diverse_triple(rows)
    with pytest.raises(ValueError, match="finite"):
        records.diverse_triple(rows.union(spark.createDataFrame([(3, [float("nan")])], rows.schema)))


def test_masks_are_whole_patches_of_an_exact_number(spark):
    from pyspark.sql import functions as F

    from huegrid.functions import patches

    keys = spark.range(200)
    for n, masked in ((16, 0), (16, 5), (16, 16), (1, 1)):
        drawn = patches.masked_patches(F.col("id"), "s", n, masked)
        rows = keys.select("id", drawn.alias("p")).select("*", patches.visible(F.col("p"), F.lit(4 * n), 4).alias("v")).select("*", patches.whole_patches(F.col("v"), 4, masked).alias("whole"), patches.whole_patches(F.col("v"), 4, masked + 1).alias("other")).collect()
        assert all(r.whole and not r.other and len(set(r.p)) == masked == len(r.p) and list(r.p) == sorted(r.p) for r in rows)
        assert all(r.v == [b // 4 not in r.p for b in range(4 * n)] for r in rows)
    shares = np.bincount([k for r in keys.select(patches.masked_patches(F.col("id"), "s", 16, 5).alias("p")).collect() for k in r.p], minlength=16) / 200
    assert shares.min() > 0.15 and shares.max() < 0.5  # 5 of 16 each
    split = spark.createDataFrame([([True, False, True, True],), ([],)], "v array<boolean>").select(patches.whole_patches(F.col("v"), 2, 1).alias("w")).collect()
    assert [r.w for r in split] == [False, False]
    with pytest.raises(ValueError, match="as many"):
        patches.masked_patches(F.col("id"), "s", 4, 5)


def test_errors_count_hidden_bands_alone(spark):
    from pyspark.sql import functions as F

    from huegrid.functions import patches

    row = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 0.0, 5.0], [True, False, False])], "x array<double>, y array<double>, v array<boolean>")
    some, every = (row.select(patches.squared_error(F.col("x"), F.col("y"), F.col("v"), e).alias("e")).first().e for e in (False, True))
    assert (some.total, some.bands, every.total, every.bands) == (8.0, 2, 9.0, 3)


def test_a_saved_model_is_the_fitted_one(spark, tmp_path):
    from huegrid.operators import models
    from pyspark.sql import functions as F

    x = np.random.default_rng(9).normal(size=(300, 5)) @ np.random.default_rng(10).normal(size=(5, 5))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    mean, parts = models.pca(rows, 5)
    models.pca_table(spark, mean, parts).repartition(3).write.parquet(str(tmp_path / "m"))
    saved = spark.read.parquet(str(tmp_path / "m"))
    again = models.pca_from_table(saved)
    assert (again[0] == mean).all() and (again[1] == parts).all()
    good = models.pca_checks(rows, *again).first()
    assert good.components == 5 and good.falling and good.basis_error < 1e-9 and good.score_mean < 1e-9 and good.total_variance == pytest.approx(x.var(0).sum())
    bad = models.pca_checks(rows, mean + 1, parts[::-1] * 1.5).first()
    assert not bad.falling and bad.basis_error > 1 and bad.score_mean > 0.1
    for broken in (saved.where("NOT (component = 2 AND band = 1)"), saved.union(saved.limit(1)), saved.withColumn("value", F.lit(float("nan"))), saved.where("component = 0")):
        with pytest.raises(ValueError, match="a saved model has"):
            models.pca_from_table(broken)
