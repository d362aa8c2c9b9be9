"""Sources, masks, alignment, summaries, plans and streams."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from huegrid.functions import spectra as S
from huegrid.operators import agreement, masks, models, quality, relations, sampling, summaries
from huegrid.sources import artifacts, envi
from huegrid.streaming import accumulators


def test_undefined_spectra_are_null(spark):
    rows = spark.createDataFrame([([1.0, float("nan"), 2.0],), ([2.0, 2.0, 2.0],), ([],), ([1.0, 2.0, 3.0],)], "x array<double>")
    got = [r.y for r in rows.select(S.snv(F.col("x")).alias("y")).collect()]
    assert got == [None, None, None, pytest.approx([-1.0, 0.0, 1.0])]


def test_calibration_needs_a_positive_span(spark):
    rows = spark.createDataFrame([(3.0, 2.0, 1.0), (3.0, 1.0, 1.0), (3.0, 0.0, 1.0)], "i double, w double, d double")
    assert [r.v for r in rows.select(S.calibrated(F.col("i"), F.col("w"), F.col("d")).alias("v")).collect()] == [2.0, None, None]


@pytest.mark.parametrize(("interleave", "axes"), [("bip", (0, 1, 2)), ("bil", (0, 2, 1)), ("bsq", (2, 0, 1))])
def test_envi_cubes(spark, tmp_path, interleave, axes):
    cube = np.arange(2 * 3 * 4, dtype="<i2").reshape(2, 3, 4)
    (tmp_path / "a.hdr").write_text(f"ENVI\nsamples = 3\nlines = 2\nbands = 4\nheader offset = 0\ndata type = 2\ninterleave = {interleave}\nbyte order = 0\nwavelength = {{1, 2,\n3, 4}}\n")
    (tmp_path / "a.raw").write_bytes(cube.transpose(axes).tobytes())
    rows = envi.read_cubes(spark, str(tmp_path)).orderBy("pixel_row", "pixel_col").collect()
    assert np.array([r.intensity for r in rows]).reshape(2, 3, 4).tolist() == cube.tolist()


def test_envi_header_errors():
    with pytest.raises(ValueError, match="wavelengths"):
        envi.layout(envi.header_fields("ENVI\nsamples = 3\nlines = 2\nbands = 4\ndata type = 2\ninterleave = bip\nwavelength = {1}\n"))
    with pytest.raises(ValueError, match="header"):
        envi.header_fields("samples = 3")


def test_ledger_finds_changes(spark, tmp_path):
    for name, content in (("x/a.txt", "1"), ("x/b.txt", "2"), ("y/a.txt", "1"), ("y/b.txt", "3"), ("y/c.txt", "4")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    old, new = (artifacts.ledger(spark, str(tmp_path / d)) for d in "xy")
    assert sorted(tuple(r) for r in artifacts.inventory_difference(new, old).collect()) == [("b.txt", "changed"), ("c.txt", "unexpected")]
    with pytest.raises(ValueError, match="changed"):
        artifacts.require_empty(artifacts.inventory_difference(new, old), "files")


def test_publish_writes_once(spark, tmp_path):
    artifacts.publish(spark.range(3), str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exists"):
        artifacts.publish(spark.range(3), str(tmp_path / "t"))


def test_components_of_a_spiral(spark):
    art = ["#######", "......#", "#####.#", "#...#.#", "#.###.#", "#.....#", "#######"]
    rows = [(1, r, c) for r, line in enumerate(art) for c, v in enumerate(line) if v == "#"]
    found = masks.components(spark.createDataFrame(rows + [(2, 0, 0)], "sample_id long, pixel_row long, pixel_col long"))
    records = sorted((r.sample_id, r.area_pixels) for r in masks.component_records(found, 7, 7).collect())
    assert records == [(1, len(rows)), (2, 1)]
    assert masks.without_small(found, 2).count() == len(rows)


def test_assignment_equals_all_permutations():
    random = np.random.default_rng(1)
    for _ in range(20):
        w = random.integers(0, 9, (5, 5))
        best = max(itertools.permutations(range(5)), key=lambda p: sum(w[i, c] for i, c in enumerate(p)))
        got = models.best_assignment(w)
        assert sum(w[i, c] for i, c in enumerate(got)) == sum(w[i, c] for i, c in enumerate(best))


def test_pca_has_an_orthonormal_basis(spark):
    random = np.random.default_rng(2)
    x = random.normal(size=(200, 6)) @ random.normal(size=(6, 6))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    mean, parts = models.pca(rows, 3)
    assert parts @ parts.T == pytest.approx(np.eye(3), abs=1e-9)
    want = np.linalg.svd(x - x.mean(0))[2][:3]
    assert np.abs((parts * want).sum(1)) == pytest.approx(1, abs=1e-8)
    got = np.array([r.pc for r in models.projected(rows, mean, parts).collect()])
    assert np.abs(got - (x - x.mean(0)) @ parts.T).max() < 1e-9


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).selectExpr("id % 5 AS g", "id")
    a = sampling.sample_rows(rows, ["g"], "id", 7, 3)
    b = sampling.sample_rows(rows.repartition(9), ["g"], "id", 7, 3)
    assert a.count() == 35 and a.exceptAll(b).isEmpty()


def test_folds_are_balanced(spark):
    sizes = [r["count"] for r in sampling.balanced_folds(spark.range(13).toDF("sample_id"), 5, 1).groupBy("test_fold").count().collect()]
    assert sorted(sizes) == [2, 2, 3, 3, 3]


def test_pair_plan_counts(spark):
    plan = sampling.pair_plan(spark, 3, 3)
    assert (plan.count(), plan.where("pair_group = 'within'").count(), plan.where("initial").count()) == (36, 9, 8)


def test_seed_plan_has_no_collisions(spark):
    plan = sampling.seed_plan(spark, ["rows", "folds"], 5, 3)
    assert plan.count() == 30 and sampling.collisions(plan).isEmpty()


def test_contract_violations(spark):
    rows = [("a", 1, 1, 0.5, None), ("a", 1, 2, None, None), ("a", 2, 1, 2.0, None), ("a", 2, 2, 0.1, "why"), ("a", 3, 1, 0.1, None), ("a", 3, 1, 0.1, None)]
    scores = spark.createDataFrame(rows, "condition string, sample_id long, repeat long, value double, reason string")
    found = sorted(set((r.sample_id, r.rule) for r in summaries.contract_violations(scores, 2, 0, 1).collect()))
    assert found == [(1, "undefined_without_reason"), (2, "defined_with_reason"), (2, "out_of_range"), (3, "duplicate"), (3, "missing_repeat")]


def test_cutoff_marks_low_bands_inside(spark):
    rows = spark.createDataFrame([(0, False), (1, True), (2, False), (3, True), (4, True)], "band long, low_snr boolean")
    got = {r.band: (r.retained, r.interior_low) for r in quality.terminal_cutoff(rows).collect()}
    assert got == {0: (True, False), 1: (True, True), 2: (True, False), 3: (False, False), 4: (False, False)}


def test_agreement_of_equal_and_swapped_labels(spark):
    rows = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (2, 1), (3, 3), (3, 3)], "l1 long, l2 long")
    (r,) = agreement.cluster_agreement(rows.groupBy("l1", "l2").agg(F.count(F.lit(1)).alias("n")), 3).collect()
    assert (r.rows, r.acc) == (6, 100) and r.nmi == pytest.approx(100) and r.ami == pytest.approx(100)
    assert agreement.accuracy(rows, "l1", "l2").first().accuracy == pytest.approx(100 / 3)


def test_expected_information_against_permutations():

    x, y = [0, 0, 0, 1, 1, 2], [0, 0, 1, 1, 2, 2]
    found = []
    for p in set(itertools.permutations(y)):
        table = np.zeros((3, 3))
        np.add.at(table, (x, list(p)), 1)
        i, j = np.nonzero(table)
        found.append((table[i, j] / 6 * np.log(6 * table[i, j] / (table.sum(1)[i] * table.sum(0)[j]))).sum())
    assert agreement.expected_information(np.bincount(x), np.bincount(y)) == pytest.approx(np.mean(found))


def test_lookups_compositions_and_large_images(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert relations.looked_up(left, spark.createDataFrame([(1, 5), (2, 6)], "k long, w long"), ["k"]).count() == 2
    with pytest.raises(Exception, match="no match for"):
        relations.looked_up(left, spark.createDataFrame([(1, 5)], "k long, w long"), ["k"]).collect()
    first = spark.createDataFrame([(1, 2), (2, 1), (3, 9)], "a long, b long")
    second = spark.createDataFrame([(1, 7), (2, 8)], "a long, b long")
    assert sorted(tuple(r) for r in relations.composed(first, second).where("target IS NOT NULL").collect()) == [(1, 8), (2, 7)]
    far = spark.createDataFrame([(1, 3000, 5), (1, 3001, 6)], "sample_id long, pixel_row int, pixel_col int")
    assert len({r.component for r in masks.components(far).collect()}) == 2 and len({r.component for r in masks.components(far, 8).collect()}) == 1


def test_counts_over_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 3, 3), (1, 1, 3, 4), (1, 2, 5, 5)], "sample_id long, draw long, label long, clean_label long")
    rows.write.parquet(str(tmp_path / "flips"))
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0)], "ts string, event_type string, value double")
    events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "events"))
    for name, make in (("flips", accumulators.flip_stream), ("events", accumulators.events_per_window)):
        read = spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
        run = make(read).writeStream.outputMode("complete").format("memory").queryName(f"{name}_test").option("checkpointLocation", str(tmp_path / f"ck-{name}")).start()
        run.processAllAvailable()
        run.stop()
    assert sorted(tuple(r) for r in spark.table("flips_test").collect()) == [(1, 1, 2, 1), (1, 2, 1, 0)]
    assert sorted((r.n, r.total) for r in spark.table("events_test").collect()) == [(1, 4.0), (2, 3.0)]


def test_occupancy_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1)], "sample_id long, label long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = accumulators.occupancy_stream(stream).writeStream.outputMode("complete").format("memory").queryName("occupancy_test")
    run = out.option("checkpointLocation", str(tmp_path / "ck")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(tuple(r) for r in spark.table("occupancy_test").collect()) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]
