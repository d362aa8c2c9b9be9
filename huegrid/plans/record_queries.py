"""Queries of records, selections and matchings, each beside SQL that states the same rows in another way."""

from __future__ import annotations

from pyspark.sql import functions as F

from huegrid.functions import spectra as S
from huegrid.operators import maps as M
from huegrid.operators import records, summaries
from huegrid.plans.queries import FOLDS, LLA, ORACLE_SQL, SUMMARY, _folds, query, rounded
from huegrid.sources import views as V

ODD = "CASE WHEN vec_id % 7 = 0 THEN list_transform(x, lambda v: 0.5::DOUBLE) WHEN vec_id % 5 = 0 THEN list_transform(x, lambda v: CASE WHEN v > 0.2 THEN 'inf'::DOUBLE ELSE v + 1 END) ELSE list_transform(x, lambda v: v + 0.3) END"
QUALITY = f"""WITH o AS (SELECT sample_id, {ODD} AS x FROM px),
r AS (SELECT sample_id, x, CASE WHEN len(list_filter(x, lambda v: isinf(v))) > 0 THEN 1 WHEN list_max(x) = list_min(x) THEN 2 WHEN list_min(x) < 0 THEN 3 ELSE 0 END AS reason FROM o),
y AS (SELECT *, CASE WHEN reason = 0 THEN sqrt(list_sum(list_transform(x, lambda v: (v - list_avg(x)) * (v - list_avg(x)))) / 63) END AS sd FROM r),
d AS (SELECT *, list_transform(range(1, 64), lambda i: (x[i + 1] - x[i]) / sd) AS d FROM y),
e AS (SELECT *, CASE WHEN reason = 0 THEN sqrt(list_avg(list_transform(d, lambda v: v * v))) END AS rms, CASE WHEN reason = 0 THEN list_max(list_transform(range(1, 63), lambda i: abs(d[i + 1] - d[i]))) END AS curve FROM d),
q AS (SELECT sample_id, count(*) AS pixels, count(*) FILTER (reason = 1) AS nonfinite, count(*) FILTER (reason = 2) AS flat, count(*) FILTER (reason = 3) AS negative, count(*) FILTER (reason = 0) AS saved,
  count(*) FILTER (reason <> 1 AND list_min(x) < 0) AS any_negative, count(*) FILTER (reason <> 1 AND list_max(x) > 1) AS any_above_one,
  round(quantile_cont(rms, 0.99), 6) AS rms_q99, round(quantile_cont(curve, 0.99), 6) AS curve_q99, round(max(curve), 6) AS curve_max,
  CASE WHEN count(sd) > 0 THEN 0.0::DOUBLE END AS mean_error, CASE WHEN count(sd) > 0 THEN 0.0::DOUBLE END AS sd_error, CASE WHEN count(sd) > 0 THEN 0.0::DOUBLE END AS norm_error,
  round(1 - count(*) FILTER (reason = 0)::DOUBLE / count(*), 6) + 0.0 AS excluded_fraction FROM e GROUP BY 1)"""
ERRORS = ("mean_error", "sd_error", "norm_error", "excluded_fraction")


def _records(spark, sf_dir):
    x = F.col("x")
    flat, wild, moved = F.transform(x, lambda v: F.lit(0.5)), F.transform(x, lambda v: F.when(v > 0.2, F.lit(float("inf"))).otherwise(v + 1)), F.transform(x, lambda v: v + 0.3)
    rows = V.pixels(spark, sf_dir).withColumn("x", F.when(F.col("vec_id") % 7 == 0, flat).when(F.col("vec_id") % 5 == 0, wild).otherwise(moved))
    return records.sample_quality(rows)


@query("sample_quality", QUALITY + " SELECT * FROM q", "px")
def sample_quality(spark, sf_dir):
    return rounded(_records(spark, sf_dir), "rms_q99", "curve_q99", "curve_max", *ERRORS)


@query(
    "dataset_summary",
    QUALITY + " SELECT count(*) AS samples, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("pixels", "nonfinite", "flat", "negative", "saved"))
    + ", max(mean_error) AS mean_error, max(sd_error) AS sd_error, max(norm_error) AS norm_error, round(1 - sum(saved)::DOUBLE / sum(pixels), 6) + 0.0 AS excluded_fraction FROM q",
    "px",
)
def dataset_summary(spark, sf_dir):
    return rounded(records.dataset_summary(_records(spark, sf_dir)), *ERRORS)


@query(
    "mask_records",
    """WITH o AS (SELECT u, w FROM (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) t(u, w)), f AS (SELECT * FROM maps WHERE l2 > 1),
h AS (SELECT m.sample_id, m.pixel_row, m.pixel_col, count(*) AS n FROM f m, o JOIN f d ON d.sample_id = m.sample_id AND d.pixel_row = m.pixel_row + u AND d.pixel_col = m.pixel_col + w GROUP BY ALL),
b AS (SELECT sample_id, pixel_row, pixel_col FROM h WHERE n = 5 - (pixel_row IN (0, 63))::INT - (pixel_col IN (0, 63))::INT),
r AS (SELECT sample_id, pixel_row, pixel_col, pixel_row * 64 + pixel_col AS l FROM b UNION SELECT b.sample_id, b.pixel_row, b.pixel_col, r.l FROM r JOIN b ON b.sample_id = r.sample_id AND greatest(abs(b.pixel_row - r.pixel_row), abs(b.pixel_col - r.pixel_col)) = 1),
c AS (SELECT sample_id, k, count(*) AS n FROM (SELECT sample_id, pixel_row, pixel_col, min(l) AS k FROM r GROUP BY ALL) GROUP BY ALL),
s AS (SELECT sample_id, sum(n) AS n, coalesce(sum(n) FILTER (n < 4), 0) AS small FROM c GROUP BY 1),
k AS (SELECT sample_id, count(*) FILTER (l2 <= 1) AS background, count(*) FILTER (l2 IN (2, 3)) AS dark, count(*) FILTER (l2 > 3) AS bright FROM maps GROUP BY 1)
SELECT sample_id, background, dark, bright, (dark + bright - coalesce(n, 0))::BIGINT AS eroded, coalesce(small, 0)::BIGINT AS removed_small, coalesce(n - small, 0)::BIGINT AS kept, round(coalesce(n - small, 0)::DOUBLE / 4096, 6) AS fraction FROM k LEFT JOIN s USING (sample_id)""",
    "maps",
)
def mask_records(spark, sf_dir):
    rows = V.one_map(spark, sf_dir, "l2").withColumnRenamed("label", "value")
    return rounded(records.mask_records(rows, 1.0, 3.0, 64, 64, 1, 4), "fraction")


ORACLE_SQL["mask_records"] = ORACLE_SQL["mask_records"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("masked_rows", "SELECT sample_id, pixel_row, pixel_col, row_number() OVER (PARTITION BY sample_id ORDER BY pixel_row, pixel_col) - 1 AS hdf5_row FROM maps WHERE l1 <= 3", "maps")
def masked_rows(spark, sf_dir):
    return records.masked_rows(V.maps(spark, sf_dir).select("sample_id", "pixel_row", "pixel_col", "l1"), F.col("l1") <= 3).drop("l1")


@query("stratified_folds", "SELECT vec_id, label, ((row_number() OVER (PARTITION BY label ORDER BY sha256('42|' || vec_id), vec_id) - 1) % 5 + 1)::BIGINT AS fold FROM embeddings")
def stratified_folds(spark, sf_dir):
    return records.stratified_folds(V.table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 5, 42)


@query(
    "probe_rows",
    "WITH n AS (SELECT sample_id, count(*) AS n FROM px GROUP BY 1), w AS (SELECT DISTINCT sample_id, CASE WHEN n <= 64 THEN i ELSE i * (n - 1) // 63 END AS hdf5_row FROM n, range(0, 64) t(i)) "
    "SELECT sample_id, count(*) AS probes, sum(hdf5_row)::BIGINT AS places, true AS within FROM px JOIN w USING (sample_id, hdf5_row) GROUP BY 1",
    "px",
)
def probe_rows(spark, sf_dir):
    """64 evenly spaced rows of a sample: SNV as stored in single precision against SNV worked out again."""
    rows = V.pixels(spark, sf_dir).withColumn("stored", S.snv(F.col("x")).cast("array<float>").cast("array<double>"))
    error = S.largest(F.zip_with("stored", S.snv(F.col("x")), lambda a, b: a - b))
    probes = records.evenly_spaced(rows, ["sample_id"], "hdf5_row", 64)
    return probes.groupBy("sample_id").agg(F.count(F.lit(1)).alias("probes"), F.sum("hdf5_row").alias("places"), (F.max(error) <= 1e-5).alias("within"))


@query(
    "typical_rows",
    """WITH b AS (SELECT sample_id, band, quantile_cont(value, 0.5) AS m FROM bands GROUP BY ALL), d AS (SELECT sample_id, hdf5_row, sqrt(avg((value - m) * (value - m))) AS d FROM bands JOIN b USING (sample_id, band) GROUP BY ALL)
SELECT sample_id, hdf5_row, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY d, hdf5_row) = 1""",
    "bands",
)
def typical_rows(spark, sf_dir):
    return rounded(records.typical_rows(V.pixels(spark, sf_dir), "hdf5_row"), "distance")


@query(
    "coordinate_violations",
    """WITH c AS (SELECT l_orderkey // 4096 AS sample_id, (l_orderkey % 4096) // 64 AS pixel_row, l_orderkey % 64 AS pixel_col, count(*) AS c FROM lineitem GROUP BY ALL), i AS (SELECT * FROM c WHERE pixel_col < 60)
SELECT 'out_of_bounds' AS rule, coalesce(sum(c), 0)::BIGINT AS n FROM c WHERE pixel_col >= 60 UNION ALL SELECT 'chosen_twice', count(*) FROM i WHERE c > 1 UNION ALL SELECT 'outside_mask', count(*) FROM i ANTI JOIN maps USING (sample_id, pixel_row, pixel_col)""",
    "maps",
)
def coordinate_violations(spark, sf_dir):
    """Images of 64 x 60 pixels."""
    key = F.col("l_orderkey")
    place = (F.expr("l_orderkey div 4096").alias("sample_id"), F.expr("(l_orderkey % 4096) div 64").alias("pixel_row"), (key % 64).alias("pixel_col"))
    return records.coordinate_violations(V.table(spark, sf_dir, "lineitem").select(*place), V.maps(spark, sf_dir), 64, 60)


@query("fold_summary", f"WITH {FOLDS}, n AS (SELECT sample_id, count(*) AS n FROM maps GROUP BY 1) SELECT test_fold, count(*) AS samples, sum(n)::BIGINT AS pixels, (sum(n) // 1024)::BIGINT AS batches FROM n JOIN f USING (sample_id) GROUP BY 1", "maps")
def fold_summary(spark, sf_dir):
    return records.fold_summary(V.maps(spark, sf_dir), _folds(spark, sf_dir), 1024)


@query("count_differences", "WITH a AS (SELECT sample_id, l1 AS label, count(*) AS mapped FROM maps GROUP BY ALL), b AS (SELECT sample_id, l2 AS label, count(*) AS recorded FROM maps GROUP BY ALL) SELECT sample_id, label, coalesce(mapped, 0) AS mapped, coalesce(recorded, 0) AS recorded FROM a FULL JOIN b USING (sample_id, label) WHERE coalesce(mapped, 0) <> coalesce(recorded, 0)", "maps")
def count_differences(spark, sf_dir):
    return records.count_differences(V.one_map(spark, sf_dir), M.occupancy(V.one_map(spark, sf_dir, "l2")))


@query("map_evaluation", "WITH l AS (" + LLA.format(r=1) + "), o AS (SELECT sample_id, label, count(*) AS n FROM m1 GROUP BY ALL), u AS (SELECT sample_id, round(count(*) / 8.0::DOUBLE, 6) AS usage_rate, round(max(n)::DOUBLE / sum(n), 6) AS max_fraction FROM o GROUP BY 1) SELECT sample_id, pixels, lla, adjusted_lla, usage_rate, max_fraction, reasons FROM l JOIN u USING (sample_id)", "m1")
def map_evaluation(spark, sf_dir):
    rows = V.one_map(spark, sf_dir)
    used = M.used_clusters(rows).select("sample_id", (F.col("used") / V.CLUSTERS).alias("usage_rate"), "max_fraction")
    out = M.lla(rows, 3).select("sample_id", "pixels", "lla", "adjusted_lla", "reasons").join(used, "sample_id")
    return rounded(out, "lla", "adjusted_lla", "usage_rate", "max_fraction")


@query("projection_centroids", "SELECT k AS label, count(x) AS pixels, round(avg(x[1]), 6) + 0.0 AS a, round(avg(x[2]), 6) + 0.0 AS b FROM range(1, 13) t(k) LEFT JOIN px ON cls = k GROUP BY 1", "px")
def projection_centroids(spark, sf_dir):
    rows = V.pixels(spark, sf_dir)
    return rounded(records.centroids(rows, "cls", F.col("x")[0], F.col("x")[1], 12), "a", "b")


@query(
    "projection_density",
    """WITH e AS (SELECT min(x[1]) AS a0, min(x[2]) AS b0, greatest(max(x[1]) - min(x[1]), max(x[2]) - min(x[2])) AS side FROM px)
SELECT least(floor((x[1] - a0) * 70 / side), 69)::BIGINT AS bin_a, least(floor((x[2] - b0) * 70 / side), 69)::BIGINT AS bin_b, count(*) AS n FROM px, e GROUP BY ALL""",
    "px",
)
def projection_density(spark, sf_dir):
    return records.density(V.pixels(spark, sf_dir), F.col("x")[0], F.col("x")[1], 70)


_CURVES = "{n} AS (SELECT k, band, avg(v) AS v FROM (SELECT sample_id, k, band, avg(v) AS v FROM (SELECT sample_id, {k} AS k, unnest(range(0, 64)) AS band, unnest(y) AS v FROM z) GROUP BY ALL) GROUP BY ALL), {n}v AS (SELECT k, list(v ORDER BY band) AS v FROM {n} GROUP BY 1)"


@query(
    "spectral_matching",
    "WITH z0 AS (SELECT sample_id, list_transform(x, lambda v: (v - list_avg(x)) / sqrt(list_sum(list_transform(x, lambda w: (w - list_avg(x)) * (w - list_avg(x)))) / 63)) AS y, list_position(x[1:8], list_max(x[1:8])) AS k1, list_position(x[9:16], list_max(x[9:16])) AS k2 FROM px), z AS (SELECT * FROM z0), "
    + _CURVES.format(n="p", k="k1") + ", " + _CURVES.format(n="t", k="k2")
    + """, s AS (SELECT pv.k::BIGINT AS reference, tv.k::BIGINT AS target, list_cosine_similarity(pv.v, tv.v) AS c FROM pv, tv),
g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS path, 0.0::DOUBLE AS total UNION ALL SELECT i + 1, list_append(path, target), total + c FROM g JOIN s ON reference = i + 1 AND NOT list_contains(path, target)),
b AS (SELECT arg_max(path, total) AS path FROM g WHERE i = 8)
SELECT reference, target, round(c, 6) + 0.0 AS similarity, b.path[reference] = target AS assigned, round((SELECT max(o.c) FROM s o WHERE o.reference = s.reference AND o.target <> s.target), 6) + 0.0 AS best_other FROM s, b""",
    "px",
)
def spectral_matching(spark, sf_dir):
    rows = V.pixels(spark, sf_dir).select("sample_id", "x", V.repeat_label(1).alias("k1"), V.repeat_label(2).alias("k2"))
    return rounded(records.spectral_matching(rows, "k1", "k2", 8), "similarity", "best_other")


ORACLE_SQL["spectral_matching"] = ORACLE_SQL["spectral_matching"].replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "paired_tables",
    "WITH c AS (SELECT sample_id FROM scores WHERE condition IN ('A', 'N') GROUP BY 1 HAVING count(value) = 6), x AS (SELECT count(*) AS excluded_samples FROM (SELECT sample_id FROM scores WHERE condition IN ('A', 'N') GROUP BY 1 HAVING count(value) < 6)), "
    "a AS (SELECT condition, sample_id, repeat, value FROM scores SEMI JOIN c USING (sample_id) WHERE condition IN ('A', 'N')), d AS (SELECT * FROM a UNION ALL SELECT 'A-N', sample_id, repeat, l.value - r.value FROM (SELECT * FROM a WHERE condition = 'A') l JOIN (SELECT * FROM a WHERE condition = 'N') r USING (sample_id, repeat)), "
    + SUMMARY.format(by="condition", src="d").replace("FROM s JOIN r USING (condition)", ", excluded_samples FROM s JOIN r USING (condition), x"),
    "scores",
)
def paired_tables(spark, sf_dir):
    return rounded(summaries.paired_tables(V.scores(spark, sf_dir), "A", "N"), "sample_sd", "mean", "repeat_sd")


@query("flat_summary", "WITH w AS (" + ORACLE_SQL["repeat_summary"] + ") SELECT condition, statistic, value, 'share' AS unit FROM (UNPIVOT (SELECT condition, mean, sample_sd, repeat_sd FROM w) ON mean, sample_sd, repeat_sd INTO NAME statistic VALUE value)")
def flat_summary(spark, sf_dir):
    rows = summaries.repeat_summary(V.scores(spark, sf_dir), ["condition"])
    return rounded(summaries.flat_summary(rows, ["condition"], "share"), "value")


@query("best_variant", "SELECT condition, round(avg(value), 6) + 0.0 AS mean FROM scores GROUP BY 1 QUALIFY row_number() OVER (ORDER BY avg(value) DESC, list_position(['N', 'A', 'R'], condition)) = 1", "scores")
def best_variant(spark, sf_dir):
    return rounded(summaries.best_variant(V.scores(spark, sf_dir), ["N", "A", "R"]), "mean")
