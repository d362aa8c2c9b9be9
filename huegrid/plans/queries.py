"""The queries of the library over the driver's tables, each beside SQL that states the same rows in another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huegrid.functions import spectra as S
from huegrid.operators import maps as M
from huegrid.operators import agreement, masks, models, perturbation, quality, relations, reproducibility, sampling, summaries
from huegrid.sources import views as V
from huegrid.sources.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *names: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(sql, *names) if names else sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """-0.0 becomes 0.0."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


# ---- label maps ------------------------------------------------------------

LLA = """WITH p AS (
  SELECT a.sample_id, count(*) AS pairs, count(*) FILTER (a.label = b.label) AS matches
  FROM m1 a JOIN m1 b ON a.sample_id = b.sample_id AND abs(a.pixel_row - b.pixel_row) <= {r} AND abs(a.pixel_col - b.pixel_col) <= {r}
    AND (a.pixel_row <> b.pixel_row OR a.pixel_col <> b.pixel_col) GROUP BY 1),
k AS (SELECT sample_id, label, count(*)::HUGEINT AS n FROM m1 GROUP BY ALL),
e AS (SELECT sample_id, sum(n)::HUGEINT AS pixels, sum(n * (n - 1))::HUGEINT AS e FROM k GROUP BY 1),
j AS (SELECT sample_id, pixels, e, pixels * (pixels - 1) AS t, coalesce(pairs, 0)::HUGEINT AS p, coalesce(matches, 0)::HUGEINT AS m FROM e LEFT JOIN p USING (sample_id))
SELECT sample_id, pixels::BIGINT AS pixels, p::BIGINT AS pairs, m::BIGINT AS matches,
  round(CASE WHEN p > 0 THEN m::DOUBLE / p::DOUBLE END, 6) + 0.0 AS lla,
  round(CASE WHEN pixels >= 2 AND p > 0 AND t <> e THEN (m * t - p * e)::DOUBLE / (p * (t - e))::DOUBLE END, 6) + 0.0 AS adjusted_lla,
  nullif(concat_ws(';', CASE WHEN pixels < 2 THEN 'fewer_than_two_valid_pixels' END, CASE WHEN p = 0 THEN 'no_valid_neighbor_pairs' END,
    CASE WHEN t = e THEN 'single_cluster' END), '') AS reasons FROM j"""


def _lla(width: int):
    @query(f"lla{width}", LLA.format(r=width // 2), "m1")
    def run(spark, sf_dir):
        return rounded(M.lla(V.one_map(spark, sf_dir), width), "lla", "adjusted_lla")


for _w in (3, 5, 9):
    _lla(_w)


@query(
    "lla_reasons",
    LLA.format(r=1).replace("FROM m1 a JOIN m1 b", "FROM f a JOIN f b").replace("FROM m1 GROUP", "FROM f GROUP").replace(
        "WITH p AS", "WITH f AS (SELECT sample_id * 8 + pixel_row // 8 AS sample_id, pixel_row, pixel_col, label FROM m1 WHERE label = 1 + (pixel_row // 8) % 5 AND pixel_col % 4 = 0), p AS"
    ),
    "m1",
)
def lla_reasons(spark, sf_dir):
    rows = V.one_map(spark, sf_dir).where("label = 1 + (pixel_row div 8) % 5 AND pixel_col % 4 = 0")
    return rounded(M.lla(rows.withColumn("sample_id", F.expr("sample_id * 8 + pixel_row div 8")), 3), "lla", "adjusted_lla")


@query("occupancy", "SELECT sample_id, label, count(*) AS pixels, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY sample_id), 6) AS fraction FROM m1 GROUP BY sample_id, label", "m1")
def occupancy(spark, sf_dir):
    return rounded(M.occupancy(V.one_map(spark, sf_dir)), "fraction")


@query(
    "used_clusters",
    """WITH o AS (SELECT sample_id, label, count(*) AS n FROM m1 GROUP BY ALL)
SELECT sample_id, count(*) AS used, round(max(n)::DOUBLE / sum(n), 6) AS max_fraction, count(*) = 1 AS single_cluster FROM o GROUP BY 1""",
    "m1",
)
def used_clusters(spark, sf_dir):
    return rounded(M.used_clusters(V.one_map(spark, sf_dir)), "max_fraction")


@query("contingency", "SELECT sample_id, l1, l2, count(*) AS n FROM maps GROUP BY ALL", "maps")
def contingency(spark, sf_dir):
    return M.contingency(V.maps(spark, sf_dir))


@query("contingency_pivot", "SELECT sample_id, l1, " + ", ".join(f"count(*) FILTER (l2 = {k}) AS n{k}" for k in range(1, 6)) + " FROM maps GROUP BY ALL", "maps")
def contingency_pivot(spark, sf_dir):
    wide = V.maps(spark, sf_dir).groupBy("sample_id", "l1").pivot("l2", list(range(1, 6))).count().fillna(0)
    return wide.select("sample_id", "l1", *(F.col(str(k)).alias(f"n{k}") for k in range(1, 6)))


ARI = """c AS (SELECT {by}, l1, l2, count(*)::HUGEINT AS n FROM {src} GROUP BY ALL),
s AS (SELECT {by}, sum(n * (n - 1) // 2)::DOUBLE AS c, sum(n)::HUGEINT AS pixels FROM c GROUP BY ALL),
a AS (SELECT {by}, sum(n * (n - 1) // 2)::DOUBLE AS a, count(*) AS used_a FROM (SELECT {by}, l1, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) GROUP BY ALL),
b AS (SELECT {by}, sum(n * (n - 1) // 2)::DOUBLE AS b, count(*) AS used_b FROM (SELECT {by}, l2, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) GROUP BY ALL),
r AS (SELECT *, (pixels * (pixels - 1) // 2)::DOUBLE AS t FROM s JOIN a USING ({by}) JOIN b USING ({by})),
ari AS (SELECT {by}, pixels::BIGINT AS pixels, used_a, used_b,
  CASE WHEN pixels < 2 THEN NULL WHEN (a + b) * t = 2 * a * b THEN 1.0 ELSE 2 * (c * t - a * b) / ((a + b) * t - 2 * a * b) END AS ari FROM r)"""


@query("ari_pairs", "WITH " + ARI.format(by="sample_id", src="maps") + " SELECT sample_id, pixels, used_a, used_b, round(ari, 6) + 0.0 AS ari FROM ari", "maps")
def ari_pairs(spark, sf_dir):
    return rounded(M.adjusted_rand(M.contingency(V.maps(spark, sf_dir))), "ari")


REPEATS = "WITH q AS (SELECT a.sample_id, a.repeat AS repeat_a, b.repeat AS repeat_b, a.label AS l1, b.label AS l2 FROM lab a JOIN lab b USING (sample_id, pixel_row, pixel_col) WHERE a.repeat < b.repeat), " + ARI.format(by="sample_id, repeat_a, repeat_b", src="q")


@query("ari_repeat_mean", REPEATS + " SELECT sample_id, round(avg(ari), 6) + 0.0 AS mean, count(ari) AS pairs FROM ari GROUP BY 1", "lab")
def ari_repeat_mean(spark, sf_dir):
    out = M.repeat_ari(V.repeat_maps(spark, sf_dir)).groupBy("sample_id").agg(F.avg("ari").alias("mean"), F.count("ari").alias("pairs"))
    return rounded(out, "mean")


@query("ari_macro", REPEATS + ", m AS (SELECT sample_id, avg(ari) AS m FROM ari GROUP BY 1) SELECT 'all' AS condition, count(m) AS samples, round(avg(m), 6) + 0.0 AS mean, round(stddev_samp(m), 6) AS sample_sd FROM m", "lab")
def ari_macro(spark, sf_dir):
    rows = M.repeat_ari(V.repeat_maps(spark, sf_dir)).withColumn("condition", F.lit("all"))
    return rounded(summaries.macro(rows, ["condition"]), "mean", "sample_sd")


@query("pair_complete_case", REPEATS + """, g AS (SELECT *, CASE WHEN repeat_a = 1 THEN 'initial' ELSE 'other' END AS pair_group FROM ari)
SELECT sample_id, pair_group, count(ari) AS defined, count(ari) = 2 AS complete,
  CASE WHEN count(ari) = 2 THEN round(avg(ari), 6) + 0.0 END AS mean, round(avg(ari), 6) + 0.0 AS partial_mean FROM g GROUP BY ALL""", "lab")
def pair_complete_case(spark, sf_dir):
    rows = M.repeat_ari(V.repeat_maps(spark, sf_dir)).withColumn("pair_group", F.when(F.col("repeat_a") == 1, "initial").otherwise("other"))
    return rounded(summaries.complete_pairs(rows, "pair_group", 2), "mean", "partial_mean")


@query("paired_ari", REPEATS + ", w AS (SELECT sample_id, max(ari) FILTER (repeat_a = 1 AND repeat_b = 2) AS x, max(ari) FILTER (repeat_a = 1 AND repeat_b = 3) AS y FROM ari GROUP BY 1) SELECT sample_id, round(x - y, 6) + 0.0 AS difference FROM w WHERE x IS NOT NULL AND y IS NOT NULL", "lab")
def paired_ari(spark, sf_dir):
    rows = M.repeat_ari(V.repeat_maps(spark, sf_dir)).where("repeat_a = 1").groupBy("sample_id").pivot("repeat_b", [2, 3]).agg(F.max("ari"))
    return rounded(rows.select("sample_id", (F.col("2") - F.col("3")).alias("difference")).where("difference IS NOT NULL"), "difference")


@query(
    "vi_bits",
    """WITH c AS (SELECT sample_id, l1, l2, count(*)::DOUBLE AS n FROM maps GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY sample_id) AS t, sum(n) OVER (PARTITION BY sample_id, l1) AS a, sum(n) OVER (PARTITION BY sample_id, l2) AS b FROM c)
SELECT sample_id, round(-sum(n / t * log2(n / a)), 6) + 0.0 AS h_b_given_a_bits, round(-sum(n / t * log2(n / b)), 6) + 0.0 AS h_a_given_b_bits,
  round(-sum(n / t * (log2(n / a) + log2(n / b))), 6) + 0.0 AS vi_bits FROM w GROUP BY 1""",
    "maps",
)
def vi_bits(spark, sf_dir):
    return rounded(M.entropies(M.contingency(V.maps(spark, sf_dir))), "h_b_given_a_bits", "h_a_given_b_bits", "vi_bits")


EDGES = """e AS (SELECT a.sample_id, a.pixel_row + b.pixel_row AS i, a.pixel_col + b.pixel_col AS j, a.{l} <> b.{l} AS boundary FROM maps a JOIN maps b
  ON a.sample_id = b.sample_id AND ((b.pixel_row = a.pixel_row AND b.pixel_col = a.pixel_col + 1) OR (b.pixel_col = a.pixel_col AND b.pixel_row = a.pixel_row + 1)))"""


@query("boundary_edges", "WITH " + EDGES.format(l="l1") + " SELECT sample_id, i, j FROM e WHERE boundary", "maps")
def boundary_edges(spark, sf_dir):
    return M.boundary(V.one_map(spark, sf_dir))


@query(
    "boundary_density",
    "WITH " + EDGES.format(l="l1") + """ SELECT sample_id, n AS valid_pixels, coalesce(ve, 0) AS valid_edges, coalesce(be, 0) AS boundary_edges, round(be::DOUBLE / ve, 6) AS boundary_density
FROM (SELECT sample_id, count(*) AS n FROM maps GROUP BY 1) LEFT JOIN (SELECT sample_id, count(*) AS ve, count(*) FILTER (boundary) AS be FROM e GROUP BY 1) USING (sample_id)""",
    "maps",
)
def boundary_density(spark, sf_dir):
    return rounded(M.diagnostics(V.one_map(spark, sf_dir)), "boundary_density")


def _coverage(width: int):
    sql = (
        "WITH " + EDGES.format(l="l1") + ", " + EDGES.format(l="l2").replace("e AS", "g AS", 1) + f""", a AS (SELECT sample_id, i, j FROM e WHERE boundary), b AS (SELECT sample_id, i, j FROM g WHERE boundary),
x AS (SELECT a.sample_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM b WHERE b.sample_id = a.sample_id AND abs(a.i - b.i) <= {width - 1} AND abs(a.j - b.j) <= {width - 1})) AS m FROM a GROUP BY 1),
y AS (SELECT b.sample_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE b.sample_id = a.sample_id AND abs(a.i - b.i) <= {width - 1} AND abs(a.j - b.j) <= {width - 1})) AS m FROM b GROUP BY 1)
SELECT s.sample_id, round(x.m::DOUBLE / x.n, 6) AS a_to_b, round(y.m::DOUBLE / y.n, 6) AS b_to_a,
  CASE WHEN x.n > 0 AND y.n > 0 THEN round(least(x.m::DOUBLE / x.n, y.m::DOUBLE / y.n), 6) END AS lower,
  CASE WHEN x.n > 0 AND y.n > 0 THEN round(greatest(x.m::DOUBLE / x.n, y.m::DOUBLE / y.n), 6) END AS upper
FROM (SELECT DISTINCT sample_id FROM maps) s LEFT JOIN x USING (sample_id) LEFT JOIN y USING (sample_id)"""
    )

    @query(f"boundary_coverage{width}", sql, "maps")
    def run(spark, sf_dir):
        both = V.maps(spark, sf_dir).select(*M.PIXEL, F.array("l1", "l2").alias("labels"))
        return rounded(reproducibility.compared(both, width), "a_to_b", "b_to_a", "lower", "upper")


for _w in (3, 5, 9):
    _coverage(_w)

TRIPLES = [(1, 0, 0), (0, 1, 0), (1, 1, 0), (2, 1, 0), (1, 2, 0), (3, 1, 0), (1, 3, 0), (2, 3, 0), (3, 2, 0)]


@query(
    "boundary_frequency",
    "WITH v AS (SELECT sample_id, pixel_row, pixel_col, t.k AS map, 1 + (l1 * t.a + l2 * t.b + pixel_row * t.c) % 8 AS label FROM maps, (VALUES "
    + ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(TRIPLES))
    + """) AS t(k, a, b, c)),
e AS (SELECT a.map, a.sample_id, a.pixel_row + b.pixel_row AS i, a.pixel_col + b.pixel_col AS j FROM v a JOIN v b ON a.map = b.map AND a.sample_id = b.sample_id AND a.label <> b.label
  AND ((b.pixel_row = a.pixel_row AND b.pixel_col = a.pixel_col + 1) OR (b.pixel_col = a.pixel_col AND b.pixel_row = a.pixel_row + 1))),
h AS (SELECT DISTINCT sample_id, (i + u) // 2 AS pixel_row, (j + w) // 2 AS pixel_col, map FROM e, range(-2, 3) a(u), range(-2, 3) b(w) WHERE (i + u) % 2 = 0 AND (j + w) % 2 = 0)
SELECT p.sample_id, p.pixel_row, p.pixel_col, round(count(h.map) / 9.0::DOUBLE, 6) AS frequency FROM (SELECT DISTINCT sample_id, pixel_row, pixel_col FROM v) p LEFT JOIN h USING (sample_id, pixel_row, pixel_col) GROUP BY ALL""",
    "maps",
)
def boundary_frequency(spark, sf_dir):
    labels = F.array(*(1 + (F.col("l1") * a + F.col("l2") * b + F.col("pixel_row") * c) % 8 for a, b, c in TRIPLES))
    rows = V.maps(spark, sf_dir).select(*M.PIXEL, labels.alias("labels"))
    return rounded(reproducibility.boundary_frequency(rows, 9, 3), "frequency")


SILHOUETTE = """WITH d AS (SELECT a.vec_id, a.sample_id, a.cls AS own, b.cls AS other, sum(greatest(0, 1 - list_dot_product(a.x, b.x))) FILTER (a.vec_id <> b.vec_id) AS s, count(*) FILTER (a.vec_id <> b.vec_id) AS n
  FROM px a, px b GROUP BY ALL),
f AS (SELECT vec_id, sample_id, own, max(CASE WHEN own = other THEN n END) AS no, max(CASE WHEN own = other THEN s / nullif(n, 0) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY ALL),
z AS (SELECT vec_id, sample_id, own, CASE WHEN no = 0 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM f)"""


def _points(spark, sf_dir):
    return V.pixels(spark, sf_dir).select("vec_id", "sample_id", F.col("cls").alias("label"), F.col("x").alias("z"))


@query("silhouette_pooled", SILHOUETTE + " SELECT count(*) AS points, round(avg(silhouette), 5) + 0.0 AS mean FROM z", "px")
def silhouette_pooled(spark, sf_dir):
    out = M.silhouette(_points(spark, sf_dir)).agg(F.count(F.lit(1)).alias("points"), F.avg("silhouette").alias("mean"))
    return rounded(out, "mean", digits=5)


@query("silhouette_sample", SILHOUETTE + " SELECT sample_id, count(*) AS points, round(avg(silhouette), 5) + 0.0 AS mean FROM z GROUP BY 1", "px")
def silhouette_sample(spark, sf_dir):
    out = M.silhouette(_points(spark, sf_dir)).groupBy("sample_id").agg(F.count(F.lit(1)).alias("points"), F.avg("silhouette").alias("mean"))
    return rounded(out, "mean", digits=5)


@query("map_violations", "SELECT sample_id, pixel_row, pixel_col, label, 'label_out_of_range' AS rule FROM m1 WHERE label > 4", "m1")
def map_violations(spark, sf_dir):
    return M.violations(V.one_map(spark, sf_dir), 4)


@query("iou_matrix", "WITH c AS (SELECT l1, l2, count(*) AS n FROM maps GROUP BY ALL) SELECT l1, l2, n, round(n::DOUBLE / (sum(n) OVER (PARTITION BY l1) + sum(n) OVER (PARTITION BY l2) - n), 6) AS iou FROM c", "maps")
def iou_matrix(spark, sf_dir):
    return rounded(models.overlap_ratio(M.contingency(V.maps(spark, sf_dir))), "iou")


@query(
    "hungarian_overlap",
    """WITH RECURSIVE c AS (SELECT l1, l2, count(*) AS n FROM maps GROUP BY ALL), k AS (SELECT unnest(range(1, 6)) AS k),
f AS (SELECT a.k AS i, b.k AS j, coalesce(n, 0) AS n FROM k a CROSS JOIN k b LEFT JOIN c ON c.l1 = a.k AND c.l2 = b.k),
p AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS path, 0::BIGINT AS total UNION ALL SELECT f.i, list_append(path, f.j), total + f.n FROM p JOIN f ON f.i = p.i + 1 AND NOT list_contains(path, f.j)),
b AS (SELECT path FROM p WHERE i = 5 ORDER BY total DESC, path LIMIT 1)
SELECT i AS l1, j AS l2, n AS overlap FROM b, f WHERE path[i] = j""".replace("WITH RECURSIVE", "WITH", 1),
    "maps",
)
def hungarian_overlap(spark, sf_dir):
    return models.matched_labels(M.contingency(V.maps(spark, sf_dir)), 5)


ORACLE_SQL["hungarian_overlap"] = ORACLE_SQL["hungarian_overlap"].replace("WITH ", "WITH RECURSIVE ", 1)

# ---- spectra ---------------------------------------------------------------


def _x(spark, sf_dir):
    return V.pixels(spark, sf_dir)


def _long(df: DataFrame, value: str, digits: int = 6) -> DataFrame:
    """Arrays as rows, for comparison."""
    out = df.select("vec_id", F.posexplode(value).alias("band", "value"))
    return rounded(out.withColumn("band", F.col("band").cast("long")), "value", digits=digits)


LONG = " SELECT vec_id, unnest(range(0, len(y)))::BIGINT AS band, round(unnest(y), {d}) + 0.0 AS value FROM s"
MEAN_SD = "list_avg(x) AS m, sqrt(list_sum(list_transform(x, lambda v: (v - list_avg(x)) * (v - list_avg(x)))) / (len(x) - 1)) AS sd"


@query("snv", f"WITH q AS (SELECT vec_id, x, {MEAN_SD} FROM px), s AS (SELECT vec_id, list_transform(x, lambda v: (v - m) / sd) AS y FROM q)" + LONG.format(d=6), "px")
def snv(spark, sf_dir):
    return _long(_x(spark, sf_dir).select("vec_id", S.snv(F.col("x")).alias("y")), "y")


@query("snv_invariants", "SELECT vec_id, 0.0::DOUBLE AS mean, 63.0::DOUBLE AS norm_squared FROM px", "px")
def snv_invariants(spark, sf_dir):
    rows = _x(spark, sf_dir).select("vec_id", S.snv(F.col("x")).alias("y"))
    return rounded(rows.select("vec_id", S.mean(F.col("y")).alias("mean"), S.dot(F.col("y"), F.col("y")).alias("norm_squared")), "mean", "norm_squared")


@query("l2norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) AS norm, len(x)::BIGINT AS finite_bands FROM px", "px")
def l2norm(spark, sf_dir):
    return rounded(_x(spark, sf_dir).select("vec_id", S.l2_norm(F.col("x")).alias("norm"), S.finite_count(F.col("x")).cast("long").alias("finite_bands")), "norm")


@query("intensity_sum", "SELECT vec_id, round(list_sum(x), 6) + 0.0 AS total FROM px", "px")
def intensity_sum(spark, sf_dir):
    return rounded(_x(spark, sf_dir).select("vec_id", S.total(F.col("x")).alias("total")), "total")


@query(
    "calibrate",
    """WITH r AS (SELECT band, avg(white) AS white, avg(dark) AS dark FROM refs WHERE band % 3 > 0 GROUP BY 1 UNION ALL SELECT band, max(dark), max(white) FROM refs WHERE band % 3 = 0 GROUP BY 1)
SELECT band, count(*) AS pixels, count(v) AS valid, round(avg(v), 4) + 0.0 AS mean FROM (SELECT band, CASE WHEN white - dark > 0 THEN (l_extendedprice - dark) / (white - dark) END AS v FROM lineitem JOIN r ON l_partkey % 32 = band) GROUP BY 1""",
    "refs",
)
def calibrate(spark, sf_dir):
    refs = V.references(spark, sf_dir).groupBy("band").agg(*(f(c).alias(f"{n}_{c}") for n, f in (("avg", F.avg), ("max", F.max)) for c in ("white", "dark")))
    odd = F.col("band") % 3 > 0
    refs = refs.select("band", F.when(odd, F.col("avg_white")).otherwise(F.col("max_dark")).alias("white"), F.when(odd, F.col("avg_dark")).otherwise(F.col("max_white")).alias("dark"))
    rows = V.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 32).alias("band"), "l_extendedprice")
    value = S.calibrated(F.col("l_extendedprice"), F.col("white"), F.col("dark"))
    out = rows.join(F.broadcast(refs), "band").groupBy("band").agg(F.count(F.lit(1)).alias("pixels"), F.count(value).alias("valid"), F.avg(value).alias("mean"))  # 32 reference rows
    return rounded(out, "mean", digits=4)


@query(
    "regrid",
    "WITH g AS (SELECT k, least(floor(k * 63.0 / 95.0 + 1e-12)::BIGINT, 62) AS l, k * 63.0::DOUBLE / 95.0 AS t FROM (SELECT unnest(range(0, 96)) AS k)) "
    "SELECT vec_id, k AS band, round(x[l + 1] * (1 - (t - l)) + x[l + 2] * (t - l), 6) + 0.0 AS value FROM px, g",
    "px",
)
def regrid(spark, sf_dir):
    return _long(_x(spark, sf_dir).select("vec_id", S.regridded(F.col("x"), 64, 96).alias("y")), "y")


@query(
    "exclusion_reason",
    """WITH y AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(x, lambda v: 0.5::DOUBLE) WHEN vec_id % 5 = 0 THEN list_transform(x, lambda v: CASE WHEN v > 0.2 THEN 'inf'::DOUBLE ELSE v + 1 END) ELSE list_transform(x, lambda v: v + 0.3) END AS x FROM px)
SELECT vec_id, CASE WHEN len(list_filter(x, lambda v: isinf(v))) > 0 THEN 1 WHEN list_max(x) = list_min(x) THEN 2 WHEN list_min(x) < 0 THEN 3 ELSE 0 END AS reason FROM y""",
    "px",
)
def exclusion_reason(spark, sf_dir):
    x = F.col("x")
    flat, wild, moved = F.transform(x, lambda v: F.lit(0.5)), F.transform(x, lambda v: F.when(v > 0.2, F.lit(float("inf"))).otherwise(v + 1)), F.transform(x, lambda v: v + 0.3)
    rows = _x(spark, sf_dir).withColumn("x", F.when(F.col("vec_id") % 7 == 0, flat).when(F.col("vec_id") % 5 == 0, wild).otherwise(moved))
    return rows.select("vec_id", S.exclusion_reason(x).alias("reason"))


ROUGH = """WITH d AS (SELECT vec_id, sample_id, x, list_transform(range(1, 64), lambda i: x[i + 1] - x[i]) AS d FROM px),
r AS (SELECT vec_id, sample_id, sqrt(list_avg(list_transform(d, lambda v: v * v))) AS rms, list_max(list_transform(range(1, 63), lambda i: abs(d[i + 1] - d[i]))) AS curve FROM d)"""


def _rough(spark, sf_dir):
    d = S.differences(F.col("x"))
    return _x(spark, sf_dir).select("vec_id", "sample_id", S.rms(d).alias("rms"), S.largest(S.differences(d)).alias("curve"))


@query("spectral_roughness", ROUGH + " SELECT vec_id, sample_id, round(rms, 6) AS rms, round(curve, 6) AS curve FROM r", "px")
def spectral_roughness(spark, sf_dir):
    return rounded(_rough(spark, sf_dir), "rms", "curve")


@query("topk_per_sample", ROUGH + " SELECT sample_id, vec_id, rank, round(rms, 6) AS rms FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY rms DESC, vec_id)::INT AS rank FROM r) WHERE rank <= 20", "px")
def topk_per_sample(spark, sf_dir):
    return rounded(quality.top_per_group(_rough(spark, sf_dir), ["sample_id"], "rms", 20, ["vec_id"]).select("sample_id", "vec_id", "rank", "rms"), "rms")


@query("topk_global_unnest", ROUGH + ", t AS (SELECT vec_id, row_number() OVER (ORDER BY curve DESC, vec_id)::INT AS rank FROM r QUALIFY rank <= 20) SELECT rank, vec_id, unnest(range(0, 64))::BIGINT AS band, round(unnest(x), 6) + 0.0 AS value FROM t JOIN px USING (vec_id)", "px")
def topk_global_unnest(spark, sf_dir):
    best = quality.top(_rough(spark, sf_dir), "curve", 20, ["vec_id"]).select("vec_id", "rank")
    rows = _x(spark, sf_dir).join(F.broadcast(best), "vec_id").select("rank", "vec_id", F.posexplode("x").alias("band", "value"))  # 20 rows
    return rounded(rows.withColumn("band", F.col("band").cast("long")), "value")


@query(
    "sg_second_derivative",
    """WITH s AS (SELECT vec_id, list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 7), lambda k: ([5, 0, -3, -4, -3, 0, 5])[k + 1] * x[least(greatest(i - 3, 0), 57) + k + 1])) / (42.0 * 400.0)) AS y FROM px)"""
    + LONG.format(d=8),
    "px",
)
def sg_second_derivative(spark, sf_dir):
    return _long(_x(spark, sf_dir).select("vec_id", S.second_derivative(F.col("x"), 64, 20.0).alias("y")), "y", digits=8)


@query("pseudo_absorbance", "WITH s AS (SELECT vec_id, list_transform(x, lambda v: -log10(v + 0.35)) AS y FROM px WHERE list_min(x) + 0.35 > 0)" + LONG.format(d=6), "px")
def pseudo_absorbance(spark, sf_dir):
    y = S.pseudo_absorbance(F.transform("x", lambda v: v + 0.35))
    return _long(_x(spark, sf_dir).select("vec_id", y.alias("y")), "y")


DELTA = "((('0x' || substr(sha256('shift|' || vec_id || '|1'), 1, 8))::BIGINT::DOUBLE / 4294967296.0) * 2 - 1) * 2.0"
SHIFTED = f"""h AS (SELECT vec_id, x, {DELTA} AS d FROM px), z AS (SELECT vec_id, x, list_transform(range(0, 64), lambda j: least(greatest(j - d, 0.0), 63.0)) AS z FROM h),
w AS (SELECT vec_id, x, list_transform(z, lambda p: x[least(floor(p)::BIGINT, 62) + 1] * (1 - (p - least(floor(p)::BIGINT, 62))) + x[least(floor(p)::BIGINT, 62) + 2] * (p - least(floor(p)::BIGINT, 62))) AS w FROM z),
c AS (SELECT vec_id, x, list_transform(w, lambda v: v - list_avg(w)) AS c FROM w),
s AS (SELECT vec_id, list_transform(c, lambda v: v / sqrt(list_sum(list_transform(c, lambda u: u * u))) * sqrt(list_sum(list_transform(x, lambda u: u * u)))) AS y FROM c)"""


@query("fractional_shift", "WITH " + SHIFTED + LONG.format(d=6), "px")
def fractional_shift(spark, sf_dir):
    return _long(perturbation.shift_draws(_x(spark, sf_dir), "vec_id", 1, 2.0), "x")


@query(
    "tgn_rotate",
    """WITH o AS (SELECT vec_id, x, coalesce(lead(x) OVER (PARTITION BY sample_id ORDER BY vec_id), first(x) OVER (PARTITION BY sample_id ORDER BY vec_id)) AS e FROM px),
n AS (SELECT vec_id, sqrt(list_dot_product(x, x)) AS r, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS n, list_transform(e, lambda v: v - list_avg(e)) AS e FROM o),
q AS (SELECT vec_id, r, n, list_transform(range(1, 65), lambda i: e[i] - list_dot_product(e, n) * n[i]) AS q FROM n),
s AS (SELECT vec_id, list_transform(range(1, 65), lambda i: r * (cos(0.05) * n[i] + sin(0.05) * q[i] / sqrt(list_dot_product(q, q)))) AS y FROM q WHERE sqrt(list_dot_product(q, q)) > 1e-8)"""
    + LONG.format(d=6),
    "px",
)
def tgn_rotate(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("sample_id").orderBy("vec_id")
    rows = _x(spark, sf_dir).withColumn("e", F.coalesce(F.lead("x").over(w), F.first("x").over(w)))
    return _long(rows.select("vec_id", S.rotated(F.col("x"), F.col("e"), F.lit(0.05)).alias("y")), "y")


CENTERS = "m AS (SELECT cls, band, avg(v) AS v FROM (SELECT cls, unnest(range(0, 64)) AS band, unnest(x) AS v FROM px) GROUP BY ALL), kk AS (SELECT cls AS kc, list(v ORDER BY band) AS c FROM m GROUP BY 1)"


def _centers(spark, sf_dir):
    return models.vector_means(_x(spark, sf_dir), ["cls"]).withColumnRenamed("cls", "cluster")


@query("assign_fixed_centers", f"WITH {CENTERS} SELECT vec_id, arg_max(kc, (list_cosine_similarity(x, c), -kc)) AS label FROM px, kk GROUP BY 1", "px")
def assign_fixed_centers(spark, sf_dir):
    return models.assigned(_x(spark, sf_dir), _centers(spark, sf_dir)).select("vec_id", "label")


@query(
    "lfr_shift",
    f"WITH {CENTERS}, {SHIFTED}, a AS (SELECT vec_id, arg_max(kc, (list_cosine_similarity(x, c), -kc)) AS l FROM px, kk GROUP BY 1), b AS (SELECT vec_id, arg_max(kc, (list_cosine_similarity(y, kk.c), -kc)) AS l FROM s, kk GROUP BY 1) "
    "SELECT vec_id // 100 AS sample_id, 1::BIGINT AS draws, round(avg((a.l <> b.l)::INT), 6) AS flip_rate FROM a JOIN b USING (vec_id) GROUP BY 1",
    "px",
)
def lfr_shift(spark, sf_dir):
    rows = _x(spark, sf_dir).select("vec_id", "sample_id", "x")
    counts = perturbation.flip_counts(rows, lambda x: perturbation.shift_draws(x, "vec_id", 1, 2.0), _centers(spark, sf_dir))
    return rounded(perturbation.flip_rates(counts, 1), "flip_rate")


DRAWN = f"""WITH {CENTERS}, h0 AS (SELECT vec_id, sample_id, x, kind, draw, sqrt(list_dot_product(x, x)) AS r,
  radians(('0x' || substr(sha256('angle|' || vec_id || '|' || draw), 1, 8))::BIGINT::DOUBLE / 4294967296.0 * 2.5 + 0.5) AS theta,
  ((('0x' || substr(sha256('shift|' || vec_id || '|' || draw), 1, 8))::BIGINT::DOUBLE / 4294967296.0) * 2 - 1) * 2.0 AS d,
  list_transform(range(0, 64), lambda b: sqrt(-2 * ln((('0x' || substr(sha256('noise|' || vec_id || '|' || draw || '|' || b), 1, 8))::BIGINT::DOUBLE + 1) / 4294967297.0))
    * cos(2 * pi() * ('0x' || substr(sha256('noise|' || vec_id || '|' || draw || '|' || b), 9, 8))::BIGINT::DOUBLE / 4294967296.0)) AS e
  FROM px, (VALUES ('noise'), ('shift'), ('both')) k(kind), range(1, 6) t(draw)),
h1 AS (SELECT *, list_transform(x, lambda v: v / r) AS n, list_transform(e, lambda v: v - list_avg(e)) AS o FROM h0),
h2 AS (SELECT *, list_transform(range(1, 65), lambda i: o[i] - list_dot_product(o, n) * n[i]) AS q FROM h1),
h3 AS (SELECT vec_id, sample_id, kind, draw, d, r, CASE WHEN kind = 'shift' THEN x ELSE list_transform(range(1, 65), lambda i: r * (cos(theta) * n[i] + sin(theta) * q[i] / sqrt(list_dot_product(q, q)))) END AS x FROM h2),
h4 AS (SELECT *, list_transform(range(0, 64), lambda j: least(greatest(j - d, 0.0), 63.0)) AS z FROM h3),
h5 AS (SELECT *, list_transform(z, lambda p: x[least(floor(p)::BIGINT, 62) + 1] * (1 - (p - least(floor(p)::BIGINT, 62))) + x[least(floor(p)::BIGINT, 62) + 2] * (p - least(floor(p)::BIGINT, 62))) AS w FROM h4),
h6 AS (SELECT *, list_transform(w, lambda v: v - list_avg(w)) AS c FROM h5),
s AS (SELECT vec_id, sample_id, kind, draw, CASE WHEN kind = 'noise' THEN x ELSE list_transform(c, lambda v: v / sqrt(list_dot_product(c, c)) * r) END AS y FROM h6)
"""


@query(
    "lfr_by_draw",
    DRAWN
    + """, a AS (SELECT vec_id, arg_max(kc, (list_cosine_similarity(x, c), -kc)) AS l FROM px, kk GROUP BY 1),
b AS (SELECT vec_id, sample_id, draw, arg_max(kc, (list_cosine_similarity(y, c), -kc)) AS l FROM s, kk WHERE kind = 'shift' GROUP BY ALL)
SELECT sample_id, draw, count(*) AS pixels, count(*) FILTER (a.l <> b.l) AS flips FROM a JOIN b USING (vec_id) GROUP BY ALL""",
    "px",
)
def lfr_by_draw(spark, sf_dir):
    rows = _x(spark, sf_dir).select("vec_id", "sample_id", "x")
    return perturbation.flip_counts(rows, lambda x: perturbation.shift_draws(x, "vec_id", 5, 2.0), _centers(spark, sf_dir))


@query(
    "lfr_kinds",
    DRAWN
    + """, a AS (SELECT vec_id, arg_max(kc, (list_cosine_similarity(x, c), -kc)) AS l FROM px, kk GROUP BY 1),
b AS (SELECT vec_id, sample_id, kind, draw, arg_max(kc, (list_cosine_similarity(y, c), -kc)) AS l FROM s, kk GROUP BY ALL)
SELECT sample_id, kind, draw, count(*) AS pixels, count(*) FILTER (a.l <> b.l) AS flips FROM a JOIN b USING (vec_id) GROUP BY ALL""",
    "px",
)
def lfr_kinds(spark, sf_dir):
    rows = _x(spark, sf_dir).select("vec_id", "sample_id", "x")
    return perturbation.flip_counts(rows, lambda x: perturbation.perturbed(x, "vec_id"), _centers(spark, sf_dir), by=("sample_id", "kind", "draw"))


@query("assign_each_k", f"WITH {CENTERS} SELECT vec_id, k, arg_max(kc, (list_cosine_similarity(x, c), -kc)) AS label FROM px, kk, range(2, 9) t(k) WHERE kc <= k GROUP BY ALL", "px")
def assign_each_k(spark, sf_dir):
    """With the first k of the centres, for every k."""
    k = F.explode(F.sequence(F.greatest(F.lit(2).cast("long"), F.col("cluster")), F.lit(8).cast("long")))
    return models.assigned_each(_x(spark, sf_dir), _centers(spark, sf_dir).where("cluster <= 8").withColumn("k", k)).select("vec_id", "k", "label")


@query("label_accuracy", "SELECT sample_id, count(*) AS rows, round(100 * avg((l1 = l2)::INT), 6) + 0.0 AS accuracy FROM maps GROUP BY 1", "maps")
def label_accuracy(spark, sf_dir):
    return rounded(agreement.accuracy(V.maps(spark, sf_dir), "l1", "l2", ("sample_id",)), "accuracy")


@query(
    "cluster_agreement",
    """WITH c AS (SELECT l1, l2, count(*)::DOUBLE AS n FROM maps GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c),
f AS (SELECT a AS l1, b AS l2, coalesce(n, 0) AS n FROM range(1, 6) x(a), range(1, 6) y(b) LEFT JOIN c ON l1 = a AND l2 = b),
m AS (SELECT max(p.n + q.n + r.n + s.n + u.n) AS m FROM f p, f q, f r, f s, f u WHERE p.l1 = 1 AND q.l1 = 2 AND r.l1 = 3 AND s.l1 = 4 AND u.l1 = 5
  AND p.l2 NOT IN (q.l2, r.l2, s.l2, u.l2) AND q.l2 NOT IN (r.l2, s.l2, u.l2) AND r.l2 NOT IN (s.l2, u.l2) AND s.l2 <> u.l2),
a AS (SELECT l1, sum(n) AS a FROM c GROUP BY 1), b AS (SELECT l2, sum(n) AS b FROM c GROUP BY 1),
i AS (SELECT sum(n / t * ln(n * t / (a * b))) AS i FROM c JOIN a USING (l1) JOIN b USING (l2), t),
h AS (SELECT (SELECT -sum(a / t * ln(a / t)) FROM a, t) AS ha, (SELECT -sum(b / t * ln(b / t)) FROM b, t) AS hb),
k AS (SELECT a, b, t, unnest(range(greatest(1, a + b - t)::BIGINT, least(a, b)::BIGINT + 1))::DOUBLE AS k FROM a, b, t),
e AS (SELECT sum(k / t * ln(t * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1)
  - lgamma(t - a - b + k + 1))) AS e FROM k)
SELECT t::BIGINT AS rows, round(100 * m / t, 6) AS acc, round(100 * i / ((ha + hb) / 2), 6) AS nmi, round(100 * (i - e) / (greatest(ha, hb) - e), 6) + 0.0 AS ami FROM t, m, i, h, e""",
    "maps",
)
def cluster_agreement(spark, sf_dir):
    return rounded(agreement.cluster_agreement(M.contingency(V.maps(spark, sf_dir)), 5), "acc", "nmi", "ami")


@query("parts_without_large_lines", "SELECT p_partkey, p_size FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def parts_without_large_lines(spark, sf_dir):
    large = V.table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return relations.complement(V.table(spark, sf_dir, "part").select("p_partkey", "p_size"), large, ["p_partkey"])


@query("orders_by_nation", "SELECT n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def orders_by_nation(spark, sf_dir):
    """Look-ups that must match: an order without its customer would end the job."""
    orders = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    customers = relations.looked_up(orders, V.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), ["c_custkey"])
    return relations.looked_up(customers, V.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]).groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "partition_rules",
    """WITH p AS (SELECT DISTINCT l_returnflag AS part, l_orderkey AS k FROM lineitem WHERE l_returnflag IN ('A', 'R')), n AS (SELECT k, count(*) AS n FROM p GROUP BY 1)
SELECT 'overlap' AS rule, count(*) AS n FROM n WHERE n > 1 UNION ALL SELECT 'missing', count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT k FROM n)
UNION ALL SELECT 'unknown', count(*) FROM n WHERE k NOT IN (SELECT o_orderkey FROM orders)""",
)
def partition_rules(spark, sf_dir):
    parts = V.table(spark, sf_dir, "lineitem").where("l_returnflag IN ('A', 'R')").select(F.col("l_returnflag").alias("part"), F.col("l_orderkey").alias("k"))
    return relations.partition_violations(parts, V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "part", "k")


@query("cosine_kmeans")
def cosine_kmeans(spark, sf_dir):
    rows = _x(spark, sf_dir)
    return models.assigned(rows, models.cosine_kmeans(rows, 8, "vec_id")).select("vec_id", "label")


@query("pca_project")
def pca_project(spark, sf_dir):
    rows = _x(spark, sf_dir)
    return models.projected(rows, *models.pca(rows, 4)).select("vec_id", "pc")


@query("cluster_band_means", "WITH e AS (SELECT sample_id, label, unnest(range(0, 64))::BIGINT AS band, unnest(x) AS v FROM px JOIN (SELECT sample_id, pixel_row, pixel_col, label FROM lab WHERE repeat = 1) USING (sample_id, pixel_row, pixel_col)) SELECT sample_id, label, band, round(avg(v), 6) + 0.0 AS mean, count(*) AS pixels FROM e GROUP BY ALL", "px", "lab")
def cluster_band_means(spark, sf_dir):
    rows = _x(spark, sf_dir).select("sample_id", V.repeat_label(1).alias("label"), F.posexplode("x").alias("band", "v"))
    out = rows.groupBy("sample_id", "label", F.col("band").cast("long").alias("band")).agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("pixels"))
    return rounded(out, "mean")


SAMPLE_MEANS = "WITH e AS (SELECT sample_id, cls, unnest(range(0, 64))::BIGINT AS band, unnest(x) AS v FROM px), m AS (SELECT sample_id, cls, band, avg(v) AS v FROM e GROUP BY ALL)"


@query("equal_sample_summary", SAMPLE_MEANS + " SELECT cls, band, round(avg(v), 6) + 0.0 AS mean, round(quantile_cont(v, 0.25), 6) + 0.0 AS q25, round(quantile_cont(v, 0.75), 6) + 0.0 AS q75, count(*) AS sample_count FROM m GROUP BY ALL", "px")
def equal_sample_summary(spark, sf_dir):
    means = models.vector_means(_x(spark, sf_dir), ["sample_id", "cls"])
    return rounded(models.equal_sample_summary(means, ["cls"]), "mean", "q25", "q75")


@query("difference_spectra", SAMPLE_MEANS + ", s AS (SELECT cls, band, avg(v) AS v FROM m GROUP BY ALL) SELECT a.cls AS cls_a, b.cls AS cls_b, a.band, round(b.v - a.v, 6) + 0.0 AS difference FROM s a JOIN s b ON a.band = b.band AND b.cls = a.cls + 1", "px")
def difference_spectra(spark, sf_dir):
    s = models.equal_sample_summary(models.vector_means(_x(spark, sf_dir), ["sample_id", "cls"]), ["cls"]).select("cls", "band", "mean")
    a, b = s.toDF("cls_a", "band", "a"), s.toDF("cls_b", "band", "b").withColumn("cls_a", F.col("cls_b") - 1)
    return rounded(a.join(b, ["cls_a", "band"]).select("cls_a", "cls_b", "band", (F.col("b") - F.col("a")).alias("difference")), "difference")


# ---- quality ---------------------------------------------------------------

QUALITY = """q AS (SELECT band, avg(white - dark) AS m, stddev_pop(white - dark) AS s, min(white - dark) AS lo, quantile_cont(white - dark, 0.01) AS q01, quantile_cont(white - dark, 0.05) AS q05,
  avg((white - dark <= 0)::INT) AS np, avg((white - dark <= 1)::INT) AS bf, max(white) AS wm, max(dark) AS dm FROM refs GROUP BY 1)"""


@query("band_quality", f"WITH {QUALITY} SELECT band, round(m, 4) AS denominator_mean, round(s, 4) AS denominator_std, round(lo, 4) AS denominator_min, round(np, 6) AS nonpositive_fraction, round(bf, 6) AS below_floor_fraction, wm AS white_max, dm AS dark_max, round(q01, 4) AS denominator_q01, round(q05, 4) AS denominator_q05, round(m / (s + 1e-12), 4) AS snr_proxy, m / (s + 1e-12) <= 10 AS low_snr FROM q", "refs")
def band_quality(spark, sf_dir):
    four = ("denominator_mean", "denominator_std", "denominator_min", "denominator_q01", "denominator_q05", "snr_proxy")
    return rounded(rounded(quality.reference_quality(V.references(spark, sf_dir)), *four, digits=4), "nonpositive_fraction", "below_floor_fraction")


@query("snr_cutoff", f"WITH {QUALITY}, l AS (SELECT band, m / (s + 1e-12) <= 3.2 AS low FROM q), g AS (SELECT max(band) FILTER (NOT low) AS last FROM l) SELECT band, low AS low_snr, band <= last AS retained, low AND band < last AS interior_low FROM l, g", "refs")
def snr_cutoff(spark, sf_dir):
    q = quality.reference_quality(V.references(spark, sf_dir), snr_limit=3.2).select("band", "low_snr")
    return quality.terminal_cutoff(q)


STATS = """b AS (SELECT sample_id, band, count(*) AS pixels, count(*) AS finite_count, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q,
  avg((value < 0)::INT) AS negative_fraction, avg((value > 1)::INT) AS above_one_fraction FROM bands GROUP BY ALL)"""
STAT_NAMES = ("mean", "std", "min", "max", "q01", "q05", "q25", "median", "q75", "q95", "q99", "negative_fraction", "above_one_fraction", "nonfinite_fraction")


@query(
    "band_stats",
    f"WITH {STATS} SELECT sample_id, band, pixels, finite_count, "
    + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("mean", "std", "min", "max", "negative_fraction", "above_one_fraction"))
    + ", "
    + ", ".join(f"round(q[{i + 1}], 6) + 0.0 AS {n}" for i, n in enumerate(("q01", "q05", "q25", "median", "q75", "q95", "q99")))
    + ", 0.0::DOUBLE AS nonfinite_fraction FROM b",
    "bands",
)
def band_stats(spark, sf_dir):
    return rounded(quality.band_statistics(V.bands(spark, sf_dir)), *STAT_NAMES)


@query(
    "band_summary",
    f"""WITH {STATS} SELECT band, count(*) AS sample_count, round(quantile_cont(negative_fraction, 0.5), 6) AS median_negative_fraction, round(quantile_cont(negative_fraction, 0.9), 6) AS q90_negative_fraction, round(max(negative_fraction), 6) AS max_negative_fraction,
round(quantile_cont(q[1], 0.5), 6) + 0.0 AS median_sample_q01, round(quantile_cont(q[4], 0.5), 6) + 0.0 AS median_sample_median, round(quantile_cont(q[7], 0.5), 6) + 0.0 AS median_sample_q99, round(quantile_cont(q[4], 0.1), 6) + 0.0 AS q10_sample_median, round(quantile_cont(q[4], 0.9), 6) + 0.0 AS q90_sample_median FROM b GROUP BY 1""",
    "bands",
)
def band_summary(spark, sf_dir):
    out = quality.band_summary(quality.band_statistics(V.bands(spark, sf_dir)))
    return rounded(out, *(c for c in out.columns if c not in ("band", "sample_count")))


@query("robust_limits", "WITH l AS (SELECT band, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM bands GROUP BY 1) SELECT band, round(a, 6) + 0.0 AS low, round(CASE WHEN b > a THEN b ELSE a + 1 END, 6) + 0.0 AS high FROM l", "bands")
def robust_limits(spark, sf_dir):
    return rounded(quality.robust_limits(V.bands(spark, sf_dir), "band"), "low", "high")


@query("feasibility", "SELECT sample_id, count(*) AS pixels, round(100.0::DOUBLE * 2000 / count(*), 6) AS requested_percent, greatest(2000 - count(*), 0)::BIGINT AS shortfall, CASE WHEN count(*) >= 2000 THEN 'OK' ELSE 'INSUFFICIENT' END AS status FROM m1 GROUP BY 1", "m1")
def feasibility(spark, sf_dir):
    counts = V.one_map(spark, sf_dir).groupBy("sample_id").agg(F.count(F.lit(1)).alias("pixels"))
    return rounded(quality.feasibility(counts, 2000), "requested_percent")


@query("quantile_summary", "SELECT band, round(avg(value), 6) + 0.0 AS mean, round(quantile_cont(value, 0.05), 6) + 0.0 AS q05, round(quantile_cont(value, 0.5), 6) + 0.0 AS median, round(quantile_cont(value, 0.95), 6) + 0.0 AS q95, round(max(value), 6) + 0.0 AS max FROM bands GROUP BY 1", "bands")
def quantile_summary(spark, sf_dir):
    return rounded(quality.quantile_summary(V.bands(spark, sf_dir), "band", "value"), "mean", "q05", "median", "q95", "max")


# ---- plans and samples -----------------------------------------------------

SAMPLES = "u AS (SELECT DISTINCT sample_id FROM maps)"
FOLDS = f"{SAMPLES}, f AS (SELECT sample_id, ntile(3) OVER (ORDER BY sha256('7|' || sample_id), sample_id)::BIGINT AS test_fold FROM u)"


def _folds(spark, sf_dir):
    return sampling.balanced_folds(V.maps(spark, sf_dir).select("sample_id").distinct(), 3, 7)


@query("kfold_assign", f"WITH {FOLDS} SELECT sample_id, test_fold FROM f", "maps")
def kfold_assign(spark, sf_dir):
    return _folds(spark, sf_dir)


ROWS = "w AS (SELECT sample_id, pixel_row * 64 + pixel_col AS hdf5_row FROM maps)"
CHOSEN = f"{ROWS}, c AS (SELECT sample_id, hdf5_row FROM w QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY sha256('11|' || sample_id || '|' || hdf5_row), hdf5_row) <= 200)"


def _chosen(spark, sf_dir):
    rows = V.maps(spark, sf_dir).select("sample_id", (F.col("pixel_row") * 64 + F.col("pixel_col")).alias("hdf5_row"))
    return sampling.sample_rows(rows, ["sample_id"], "hdf5_row", 200, 11)


@query("sample_q", f"WITH {CHOSEN} SELECT sample_id, hdf5_row FROM c", "maps")
def sample_q(spark, sf_dir):
    return _chosen(spark, sf_dir)


@query(
    "manifest_violations",
    f"WITH {FOLDS}, {CHOSEN}, t AS (SELECT (sample_id % 3 + 1)::BIGINT AS fold, sample_id, hdf5_row FROM c) "
    "SELECT 'leakage' AS rule, count(*) AS n FROM t JOIN f ON f.sample_id = t.sample_id AND f.test_fold = t.fold UNION ALL SELECT 'wrong_count', count(*) FROM (SELECT fold, sample_id FROM t GROUP BY ALL HAVING count(*) <> 200) "
    "UNION ALL SELECT 'duplicate_row', 0 UNION ALL SELECT 'unknown_sample', 0 UNION ALL SELECT 'unbalanced_folds', 0",
    "maps",
)
def manifest_violations(spark, sf_dir):
    """A plan with leaks: samples train in a fold of their own choice."""
    chosen = _chosen(spark, sf_dir).withColumn("fold", F.col("sample_id") % 3 + 1)
    return sampling.selection_violations(chosen, _folds(spark, sf_dir), 200)


@query(
    "stratified_split",
    """WITH o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('42|' || vec_id), vec_id) AS p, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id, label, CASE WHEN p <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN p <= floor(n * 0.8::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM o""",
)
def stratified_split(spark, sf_dir):
    rows = V.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return sampling.stratified_split(rows, "label", "vec_id", [("train", 0.6), ("validation", 0.2), ("test", 0.2)], 42)


@query(
    "sample_seeds",
    """SELECT sample_id, ('0x' || substr(sha256('["huegrid",20260905,"rows",' || sample_id || ']'), 1, 8))::BIGINT AS seed FROM (SELECT DISTINCT sample_id FROM maps)""",
    "maps",
)
def sample_seeds(spark, sf_dir):
    samples = V.maps(spark, sf_dir).select("sample_id").distinct()
    return samples.select("sample_id", sampling.purpose_seed("huegrid", 20260905, "rows", F.col("sample_id")).alias("seed"))


# ---- summaries -------------------------------------------------------------


@query("score_availability", "SELECT condition, repeat, count(*) AS total, count(value) AS defined, coalesce(string_agg(sample_id::VARCHAR, ';' ORDER BY sample_id) FILTER (value IS NULL), '') AS unavailable FROM scores GROUP BY ALL", "scores")
def score_availability(spark, sf_dir):
    return summaries.availability(V.scores(spark, sf_dir))


@query("score_violations", "SELECT condition, sample_id, 'out_of_range' AS rule FROM scores WHERE value > 0.0505", "scores")
def score_violations(spark, sf_dir):
    return summaries.contract_violations(V.scores(spark, sf_dir), 3, 0.0, 0.0505)


SUMMARY = """g AS (SELECT {by}, sample_id FROM {src} GROUP BY ALL HAVING count(value) = 3), k AS (SELECT {src}.* FROM {src} JOIN g USING ({by}, sample_id)),
s AS (SELECT {by}, count(*) AS common_samples, stddev_samp(m) AS sample_sd FROM (SELECT {by}, sample_id, avg(value) AS m FROM k GROUP BY ALL) GROUP BY ALL),
r AS (SELECT {by}, avg(m) AS mean, stddev_samp(m) AS repeat_sd FROM (SELECT {by}, repeat, avg(value) AS m FROM k GROUP BY ALL) GROUP BY ALL)
SELECT {by}, common_samples, round(sample_sd, 6) AS sample_sd, round(mean, 6) + 0.0 AS mean, round(repeat_sd, 6) AS repeat_sd FROM s JOIN r USING ({by})"""


@query("repeat_summary", "WITH " + SUMMARY.format(by="condition", src="scores"), "scores")
def repeat_summary(spark, sf_dir):
    return rounded(summaries.repeat_summary(V.scores(spark, sf_dir), ["condition"]), "sample_sd", "mean", "repeat_sd")


@query("paired_difference", "WITH d AS (SELECT 'A-N' AS contrast, sample_id, repeat, a.value - n.value AS value FROM (SELECT * FROM scores WHERE condition = 'A') a JOIN (SELECT * FROM scores WHERE condition = 'N') n USING (sample_id, repeat)), " + SUMMARY.format(by="contrast", src="d"), "scores")
def paired_difference(spark, sf_dir):
    return rounded(summaries.paired_difference(V.scores(spark, sf_dir), "A", "N"), "sample_sd", "mean", "repeat_sd")


@query(
    "interaction",
    """WITH h AS (SELECT l_returnflag || l_linestatus AS condition, c_nationkey::BIGINT AS sample_id, (l_linenumber % 3 + 1)::BIGINT AS repeat, avg(l_tax) AS value FROM (SELECT * REPLACE (CASE WHEN l_partkey % 2 = 0 THEN 'O' ELSE 'F' END AS l_linestatus) FROM (SELECT *, '' AS l_linestatus FROM lineitem WHERE l_returnflag IN ('A', 'N')))
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
d AS (SELECT 'interaction' AS contrast, sample_id, repeat, CASE WHEN count(value) = 4 THEN sum(CASE WHEN condition IN ('AO', 'NF') THEN value ELSE -value END) END AS value FROM h GROUP BY ALL), """
    + SUMMARY.format(by="contrast", src="d"),
)
def interaction(spark, sf_dir):
    line, orders, customer = (V.table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    joined = line.where("l_returnflag IN ('A', 'N')").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    condition = F.concat("l_returnflag", F.when(F.col("l_partkey") % 2 == 0, "O").otherwise("F"))
    rows = joined.groupBy(condition.alias("condition"), F.col("c_nationkey").cast("long").alias("sample_id"), (F.col("l_linenumber") % 3 + 1).cast("long").alias("repeat")).agg(F.avg("l_tax").alias("value"))
    return rounded(summaries.interaction(rows, "AO", "AF", "NO", "NF"), "sample_sd", "mean", "repeat_sd")


@query("scores_wide", "SELECT condition, sample_id, " + ", ".join(f"round(max(value) FILTER (repeat = {r}), 6) AS repeat_{r}" for r in (1, 2, 3)) + " FROM scores GROUP BY ALL", "scores")
def scores_wide(spark, sf_dir):
    return rounded(summaries.wide(V.scores(spark, sf_dir), [1, 2, 3]), "repeat_1", "repeat_2", "repeat_3")


@query(
    "seed_stats_ci",
    "WITH p AS (SELECT l_returnflag AS condition, l_linenumber AS seed, avg(l_extendedprice) AS m FROM lineitem WHERE l_linenumber <= 5 GROUP BY ALL) "
    "SELECT condition, count(*) AS seeds, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS sd, round(2.7764451 * stddev_samp(m) / sqrt(count(*)), 4) AS half_width FROM p GROUP BY 1",
)
def seed_stats_ci(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem").where("l_linenumber <= 5").select(F.col("l_returnflag").alias("condition"), F.col("l_linenumber").alias("seed"), "l_extendedprice")
    return rounded(summaries.seed_interval(rows, "condition", "seed", "l_extendedprice", 2.7764451), "mean", "sd", "half_width", digits=4)


@query(
    "occupancy_fold_tables",
    """WITH o AS (SELECT sample_id, sample_id % 5 + 1 AS fold, l1 AS label, count(*) AS n FROM maps GROUP BY ALL), t AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY sample_id) AS f, count(*) OVER () AS x FROM o),
c AS (SELECT fold, count(DISTINCT sample_id) AS samples, sum(n) AS total FROM o GROUP BY 1)
SELECT fold, label, round(sum(n)::DOUBLE / any_value(total), 6) AS pooled_fraction, round(sum(f) / any_value(samples), 6) AS sample_macro_fraction FROM t JOIN c USING (fold) GROUP BY fold, label""",
    "maps",
)
def occupancy_fold_tables(spark, sf_dir):
    o = M.occupancy(V.one_map(spark, sf_dir)).withColumn("fold", F.col("sample_id") % 5 + 1)
    totals = o.groupBy("fold").agg(F.countDistinct("sample_id").alias("samples"), F.sum("pixels").alias("total"))
    rows = o.groupBy("fold", "label").agg(F.sum("pixels").alias("p"), F.sum("fraction").alias("f")).join(totals, "fold")
    out = rows.select("fold", "label", (F.col("p") / F.col("total")).alias("pooled_fraction"), (F.col("f") / F.col("samples")).alias("sample_macro_fraction"))
    return rounded(out, "pooled_fraction", "sample_macro_fraction")


# ---- masks -----------------------------------------------------------------


@query(
    "erode_mask",
    """WITH c AS (SELECT * FROM maps) SELECT sample_id, pixel_row, pixel_col FROM c WHERE
  (pixel_row = 0 OR EXISTS (SELECT 1 FROM c d WHERE d.sample_id = c.sample_id AND d.pixel_row = c.pixel_row - 1 AND d.pixel_col = c.pixel_col)) AND (pixel_row = 63 OR EXISTS (SELECT 1 FROM c d WHERE d.sample_id = c.sample_id AND d.pixel_row = c.pixel_row + 1 AND d.pixel_col = c.pixel_col))
  AND (pixel_col = 0 OR EXISTS (SELECT 1 FROM c d WHERE d.sample_id = c.sample_id AND d.pixel_row = c.pixel_row AND d.pixel_col = c.pixel_col - 1)) AND (pixel_col = 63 OR EXISTS (SELECT 1 FROM c d WHERE d.sample_id = c.sample_id AND d.pixel_row = c.pixel_row AND d.pixel_col = c.pixel_col + 1))""",
    "maps",
)
def erode_mask(spark, sf_dir):
    return masks.eroded(V.maps(spark, sf_dir), 64, 64)


@query(
    "erode_radius2",
    """WITH o AS (SELECT u, w FROM range(-2, 3) a(u), range(-2, 3) b(w) WHERE u * u + w * w <= 4),
k AS (SELECT r AS pixel_row, c AS pixel_col, count(*) AS needed FROM range(64) x(r), range(64) y(c), o WHERE r + u BETWEEN 0 AND 63 AND c + w BETWEEN 0 AND 63 GROUP BY ALL),
n AS (SELECT m.sample_id, m.pixel_row, m.pixel_col, count(*) AS n FROM maps m, o JOIN maps d ON d.sample_id = m.sample_id AND d.pixel_row = m.pixel_row + u AND d.pixel_col = m.pixel_col + w GROUP BY ALL)
SELECT sample_id, pixel_row, pixel_col FROM n JOIN k USING (pixel_row, pixel_col) WHERE n = needed""",
    "maps",
)
def erode_radius2(spark, sf_dir):
    return masks.eroded(V.maps(spark, sf_dir), 64, 64, 2)


@query(
    "components",
    """WITH b AS (SELECT sample_id, pixel_row, pixel_col, pixel_row * 1048576 + pixel_col AS k FROM maps WHERE l1 = 1),
r AS (SELECT sample_id, pixel_row, pixel_col, k AS l FROM b UNION SELECT b.sample_id, b.pixel_row, b.pixel_col, r.l FROM r JOIN b ON b.sample_id = r.sample_id AND abs(b.pixel_row - r.pixel_row) + abs(b.pixel_col - r.pixel_col) = 1),
m AS (SELECT sample_id, pixel_row, pixel_col, min(l) AS component FROM r GROUP BY ALL)
SELECT sample_id, component, count(*) AS area_pixels, min(pixel_row) AS min_row, min(pixel_col) AS min_col, max(pixel_row) + 1 AS max_row, max(pixel_col) + 1 AS max_col,
  min(pixel_row) = 0 OR min(pixel_col) = 0 OR max(pixel_row) = 63 OR max(pixel_col) = 63 AS touches_boundary FROM m GROUP BY sample_id, component""",
    "maps",
)
def components(spark, sf_dir):
    """Of the pixels with label 1."""
    return masks.component_records(masks.components(V.maps(spark, sf_dir).where("l1 = 1")), 64, 64)


ORACLE_SQL["components"] = ORACLE_SQL["components"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("components8", ORACLE_SQL["components"].replace("abs(b.pixel_row - r.pixel_row) + abs(b.pixel_col - r.pixel_col) = 1", "greatest(abs(b.pixel_row - r.pixel_row), abs(b.pixel_col - r.pixel_col)) = 1"))
def components8(spark, sf_dir):
    """Of the pixels with label 1, corners joined."""
    return masks.component_records(masks.components(V.maps(spark, sf_dir).where("l1 = 1"), 8), 64, 64)


@query(
    "multi_otsu",
    """WITH h AS (SELECT o_orderpriority AS sample_id, least(floor(o_totalprice / 8000)::BIGINT, 63) AS bin, count(*)::DOUBLE AS n FROM orders GROUP BY ALL),
p AS (SELECT sample_id, a.k AS low, b.k AS high, sum(n) FILTER (bin <= a.k) AS w0, sum(n * bin) FILTER (bin <= a.k) AS m0, sum(n) FILTER (bin > a.k AND bin <= b.k) AS w1, sum(n * bin) FILTER (bin > a.k AND bin <= b.k) AS m1, sum(n) FILTER (bin > b.k) AS w2, sum(n * bin) FILTER (bin > b.k) AS m2
  FROM h, (SELECT unnest(range(0, 62)) AS k) a, (SELECT unnest(range(0, 63)) AS k) b WHERE a.k < b.k GROUP BY ALL),
v AS (SELECT sample_id, low, high, round(coalesce(m0 * m0 / w0, 0) + coalesce(m1 * m1 / w1, 0) + coalesce(m2 * m2 / w2, 0), 6) AS v FROM p)
SELECT sample_id, low, high FROM v QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY v DESC, low, high) = 1""",
)
def multi_otsu(spark, sf_dir):
    bins = F.least(F.floor(F.col("o_totalprice") / 8000), F.lit(63))
    counts = V.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("sample_id"), bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return masks.otsu_thresholds(counts, 64)


# ---- tables against each other ----------------------------------------------


@query("unmatched_parts", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unmatched_parts(spark, sf_dir):
    used = V.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return V.table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("event_properties", "SELECT event_type, (props->>'$.k')::BIGINT AS k, count(*) AS n, round(avg(value), 8) AS mean FROM events GROUP BY ALL")
def event_properties(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    return rounded(rows.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")), "mean", digits=8)
