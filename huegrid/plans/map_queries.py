"""Queries of nine maps of each sample and of models fitted on one split and scored on another, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from huegrid.operators import agreement, models
from huegrid.operators import reproducibility as R
from huegrid.operators.maps import PIXEL
from huegrid.plans.queries import query, rounded
from huegrid.sources import shared
from huegrid.sources import views as V

MAPS, REPEATS = 9, 3

# ---- nine maps, all pairs, three windows -------------------------------------

PAIRS = """WITH v AS (SELECT sample_id, pixel_row AS r, pixel_col AS c, m, CASE WHEN l1 = 1 AND l2 = m % 5 + 1 THEN 6 ELSE 1 + (pixel_row // (8 + m) + pixel_col // (9 + m)) % 5 END AS l
  FROM maps, range(0, 9) t(m) WHERE NOT (m = 8 AND l2 = 5)),
e AS (SELECT a.sample_id, a.m, a.r + b.r AS i, a.c + b.c AS j, a.l <> b.l AS cut FROM v a JOIN v b ON a.sample_id = b.sample_id AND a.m = b.m AND b.r = a.r AND b.c = a.c + 1
  UNION ALL SELECT a.sample_id, a.m, a.r + b.r, a.c + b.c, a.l <> b.l FROM v a JOIN v b ON a.sample_id = b.sample_id AND a.m = b.m AND b.c = a.c AND b.r = a.r + 1),
n AS (SELECT sample_id, m, count(*) AS edges, count(*) FILTER (cut) AS cuts FROM e GROUP BY ALL),
s AS (SELECT sample_id, i, j, bit_or(1 << m::INT) AS b FROM e WHERE cut GROUP BY ALL),
o AS (SELECT u, w FROM range(-8, 9) a(u), range(-8, 9) b(w) WHERE (u + w) % 2 = 0),
f AS (SELECT s.sample_id, s.i + u AS i, s.j + w AS j, greatest(abs(u), abs(w)) AS d, b FROM s, o),
g AS (SELECT s.sample_id, s.i, s.j, s.b, coalesce(bit_or(f.b) FILTER (d <= 2), 0) AS b3, coalesce(bit_or(f.b) FILTER (d <= 4), 0) AS b5, coalesce(bit_or(f.b) FILTER (d <= 8), 0) AS b9
  FROM s JOIN f USING (sample_id, i, j) GROUP BY ALL),
h AS (SELECT sample_id, x.m AS a, y.m AS z, k.w, count(*) FILTER (b >> x.m::INT & 1 = 1 AND (CASE k.w WHEN 3 THEN b3 WHEN 5 THEN b5 ELSE b9 END) >> y.m::INT & 1 = 1) AS hits
  FROM g, range(0, 9) x(m), range(0, 9) y(m), (VALUES (3), (5), (9)) k(w) WHERE x.m <> y.m GROUP BY ALL),
q AS (SELECT DISTINCT sample_id FROM v), p AS (SELECT sample_id, x.m AS a, y.m AS z, k.w FROM q, range(0, 9) x(m), range(0, 9) y(m), (VALUES (3), (5), (9)) k(w) WHERE x.m <> y.m),
d AS (SELECT p.*, CASE WHEN cuts > 0 THEN coalesce(hits, 0)::DOUBLE / cuts END AS val, CASE WHEN coalesce(edges, 0) = 0 THEN 'no_valid_adjacent_edges' WHEN cuts = 0 THEN 'empty_source_boundary' END AS why
  FROM p LEFT JOIN h USING (sample_id, a, z, w) LEFT JOIN n ON n.sample_id = p.sample_id AND n.m = p.a),
cells AS (SELECT a.sample_id, a.m AS a, b.m AS z, a.l AS l1, b.l AS l2, count(*) AS n FROM v a JOIN v b ON a.sample_id = b.sample_id AND a.r = b.r AND a.c = b.c AND a.m < b.m GROUP BY ALL),
t AS (SELECT sample_id, a, z, sum(n) AS n, sum(n * (n - 1) / 2)::DOUBLE AS c FROM cells GROUP BY ALL),
ta AS (SELECT sample_id, a, z, sum(k * (k - 1) / 2)::DOUBLE AS x FROM (SELECT sample_id, a, z, l1, sum(n) AS k FROM cells GROUP BY ALL) GROUP BY ALL),
tb AS (SELECT sample_id, a, z, sum(k * (k - 1) / 2)::DOUBLE AS y FROM (SELECT sample_id, a, z, l2, sum(n) AS k FROM cells GROUP BY ALL) GROUP BY ALL),
ari AS (SELECT sample_id, a, z, CASE WHEN n < 2 THEN NULL WHEN (x + y) * (n * (n - 1) / 2) - 2 * x * y = 0 THEN 1 ELSE 2 * (c * (n * (n - 1) / 2) - x * y) / ((x + y) * (n * (n - 1) / 2) - 2 * x * y) END AS ari
  FROM t JOIN ta USING (sample_id, a, z) JOIN tb USING (sample_id, a, z)),
records AS (SELECT f.sample_id, f.a::INT AS map_a, f.z::INT AS map_b, f.w::INT AS "window", f.val AS a_to_b, b.val AS b_to_a,
  nullif(array_to_string(list_sort(list_distinct(list_filter([f.why, b.why], lambda y: y IS NOT NULL))), ';'), '') AS reasons,
  CASE WHEN f.val IS NOT NULL AND b.val IS NOT NULL THEN least(f.val, b.val) END AS lower, CASE WHEN f.val IS NOT NULL AND b.val IS NOT NULL THEN greatest(f.val, b.val) END AS upper, ari
  FROM d f JOIN d b ON f.sample_id = b.sample_id AND f.a = b.z AND f.z = b.a AND f.w = b.w AND f.a < f.z LEFT JOIN ari ON ari.sample_id = f.sample_id AND ari.a = f.a AND ari.z = f.z)"""
SHARES = ("a_to_b", "b_to_a", "lower", "upper", "ari")


def _stacks(spark, sf_dir):
    """Nine maps of each sample: patches whose size differs from map to map, with single pixels of another label; the last map has holes."""

    def label(m: int):
        spot = (F.col("l1") == 1) & (F.col("l2") == m % 5 + 1)
        value = F.when(spot, F.lit(6)).otherwise(1 + (F.expr(f"pixel_row div {8 + m}") + F.expr(f"pixel_col div {9 + m}")) % 5).cast("long")
        return F.when(F.col("l2") != 5, value) if m == MAPS - 1 else value

    return V.maps(spark, sf_dir).select(*PIXEL, F.array(*map(label, range(MAPS))).alias("labels"))


def _records(spark, sf_dir):
    return rounded(R.pair_records(_stacks(spark, sf_dir), MAPS), *SHARES)


ROUNDED = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in SHARES)


@query("reproducibility_pairs", PAIRS + f' SELECT sample_id, map_a, map_b, "window", reasons, {ROUNDED} FROM records', "maps")
def reproducibility_pairs(spark, sf_dir):
    return _records(spark, sf_dir)


@query(
    "reproducibility_summary",
    PAIRS
    + f""" SELECT sample_id, CASE WHEN map_a // 3 = map_b // 3 THEN 'within' ELSE 'between' END AS pair_group, "window", count(*) AS pairs, count(lower) AS defined, round(avg(lower), 5) + 0.0 AS lower, round(avg(upper), 5) + 0.0 AS upper,
  round(avg(ari), 5) + 0.0 AS ari, round(min(lower), 5) + 0.0 AS least_lower FROM (SELECT sample_id, map_a, map_b, "window", {ROUNDED} FROM records) GROUP BY ALL""",
    "maps",
)
def reproducibility_summary(spark, sf_dir):
    """Summed up from the saved pair records, so that another summary needs no maps."""
    path = shared.shared_folder(spark, "pairs")
    _records(spark, sf_dir).write.parquet(path)
    return rounded(R.pair_summary(spark.read.parquet(path), REPEATS), "lower", "upper", "ari", "least_lower", digits=5)


@query(
    "pair_record_rules",
    PAIRS
    + """, x AS (SELECT sample_id, map_a, map_b, "window" FROM records)
SELECT sample_id, map_b AS map_a, map_a AS map_b, "window", 'pair_order' AS rule FROM x WHERE map_a = 0 AND map_b = 4 AND "window" = 5
UNION ALL SELECT sample_id, map_a, map_b, NULL, 'missing' FROM x WHERE map_a = 0 AND map_b = 4 AND "window" = 5
UNION ALL SELECT sample_id, map_a, map_b, NULL, 'missing' FROM x WHERE map_a = 2 AND map_b = 5 AND "window" = 9
UNION ALL SELECT sample_id, map_a, map_b, 7, 'window' FROM x WHERE map_a = 1 AND map_b = 3 AND "window" = 9
UNION ALL SELECT sample_id, map_a, map_b, NULL, 'missing' FROM x WHERE map_a = 1 AND map_b = 3 AND "window" = 9
UNION ALL SELECT sample_id, map_a, map_b, "window", 'derived' FROM x WHERE map_a = 3 AND sample_id % 2 = 0
UNION ALL SELECT sample_id, map_a, map_b, "window", 'reasons' FROM records WHERE map_a = 6 AND map_b = 7 AND reasons IS NULL""",
    "maps",
)
def pair_record_rules(spark, sf_dir):
    """Pair records of which some are spoilt: both maps swapped, a window lost or wrong, bounds moved, a reason without cause."""
    at = lambda a, b, w: (F.col("map_a") == a) & (F.col("map_b") == b) & (F.col("window") == w)
    rows = _records(spark, sf_dir).where(~at(2, 5, 9))
    swapped = at(0, 4, 5)
    spoilt = rows.select(
        "sample_id", F.when(swapped, F.col("map_b")).otherwise(F.col("map_a")).alias("map_a"), F.when(swapped, F.col("map_a")).otherwise(F.col("map_b")).alias("map_b"),
        F.when(at(1, 3, 9), 7).otherwise(F.col("window")).alias("window"), "a_to_b", "b_to_a", "upper",
        F.when((F.col("map_a") == 3) & (F.col("sample_id") % 2 == 0), F.coalesce("lower", F.lit(0.0)) + 0.5).otherwise(F.col("lower")).alias("lower"),
        F.when((F.col("map_a") == 6) & (F.col("map_b") == 7) & F.col("reasons").isNull(), "no_cause").otherwise(F.col("reasons")).alias("reasons"),
    )
    return R.pair_violations(spoilt, MAPS)


# ---- fitted on one split, scored on the other -----------------------------------

STEPS, CLASSES = 3, 5


def _fit_sql() -> str:
    ctes = [
        "u AS (SELECT vec_id, (cls - 1) % 5 + 1 AS cls, vec_id % 4 = 0 AS test, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS x FROM px)",
        "c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, x AS c FROM (SELECT * FROM u WHERE NOT test ORDER BY vec_id LIMIT 5))",
    ]
    for s in range(STEPS):
        ctes += [
            f"a{s} AS (SELECT vec_id, any_value(x) AS x, arg_max(k, (list_dot_product(x, c), -k)) AS k FROM u, c{s} WHERE NOT test GROUP BY 1)",
            f"d{s} AS (SELECT k, b, avg(v) AS v FROM (SELECT k, unnest(range(1, len(x) + 1)) AS b, unnest(x) AS v FROM a{s}) GROUP BY ALL)",
            f"m{s} AS (SELECT k, list(v ORDER BY b) AS v FROM d{s} GROUP BY 1)",
            f"c{s + 1} AS (SELECT k, coalesce(list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))), c) AS c FROM c{s} LEFT JOIN m{s} USING (k))",
        ]
    return "WITH " + ",\n".join(ctes)


SCORES = """, hit AS (SELECT vec_id, any_value(cls) AS l1, arg_max(k, (list_dot_product(x, c), -k)) + 1 AS l2 FROM u, c3 WHERE test GROUP BY 1),
c AS (SELECT l1, l2, count(*)::DOUBLE AS n FROM hit GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c),
f AS (SELECT a AS l1, b AS l2, coalesce(n, 0) AS n FROM range(1, 6) x(a), range(1, 6) y(b) LEFT JOIN c ON l1 = a AND l2 = b),
m AS (SELECT max(p.n + q.n + r.n + s.n + w.n) AS m FROM f p, f q, f r, f s, f w WHERE p.l1 = 1 AND q.l1 = 2 AND r.l1 = 3 AND s.l1 = 4 AND w.l1 = 5
  AND p.l2 NOT IN (q.l2, r.l2, s.l2, w.l2) AND q.l2 NOT IN (r.l2, s.l2, w.l2) AND r.l2 NOT IN (s.l2, w.l2) AND s.l2 <> w.l2),
a AS (SELECT l1, sum(n) AS a FROM c GROUP BY 1), b AS (SELECT l2, sum(n) AS b FROM c GROUP BY 1),
i AS (SELECT sum(n / t * ln(n * t / (a * b))) AS i FROM c JOIN a USING (l1) JOIN b USING (l2), t),
h AS (SELECT (SELECT -sum(a / t * ln(a / t)) FROM a, t) AS ha, (SELECT -sum(b / t * ln(b / t)) FROM b, t) AS hb),
k AS (SELECT a, b, t, unnest(range(greatest(1, a + b - t)::BIGINT, least(a, b)::BIGINT + 1))::DOUBLE AS k FROM a, b, t),
e AS (SELECT sum(k / t * ln(t * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1)
  - lgamma(t - a - b + k + 1))) AS e FROM k)
SELECT (SELECT count(*) FROM u WHERE NOT test) AS train_rows, t::BIGINT AS test_rows, round(100 * m / t, 6) AS acc, round(100 * i / ((ha + hb) / 2), 6) AS nmi, round(100 * (i - e) / (greatest(ha, hb) - e), 6) + 0.0 AS ami
FROM t, m, i, h, e"""


def _model(spark, sf_dir):
    """Rows, and the path of the model: three steps from the first five training rows, saved as a table."""
    rows = V.pixels(spark, sf_dir).select("vec_id", ((F.col("cls") - 1) % CLASSES + 1).alias("label"), "x")
    train = rows.where("vec_id % 4 <> 0")
    seeds = train.orderBy("vec_id").limit(CLASSES).collect()
    first = spark.createDataFrame([(i, r.x) for i, r in enumerate(seeds)], "cluster long, center array<double>")
    path = shared.shared_folder(spark, "centers")
    models.fitted_centers(train, first, iterations=STEPS, tolerance=0.0).write.parquet(path)
    return rows, path


@query("train_fit_test_score", _fit_sql() + SCORES, "px")
def train_fit_test_score(spark, sf_dir):
    """Centres of three quarters of the rows, held against the labels of the last quarter."""
    rows, path = _model(spark, sf_dir)
    return rounded(agreement.held_out_scores(rows.where("vec_id % 4 = 0"), spark.read.parquet(path), CLASSES), "acc", "nmi", "ami")


@query(
    "fitted_centers",
    _fit_sql()
    + """, n AS (SELECT k, count(*) AS n FROM (SELECT vec_id, arg_max(k, (list_dot_product(x, c), -k)) AS k FROM u, c3 WHERE NOT test GROUP BY 1) GROUP BY 1)
SELECT k::BIGINT AS cluster, coalesce(n, 0)::BIGINT AS rows, round(c[1], 6) + 0.0 AS first, round(c[64], 6) + 0.0 AS last FROM c3 LEFT JOIN n USING (k)""",
    "px",
)
def fitted_centers(spark, sf_dir):
    _, path = _model(spark, sf_dir)
    model = spark.read.parquet(path)
    return rounded(model.select("cluster", "rows", F.col("center")[0].alias("first"), F.element_at("center", -1).alias("last")), "first", "last")
