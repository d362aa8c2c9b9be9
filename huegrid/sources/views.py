"""Pixels, label maps, scores and references seen in plain tables, lazily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLUSTERS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 x 10 tiles of spectra: sample_id, hdf5_row, pixel_row, pixel_col, x array<double>, cls, vec_id."""
    e = table(spark, sf_dir, "embeddings")
    place = F.col("vec_id") % 100
    return e.select(
        F.expr("vec_id div 100").alias("sample_id"),
        place.alias("hdf5_row"),
        F.expr("(vec_id % 100) div 10").alias("pixel_row"),
        (F.col("vec_id") % 10).alias("pixel_col"),
        F.col("embedding").cast("array<double>").alias("x"),
        (F.col("label") + 1).cast("long").alias("cls"),
        "vec_id",
    )


def repeat_label(repeat: int) -> Column:
    """The place (1..8) of the greatest of eight bands, the lowest on ties."""
    part = F.slice("x", CLUSTERS * (repeat - 1) + 1, CLUSTERS)
    return F.array_position(part, F.array_max(part)).cast("long")


def repeat_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three repeats of label maps over the pixels, in one pass: sample_id, pixel_row, pixel_col, repeat, label."""
    labels = F.array(*(F.struct(F.lit(r).alias("repeat"), repeat_label(r).alias("label")) for r in (1, 2, 3)))
    return pixels(spark, sf_dir).select("sample_id", "pixel_row", "pixel_col", F.inline(labels))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 x 64 maps with holes and two partitions l1, l2: sample_id, pixel_row, pixel_col, l1, l2."""
    key = F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .where("o_orderstatus <> 'P'")
        .select(
            F.expr("o_orderkey div 4096").alias("sample_id"),
            F.expr("(o_orderkey % 4096) div 64").alias("pixel_row"),
            (key % 64).alias("pixel_col"),
            F.substring("o_orderpriority", 1, 1).cast("long").alias("l1"),
            (F.floor("o_totalprice") % 5 + 1).cast("long").alias("l2"),
        )
    )


def one_map(spark: SparkSession, sf_dir: str, label: str = "l1") -> DataFrame:
    return maps(spark, sf_dir).select("sample_id", "pixel_row", "pixel_col", F.col(label).alias("label"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """condition, sample_id, repeat, value (null where undefined), reason."""
    line, orders, customer = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    cells = joined.groupBy(
        F.col("l_returnflag").alias("condition"),
        F.col("c_nationkey").cast("long").alias("sample_id"),
        (F.col("l_linenumber") % 3 + 1).cast("long").alias("repeat"),
    ).agg(F.avg("l_discount").alias("v"))
    undefined = (F.col("sample_id") + F.col("repeat") + F.ascii("condition")) % 13 == 0
    return cells.select("condition", "sample_id", "repeat", F.when(~undefined, F.col("v")).alias("value"), F.when(undefined, F.lit("fixture_undefined")).alias("reason"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, band, value of every pixel and band."""
    return pixels(spark, sf_dir).select("sample_id", "hdf5_row", F.posexplode("x").alias("band", "value")).withColumn("band", F.col("band").cast("long"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """band, white, dark: the spatial pixels of a white and a dark reference; some are not positive."""
    white = F.col("p_retailprice") + 100
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 32).alias("band"),
        white.alias("white"),
        F.when(F.col("p_partkey") % 17 == 0, white).otherwise(F.col("p_size").cast("double")).alias("dark"),
    )


#: The same views for an SQL engine that checks the queries.
SQL = {
    "px": """SELECT vec_id // 100 AS sample_id, vec_id % 100 AS hdf5_row, (vec_id % 100) // 10 AS pixel_row, vec_id % 10 AS pixel_col,
  embedding::DOUBLE[] AS x, (label + 1)::BIGINT AS cls, vec_id FROM embeddings""",
    "lab": """SELECT sample_id, pixel_row, pixel_col, r AS repeat,
  list_position(x[8*(r-1)+1:8*r], list_max(x[8*(r-1)+1:8*r]))::BIGINT AS label FROM px, (VALUES (1), (2), (3)) AS t(r)""",
    "maps": """SELECT o_orderkey // 4096 AS sample_id, (o_orderkey % 4096) // 64 AS pixel_row, o_orderkey % 64 AS pixel_col,
  substr(o_orderpriority, 1, 1)::BIGINT AS l1, (1 + floor(o_totalprice)::BIGINT % 5)::BIGINT AS l2 FROM orders WHERE o_orderstatus <> 'P'""",
    "m1": "SELECT sample_id, pixel_row, pixel_col, l1 AS label FROM maps",
    "scores": """SELECT condition, sample_id, repeat,
  CASE WHEN (sample_id + repeat + ascii(condition)) % 13 = 0 THEN NULL ELSE v END AS value,
  CASE WHEN (sample_id + repeat + ascii(condition)) % 13 = 0 THEN 'fixture_undefined' END AS reason
  FROM (SELECT l_returnflag AS condition, c_nationkey::BIGINT AS sample_id, (l_linenumber % 3 + 1)::BIGINT AS repeat, avg(l_discount) AS v
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)""",
    "bands": "SELECT sample_id, hdf5_row, (generate_subscripts(x, 1) - 1)::BIGINT AS band, unnest(x) AS value FROM px",
    "refs": """SELECT p_partkey % 32 AS band, p_retailprice + 100 AS white,
  CASE WHEN p_partkey % 17 = 0 THEN p_retailprice + 100 ELSE p_size::DOUBLE END AS dark FROM part""",
}
NEEDS = {"lab": ("px",), "bands": ("px",), "m1": ("maps",)}


def with_views(sql: str, *names: str) -> str:
    """The statement with the named views in front."""
    order: list[str] = []
    for name in names:
        order.extend(n for n in (*NEEDS.get(name, ()), name) if n not in order)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    body = sql.strip()
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
