"""Masks on pixel grids: thresholds, erosion, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from huegrid.operators.maps import PIXEL, _moved

def otsu_thresholds(counts: DataFrame, bins: int) -> DataFrame:
    """sample_id, low, high: the two cuts of a histogram (sample_id, bin, n) that maximise the variance between three classes.

    A histogram is one array of ``bins`` counts, so all cuts are tried within a row; the lowest pair wins ties."""
    rows = counts.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bin").cast("int"), F.col("n").cast("double")))).alias("h"))
    n = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("h", b), F.lit(0.0)))
    rows = rows.select("sample_id", n.alias("n"))

    def running(values):
        return F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda k: F.aggregate(F.slice(values, F.lit(1), k), F.lit(0.0), lambda a, v: a + v))

    rows = rows.withColumns({"cw": running(F.col("n")), "cm": running(F.transform("n", lambda v, i: v * i))})
    rows = rows.withColumn("low", F.explode(F.sequence(F.lit(0), F.lit(bins - 3)))).withColumn("high", F.explode(F.sequence(F.col("low") + 1, F.lit(bins - 2))))
    w = lambda k: F.element_at("cw", k + 1)
    m = lambda k: F.element_at("cm", k + 1)
    end = F.lit(bins - 1)
    classes = [(w(F.col("low")), m(F.col("low"))), (w(F.col("high")) - w(F.col("low")), m(F.col("high")) - m(F.col("low"))), (w(end) - w(F.col("high")), m(end) - m(F.col("high")))]
    between = sum((F.coalesce(F.try_divide(b * b, a), F.lit(0.0)) for a, b in classes), F.lit(0.0))
    rows = rows.select("sample_id", "low", "high", F.round(between, 6).alias("v"))
    best = F.max_by(F.struct("low", "high"), F.struct("v", -F.col("low"), -F.col("high")))
    return rows.groupBy("sample_id").agg(best.alias("b")).select("sample_id", F.col("b.low").cast("long").alias("low"), F.col("b.high").cast("long").alias("high"))


def disk(radius: int) -> list[tuple[int, int]]:
    reach = range(-radius, radius + 1)
    return [(a, b) for a in reach for b in reach if a * a + b * b <= radius * radius]


def eroded(mask: DataFrame, height: int, width: int, radius: int = 1) -> DataFrame:
    """Pixels whose neighbours within the radius are in the mask, too; what lies outside the image counts as mask."""
    row, col = F.col("pixel_row"), F.col("pixel_col")
    hits = _moved(mask.select(*PIXEL), disk(radius)).groupBy(*PIXEL).agg(F.count(F.lit(1)).alias("n"))
    inside = lambda a, b: (row + a).between(0, height - 1) & (col + b).between(0, width - 1)
    needed = sum((inside(a, b).cast("int") for a, b in disk(radius)), F.lit(0))
    return hits.where(inside(0, 0) & (F.col("n") == needed)).select(*PIXEL)


def components(mask: DataFrame, neighbours: int = 4) -> DataFrame:
    """mask with ``component``: the smallest (row, col) number reached over 4 or 8 neighbours, by runs and repeated minima.

    Runs of a row are found by a window first, so that the minima travel over runs and not over pixels; each round is
    written to the shared checkpoint folder and halves what is left by pointer jumping."""
    spark = mask.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="huegrid-ck-" + uuid.uuid4().hex[:6]))
    line = W.partitionBy("sample_id", "pixel_row").orderBy("pixel_col")
    start = F.col("pixel_col") - F.row_number().over(line)
    runs = mask.select(*PIXEL).withColumn("_s", start)
    first = F.min("pixel_col").over(W.partitionBy("sample_id", "pixel_row", "_s"))
    runs = runs.withColumn("run", F.col("pixel_row").cast("long") * F.lit(1 << 20) + first).drop("_s").checkpoint()
    down = runs.select("sample_id", (F.col("pixel_row") + 1).alias("pixel_row"), "pixel_col", F.col("run").alias("above"))
    if neighbours == 8:
        down = _moved(down, [(0, -1), (0, 0), (0, 1)])
    edges = runs.join(down, PIXEL).select("sample_id", F.col("run").alias("a"), F.col("above").alias("b")).distinct()
    edges = edges.union(edges.select("sample_id", "b", "a")).checkpoint()
    label = runs.select("sample_id", F.col("run").alias("a")).distinct().withColumn("l", F.col("a")).checkpoint()
    while True:
        near = edges.join(label.withColumnRenamed("a", "b"), ["sample_id", "b"]).groupBy("sample_id", "a").agg(F.min("l").alias("m"))
        new = label.join(near, ["sample_id", "a"], "left").select("sample_id", "a", "l", F.least("l", F.coalesce("m", "l")).alias("n"))
        jump = new.select("sample_id", F.col("a").alias("n"), F.col("n").alias("j"))
        new = new.join(jump, ["sample_id", "n"]).select("sample_id", "a", "l", F.least("n", "j").alias("n")).checkpoint()
        label = new.select("sample_id", "a", F.col("n").alias("l"))
        if new.where("l <> n").isEmpty():
            break
    return runs.join(label.withColumnRenamed("a", "run"), ["sample_id", "run"]).select(*PIXEL, F.col("l").alias("component"))


def component_records(found: DataFrame, height: int, width: int) -> DataFrame:
    """Area, half-open bounding box and whether the component touches the image's edge."""
    touches = (F.min("pixel_row") == 0) | (F.min("pixel_col") == 0) | (F.max("pixel_row") == height - 1) | (F.max("pixel_col") == width - 1)
    return found.groupBy("sample_id", "component").agg(
        F.count(F.lit(1)).alias("area_pixels"),
        F.min("pixel_row").alias("min_row"),
        F.min("pixel_col").alias("min_col"),
        (F.max("pixel_row") + 1).alias("max_row"),
        (F.max("pixel_col") + 1).alias("max_col"),
        touches.alias("touches_boundary"),
    )


def without_small(found: DataFrame, least: int) -> DataFrame:
    n = F.count(F.lit(1)).over(W.partitionBy("sample_id", "component"))
    return found.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")
