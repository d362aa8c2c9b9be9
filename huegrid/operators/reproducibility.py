"""Label maps of several repeats held against each other: boundaries, their distances, and all pairs of maps at all windows.

Maps come as one row for each pixel with an array of their labels (``labels``; null where a map has no such pixel). Pixels are
sent once to the block of the image that owns them, and to a neighbouring block where they are within reach of its edge. Inside a
block the distance of every place to each map's nearest boundary is found by two running passes along rows and one along
columns; all windows and all pairs of maps read this one distance. What a task holds is a block and its rim, however large
the image; counts of blocks are added up by Spark.

Places are in doubled coordinates: pixels on even ones, the edge between two adjacent pixels halfway. Distances are the
greater of both coordinates' differences, and a window of w pixels reaches w - 1 of them.

Defined results: rows with a null coordinate or no labels are left out; of a pixel given twice, a map's greatest label counts; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from huegrid.operators.maps import PIXEL, adjusted_rand

BLOCK = 128  # pixels along one side of a block, where no other is given
WINDOWS = (3, 5, 9)


def stacked(maps: DataFrame, ids: Sequence) -> DataFrame:
    """One row for each pixel with ``labels`` in the order of ``ids``, from rows of single maps (sample_id, pixel_row, pixel_col, map, label)."""
    at = [F.max(F.when(F.col("map") == F.lit(m), F.col("label"))) for m in ids]
    return maps.groupBy(*PIXEL).agg(F.array(*at).alias("labels"))


def boundaries(labels: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, boundary) of maps (map, row, column) over all doubled places."""
    maps, rows, cols = labels.shape
    edge = np.zeros((maps, 2 * rows - 1, 2 * cols - 1), bool)
    cut = edge.copy()
    edge[:, ::2, 1::2] = valid[:, :, 1:] & valid[:, :, :-1]
    edge[:, 1::2, ::2] = valid[:, 1:] & valid[:, :-1]
    cut[:, ::2, 1::2] = labels[:, :, 1:] != labels[:, :, :-1]
    cut[:, 1::2, ::2] = labels[:, 1:] != labels[:, :-1]
    return edge, cut & edge


def distances(boundary: np.ndarray, reach: int) -> np.ndarray:
    """Distance of every place to the nearest boundary of each map, ``reach`` + 1 where it is farther."""
    far, width = reach + 1, boundary.shape[2]
    at = np.arange(width, dtype=np.int32)
    before = at - np.maximum.accumulate(np.where(boundary, at, -far), axis=2)
    after = np.minimum.accumulate(np.where(boundary, at, width + far)[:, :, ::-1], axis=2)[:, :, ::-1] - at
    along = np.minimum(np.minimum(before, after), far).astype(np.int16)
    near = along.copy()
    for step in range(1, min(reach, boundary.shape[1] - 1) + 1):
        np.minimum(near[:, step:], np.maximum(along[:, :-step], step), out=near[:, step:])
        np.minimum(near[:, :-step], np.maximum(along[:, step:], step), out=near[:, :-step])
    return near


def _blocks(stacks: DataFrame, reach: int, block: int) -> DataFrame:
    rim = reach // 2 + 1
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - rim) / block), F.floor((F.col(c) + rim) / block)))
    rows = stacks.dropna(subset=[*PIXEL, "labels"]).select("sample_id", *(F.col(c).cast("long").alias(c) for c in PIXEL[1:]), F.col("labels").cast("array<long>").alias("labels"))
    return rows.withColumn("block_row", span("pixel_row")).withColumn("block_col", span("pixel_col"))


def _places(group: pd.DataFrame, n_maps: int, reach: int, block: int):
    """Edges, boundaries and distances of a block with its rim, which of its places the block owns, and its first pixel."""
    at = group[["pixel_row", "pixel_col"]].to_numpy(np.int64)
    first = at.min(0)
    rows, cols = (at - first).T
    shape = at.max(0) - first + 1
    found = pd.DataFrame(group["labels"].tolist()).reindex(columns=range(n_maps)).to_numpy()
    valid, labels = np.zeros((n_maps, *shape), bool), np.zeros((n_maps, *shape), np.int64)
    for m in range(n_maps):
        there = ~pd.isna(found[:, m])
        value = found[there, m].astype(np.int64)
        order = np.argsort(value, kind="stable")  # the last of equal places stays
        valid[m, rows[there], cols[there]] = True
        labels[m, rows[there][order], cols[there][order]] = value[order]
    edge, cut = boundaries(labels, valid)
    begin = np.array([group["block_row"].iloc[0], group["block_col"].iloc[0]]) * block - first
    own = [(np.arange(2 * n - 1) >= 2 * b) & (np.arange(2 * n - 1) < 2 * (b + block)) for n, b in zip(shape, begin, strict=True)]
    return edge, cut, distances(cut, reach), own[0][:, None] & own[1][None], first, valid


def _same(group: pd.DataFrame, n: int) -> pd.Series:
    """The group's sample n times, as plain objects."""
    return pd.Series([group["sample_id"].iloc[0]] * n, dtype=object)


def boundary_matches(stacks: DataFrame, n_maps: int, windows: Sequence[int] = WINDOWS, block: int = BLOCK) -> DataFrame:
    """sample_id, source, target (places in ``labels``, from 0), window, edges and boundary of the source, and how many of that
    boundary's places are within the window of the target's boundary; for all ordered pairs of maps, a map with itself included."""
    reach, kind = max(windows) - 1, stacks.schema["sample_id"].dataType.simpleString()
    pairs = [(a, b, w) for a in range(n_maps) for b in range(n_maps) for w in windows]
    source, target, window = (np.array(x) for x in zip(*pairs, strict=True))

    def count(group: pd.DataFrame) -> pd.DataFrame:
        edge, cut, near, own, _, _ = _places(group, n_maps, reach, block)
        edges, boundary = (edge & own).sum((1, 2)), (cut & own).sum((1, 2))
        hits = []
        for a in range(n_maps):
            d = near[:, cut[a] & own]
            hits.append([[(d[b] < w).sum() for w in windows] for b in range(n_maps)])
        return pd.DataFrame(
            {
                "sample_id": _same(group, len(pairs)), "source": source, "target": target, "window": window,
                "edges": edges[source], "boundary": boundary[source], "matched": np.array(hits).ravel(),
            }
        )

    schema = f"sample_id {kind}, source int, target int, window int, edges long, boundary long, matched long"
    counts = _blocks(stacks, reach, block).groupBy("sample_id", "block_row", "block_col").applyInPandas(count, schema)
    return counts.groupBy("sample_id", "source", "target", "window").agg(*(F.sum(c).alias(c) for c in ("edges", "boundary", "matched")))


def boundary_cover(stacks: DataFrame, n_maps: int, window: int, block: int = BLOCK) -> DataFrame:
    """sample_id, pixel_row, pixel_col, covered: in how many maps the pixel's centre is within the window of a boundary."""
    kind = stacks.schema["sample_id"].dataType.simpleString()

    def cover(group: pd.DataFrame) -> pd.DataFrame:
        _, _, near, own, first, valid = _places(group, n_maps, window - 1, block)
        r, c = np.nonzero(valid.any(0) & own[::2, ::2])
        covered = (near[:, ::2, ::2] < window).sum(0)[r, c]
        return pd.DataFrame({"sample_id": _same(group, len(r)), "pixel_row": r + first[0], "pixel_col": c + first[1], "covered": covered})

    blocks = _blocks(stacks, window - 1, block).groupBy("sample_id", "block_row", "block_col")
    return blocks.applyInPandas(cover, f"sample_id {kind}, pixel_row long, pixel_col long, covered long")


def pair_ari(stacks: DataFrame, n_maps: int) -> DataFrame:
    """sample_id, map_a, map_b, ari of all pairs of maps; pixels that one of both lacks are left out. A shuffle of counts, no join of pixels."""
    pairs = F.array(*(F.struct(F.lit(a).alias("map_a"), F.lit(b).alias("map_b"), F.col("labels")[a].alias("l1"), F.col("labels")[b].alias("l2")) for a in range(n_maps) for b in range(a + 1, n_maps)))
    by = ("sample_id", "map_a", "map_b")
    cells = stacks.select("sample_id", F.inline(pairs)).where("l1 IS NOT NULL AND l2 IS NOT NULL").groupBy(*by, "l1", "l2").agg(F.count(F.lit(1)).alias("n"))
    return adjusted_rand(cells, by=by).select(*by, "ari")


def pair_records(stacks: DataFrame, n_maps: int, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """For each sample, pair of maps (map_a < map_b) and window: coverage in both directions, the lower and the upper one where
    both are defined, why one is not (reasons, joined by ``;``), and the pair's adjusted Rand index."""
    share = F.try_divide(F.col("matched").cast("double"), F.col("boundary").cast("double"))
    why = F.when(F.col("edges") == 0, "no_valid_adjacent_edges").when(F.col("boundary") == 0, "empty_source_boundary")
    at = boundary_matches(stacks, n_maps, windows).where("source <> target").withColumns({"value": share, "reason": why})
    ahead = F.col("source") < F.col("target")
    one = lambda c, forward: F.max(F.when(ahead if forward else ~ahead, F.col(c)))
    rows = at.groupBy("sample_id", F.least("source", "target").alias("map_a"), F.greatest("source", "target").alias("map_b"), "window").agg(
        one("value", True).alias("a_to_b"), one("value", False).alias("b_to_a"), F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("reasons")
    )
    both = F.col("a_to_b").isNotNull() & F.col("b_to_a").isNotNull()
    rows = rows.withColumns({"lower": F.when(both, F.least("a_to_b", "b_to_a")), "upper": F.when(both, F.greatest("a_to_b", "b_to_a")), "reasons": F.when(F.col("reasons") != "", F.col("reasons"))})
    return rows.join(pair_ari(stacks, n_maps), ["sample_id", "map_a", "map_b"], "left")


def pair_summary(records: DataFrame, repeats: int) -> DataFrame:
    """sample_id, pair_group, window, and over the pairs of the group: pairs, how many are defined, the means of lower, upper and
    ari over these, and the least lower. Maps are numbered encoder by encoder, ``repeats`` maps each."""
    group = F.when(F.expr(f"map_a div {repeats} = map_b div {repeats}"), "within").otherwise("between")
    return records.groupBy("sample_id", group.alias("pair_group"), "window").agg(
        F.count(F.lit(1)).alias("pairs"), F.count("lower").alias("defined"), F.avg("lower").alias("lower"), F.avg("upper").alias("upper"), F.avg("ari").alias("ari"), F.min("lower").alias("least_lower")
    )


def pair_violations(records: DataFrame, n_maps: int, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """sample_id, map_a, map_b, window, rule: saved pair records that break a rule. Rules: pair_order (map_a < map_b within the
    maps), window (not one of ``windows``, or given twice), derived (lower or upper is not the lesser or greater of both
    directions, or defined where one of them is not), reasons (given where both directions are defined, missing where one is
    not, or not sorted), missing (a pair of a sample without all its windows; window is null)."""
    key = ["sample_id", "map_a", "map_b"]
    ordered = F.coalesce((F.col("map_a") >= 0) & (F.col("map_a") < F.col("map_b")) & (F.col("map_b") < n_maps), F.lit(False))
    twice = F.count(F.lit(1)).over(W.partitionBy(*key, "window")) > 1
    both = F.col("a_to_b").isNotNull() & F.col("b_to_a").isNotNull()
    low, high = F.when(both, F.least("a_to_b", "b_to_a")), F.when(both, F.greatest("a_to_b", "b_to_a"))
    sorted_ = F.array_join(F.array_sort(F.array_distinct(F.split("reasons", ";"))), ";")
    rules = [
        (~ordered, "pair_order"),
        (~F.coalesce(F.col("window").isin(*windows), F.lit(False)) | twice, "window"),
        (~(F.col("lower").eqNullSafe(low) & F.col("upper").eqNullSafe(high)), "derived"),
        ((both != F.col("reasons").isNull()) | ~F.coalesce(sorted_ == F.col("reasons"), F.lit(True)), "reasons"),
    ]
    broken = F.filter(F.array(*(F.when(c, name) for c, name in rules)), lambda r: r.isNotNull())
    found = records.select(*key, "window", broken.alias("broken")).select(*key, "window", F.explode("broken").alias("rule"))
    plan = F.explode(F.array(*(F.struct(F.lit(a).alias("map_a"), F.lit(b).alias("map_b"), F.lit(w).alias("window")) for a in range(n_maps) for b in range(a + 1, n_maps) for w in windows))).alias("p")
    wanted = records.select("sample_id").distinct().select("sample_id", plan).select("sample_id", "p.*")
    missing = wanted.join(records, [*key, "window"], "left_anti").select(*key).distinct()
    return found.unionByName(missing.select(*key, F.lit(None).cast("int").alias("window"), F.lit("missing").alias("rule")))


def coverage(source: DataFrame, target: DataFrame, width: int) -> DataFrame:
    """Share of the source's boundary within the target's neighbourhood: null without a source, 0 without a target."""
    maps = [rows.select(*PIXEL, "label", F.lit(m).alias("map")) for m, rows in enumerate((source, target))]
    counts = boundary_matches(stacked(maps[0].unionByName(maps[1]), (0, 1)), 2, (width,)).where("source = 0 AND target = 1")
    counts = counts.select("sample_id", F.col("boundary").alias("boundary_count"), F.col("matched").alias("matched_count"))
    rows = source.select("sample_id").distinct().join(counts, "sample_id", "left").fillna(0, ["boundary_count", "matched_count"])
    value = F.try_divide(F.col("matched_count").cast("double"), F.col("boundary_count").cast("double"))
    return rows.withColumn("value", value).withColumn("undefined_reason", F.when(F.col("boundary_count") == 0, "empty_source_boundary"))


def compare(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Both directions of coverage of two maps (sample_id, pixel_row, pixel_col, label), the lower and the upper one where both are defined."""
    maps = [rows.select(*PIXEL, "label", F.lit(m).alias("map")) for m, rows in enumerate((left, right))]
    return compared(stacked(maps[0].unionByName(maps[1]), (0, 1)), width)


def compared(stacks: DataFrame, width: int) -> DataFrame:
    """As ``compare``, of the first two labels of each pixel."""
    at = boundary_matches(stacks, 2, (width,)).where("source <> target")
    value = F.try_divide(F.col("matched").cast("double"), F.col("boundary").cast("double"))
    rows = at.groupBy("sample_id").agg(*(F.max(F.when(F.col("source") == s, value)).alias(n) for s, n in ((0, "a_to_b"), (1, "b_to_a"))))
    both = F.col("a_to_b").isNotNull() & F.col("b_to_a").isNotNull()
    return rows.withColumns({"lower": F.when(both, F.least("a_to_b", "b_to_a")), "upper": F.when(both, F.greatest("a_to_b", "b_to_a"))})


def boundary_frequency(stacks: DataFrame, n_maps: int, width: int) -> DataFrame:
    """Share of the maps whose boundary is within the window of each pixel's centre; pixels that no map has are left out."""
    return boundary_cover(stacks, n_maps, width).select(*PIXEL, (F.col("covered") / n_maps).alias("frequency"))
