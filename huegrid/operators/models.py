"""Fixed-centre assignment, cosine k-means, PCA, alignment of labels and spectra of clusters."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huegrid.functions import spectra


def vector_means(rows: DataFrame, by: list[str], x: str = "x", name: str = "center") -> DataFrame:
    """Mean vector of each group, summed map-side band by band."""
    bands = rows.select(*by, F.posexplode(x).alias("_k", "_v")).groupBy(*by, "_k").agg(F.avg("_v").alias("_m"))
    return bands.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_m"))), lambda e: e["_m"]).alias(name))


def assigned(rows: DataFrame, centers: DataFrame, x: str = "x") -> DataFrame:
    """rows with ``label``: the centre (cluster, center) of greatest cosine, the smallest cluster on ties.

    The centres are one row of an array (as many entries as clusters), so that nothing is multiplied by them."""
    all_ = centers.agg(F.array_sort(F.collect_list(F.struct("cluster", "center"))).alias("_c"))
    near = F.transform("_c", lambda c: F.struct(spectra.cosine(F.col(x), c["center"]).alias("s"), (-c["cluster"]).alias("k")))
    return rows.crossJoin(F.broadcast(all_)).withColumn("label", -F.array_max(near)["k"]).drop("_c")


def assigned_each(rows: DataFrame, centers: DataFrame, x: str = "x") -> DataFrame:
    """rows once for each k of the centres (k, cluster, center), with its label: all sets of centres in one pass."""
    sets = centers.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("cluster", "center"))).alias("c"))
    all_ = sets.agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("_c"))  # as many vectors as there are centres
    best = lambda s: -F.array_max(F.transform(s["c"], lambda c: F.struct(spectra.cosine(F.col(x), c["center"]).alias("s"), (-c["cluster"]).alias("k"))))["k"]
    found = F.transform("_c", lambda s: F.struct(s["k"].alias("k"), best(s).alias("label")))
    return rows.crossJoin(F.broadcast(all_)).select(*rows.columns, F.inline(found))


def cosine_kmeans(rows: DataFrame, k: int, key: str, x: str = "x", iterations: int = 20, tolerance: float = 1e-4, seed: int = 1) -> DataFrame:
    """(cluster, center) after Lloyd's steps on the unit sphere. Each step is one grouped sum; k vectors come back."""
    unit = rows.select(key, spectra.unit(F.col(x)).alias("u")).where("u IS NOT NULL").persist()
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    first = np.array([r.u for r in unit.orderBy(order).limit(k).collect()])
    found = _lloyd(unit, first, iterations, tolerance)
    unit.unpersist()
    return found


def _lloyd(unit: DataFrame, first: np.ndarray, iterations: int, tolerance: float) -> DataFrame:
    """(cluster, center) of unit vectors ``u`` after steps from ``first``; a centre without rows stays."""
    spark = unit.sparkSession

    def frame(c: np.ndarray) -> DataFrame:
        return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(c)], "cluster long, center array<double>")

    for _ in range(iterations):
        sums = vector_means(assigned(unit, frame(first), "u"), ["label"], "u").collect()
        new = first.copy()
        for r in sums:
            v = np.array(r.center)
            new[r.label] = v / max(np.linalg.norm(v), 1e-12)
        done = np.abs(new - first).max() < tolerance
        first = new
        if done:
            break
    return frame(first)


def fitted_centers(train: DataFrame, first: DataFrame, x: str = "x", iterations: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """A fitted model as a table: cluster, center (unit vectors), rows (how many training rows are nearest to it).

    ``first`` (cluster from 0 without gaps, center) is where the steps begin; it comes to the driver, as many vectors as there
    are clusters. Training rows without a direction (null or zero vectors) are left out."""
    start = {r.cluster: np.array(r.center, np.float64) for r in first.select("cluster", "center").collect()}
    if not start or sorted(start) != list(range(len(start))):
        raise ValueError("clusters must be numbered from 0 without gaps")
    unit = train.select(spectra.unit(F.col(x)).alias("u")).where("u IS NOT NULL").persist()
    begin = np.stack([start[i] / max(np.linalg.norm(start[i]), 1e-12) for i in range(len(start))])
    centers = _lloyd(unit, begin, iterations, tolerance)
    counts = {r.label: r["count"] for r in assigned(unit, centers, "u").groupBy("label").count().collect()}
    unit.unpersist()
    return centers.withColumn("rows", F.coalesce(F.element_at(F.create_map(*(F.lit(v).cast("long") for kv in (counts or {-1: 0}).items() for v in kv)), F.col("cluster")), F.lit(0)).cast("long"))


def pca(rows: DataFrame, components: int, x: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """Mean and components (rows), from one pass that sums each task's Gram matrix; signs make the largest entry positive."""

    def grams(batches):
        import pandas as pd

        n, s, g = 0, None, None
        for b in batches:
            m = np.stack(b[x].to_numpy()) if len(b) else None
            if m is not None:
                n, s, g = n + len(m), m.sum(0) if s is None else s + m.sum(0), m.T @ m if g is None else g + m.T @ m
        if n:
            yield pd.DataFrame({"v": [[float(n), *s.tolist(), *g.ravel().tolist()]]})

    parts = rows.select(x).mapInPandas(grams, "v array<double>")
    total = parts.select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()  # 1 + bands + bands^2
    if not total:
        raise ValueError("no rows to fit")
    n, *sums = (r.v for r in total)
    bands = round((4 * len(sums) + 1) ** 0.5 - 1) // 2
    mean = np.array(sums[:bands]) / n
    cov = np.array(sums[bands:]).reshape(bands, bands) / n - np.outer(mean, mean)
    _, vectors = np.linalg.eigh(cov)
    v = vectors[:, ::-1][:, :components].T
    return mean, v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]


def projected(rows: DataFrame, mean: np.ndarray, components: np.ndarray, x: str = "x", name: str = "pc") -> DataFrame:
    at = F.zip_with(F.col(x), F.array(*map(F.lit, mean.tolist())), lambda a, b: a - b)
    return rows.withColumn("_c", at).withColumn(name, F.array(*(spectra.dot(F.col("_c"), F.array(*map(F.lit, c.tolist()))) for c in components))).drop("_c")


def pca_table(spark, mean: np.ndarray, components: np.ndarray) -> DataFrame:
    """A fitted model as rows: component (0 for the mean), band, value."""
    rows = [(k, b, float(v)) for k, line in enumerate([mean, *components]) for b, v in enumerate(line)]
    return spark.createDataFrame(rows, "component long, band long, value double")


def pca_from_table(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and components of a saved model; raises unless every component has every band once, with a finite value."""
    found = table.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("band", "value"))).alias("v")).orderBy("component").collect()  # components x bands
    if len(found) < 2 or [r.component for r in found] != list(range(len(found))) or any([p.band for p in r.v] != list(range(len(found[0].v))) for r in found):
        raise ValueError("a saved model has a mean and components, each with the same bands once")
    values = np.array([[p.value for p in r.v] for r in found], np.float64)
    if not np.isfinite(values).all():
        raise ValueError("a saved model has finite values")
    return values[0], values[1:]


def pca_checks(rows: DataFrame, mean: np.ndarray, components: np.ndarray, x: str = "x") -> DataFrame:
    """components, total_variance (of all scores), score_mean (the greatest, from zero), basis_error (the greatest, from an orthonormal basis)
    and falling (whether variances fall from component to component), from one pass over the rows."""
    moments = projected(rows, mean, components, x, "__pc").select(F.posexplode("__pc").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    error = float(np.abs(components @ components.T - np.eye(len(components))).max())
    kept = F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda p: p["s"])
    out = moments.agg(F.count(F.lit(1)).alias("components"), F.sum("s").alias("total_variance"), F.max(F.abs("m")).alias("score_mean"), kept.alias("v"))
    falling = F.forall(F.transform("v", lambda s, i: F.coalesce(F.get("v", i + 1) <= s * (1 + 1e-9) + 1e-12, F.lit(True))), lambda b: b)
    return out.select("components", "total_variance", "score_mean", F.lit(error).alias("basis_error"), falling.alias("falling"))


def overlap_ratio(table: DataFrame, left: str = "l1", right: str = "l2") -> DataFrame:
    """Intersection over union of each pair of labels, pooled."""
    n = table.groupBy(left, right).agg(F.sum("n").alias("n"))
    nl, nr = F.sum("n").over(W.partitionBy(left)), F.sum("n").over(W.partitionBy(right))
    return n.select(left, right, "n", (F.col("n") / (nl + nr - F.col("n"))).alias("iou"))


def best_assignment(weight: np.ndarray) -> list[int]:
    """The column of each row that maximises the sum; of equal sums, the one with the smallest columns, row by row.

    Shortest augmenting paths, O(rows^2 columns). Weights are taken as whole numbers of one unit, with the order of ties below
    that unit, so the result is exact."""
    rows, cols = weight.shape
    if rows > cols:
        raise ValueError("rows must not exceed columns")
    exact = [[Fraction(v) for v in line] for line in weight.tolist()]
    unit = max((v.denominator for line in exact for v in line), default=1)  # denominators are powers of two
    tie = (cols + 1) ** (rows + 1)
    cost = [[c * (cols + 1) ** (rows - 1 - r) - int(exact[r][c] * unit) * tie for c in range(cols)] for r in range(rows)]
    row_price, price, owner = [0] * rows, [0] * cols, [-1] * cols
    for r in range(rows):
        distance = [cost[r][c] - row_price[r] - price[c] for c in range(cols)]
        before, open_, done = [r] * cols, set(range(cols)), []
        while True:
            c = min(open_, key=distance.__getitem__)
            reach = distance[c]
            open_.remove(c)
            if owner[c] < 0:
                break
            done.append(c)
            via = owner[c]
            for k in open_:
                longer = reach + cost[via][k] - row_price[via] - price[k]
                if longer < distance[k]:
                    distance[k], before[k] = longer, via
        row_price[r] += reach
        for k in done:
            row_price[owner[k]] += reach - distance[k]
            price[k] -= reach - distance[k]
        while True:  # turn the path: each row takes the column that was found from it
            via = before[c]
            owner[c], following = via, next((k for k in done if owner[k] == via), None)
            if via == r:
                break
            c = following
    out = [0] * rows
    for c, r in enumerate(owner):
        if r >= 0:
            out[r] = c
    return out


def aligned_labels(counts: DataFrame, labels: int, by: list[str], reference: str = "l1", target: str = "l2") -> DataFrame:
    """by, target, display, overlap, target_pixels, reference_pixels: for each group, the reference label that each target label 1..labels is shown as.

    counts has by, reference, target, n. Labels that occur are matched one to one with the greatest overlap (ties: the smallest
    labels, in order of the target's); labels that don't take the ids left over, ascending. Each group (a map, a fold, a sample) is
    labels^2 numbers and is matched in one task; groups are dealt over all of them."""
    summed = counts.groupBy(*by, reference, target).agg(F.sum("n").cast("long").alias("n"))
    fields = summed.select(*by, target).schema.add("display", T.LongType()).add("overlap", T.LongType()).add("target_pixels", T.LongType()).add("reference_pixels", T.LongType())

    def one(frame):
        table = np.zeros((labels, labels), np.int64)  # target, reference
        if not (frame[reference].between(1, labels) & frame[target].between(1, labels)).all():
            raise ValueError(f"labels must be 1 to {labels}")
        table[frame[target] - 1, frame[reference] - 1] = frame.n
        present, shown = np.flatnonzero(table.sum(1)), np.full(labels, -1)
        shown[present] = best_assignment(table[present])
        shown[shown < 0] = sorted(set(range(labels)) - set(shown.tolist()))
        columns = {c: [frame[c].iloc[0]] * labels for c in by} | {target: np.arange(1, labels + 1), "display": shown + 1, "overlap": table[np.arange(labels), shown]}
        return pd.DataFrame(columns | {"target_pixels": table.sum(1), "reference_pixels": table.sum(0)[shown]})[fields.names]

    return summed.groupBy(*by).applyInPandas(one, fields)


def matched_labels(table: DataFrame, labels: int, left: str = "l1", right: str = "l2") -> DataFrame:
    """l1, l2, overlap: one-to-one matching of labels 1..labels with the greatest pooled overlap."""
    w = np.zeros((labels, labels))
    for r in table.groupBy(left, right).agg(F.sum("n").alias("n")).collect():  # labels^2 rows
        w[r[left] - 1, r[right] - 1] = r.n
    pairs = [(i + 1, c + 1, int(w[i, c])) for i, c in enumerate(best_assignment(w))]
    return table.sparkSession.createDataFrame(pairs, f"{left} long, {right} long, overlap long")


def equal_sample_summary(means: DataFrame, by: list[str], x: str = "center") -> DataFrame:
    """Band by band over samples: mean, quartiles, number of samples."""
    rows = means.select(*by, F.posexplode(x).alias("band", "v"))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.75)))
    out = rows.groupBy(*by, "band").agg(F.avg("v").alias("mean"), q.alias("q"), F.count(F.lit(1)).alias("sample_count"))
    return out.select(*by, F.col("band").cast("long").alias("band"), "mean", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75"), "sample_count")
