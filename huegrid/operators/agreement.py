"""How far two labelings of the same rows agree: accuracy, accuracy under the best matching, mutual information."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huegrid.operators.maps import contingency
from huegrid.operators.models import assigned, best_assignment


def accuracy(rows: DataFrame, truth: str, found: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, rows, accuracy (percent): the share of rows with equal labels; rows without one of them count as wrong."""
    right = F.coalesce(F.col(truth) == F.col(found), F.lit(False))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), (100 * F.avg(right.cast("double"))).alias("accuracy"))


def _log_factorial(n: np.ndarray) -> np.ndarray:
    x = np.asarray(n, np.float64) + 9  # Stirling's series for x - 1 = n + 8, then back by eight factors
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return series - sum(np.log(x - k) for k in range(1, 9))


def expected_information(a: np.ndarray, b: np.ndarray) -> float:
    """The mean mutual information (nats) of two labelings with class sizes a and b, over all permutations of the rows.

    Of a cell's hypergeometric counts, those beyond twelve deviations from the mean are below rounding."""
    n, total = int(a.sum()), 0.0
    for x in a.tolist():
        for y in b.tolist():
            mean = x * y / n
            reach = 40 + 12 * np.sqrt(mean * (1 - x / n) * (n - y) / max(1, n - 1))
            k = np.arange(max(1, x + y - n, int(mean - reach)), min(x, y, int(mean + reach) + 1) + 1, dtype=np.float64)
            f = _log_factorial
            chance = f(x) + f(y) + f(n - x) + f(n - y) - f(n) - f(k) - f(x - k) - f(y - k) - f(n - x - y + k)
            total += float((k / n * np.log(n * k / (x * y)) * np.exp(chance)).sum())
    return total


def cluster_agreement(table: DataFrame, labels: int, left: str = "l1", right: str = "l2") -> DataFrame:
    """acc (best one-to-one matching), nmi (over the mean entropy), ami (over the greater entropy), in percent, and the rows.

    ``table`` holds counts n of labels 1..labels; its labels^2 sums come to the driver. A label out of range is an error."""
    counts = np.zeros((labels, labels), np.int64)
    for r in table.groupBy(left, right).agg(F.sum("n").alias("n")).collect():
        if not (r[left] and r[right] and 1 <= r[left] <= labels and 1 <= r[right] <= labels):
            raise ValueError(f"labels must be in 1..{labels}")
        counts[r[left] - 1, r[right] - 1] = r.n
    n = int(counts.sum())
    if not n:
        raise ValueError("no labelled rows")
    matched = sum(int(counts[i, c]) for i, c in enumerate(best_assignment(counts)))
    a, b = (s[s > 0] for s in (counts.sum(1), counts.sum(0)))
    entropy = [float(-(s / n * np.log(s / n)).sum()) for s in (a, b)]
    i, j = np.nonzero(counts)
    cell = counts[i, j]
    information = max(0.0, float((cell / n * (np.log(cell) + np.log(n) - np.log(counts.sum(1)[i]) - np.log(counts.sum(0)[j]))).sum()))
    if len(a) == len(b) == 1:
        nmi = ami = 1.0
    else:
        chance = expected_information(a, b)
        nmi, room = information / max(sum(entropy) / 2, 1e-300), max(entropy) - chance
        ami = (information - chance) / (room if abs(room) > 1e-15 else np.copysign(1e-15, room))
    return table.sparkSession.createDataFrame([(n, 100 * matched / n, 100 * nmi, 100 * ami)], "rows long, acc double, nmi double, ami double")


def held_out_scores(test: DataFrame, model: DataFrame, labels: int, truth: str = "label", x: str = "x") -> DataFrame:
    """train_rows, test_rows, acc, nmi, ami: a model fitted elsewhere (cluster from 0, center, rows) held against the true labels 1..labels of ``test``.

    Its centres stay as they are. A test row without a vector or a label is an error, not left out; so is a model of more clusters than labels."""
    rows = test.select(F.col(truth).alias("l1"), F.col(x).alias("x"))
    if rows.where("l1 IS NULL OR x IS NULL").head(1):
        raise ValueError("test rows need a vector and a label")
    found = assigned(rows, model, "x").select("l1", (F.col("label") + 1).alias("l2"))
    scores = cluster_agreement(contingency(found, by=()), labels)
    return scores.crossJoin(model.agg(F.sum("rows").alias("train_rows"))).withColumnRenamed("rows", "test_rows").select("train_rows", "test_rows", "acc", "nmi", "ami")  # one row each
