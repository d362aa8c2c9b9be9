"""Fingerprints of tables that don't depend on order or partitions, and writing only what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> DataFrame:
    """column, kind, rows, nulls, low, high: for each column and for whole rows (column null), the sums of the two halves of a SHA-256 of
    each value's JSON.

    Sums add up inside tasks and in any order, so equal rows in any order or partitioning have equal fingerprints, and repeated rows
    count. A changed, added or lost row changes the whole row's sums, a changed value its column's, too (but for a chance of 2^-64)."""

    def sums(value, name: str) -> list:
        digest = F.sha2(value.cast("binary"), 256)
        half = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)"))
        return [half(1).alias(f"low_{name}"), half(16).alias(f"high_{name}")]

    kinds = [None, *(f.dataType.simpleString() for f in df.schema.fields)]
    names = [None, *df.columns]
    as_json = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    values = [as_json(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns))), *(as_json(F.col(f"`{c}`").alias("v")) for c in df.columns)]
    found = [F.count(F.lit(1)).alias("rows")]
    for i, (name, value) in enumerate(zip(names, values, strict=True)):
        found += [F.count_if(F.col(f"`{name}`").isNull()).alias(f"nulls_{i}") if name is not None else F.lit(0).cast("long").alias(f"nulls_{i}"), *sums(value, str(i))]
    each = [
        F.struct(F.lit(n).cast("string").alias("column"), F.lit(k).cast("string").alias("kind"), F.col("rows"), F.col(f"nulls_{i}").alias("nulls"), *(F.coalesce(F.col(f"{half}_{i}").cast("string"), F.lit("0")).alias(half) for half in ("low", "high")))
        for i, (n, k) in enumerate(zip(names, kinds, strict=True))
    ]
    return df.agg(*found).select(F.inline(F.array(*each)))


def changed_columns(new: DataFrame, old: DataFrame) -> DataFrame:
    """column, change of two fingerprints: added, removed, retyped or changed; no rows where the tables are equal."""
    both = new.alias("n").join(old.alias("o"), F.col("n.column").eqNullSafe(F.col("o.column")), "full")
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("rows", "nulls", "low", "high")]
    change = F.when(F.col("o.rows").isNull(), "added").when(F.col("n.rows").isNull(), "removed").when(~F.col("n.kind").eqNullSafe(F.col("o.kind")), "retyped")
    change = change.when(~(same[0] & same[1] & same[2] & same[3]), "changed")
    return both.select(F.coalesce("n.column", "o.column").alias("column"), change.alias("change")).where("change IS NOT NULL")


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Writes df as Parquet at path unless the same rows lie there; says whether it wrote.

    What lies there is judged by a fingerprint of its own rows, beside them in ``path``-fingerprint, which is written last: a write that
    broke off leaves none that fits, and is repeated."""
    spark, beside = df.sparkSession, f"{path.rstrip('/')}-fingerprint"
    new = fingerprint(df).collect()  # a row for each column
    try:
        old = spark.read.parquet(beside).collect()
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error) and "does not exist" not in str(error):
            raise
        old = None
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    if old is not None and key(old) == key(new):
        return False
    schema = fingerprint(df).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(beside)
    df.write.mode("overwrite").parquet(path)
    spark.createDataFrame(new, schema).coalesce(1).write.mode("overwrite").parquet(beside)
    return True
