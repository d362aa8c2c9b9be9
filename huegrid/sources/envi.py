"""ENVI cubes as a table: one row per pixel, read through Spark's binary files, so any store that Spark reads will do."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: data type codes, and interleaves as the order of (line, sample, band) in the file.
TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
ORDERS = {"bip": (0, 1, 2), "bil": (0, 2, 1), "bsq": (1, 2, 0)}
SCHEMA = "sample_id string, pixel_row int, pixel_col int, intensity array<double>"


def header_fields(text: str) -> dict[str, str]:
    if not text.lstrip().upper().startswith("ENVI"):
        raise ValueError("not an ENVI header")
    pairs = re.findall(r"^\s*([^=\n]+?)\s*=\s*(\{[^}]*\}|[^\n]*)", text, re.MULTILINE)
    return {k.lower(): v.strip() for k, v in pairs}


def layout(fields: dict[str, str]) -> dict:
    """Shape, type, offset and wavelengths of a header; wrong or missing values raise."""
    try:
        lines, samples, bands = (int(fields[k]) for k in ("lines", "samples", "bands"))
        kind = ("<", ">")[int(fields.get("byte order", "0"))] + TYPES[int(fields["data type"])]
        order = ORDERS[fields["interleave"].lower()]
    except (KeyError, ValueError, IndexError) as error:
        raise ValueError(f"ENVI header: {error}") from error
    waves = [float(x) for x in fields.get("wavelength", "{}").strip("{}").replace("\n", " ").split(",") if x.strip()]
    if waves and len(waves) != bands:
        raise ValueError(f"ENVI header: {len(waves)} wavelengths for {bands} bands")
    return {"lines": lines, "samples": samples, "bands": bands, "dtype": kind, "order": order, "offset": int(fields.get("header offset", "0")), "wavelengths": waves}


def cube(content: bytes, at: dict) -> np.ndarray:
    """lines x samples x bands."""
    shape = [at["lines"], at["samples"], at["bands"]]
    stored = {(0, 1, 2): shape, (0, 2, 1): [shape[0], shape[2], shape[1]], (1, 2, 0): [shape[2], shape[0], shape[1]]}[at["order"]]
    data = np.frombuffer(content, at["dtype"], offset=at["offset"])
    if data.size != np.prod(shape):
        raise ValueError(f"ENVI data: {data.size} values for {shape}")
    data = data.reshape(stored)
    return {(0, 1, 2): lambda a: a, (0, 2, 1): lambda a: a.transpose(0, 2, 1), (1, 2, 0): lambda a: a.transpose(1, 2, 0)}[at["order"]](data)


def _pixels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for name, header, raw in zip(frame.sample_id, frame.header, frame.raw, strict=True):
            values = cube(bytes(raw), layout(header_fields(bytes(header).decode("utf-8")))).astype(np.float64)
            for row, line in enumerate(values):
                yield pd.DataFrame({"sample_id": name, "pixel_row": row, "pixel_col": range(len(line)), "intensity": list(line)})


def read_cubes(spark: SparkSession, folder: str, pattern: str = r"([^/]+)\.(hdr|raw)$") -> DataFrame:
    """sample_id, pixel_row, pixel_col, intensity of each .hdr with its .raw; a missing partner raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.select(F.regexp_extract("path", pattern, 1).alias("sample_id"), F.regexp_extract("path", pattern, 2).alias("kind"), "content").where("sample_id <> ''")
    both = files.groupBy("sample_id").pivot("kind", ["hdr", "raw"]).agg(F.first("content"))
    lacking = F.raise_error(F.concat(F.lit("no partner for "), F.col("sample_id")))
    both = both.select("sample_id", F.coalesce("hdr", lacking.cast("binary")).alias("header"), F.coalesce("raw", lacking.cast("binary")).alias("raw"))
    return both.mapInPandas(_pixels, SCHEMA)
