"""ENVI cubes by blocks of rows: a Spark data source that reads each block by its place in the file.

Headers are small and read when the query is planned; they give each file's blocks, one partition each. A task reads the
bytes of its block alone, so files of any size are split, and a filter on sample or row that is pushed down leaves out
whole blocks before anything is read. Files are opened through Arrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from huegrid.functions import spectra
from huegrid.sources.envi import header_fields, layout

SCHEMA = "sample_id string, pixel_row int, pixel_col int, intensity array<double>"
#: Names of headers (with the mode of acquisition, if any), and of the two references.
NAME, REFERENCES = r"(?:(?P<mode>\d{3})hz_)?(?P<sample>[^/.]+)\.hdr$", ("white", "dark")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: References of more bytes are joined instead of broadcast.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Cube:
    sample_id: str
    raw: str
    lines: int
    samples: int
    bands: int
    dtype: str
    order: tuple[int, int, int]
    offset: int
    wavelengths: tuple[float, ...]
    x_start: int

    @property
    def bytes(self) -> int:
        return self.lines * self.samples * self.bands * np.dtype(self.dtype).itemsize


def _system(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def discovered(folder: str, mode: str | None = None, width: int | None = None, bands: int | None = None, references: bool = False) -> list[Cube]:
    """The cubes below a folder by name, or its references, from their headers alone.

    Raises on a missing or short raw file, a second header of a sample, a width or number of bands that isn't the expected
    one, a frame rate that isn't the mode's, and where nothing is found."""
    from pyarrow.fs import FileSelector

    system, root = _system(folder)
    files = {f.path: f.size for f in system.get_file_info(FileSelector(root, recursive=True)) if f.is_file}
    cubes: dict[str, Cube] = {}
    for path in sorted(files):
        match = re.search(NAME, path)
        if match is None or (mode is not None and match["mode"] != mode) or (match["sample"] in REFERENCES) != references:
            continue
        name, raw = match["sample"], path[: -len(".hdr")] + ".raw"
        if name in cubes:
            raise ValueError(f"a second header for {name}: {path}")
        if raw not in files:
            raise ValueError(f"no raw file for {path}")
        with system.open_input_file(path) as f:
            fields = header_fields(f.read().decode("utf-8"))
        at = layout(fields)
        cube = Cube(name, raw, at["lines"], at["samples"], at["bands"], at["dtype"], at["order"], at["offset"], tuple(at["wavelengths"]), int(fields.get("x start", 0)))
        wrong = [f"{what} {got} instead of {want}" for what, got, want in (("width", cube.samples, width), ("bands", cube.bands, bands), ("bytes", files[raw], cube.offset + cube.bytes)) if want not in (None, got)]
        if mode and "fps" in fields and not np.isclose(float(fields["fps"]), int(mode)):
            wrong.append(f"{fields['fps']} frames a second in mode {mode}")
        if wrong or min(cube.lines, cube.samples, cube.bands) < 1:
            raise ValueError(f"{path}: {', '.join(wrong) or 'empty'}")
        cubes[name] = cube
    if not cubes:
        raise ValueError(f"no {'references' if references else 'cubes'} in {folder}" + (f" for mode {mode}" if mode else ""))
    return list(cubes.values())


@dataclass
class Block(InputPartition):
    cube: Cube
    first: int
    last: int  # exclusive


def block_values(file, cube: Cube, first: int, last: int) -> np.ndarray:
    """Rows first..last of a cube (line, sample, band), read by their place in the file."""
    size, lines = np.dtype(cube.dtype).itemsize, last - first
    if cube.order == (1, 2, 0):  # bands apart: a stretch of each
        stretch, band = cube.samples * size, cube.lines * cube.samples * size
        parts = [file.read_at(lines * stretch, cube.offset + b * band + first * stretch) for b in range(cube.bands)]
        return np.frombuffer(b"".join(parts), cube.dtype).reshape(cube.bands, lines, cube.samples).transpose(1, 2, 0)
    line = cube.samples * cube.bands * size
    values = np.frombuffer(file.read_at(lines * line, cube.offset + first * line), cube.dtype)
    if cube.order == (0, 2, 1):
        return values.reshape(lines, cube.bands, cube.samples).transpose(0, 2, 1)
    return values.reshape(lines, cube.samples, cube.bands)


class BlockReader(DataSourceReader):
    def __init__(self, folder: str, cubes: list[Cube], rows: int):
        self.folder, self.cubes, self.rows = folder, cubes, rows
        self.low, self.high = 0, max(c.lines for c in cubes)

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Leaves out samples and narrows the rows; Spark evaluates all filters again."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("sample_id",) and isinstance(f, EqualTo | In):
                wanted = set(f.value if isinstance(f, In) else [f.value])
                self.cubes = [c for c in self.cubes if c.sample_id in wanted]
            elif column == ("pixel_row",):
                if isinstance(f, EqualTo | In):
                    rows = [v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None]
                    self.low, self.high = max([self.low, min(rows, default=0)]), min([self.high, max(rows, default=-1) + 1])
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            yield f

    def partitions(self) -> list[Block]:
        """Blocks start at multiples of ``rows``; those without a wanted row are left out."""
        starts = [(c, k) for c in self.cubes for k in range(0, c.lines, self.rows) if k < self.high and k + self.rows > self.low]
        return [Block(c, max(k, self.low), min(k + self.rows, c.lines, self.high)) for c, k in starts]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.last <= partition.first:
            return
        cube, (system, _) = partition.cube, _system(self.folder)
        with system.open_input_file(cube.raw) as file:
            values = block_values(file, cube, partition.first, partition.last)
        column = pa.array(np.arange(cube.samples, dtype=np.int32))
        ends = pa.array(np.arange(cube.samples + 1, dtype=np.int32) * cube.bands)
        for row, line in enumerate(values, partition.first):  # a row of the image at a time
            flat = pa.array(np.ascontiguousarray(line, np.float64).ravel())
            columns = [pa.array([cube.sample_id] * cube.samples), pa.array(np.full(cube.samples, row, np.int32)), column, pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(columns, ["sample_id", "pixel_row", "pixel_col", "intensity"])


class EnviBlocks(DataSource):
    """Options: mode, width, bands (expected), references (true: white and dark instead of the samples), rows (of a block)."""

    @classmethod
    def name(cls) -> str:
        return "envi_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        get = self.options.get
        number = lambda name: int(get(name)) if get(name) else None
        cubes = discovered(get("path"), get("mode"), number("width"), number("bands"), get("references") == "true")
        return BlockReader(get("path"), cubes, number("rows") or 64)


def read_blocks(spark: SparkSession, folder: str, mode: str | None = None, width: int | None = None, bands: int | None = None, rows: int = 64, references: bool = False) -> DataFrame:
    """sample_id, pixel_row, pixel_col, intensity, one partition for each block of ``rows`` image rows.

    Turns on filter pushdown for Python data sources in this session: where sample_id or pixel_row is compared with values,
    blocks without such rows are not read."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(EnviBlocks)
    options = {"mode": mode, "width": width, "bands": bands, "rows": rows, "references": str(references).lower()}
    return spark.read.format("envi_blocks").options(**{k: str(v) for k, v in options.items() if v is not None}).load(folder)


def _matching(cubes: list[Cube], white: Cube, dark: Cube) -> None:
    """Raises unless the references are one row each, of the same kind, and on the columns and wavelengths of all cubes."""
    same = lambda a, b: len(a.wavelengths) == len(b.wavelengths) and np.allclose(a.wavelengths, b.wavelengths, rtol=0, atol=1e-6)
    wrong = [what for what, bad in (("shape", (white.lines, white.samples, white.bands) != (dark.lines, dark.samples, dark.bands) or white.lines != 1), ("type", white.dtype != dark.dtype), ("x start", white.x_start != dark.x_start), ("wavelengths", not same(white, dark))) if bad]
    wrong += [f"{what} of {c.sample_id}" for c in cubes for what, bad in (("shape", (c.samples, c.bands) != (white.samples, white.bands)), ("x start", c.x_start != white.x_start), ("wavelengths", not same(c, white))) if bad]
    if wrong:
        raise ValueError(f"references don't match: {', '.join(wrong)}")


def read_references(spark: SparkSession, folder: str, mode: str | None = None, width: int | None = None, bands: int | None = None) -> DataFrame:
    """pixel_col, white, dark (spectra of each column of the image) and dtype_max (the greatest value of the file's type, null for floats)."""
    found = {c.sample_id: c for c in discovered(folder, mode, width, bands, references=True)}
    if set(found) != set(REFERENCES):
        raise ValueError(f"a reference is missing: {sorted(set(REFERENCES) - set(found))}")
    _matching([], found["white"], found["dark"])
    kind = np.dtype(found["white"].dtype)
    most = F.lit(float(np.iinfo(kind).max)) if kind.kind in "iu" else F.lit(None).cast("double")
    both = read_blocks(spark, folder, mode, width, bands, references=True).groupBy("pixel_col")
    side = lambda name: F.any_value(F.when(F.col("sample_id") == name, F.col("intensity")), True).alias(name)
    return both.agg(*map(side, REFERENCES)).select("pixel_col", *REFERENCES, most.alias("dtype_max"))


def read_calibrated(spark: SparkSession, folder: str, mode: str | None = None, width: int | None = None, bands: int | None = None, rows: int = 64) -> DataFrame:
    """sample_id, pixel_row, pixel_col, reflectance: (I - D) / (W - D) of each band by the column's references, null where W - D isn't positive.

    Checks that the references fit all cubes first. They are one image row, broadcast up to BROADCAST_BYTES."""
    cubes, refs = discovered(folder, mode, width, bands), {c.sample_id: c for c in discovered(folder, mode, width, bands, references=True)}
    reference = read_references(spark, folder, mode, width, bands).drop("dtype_max")
    _matching(cubes, refs["white"], refs["dark"])
    if 2 * 8 * refs["white"].samples * refs["white"].bands <= BROADCAST_BYTES:
        reference = F.broadcast(reference)
    both = read_blocks(spark, folder, mode, width, bands, rows).join(reference, "pixel_col")
    return both.select("sample_id", "pixel_row", "pixel_col", spectra.calibrated_spectrum(F.col("intensity"), F.col("white"), F.col("dark")).alias("reflectance"))


def write_cubes(pixels: DataFrame, folder: str, wavelengths: list[float], mode: str, dtype: str = "<f4", interleave: str = "bil", x: str = "x") -> None:
    """Pixels (sample_id, pixel_row, pixel_col, x) as one cube for each sample; a cube is one file and is written by one task, which holds it whole."""
    from huegrid.sources.envi import ORDERS, TYPES

    code = next(k for k, v in TYPES.items() if v == dtype[1:])
    axes = {"bip": (0, 1, 2), "bil": (0, 2, 1), "bsq": (2, 0, 1)}[interleave]
    assert interleave in ORDERS

    def one(key, frame):
        frame = frame.sort_values(["pixel_row", "pixel_col"])
        lines, samples = int(frame.pixel_row.max()) + 1, int(frame.pixel_col.max()) + 1
        values = np.array(frame[x].tolist(), dtype).reshape(lines, samples, len(wavelengths))
        head = f"ENVI\nsamples = {samples}\nlines = {lines}\nbands = {len(wavelengths)}\nheader offset = 0\ndata type = {code}\ninterleave = {interleave}\nbyte order = {int(dtype[0] == '>')}\nfps = {int(mode)}\nx start = 0\n"
        head += f"wavelength = {{{', '.join(map(str, wavelengths))}}}\n"
        system, root = _system(folder)
        system.create_dir(root, recursive=True)
        for end, content in (("raw", values.transpose(axes).tobytes()), ("hdr", head.encode())):
            with system.open_output_stream(f"{root}/{mode}hz_{key[0]}.{end}") as f:
                f.write(content)
        return frame[["sample_id"]].head(1)

    done = pixels.select("sample_id", "pixel_row", "pixel_col", x).groupBy("sample_id").applyInPandas(one, pixels.select("sample_id").schema)
    done.write.format("noop").mode("overwrite").save()
