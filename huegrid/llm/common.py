"""What the corpus operators share: table access, shared storage, words and hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Row groups of tables between stages; a writer holds one in memory.
BLOCK_BYTES = 16 << 20


#: Rows of texts in an Arrow batch, where the session has Spark's default of 10,000: a few MB of usual texts.
BATCH_ROWS, BATCH = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on one machine one of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not (spark.conf.get("spark.master", "") + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="huegrid-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: this cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_columns(df: DataFrame, taken: Iterable[str]) -> str:
    """A column name that neither df nor ``taken`` uses."""
    names = {c.lower() for c in (*df.columns, *taken)}
    name = "_k"
    while name in names:
        name += "_"
    return name


def doc_bucket(modulus: int):
    """crc32(doc_id as text) mod modulus, null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(modulus)


# ---- words ---------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    """Lower-case A-Z; words are runs without space, tab, newline, vertical tab, form feed and return."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Vocabulary:
    """Gives each word of a task a small number; forgets all words once there are too many, or once they may hold too many bytes."""

    def __init__(self, limit: int = 400_000, most: int = 1 << 26):
        self.limit, self.most, self.turn = limit, most, 0
        self.clear()

    def clear(self) -> None:
        self.turn += 1  # tells users that the numbers have changed
        self.seen = 0  # bytes of text, and so at least those of the words
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.hashes = np.empty(0, np.uint64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the texts, one after the other, and where each text starts (one more entry than texts)."""
        if len(self.ids) > self.limit or self.seen > self.most:
            self.clear()
        self.seen += sum(len(t) for t in texts if t)
        get, parts, ends = self.ids.__getitem__, [], np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            words = words_of(text)
            ends[i + 1] = ends[i] + len(words)
            parts.append(np.fromiter(map(get, words), np.uint32, len(words)))
        return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), ends

    def words(self, start: int = 0) -> list[bytes]:
        return list(self.ids)[start:] if start else list(self.ids)

    def hashed(self) -> np.ndarray:
        """The 64-bit hash of every word, by its number."""
        import xxhash

        if (known := len(self.hashes)) < len(self.ids):
            digest, new = xxhash.xxh3_64_intdigest, self.words(known)
            self.hashes = np.concatenate([self.hashes, np.fromiter((digest(w) for w in new), np.uint64, len(new))])
        return self.hashes


def tidy(f: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """For the functions of tasks: what a task used is given back at its end, as Spark keeps the worker for later stages."""

    @wraps(f)
    def rows(*args, **named) -> Iterator:
        try:
            yield from f(*args, **named)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not every C library has it
                pass

    return rows


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of SplitMix64)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def slices(n: int, size: int) -> Iterable[slice]:
    return (slice(i, min(i + size, n)) for i in range(0, n, size))


def by_size(texts: pa.Array, most: int = 1 << 21) -> Iterable[slice]:
    """Rows in groups of at most ``most`` bytes of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(start, stop)
        start = stop
