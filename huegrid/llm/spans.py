"""Substring dedup: text covered by a repeated run of consecutive sentences, except at the run's first place.

A text is cut into pieces after words whose value is the least of some ``NEAR`` words in a row, a word's value being its
hash, lowered below all others where a sentence ends (after ``.``, ``!`` or ``?``, and at line ends). So pieces are
sentences, short neighbours of them together and long ones in parts of at most ``NEAR`` words; the cuts depend on the words
around them alone and fall alike in every copy of a passage. From each piece on, the run of the fewest consecutive pieces
that are at least ``min_sentences`` and hold at least ``min_words`` words is hashed (64 bits, over its words). All runs meet
by hash over the whole corpus: the first place of a run is the smallest (doc_id, text, position); everywhere else its pieces
are removed, within the same document too.

In a passage of more than 50 words, the first ``NEAR`` words hold a cut that all copies share, and so do the eight words from
the 25th after it on; all windows that decide about the latter lie in the passage. So every such passage holds a run.

Each task sends a run once, from its first place there, and the further places at once as ranges to remove: a hash shared by
a third of all documents is a row for each task in its shuffle. There is one shuffle of runs and one of what is removed.

Defined results: null and empty texts hold no runs; rows with a null id keep their text; rows with the same id and text
count as one document, rows with the same id and other texts as different ones; of equal places the smallest id stays; texts
of any length are read whole; all other columns pass through ``deduplicated`` unchanged, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from huegrid.llm.common import by_size, mix, signed, table, tidy

NEAR = 9
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = re.compile(r"\s+")
SPACES = np.array([chr(c).isspace() for c in range(0x3001)] + [False])  # the last stands for all code points from there on
LINE = np.isin(np.arange(0x3002), (10, 11, 12, 13, 0x85, 0x2028, 0x2029))
SCRAMBLED = mix(np.arange(0x3002))
STOPS = (ord("."), ord("!"), ord("?"))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values times powers of STEP; a stretch's hash is a difference of two, scaled back."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(STEP, len(values)), out=out[1:])
    return out


def words_at(text: str, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word, and whether a sentence ends there; ``block`` characters and a word at a time."""
    found, at = [], 0
    while at < len(text):
        gap = SPACE.search(text, at + block)
        stop = gap.end() if gap else len(text)
        start, end, value, final = _words(text[at:stop])
        found.append((start + at, end + at, value, final))
        at = stop
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else _words("")


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(code, len(SPACES) - 1)
    edge = np.nonzero(np.diff(SPACES[small], prepend=True, append=True))[0]
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        scrambled = SCRAMBLED[small]
        large = np.nonzero(code >= len(SPACES) - 1)[0]
        scrambled[large] = mix(code[large])
        sums = _sums(scrambled)
        value = mix((sums[end] - sums[start]) * _powers(BACK, len(code) + 1)[start] + (end - start).astype(np.uint64))
    lines = np.concatenate([[0], np.cumsum(LINE[small])])
    after = np.append(start, len(code))[1:]
    return start, end, value, np.isin(code[end - 1], STOPS) | (lines[after] > lines[end])


def runs_of(texts: list[str | None], min_sentences: int = 3, min_words: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash, first and last character position of each run of the texts."""
    whole = "\n".join(t or "" for t in texts)
    at = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])]).astype(np.int64)
    start, end, value, final = words_at(whole)
    n = len(start)
    none = np.empty(0, np.int64)
    if n < NEAR:
        return none, none.astype(np.uint64), none, none
    doc = np.searchsorted(at, start, "right") - 1
    rank = (value >> np.uint64(1)) | np.where(final, np.uint64(0), np.uint64(1 << 63))
    least = rank[: n - NEAR + 1].copy()
    for k in range(1, NEAR):
        np.minimum(least, rank[k : n - NEAR + 1 + k], out=least)
    inside = doc[: n - NEAR + 1] == doc[NEAR - 1 :]
    cut = np.append(doc[1:] != doc[:-1], True)  # the last word of each text
    for k in range(NEAR):
        cut[k : n - NEAR + 1 + k] |= inside & (rank[k : n - NEAR + 1 + k] == least)
    cuts = np.nonzero(cut)[0]
    first = np.concatenate([[0], cuts[:-1] + 1])
    piece = np.maximum(np.searchsorted(cuts, first + min_words - 1), np.arange(len(cuts)) + min_sentences - 1)
    there = piece < len(cuts)
    first, last = first[there], cuts[piece[there]]
    same = doc[first] == doc[last]
    first, last = first[same], last[same]
    with np.errstate(over="ignore"):
        sums = _sums(value)
        key = mix((sums[last + 1] - sums[first]) * _powers(BACK, n)[first] + (last + 1 - first).astype(np.uint64))
    # White space behind a run goes with it, up to the next word or the end of the text.
    stop = np.append(start, len(whole) + 1)[last + 1]
    return doc[first], key, start[first] - at[doc[first]], np.minimum(stop, at[doc[first] + 1] - 1) - at[doc[first]]


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each owner, those that overlap or touch as one."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    far = end + (owner - owner[:1]) * (end.max(initial=0) + 1)  # beyond all ends of the owners before
    reach = np.maximum.accumulate(far)
    new = np.append(True, (owner[1:] != owner[:-1]) | (start[1:] + far[1:] - end[1:] > reach[:-1])) if len(owner) else np.empty(0, bool)
    low = np.nonzero(new)[0]
    return owner[low], start[low], np.maximum.reduceat(end, low) if len(low) else end


@tidy
def _runs(batches: Iterator[pa.RecordBatch], min_sentences: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """Rows run, doc_id, text_key, start, end, gone: of each group of rows every run once, and ranges that are repeats there."""
    for batch in batches:
        for part in by_size(batch.column("text"), 1 << 24):
            rows = batch.slice(part.start, part.stop - part.start)
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text_key", "ascending")]))
            found = []
            for some in by_size(rows.column("text"), 1 << 20):
                doc, *rest = runs_of(rows.column("text").slice(some.start, some.stop - some.start).to_pylist(), min_sentences, min_words)
                found.append((doc + some.start, *rest))
            doc, key, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
            document = pd.MultiIndex.from_arrays([rows.column(c).to_pandas() for c in ("doc_id", "text_key")]).factorize()[0]
            kept = ~pd.Series(document).duplicated().to_numpy()[doc]  # a repeated row counts once
            doc, key, start, end = doc[kept], key[kept], start[kept], end[kept]
            order = np.lexsort((start, doc, key))
            again = np.zeros(len(key), bool)
            again[order[1:]] = key[order[1:]] == key[order[:-1]]
            gone_doc, gone_start, gone_end = merged(doc[again], start[again], end[again])
            doc, start, end = (np.concatenate([x[~again], y]) for x, y in ((doc, gone_doc), (start, gone_start), (end, gone_end)))
            apart = mix(np.arange(len(gone_doc), dtype=np.uint64) + key[:1].sum())  # deals ranges evenly
            take = pa.array(doc)
            gone = pa.array(np.arange(len(doc)) >= len(doc) - len(gone_doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate([key[~again], apart]))), rows.column("doc_id").take(take), rows.column("text_key").take(take), pa.array(start), pa.array(end), gone],
                ["run", "doc_id", "text_key", "start", "end", "gone"],
            )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("text_key"), "text")


def repeated_ranges(docs: DataFrame, min_sentences: int = 3, min_words: int = 25) -> DataFrame:
    """doc_id, text_key (crc32 of the text), ranges (start, end in characters): what to remove, overlapping ranges merged."""
    rows = _keyed(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    kind = rows.schema["doc_id"].dataType.simpleString()
    runs = rows.mapInArrow(lambda b: _runs(b, min_sentences, min_words), f"run long, doc_id {kind}, text_key long, start long, end long, gone boolean")
    order = W.partitionBy("run").orderBy("gone", "doc_id", "text_key", "start")
    later = runs.withColumn("rank", F.dense_rank().over(order)).where("gone OR rank > 1").select("doc_id", "text_key", "start", "end")
    by_doc = W.partitionBy("doc_id", "text_key").orderBy("start", "end")
    reach = F.max("end").over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    later = later.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    islands = later.withColumn("island", F.sum("new").over(by_doc)).groupBy("doc_id", "text_key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return islands.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def without_ranges(text: str, ranges: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in sorted(ranges):
        out.append(text[at:start])
        at = max(at, end)
    return "".join([*out, text[at:]])


def _cut_all(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t if s is None else without_ranges(t, list(zip(s, e, strict=True))) for t, s, e in zip(text, starts, ends, strict=True)])


def _cut(*columns: str) -> Column:
    return F.pandas_udf(_cut_all, "string")(*columns)


def deduplicated(docs: DataFrame, min_sentences: int = 3, min_words: int = 25) -> DataFrame:
    """docs with the repeated sentences removed from ``text``; every row and column stays."""
    found = repeated_ranges(docs, min_sentences, min_words).select(F.struct("doc_id", "text_key").alias("document"), "ranges")
    rows = docs.select(F.struct("*").alias("row"), F.struct("doc_id", F.crc32(F.col("text").cast("binary")).alias("text_key")).alias("document"))
    joined = rows.join(found, "document", "left").select("row", F.col("row.text").alias("text"), "ranges.start", "ranges.end")
    text = F.when(F.col("start").isNull(), F.col("text")).otherwise(_cut("text", "start", "end"))
    return joined.select("row", text.alias("text")).select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*").select(*docs.columns)


def op4_substring_dedup(spark, sf_dir) -> DataFrame:
    """One row for each document that loses text: what is left of it."""
    docs = table(spark, sf_dir, "documents")
    joined = _keyed(docs).join(repeated_ranges(docs), ["doc_id", "text_key"])
    return joined.select(
        "doc_id",
        F.size("ranges").cast("long").alias("n_ranges"),
        F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("removed_chars"),
        _cut("text", "ranges.start", "ranges.end").alias("text"),
    )
