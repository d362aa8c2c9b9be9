"""Benchmark decontamination: latent semantic retrieval of benchmark items in documents, then exact checks.

Words are runs of letters, digits and non-ASCII characters without letter case (A-Z). The words of the benchmark are the
columns of all matrices, so that no two words share one.

1. Document frequencies of the columns over all documents give the weights of TF-IDF.
2. A randomised SVD of the TF-IDF matrix A of the passages (``PASSAGE`` words) of all documents is made by Spark: tasks sum
   ``A^T (A G)`` for a random G, the sums meet by block of rows, and the singular vectors follow from ``G`` and this sum.
3. Every text is read as windows that start at every ``BLOCK``-th word and reach ``BLOCK`` words before and half an item
   and ``BLOCK`` words behind the item's length, so that whatever spans at most one and a half times the item's words lies
   whole in one of them, wherever it starts. Windows without as many of the item's rare words as step 4 can't do without
   are left out: a common subsequence can't be longer than the common words, so this loses nothing. In the others, the run
   of as many words as the item has whose cosine with the item in the latent space is the highest, over all starts, makes
   the window a candidate if this cosine reaches ``least_cosine``. Every word of the benchmark has a weight, however
   common, so a window that holds the item itself has cosine 1; an item without a direction in the space leaves the
   decision to step 4.
4. A candidate counts if the longest common subsequence of item and window holds at least ``share`` of the item's words,
   and at least half of the words of its answer (the item's last sentence) in order.

Benchmark items are the stated query set; they are read in blocks of ``ITEMS``, and each block is one search over all
documents.

Defined results: null and empty texts and items match nothing; items with fewer than ``min_words`` words are too short to
tell and match nothing; repeated rows give repeated results, and of windows of a document that match an item equally well
the one with the higher cosine, then the first, is reported; rows with a null id are searched too; texts of any length are
read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huegrid.llm.common import by_size, table, tidy

RANK, BLOCK, PASSAGE, ITEMS, ROWS = 64, 8, 48, 5000, 32
#: Words of a weight above each of these are counted in a window, the rarest first.
RARE = (6.0, 4.5, 3.0, 2.0, 1.0, 0.0)
PLAIN = bytes(c | 32 if chr(c).isupper() and c < 128 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
ANSWER = re.compile(r"(?<=[.!?])\s+")


def plain_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split() if text else []


class Columns:
    """The words of some texts, numbered from 1; 0 is any other word."""

    def __init__(self, texts: list[str | None]):
        self.of = {w: k for k, w in enumerate(sorted({w for t in texts for w in plain_words(t)}), 1)}
        self.size = len(self.of) + 1

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The columns of all words of the texts, one after the other, and where each text starts (one more entry than texts)."""
        parts, ends = [], np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            words = plain_words(text)
            ends[i + 1] = ends[i] + len(words)
            parts.append(np.fromiter(map(self.of.get, words, repeat(0)), np.int32, len(words)))
        return (np.concatenate(parts) if parts else np.empty(0, np.int32)), ends

    def known(self, texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """By group of rows: the rows, the places and columns of the words that have one, and where each text starts."""
        for part in by_size(texts):
            ids, ends = self.encode(texts.slice(part.start, part.stop - part.start).to_pylist())
            place = np.nonzero(ids)[0]
            yield part, place, ids[place], ends


@tidy
def _frequencies(batches: Iterator[pa.RecordBatch], columns: Columns) -> Iterator[pa.RecordBatch]:
    total = np.zeros(columns.size, np.int64)  # of column 0: the documents
    for batch in batches:
        for part, place, column, ends in columns.known(batch.column("text")):
            doc = np.searchsorted(ends, place, "right") - 1
            total += np.bincount(np.unique(doc * columns.size + column) % columns.size, minlength=columns.size)
            total[0] += part.stop - part.start
    used = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["column", "n"])


def inverse_frequencies(docs: DataFrame, columns: Columns) -> np.ndarray:
    """The weight of each column: log((1 + documents) / (1 + documents with it)), at least 0.05; 0 for column 0."""
    counts = docs.select("text").mapInArrow(lambda b: _frequencies(b, columns), "column long, n long").groupBy("column").agg(F.sum("n").alias("n"))
    total = np.zeros(columns.size)
    for row in counts.collect():  # as many rows as columns
        total[row["column"]] = row.n
    weight = np.maximum(np.log((1 + total[0]) / (1 + total)), 0.05).astype(np.float32)
    weight[0] = 0
    return weight


def _passages(place: np.ndarray, column: np.ndarray, ends: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF rows of length 1 in coordinates: row, column, value, rows without a known word left out."""
    doc = np.searchsorted(ends, place, "right") - 1
    first = np.concatenate([[0], np.cumsum(-(-np.diff(ends) // PASSAGE))])
    cell, count = np.unique((first[doc] + (place - ends[doc]) // PASSAGE) * len(idf) + column, return_counts=True)
    row, column = np.divmod(cell, len(idf))
    row = np.cumsum(np.diff(row, prepend=-1) > 0) - 1
    value = count * idf[column]
    norm = np.sqrt(np.bincount(row, value**2))
    return row, column, (value / norm[row]).astype(np.float32)


@tidy
def _sketch(batches: Iterator[pa.RecordBatch], columns: Columns, idf: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(right.shape, np.float64)
    for batch in batches:
        for _, place, column, ends in columns.known(batch.column("text")):
            if not len(place):
                continue
            row, column, value = _passages(place, column, ends, idf)
            edges = np.searchsorted(row, np.arange(0, row[-1] + 513, 512))
            for low, high in zip(edges[:-1], edges[1:], strict=True):  # 512 passages at a time
                some, c, v = row[low:high], column[low:high], value[low:high, None]
                starts = np.nonzero(np.diff(some, prepend=-1))[0]
                product = np.add.reduceat(right[c] * v, starts, axis=0)
                order = np.argsort(c, kind="stable")
                starts = np.nonzero(np.diff(c[order], prepend=-1))[0]
                total[c[order[starts]]] += np.add.reduceat(product[some[order] - some[0]] * v[order], starts, axis=0)
    blocks = [total[i : i + ROWS] for i in range(0, len(total), ROWS)]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "data"])


def _summed(blocks: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(d) for d in sorted(blocks.data))
    return pd.DataFrame({"block": blocks.block[:1], "data": [total.tobytes()]})


def latent_space(docs: DataFrame, columns: Columns, idf: np.ndarray, seed: int = 11) -> np.ndarray:
    """The first right singular vectors (columns x RANK at most) of the passages of all documents, by a randomised SVD in one pass."""
    rows = docs.select("text")
    rows = rows.coalesce(max(24, rows.rdd.getNumPartitions() // 16))  # each task sends one sketch
    width = min(RANK + 8, columns.size)
    right = np.linalg.qr(np.random.default_rng(seed).normal(size=(columns.size, width)))[0].astype(np.float32)
    parts = rows.mapInArrow(lambda b: _sketch(b, columns, idf, right), "block int, data binary").groupBy("block").applyInPandas(_summed, "block int, data binary")
    found = {r.block: np.frombuffer(r.data) for r in parts.collect()}  # one matrix of columns x width, whatever the input
    if not found:
        return np.zeros((columns.size, 1), np.float32)
    product = np.concatenate([found[k] for k in sorted(found)]).reshape(-1, width)
    core = right.T.astype(np.float64) @ product  # G^T A^T A G; A^T A is product core^-1 product^T up to the rank
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > 1e-9 * max(value.max(), 1e-300)
    vectors, _, _ = np.linalg.svd(product @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    return np.ascontiguousarray(vectors[:, :RANK], np.float32) if good.any() else np.zeros((columns.size, 1), np.float32)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    state = full = (1 << len(a)) - 1
    for y in b:
        hit = state & masks.get(y, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


class Items:
    """Benchmark items in the latent space, and the rare words that a match can't do without."""

    def __init__(self, rows: list, columns: Columns, idf: np.ndarray, space: np.ndarray, min_words: int, share: float):
        self.columns = columns
        self.weighted = (idf**2).astype(np.float32)[:, None] * space  # the weight of a word in the item and in the window; no word of the benchmark has none
        self.levels = []  # rare words, and how many places of them a match must have at least
        self.ids, self.words, self.answers, vectors = [], [], [], []
        for item_id, text in rows:
            words = columns.encode([text])[0]
            if len(words) < min_words:
                continue
            last = plain_words((ANSWER.split((text or "").strip()) or [""])[-1])
            self.ids.append(item_id)
            self.words.append(words.tolist())
            self.answers.append(words[len(words) - len(last) :].tolist())
            weight = idf[words]
            self.levels.append([(np.unique(words[weight > r]), need) for r in RARE if (need := int(np.ceil(share * len(words) - int((weight <= r).sum()) - 1e-9))) > 0])
            v = self.weighted[words].sum(0)
            vectors.append(v / max(np.linalg.norm(v), 1e-9))
        self.vectors = np.array(vectors, np.float32).reshape(-1, space.shape[1])
        # The items of each column of their rarest level, one column after the other.
        some = [(levels or [(np.empty(0, np.int32), 0)])[0] for levels in self.levels]
        word = np.concatenate([w for w, _ in some]) if some else np.empty(0, np.int32)
        item = np.repeat(np.arange(len(some)), [len(w) for w, _ in some])
        self.of_word = item[np.argsort(word, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=columns.size))])
        self.need = np.array([n for _, n in some], np.int64)
        size = np.array([len(w) for w in self.words], np.int64)
        self.behind = np.maximum(1, np.round(size / BLOCK).astype(np.int64)) * BLOCK + size // 2 + BLOCK

    def windows(self, place: np.ndarray, column: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, document and first word (a multiple of BLOCK) of all windows with enough of the item's rarest words."""
        times = self.first[column + 1] - self.first[column]
        hit = np.nonzero(times)[0]
        place, column, times = place[hit], column[hit], times[hit]
        low = self.first[column]
        place = np.repeat(place, times)
        item = self.of_word[np.repeat(low - np.cumsum(times) + times, times) + np.arange(len(place))]
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order]
        doc = np.searchsorted(ends, place, "right") - 1
        last = np.arange(len(place)) + self.need[item] - 1  # with this place, the words from here on are enough
        here = np.nonzero(last < len(place))[0]
        last = last[here]
        good = (item[last] == item[here]) & (doc[last] == doc[here]) & (place[last] - place[here] < self.behind[item[here]] + BLOCK)
        here, last = here[good], last[good]
        if not len(here):
            return (np.empty(0, np.int64),) * 3
        item, doc = item[here], doc[here]
        p, q = place[here] - ends[doc], place[last] - ends[doc]
        low = np.maximum(0, (q - self.behind[item]) // BLOCK + 1)
        times = np.maximum(0, np.minimum(p // BLOCK + 1, (ends[doc + 1] - ends[doc] - 1) // BLOCK) - low + 1)
        block = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        blocks = int(np.diff(ends).max()) // BLOCK + 2
        key = np.unique((np.repeat(item, times) * len(ends) + np.repeat(doc, times)) * blocks + block)
        return key // blocks // len(ends), key // blocks % len(ends), key % blocks * BLOCK

    def nearest(self, item: int, words: np.ndarray) -> tuple[float, int]:
        """Cosine and place of the run of the item's length that is nearest to it; 1 and the window's start where the item has no direction."""
        if not self.vectors[item].any():
            return 1.0, 0
        n = min(len(self.words[item]), len(words))
        sums = np.zeros((len(words) + 1, self.weighted.shape[1]))
        np.cumsum(self.weighted[words], axis=0, out=sums[1:])
        runs = sums[n:] - sums[: len(sums) - n]
        near = runs @ self.vectors[item] / np.maximum(np.sqrt(np.einsum("ij,ij->i", runs, runs)), 1e-9)
        at = int(near.argmax())
        return float(near[at]), at


class Places:
    """The places of each column in a group of texts."""

    def __init__(self, place: np.ndarray, column: np.ndarray, size: int):
        self.at = place[np.argsort(column, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=size))])

    def of(self, columns: np.ndarray) -> np.ndarray:
        return np.sort(np.concatenate([self.at[self.first[c] : self.first[c + 1]] for c in columns.tolist()]))


def _matches(items: Items, place: np.ndarray, column: np.ndarray, ends: np.ndarray, share: float, least_cosine: float) -> dict[tuple[int, int], tuple[float, float, int]]:
    """(document, item): share, cosine, minus the first word of the best window."""
    found: dict[tuple[int, int], tuple[float, float, int]] = {}
    which, doc, start = items.windows(place, column, ends)
    if not len(which):
        return found
    places = Places(place, column, items.columns.size)
    edges = np.append(np.nonzero(np.diff(which, prepend=-1))[0], len(which))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        item, of, at = int(which[a]), doc[a:b], ends[doc[a:b]] + start[a:b]
        low = np.maximum(ends[of], at - BLOCK)
        high = np.minimum(ends[of + 1], at + items.behind[item])
        for rare, needed in items.levels[item]:
            there = places.of(rare)
            good = np.searchsorted(there, high) - np.searchsorted(there, low) >= needed
            of, low, high = of[good], low[good], high[good]
            if not len(of):
                break
        words, answer, own = items.words[item], items.answers[item], set(items.words[item])
        for d, x, y in zip(of.tolist(), low.tolist(), high.tolist(), strict=True):
            i, j = np.searchsorted(place, (x, y))
            window = np.zeros(y - x, np.int32)
            window[place[i:j] - x] = column[i:j]
            near, word = items.nearest(item, window)
            if near < least_cosine:
                continue
            around = [w for w in column[i:j].tolist() if w in own]
            lcs = common_subsequence(words, around) / len(words)
            if lcs >= share and 2 * common_subsequence(answer, around) >= len(answer):
                found[d, item] = max(found.get((d, item), (0.0, -2.0, 0)), (lcs, near, -int(x - ends[d] + word)))
    return found


@tidy
def _search(batches: Iterator[pa.RecordBatch], items: Items, share: float, least_cosine: float) -> Iterator[pa.RecordBatch]:
    item_kind = pa.int64() if all(isinstance(i, int) for i in items.ids) else pa.string()
    for batch in batches:
        out = []
        for part, place, column, ends in items.columns.known(batch.column("text")):
            found = _matches(items, place, column, ends, share, least_cosine)
            ids = batch.column("doc_id").slice(part.start, part.stop - part.start)
            out.extend((ids[d].as_py(), items.ids[item], lcs, cos, -word) for (d, item), (lcs, cos, word) in sorted(found.items()))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [batch.schema.field("doc_id").type, item_kind, pa.float64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "share", "cosine", "first_word"])


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, min_words: int = 8, least_cosine: float = 0.4) -> DataFrame:
    """doc_id, item_id, share (of the item's words, in order), cosine, first_word of each document and item that it holds."""
    rows = docs.select("doc_id", "text")
    kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_kind = "long" if item_kind in ("tinyint", "smallint", "int", "bigint") else "string"
    items = benchmark.select(F.col("item_id").cast(item_kind), "text").where("item_id IS NOT NULL")
    blocks = max(1, -(-items.count() // ITEMS))
    found = None
    for k in range(blocks):
        queries = sorted((r.item_id, r.text or "") for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect())
        columns = Columns([text for _, text in queries])
        idf = inverse_frequencies(rows, columns)
        search = Items(queries, columns, idf, latent_space(rows, columns, idf), min_words, share)
        part = rows.mapInArrow(lambda b, q=search: _search(b, q, share, least_cosine), f"doc_id {kind}, item_id {item_kind}, share double, cosine double, first_word long")
        found = part if found is None else found.union(part)
    return found


def op9_benchmark_decontamination(spark, sf_dir) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
