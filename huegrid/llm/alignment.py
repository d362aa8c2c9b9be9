"""Alignment of two tokenizers' tokens, by lockstep merging of all documents of a batch.

A document is encoded by A (byte-level BPE) and B (sentence pieces); both give the same bytes, cut at other places. One
state vector holds, for every document of the batch that isn't finished, how many A and B tokens lie behind it. In each
step every document moves on: past the token that ends first, or past both where they end at the same byte. There a cut
is emitted, with the group of A and B tokens that it closes; all pairs of a group are links. Documents that reach their
last byte leave the vector.

Each document's distinct pairs, with how many links each has there, are written to the shared folder; Spark counts the
documents of each pair from that table. Where there are at most ``broadcast_pairs`` distinct pairs their counts are
broadcast and looked up row by row, without a shuffle; a larger table is joined with the documents' pairs.

Defined results: null and empty texts, and texts whose tokens don't give back space and text (say, with U+2581), have no
tokens and zeros; repeated rows count as documents each; rows with a null id are aligned; an empty table gives no rows;
columns besides doc_id and text are ignored. A very long text is a batch of its own, in memory in proportion to it; the
pairs of a group are worked off in slices, so a group of any size is.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huegrid.llm.common import by_size, table, tidy, written
from huegrid.llm.packing import _byte_of

#: A text may be cut before a space that follows no white space: no token of A or B crosses such a place.
CUT, ODD = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")
BATCH_BYTES = 2 << 20
#: Links that are held at once.
SLICE = 1 << 18
BROADCAST_PAIRS = 4 << 20


class Pair:
    """Both tokenizers. Texts are cut into pieces at safe places, and each distinct piece of a batch is encoded once."""

    def __init__(self, a_path: str | None, b_path: str | None):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            file = json.load(f)
        byte_of, added = _byte_of(), {t["content"] for t in file.get("added_tokens", ())}
        tokens = {i: bytes(map(byte_of.__getitem__, t)) for t, i in file["model"]["vocab"].items() if t not in added}
        self.encode_a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in tokens.items()}, special_tokens={}).encode_ordinary
        b = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path("piece_bpe_32k.model"))
        names, self.blank = [b.id_to_piece(i) for i in range(b.get_piece_size())], [b.piece_to_id("▁")]
        self.encode_b = lambda pieces: b.encode(pieces, num_threads=1)
        if any(re.search("[^▁]▁", p) for p in names):
            raise ValueError("pieces of B may not cross a space")
        self.bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)], [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.lengths = tuple(np.array(list(map(len, side)), np.int32) for side in self.bytes)
        self.size_b = len(names)

    def _apart(self, plain: list[str], odd: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For A and for B: the ids of all pieces one after the other, and how many each has; and whether both give a piece's bytes back.

        Pieces start with a space, which B adds itself. The plain ones don't end in white space, so that A can read them as one text."""
        pieces, raw = plain + odd, [p.encode() for p in plain + odd]
        ids = np.array(self.encode_a("".join(plain)), np.int32)
        ends = np.searchsorted(np.cumsum(self.lengths[0][ids], dtype=np.int64), np.cumsum([len(r) for r in raw[: len(plain)]]))
        rest = [self.encode_a(p) for p in odd]
        sides = [(np.concatenate([ids, np.array([i for x in rest for i in x], np.int32)]), np.concatenate([np.diff(ends, prepend=-1), np.array([len(x) for x in rest], np.int64)]).astype(np.int64))]
        lists = [x if p != " " else self.blank for p, x in zip(pieces, self.encode_b([p[1:] for p in pieces]), strict=True)]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        sides.append((np.fromiter(chain.from_iterable(lists), np.int32, n.sum()), n))
        whole, same = b"".join(raw), np.ones(len(pieces), bool)
        for (flat, n), tokens, lengths in zip(sides, self.bytes, self.lengths, strict=True):
            stops, sizes = np.cumsum(n), np.concatenate([[0], np.cumsum(lengths[flat], dtype=np.int64)])
            if b"".join(map(tokens.__getitem__, flat.tolist())) != whole or not np.array_equal(sizes[stops], np.cumsum([len(r) for r in raw])):
                same &= [b"".join(map(tokens.__getitem__, flat[e - k : e].tolist())) == r for e, k, r in zip(stops.tolist(), n.tolist(), raw, strict=True)]
        return sides, same

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of space and text by A and by B, all texts one after the other, and where each text's start; none for an empty text, or where bytes don't come back."""
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        rows = []
        for text in texts:
            full = " " + text if text else ""
            pieces = CUT.split(full) if ODD.search(full) else [" " + x for x in text.split(" ")] if text else []
            rows.append(np.fromiter(map(numbers.__getitem__, pieces), np.int64, len(pieces)))
        ends_odd = np.fromiter((p[-1].isspace() for p in numbers), bool, len(numbers))
        both: tuple[list[str], list[str]] = ([], [])
        for piece, end in zip(numbers, ends_odd.tolist(), strict=True):
            both[end].append(piece)
        place = np.where(ends_odd, len(both[0]) + np.cumsum(ends_odd) - 1, np.cumsum(~ends_odd) - 1)
        sides, same = self._apart(*both)
        every = place[np.concatenate([*rows, np.empty(0, np.int64)])]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
        if not same.all():
            rows = [every[s:e] if same[every[s:e]].all() else every[:0] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            every, bounds = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
        out = []
        for flat, n in sides:
            start, many = np.cumsum(n) - n, n[every]
            ends = np.concatenate([[0], np.cumsum(many)])
            out.append((flat[np.arange(ends[-1]) + np.repeat(start[every] - ends[:-1], many)], ends[bounds]))
        return out[0][0], out[1][0], out[0][1], out[1][1]


_PAIRS: dict[tuple, Pair] = {}


def _pair(paths: tuple) -> Pair:
    """One pair of encoders for all tasks of a worker."""
    if paths not in _PAIRS:
        _PAIRS[paths] = Pair(*paths)
    return _PAIRS[paths]


@dataclass
class Aligned:
    """A batch: all tokens one after the other, where each document's start, and the groups by document."""

    a: np.ndarray
    b: np.ndarray
    a_from: np.ndarray  # per document, and the end
    b_from: np.ndarray
    group_from: np.ndarray
    a_end: np.ndarray  # per group, in all tokens
    b_end: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.a_from) - 1


def aligned(a: np.ndarray, b: np.ndarray, a_from: np.ndarray, b_from: np.ndarray, lengths: tuple[np.ndarray, np.ndarray]) -> Aligned:
    """Lockstep merging. The bytes of a document's A and B tokens are as many, so ends are counted over the whole batch."""
    ends_a, ends_b = np.cumsum(lengths[0][a], dtype=np.int64), np.cumsum(lengths[1][b], dtype=np.int64)
    most = np.minimum(np.diff(a_from), np.diff(b_from))  # groups of a document
    room = np.concatenate([[0], np.cumsum(most)])
    out_a, out_b, n_groups = np.zeros(room[-1], np.int64), np.zeros(room[-1], np.int64), np.zeros(len(most), np.int64)
    doc = np.flatnonzero(most)
    i, j, g, last = a_from[doc], b_from[doc], room[doc], a_from[doc + 1]
    while len(doc):
        end_a, end_b = ends_a[i], ends_b[j]
        i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        cut = np.flatnonzero(end_a == end_b)
        if len(cut):
            at, behind = g[cut], i[cut]
            out_a[at], out_b[at] = behind, j[cut]
            g[cut] += 1
            over = cut[behind == last[cut]]
            if len(over):
                n_groups[doc[over]] = g[over] - room[doc[over]]
                stay = np.ones(len(doc), bool)
                stay[over] = False
                doc, i, j, g, last = doc[stay], i[stay], j[stay], g[stay], last[stay]
    group_from = np.concatenate([[0], np.cumsum(n_groups)])
    keep = np.arange(group_from[-1]) + np.repeat(room[:-1] - group_from[:-1], n_groups)
    return Aligned(a, b, a_from, b_from, group_from, out_a[keep], out_b[keep])


def _sizes(x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each group's A and B tokens start, and how many it has. The groups of a batch follow each other without gaps."""
    a_start, b_start = np.concatenate([[0], x.a_end[:-1]])[: len(x.a_end)], np.concatenate([[0], x.b_end[:-1]])[: len(x.b_end)]
    return a_start, b_start, x.a_end - a_start, x.b_end - b_start


def links(x: Aligned, size_b: int, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """All links in slices: the documents from first to last (exclusive) that the slice is of, and for each link its document and pair (id of A times size_b plus id of B).

    A slice holds whole documents; one with more than ``most`` links is a run of slices of its own."""
    a_start, b_start, n_a, n_b = _sizes(x)
    before = np.concatenate([[0], np.cumsum(n_a * n_b)])
    by_doc = before[x.group_from]
    owner = np.repeat(np.arange(x.docs), np.diff(x.group_from))
    first = 0
    while first < x.docs:
        last = max(first + 1, int(np.searchsorted(by_doc, by_doc[first] + most, "right")) - 1)
        for start in range(int(by_doc[first]), int(by_doc[last]), most):
            link = np.arange(start, min(start + most, int(by_doc[last])))
            group = np.searchsorted(before, link, "right") - 1
            inside = link - before[group]
            at_a, at_b = a_start[group] + inside // n_b[group], b_start[group] + inside % n_b[group]
            yield first, last, owner[group], x.a[at_a].astype(np.int64) * size_b + x.b[at_b]
        first = last


def _counted(key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often (or with what weight) each stands there."""
    if weight is None:
        return np.unique(key, return_counts=True)
    keys, at = np.unique(key, return_inverse=True)
    return keys, np.bincount(at, weight, len(keys)).astype(np.int64)


def pairs_by_document(x: Aligned, size_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document, pair and its links there, each pair once for a document."""
    span, waiting = 1 << 32, None
    for first, last, doc, pair in links(x, size_b):
        key, n = _counted((doc - first) * span + pair)
        if last == first + 1:  # a document of its own may go on in the next slice
            if waiting and waiting[0] == first:
                key, n = _counted(np.concatenate([waiting[1], key]), np.concatenate([waiting[2], n]))
            elif waiting:
                yield np.full(len(waiting[1]), waiting[0]), waiting[1], waiting[2]
            waiting = first, key, n
            continue
        if waiting:
            yield np.full(len(waiting[1]), waiting[0]), waiting[1], waiting[2]
            waiting = None
        yield first + key // span, key % span, n
    if waiting:
        yield np.full(len(waiting[1]), waiting[0]), waiting[1], waiting[2]


def _written_groups(x: Aligned) -> list[str]:
    """The digest of each document's groups, written as a1,a2|b1;a3|b2,b3."""
    a_start, b_start, n_a, n_b = _sizes(x)
    groups = len(n_a)
    group_a, group_b = np.repeat(np.arange(groups), n_a), np.repeat(np.arange(groups), n_b)
    order_a = np.arange(len(x.a)) + b_start[group_a]
    order_b = np.arange(len(x.b)) + x.a_end[group_b]
    ids, mark = np.empty(len(x.a) + len(x.b), np.int32), np.full(len(x.a) + len(x.b), ord(","), np.uint8)
    ids[order_a], ids[order_b] = x.a, x.b
    mark[order_a[x.a_end - 1]], mark[order_b[x.b_end - 1]] = ord("|"), ord(";")
    digits = np.arange(int(ids.max(initial=0)) + 1).astype("S")
    cells = np.zeros((len(ids), digits.itemsize + 1), np.uint8)
    cells[:, :-1] = digits.view(np.uint8).reshape(-1, digits.itemsize)[ids]
    cells[:, -1] = mark
    ends = x.a_from + x.b_from
    flat = [cells[s:e].tobytes().translate(None, b"\0")[:-1] for s, e in zip(ends[:-1], ends[1:], strict=True)]
    return [hashlib.sha256(text).hexdigest() if text else "" for text in flat]


def _batches(batches: Iterator[pa.RecordBatch], paths: tuple, most: int = BATCH_BYTES) -> Iterator[tuple[pa.Array, Aligned, Pair]]:
    """Rows of at most ``most`` bytes of text at once, or one row."""
    held: list[pa.RecordBatch] = []

    def done() -> tuple[pa.Array, Aligned, Pair]:
        pair, some = _pair(paths), pa.Table.from_batches(held).combine_chunks()
        held.clear()
        a, b, a_from, b_from = pair.encode(some.column("text").to_pylist())
        return some.column("doc_id").combine_chunks(), aligned(a, b, a_from, b_from, pair.lengths), pair

    waiting = 0
    for batch in batches:
        for part in by_size(batch.column("text"), most):
            some = batch.slice(part.start, part.stop - part.start)
            size = pc.sum(pc.binary_length(some.column("text"))).as_py() or 0
            if held and waiting + size > most:
                yield done()
                waiting = 0
            held.append(some)
            waiting += size
    if held:
        yield done()


COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _columns(x: Aligned) -> list[pa.Array]:
    _, _, n_a, n_b = _sizes(x)
    total = np.concatenate([[0], np.cumsum(n_a * n_b)])[x.group_from]
    return [*map(pa.array, (np.diff(x.a_from), np.diff(x.b_from), np.diff(x.group_from), np.diff(total))), pa.array(_written_groups(x), pa.string())]


@tidy
def _with_pairs(batches: Iterator[pa.RecordBatch], paths: tuple) -> Iterator[pa.RecordBatch]:
    """A row per document, with its pairs and their links; ``row`` is a number of its own."""
    context = TaskContext.get()
    row = (context.partitionId() if context else 0) << 40
    for ids, x, pair in _batches(batches, paths):
        found = [*zip(*pairs_by_document(x, pair.size_b), strict=True)] or [[np.empty(0, np.int64)]] * 3
        doc, keys, n = map(np.concatenate, found)
        starts = pa.array(np.searchsorted(doc, np.arange(x.docs + 1)), pa.int32())
        columns = [pa.array(np.arange(row, row + x.docs)), ids, *_columns(x)]
        columns += [pa.ListArray.from_arrays(starts, pa.array(keys, pa.int64())), pa.ListArray.from_arrays(starts, pa.array(n, pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", *(c.split()[0] for c in COUNTS.split(", ")), "pairs", "links"])
        row += x.docs


@tidy
def _looked_up(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """n_best and count_sum from the broadcast table: pairs ascending, their documents, and whether these are the most of their A id."""
    keys, docs, best = known.value
    for batch in batches:
        pairs, n = batch.column("pairs"), batch.column("links").flatten().to_numpy()
        at = np.searchsorted(keys, pairs.flatten().to_numpy())
        ends = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
        total, hits = (np.concatenate([[0], np.cumsum(x[at] * n)])[ends] for x in (docs, best))
        kept = [batch.column(c) for c in batch.schema.names if c not in ("pairs", "links")]
        names = [c for c in batch.schema.names if c not in ("pairs", "links")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(hits)), pa.array(np.diff(total))], [*names, "n_best", "count_sum"])


def aligned_documents(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and pairs and links: distinct pairs (id of A times
    the size of B plus id of B) and how many links each has. The tokenizers are files on the executors."""
    paths = (tokenizer_a, tokenizer_b)
    fields = [T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(COUNTS).fields]
    schema = T.StructType([*fields, *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("pairs", "links"))])
    return docs.select("doc_id", "text").mapInArrow(lambda x: _with_pairs(x, paths), schema)


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """pair, docs (how many documents hold it linked) and best (whether that is the most of the pairs of its A id), for rows of ``aligned_documents``."""
    found = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "alignment-pairs")
    a = F.floor(F.col("pair") / size_b)
    most = found.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    return found.withColumn("a", a).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def token_links(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum per document.

    Up to ``broadcast_pairs`` distinct pairs (17 bytes each) are broadcast; more are joined."""
    size_b = _pair((tokenizer_a, tokenizer_b)).size_b
    rows = written(aligned_documents(docs, tokenizer_a, tokenizer_b), "alignment-rows")
    counts = written(pair_counts(rows, size_b), "alignment-counts")
    if counts.count() <= broadcast_pairs:
        known = counts.toArrow()
        columns = [known.column(c).to_numpy() for c in ("pair", "docs", "best")]
        order = np.argsort(columns[0])
        shared = docs.sparkSession.sparkContext.broadcast(tuple(c[order] for c in columns))
        schema = T.StructType([*rows.drop("row", "pairs", "links").schema.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
        return rows.drop("row").mapInArrow(lambda x: _looked_up(x, shared), schema)
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("n"))
    sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("pairs", "links").join(sums, "row", "left").select("doc_id", *(c.split()[0] for c in COUNTS.split(", ")), *zero)


def op12_tokenizer_alignment(spark, sf_dir) -> DataFrame:
    return token_links(table(spark, sf_dir, "documents")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
