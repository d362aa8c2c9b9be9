"""Packing: documents into context windows of several sizes, with hardly any padding.

Each task packs the documents that it reads. A document of n ids fills whole windows of the longest tier; its rest is
routed to the smallest tier that holds it. A long window is opened by a rest of the longest tier, and its gap is filled
from the shorter tiers, longest first; the piece that closes the gap is cut, and what is left of it is routed again.
Shorter tiers pack windows of their own size the same way once enough rests wait there. What remains at a task's end
goes into windows of powers of two, so no window needs padding unless its size is none. Windows are dealt to step
groups of ``step_tokens`` ids, each window to the first open group with room, so all closed groups weigh the same.

Nothing is shuffled and no state but one task's waiting rests (at most ``waiting`` a tier) is held; a task that runs
again gives the same pieces.

Defined results: null text is empty and has its end id alone; repeated rows and rows with a null id are packed like any
other; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from struct import pack


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from huegrid.llm.common import by_size, table, tidy

SEGMENT = re.compile(" ?[^ ]+")
RARE_SPACE = re.compile(r"[^\S \n]")
SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest counted up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Texts to little-endian 32-bit ids of a byte-level BPE tokenizer file, with the words of a worker remembered.

    The vocabulary is the file's own; its merges stand in the order of their ids, so ids serve as ranks. Pieces never
    cross a single space, so a text without other white space beside a space is encoded word by word."""

    def __init__(self, path: str | None, limit: int = 300_000, longest: int = 64):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.added = {token["content"]: pack("<I", token["id"]) for token in file.get("added_tokens", ())}
        self.split = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        byte_of, special = _byte_of(), "<|endoftext|>"
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in model["vocab"].items() if token != special}
        self.encode_one = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.limit, self.longest = limit, longest  # words of more characters are not remembered

    @staticmethod
    def _splits(text: str) -> bool:
        return not (text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text or RARE_SPACE.search(text))

    def encode(self, text: str) -> bytes:
        if not self._splits(text):
            return np.array(self.encode_one(text), "<u4").tobytes()
        known, words = self.known, SEGMENT.findall(text)
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            out = []
            for word in words:
                if (ids := known.get(word)) is None:
                    ids = np.array(self.encode_one(word), "<u4").tobytes()
                    if len(word) <= self.longest:
                        known[word] = ids
                out.append(ids)
            return b"".join(out)

    def encode_added(self, text: str) -> bytes:
        """As the tokenizer library does by default: added tokens inside the text are ids of their own, and what is between is encoded apart."""
        out, at = [], 0
        for m in self.split.finditer(text) if self.split else ():
            out += [self.encode(text[at : m.start()]), self.added[m.group()]]
            at = m.end()
        return b"".join([*out, self.encode(text[at:])]) if out else self.encode(text)


_ENCODERS: dict[str | None, Encoder] = {}


def encoder_of(path: str | None) -> Encoder:
    """One encoder for all tasks of a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    def __init__(self, size: int, smallest: int, step_tokens: int, waiting: int, first_id: int):
        self.tiers = [size >> i for i in range(size.bit_length()) if size >> i >= smallest]
        self.size, self.step_tokens, self.waiting = size, step_tokens, waiting
        self.rests: dict[int, deque] = {t: deque() for t in self.tiers}
        self.groups: dict[int, int] = {}  # open step groups and their free room
        self.next_group = self.next_id = first_id
        self.out: list[tuple] = []

    def _emit(self, tier: int, pieces: list) -> None:
        total = sum(p[2] for p in pieces)
        group = next((g for g, room in self.groups.items() if room >= total), None)
        if group is None:
            group, self.next_group = self.next_group, self.next_group + 1
            self.groups[group] = self.step_tokens
        self.groups[group] -= total
        if not self.groups[group]:
            del self.groups[group]
        at = 0
        for doc, start, length, ids, n in pieces:
            self.out.append((doc, start, length, zlib.crc32(ids), n, self.next_id, at, tier, group))
            at += length
        self.next_id += 1

    def _route(self, piece: tuple) -> None:
        self.rests[next(t for t in reversed(self.tiers) if t >= piece[2])].append(piece)

    @staticmethod
    def _cut(piece: tuple, length: int) -> tuple[tuple, tuple]:
        doc, start, n, ids, total = piece
        return (doc, start, length, ids[: 4 * length], total), (doc, start + length, n - length, ids[4 * length :], total)

    def add(self, doc, ids: bytes) -> None:
        n = len(ids) // 4
        full = n // self.size * self.size
        for start in range(0, full, self.size):
            self._emit(self.size, [(doc, start, self.size, ids[4 * start : 4 * (start + self.size)], n)])
        if full < n:
            self._route((doc, full, n - full, ids[4 * full :], n))
            for tier in self.tiers:
                while len(self.rests[tier]) > self.waiting and self._pack(tier):
                    pass

    def _pack(self, tier: int) -> bool:
        """One full window of the tier from rests no longer than it; False (and nothing taken) if they don't fill it."""
        below = [t for t in self.tiers if t <= tier]
        if sum(p[2] for t in below for p in self.rests[t]) < tier:
            return False
        pieces, gap, first = [], tier, True
        while gap:
            # The opening rest is of the window's own tier, the fillers are of shorter ones, the longest that fits.
            order = below if first else [t for t in below[1:] if self.rests[t] and self.rests[t][0][2] <= gap] or below[1:] + below[:1]
            piece = self.rests[next(t for t in order if self.rests[t])].popleft()
            if piece[2] > gap:
                piece, left = self._cut(piece, gap)
                self._route(left)
            pieces.append(piece)
            gap, first = gap - piece[2], False
        self._emit(tier, pieces)
        return True

    def close(self) -> None:
        while self._pack(self.size):
            pass
        left = deque(p for t in self.tiers for p in self.rests[t])
        total = sum(p[2] for p in left)
        for bit in reversed(range(total.bit_length())):
            if total >> bit & 1:
                pieces, gap = [], 1 << bit
                while gap:
                    piece = left.popleft()
                    if piece[2] > gap:
                        piece, rest = self._cut(piece, gap)
                        left.appendleft(rest)
                    pieces.append(piece)
                    gap -= piece[2]
                self._emit(1 << bit, pieces)


@tidy
def _pieces(batches: Iterator[pa.RecordBatch], path: str | None, size: int, smallest: int, step_tokens: int, waiting: int, end_id: int, added_tokens: bool) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    packer = Packer(size, smallest, step_tokens, waiting, (context.partitionId() if context else 0) << 40)
    end, kind = np.array([end_id], "<u4").tobytes(), None

    def rows() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*packer.out, strict=True)] or [[]] * 9
        packer.out = []
        types = [kind, *[pa.int64()] * 6, pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        encoder = encoder_of(path)
        encode = encoder.encode_added if added_tokens else encoder.encode
        for part in by_size(batch.column("text")):
            some = batch.slice(part.start, part.stop - part.start)
            for doc, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                packer.add(doc, encode(text or "") + end)
            yield rows()
    if kind is not None:
        packer.close()
        yield rows()


def packed(docs: DataFrame, tokenizer: str | None = None, size: int = 1024, smallest: int = 128, step_tokens: int = 1 << 16, waiting: int = 64, end_id: int = 0, added_tokens: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the window's size), step_group.

    ``tokenizer`` is the tokenizer's file on the executors; by default the public byte-level BPE of 50k entries.
    With ``added_tokens``, its added tokens (<|endoftext|>) become their ids where they stand in a text; otherwise they are text like any other."""
    if size & (size - 1) or smallest & (smallest - 1) or not 1 <= smallest <= size or step_tokens % size:
        raise ValueError("size and smallest are powers of two, and step_tokens is a multiple of size")
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(lambda b: _pieces(b, tokenizer, size, smallest, step_tokens, waiting, end_id, added_tokens), SCHEMA.format(rows.schema["doc_id"].dataType.simpleString()))


def op1_packing(spark, sf_dir) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), added_tokens=True)
