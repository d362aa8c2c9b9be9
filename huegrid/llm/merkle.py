"""Merkle manifest of a dataset: ternary hash trees over documents, stored in van Emde Boas layout.

Each source has a tree over its documents in order of their ids; a tree over the sources' roots gives the root of the
dataset. A tree is cut into aligned blocks of ``HEIGHT`` levels. A block's digests lie in one binary value: the upper half
of the levels first, then each subtree below it, each laid out in the same way. Where a node lies is worked out from its
depth and place alone, whatever the height, so the same arithmetic builds a block and finds siblings. The roots of blocks
are the leaves of the next round of blocks, until each tree has one root: a round is one grouping of rows by block, and
each has 729 times fewer nodes than the one before.

Documents are numbered without a window over a source: their leaves are sorted by range over all partitions, and what the
partitions before hold of a source is added to a row's place in its own. Proofs go down the rounds: a block hands to its
leaves its own path to the root and adds the siblings inside itself, so only digests and paths are shuffled, never texts.

Defined results: nulls are part of a leaf ('-'), a null source is a source of its own, before all others; rows with one
id in one source follow each other by their leaf, and equal rows are leaves each; null ids come first; a source of one
row has that row's leaf as root, and a dataset of one source has that source's root; an empty table gives no rows; other
columns are ignored. Texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huegrid.llm.common import table, tidy, written

FAN, HEIGHT = 3, 6
LEVEL = "struct<before: string, after: string>"
#: Columns of a document that its leaf is made of, in this order.
PARTS = ("doc_id", "source", "lang", "n_chars", "text")


# ---- layout -----------------------------------------------------------------


def _nodes(levels: int) -> int:
    """Nodes of a whole subtree."""
    return (FAN**levels - 1) // (FAN - 1)


def address(depth: int, place: np.ndarray, levels: int) -> np.ndarray:
    """Where the nodes at this depth (0 is the root) and these places lie in a whole subtree of so many levels."""
    out = np.zeros(len(place), np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        below = FAN ** (depth - upper)
        out += _nodes(upper) + place // below * _nodes(levels - upper)
        place, depth, levels = place % below, depth - upper, levels - upper
    return out


def _hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(n: int, whole: bool, height: int) -> int:
    """Levels of a block with n leaves: all of height + 1 unless the block is a whole tree, which ends at one node."""
    levels = 1
    while n > FAN ** (levels - 1):
        levels += 1
    return levels if whole else height + 1


def build(leaves: list[str], levels: int) -> bytes:
    """The block's layout: 32 bytes a node, up to the last node that is used."""
    out = np.zeros((_nodes(levels), 32), np.uint8)
    now, last = leaves, 0
    for depth in range(levels - 1, -1, -1):
        at = address(depth, np.arange(len(now)), levels)
        out[at] = np.frombuffer(bytes.fromhex("".join(now)), np.uint8).reshape(-1, 32)
        last = max(last, int(at.max()))
        now = [_hash(now[i : i + FAN]) for i in range(0, len(now), FAN)]
    return out[: last + 1].tobytes()


def paths(layout: bytes, n: int, levels: int) -> Iterator[list[dict[str, str]]]:
    """For each of n leaves, from the leaves upwards: the digests of its siblings before and after it, joined."""
    nodes, rows = np.frombuffer(layout, np.uint8).reshape(-1, 32), []
    for depth in range(levels - 1, 0, -1):
        digests = [d.tobytes().hex() for d in nodes[address(depth, np.arange(n), levels)]]
        rows.append([{"before": "".join(digests[i - i % FAN : i]), "after": "".join(digests[i + 1 : i - i % FAN + FAN])} for i in range(n)])
        n = -(-n // FAN)
    n = len(rows[0]) if rows else n
    for leaf in range(n):
        out, at = [], leaf
        for level in rows:
            out.append(level[at])
            at //= FAN
        yield out


# ---- trees over rows --------------------------------------------------------


@tidy
def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``place``: how many rows of the same tree stand before, in this sorted partition."""
    last, seen = object(), 0
    for batch in batches:
        trees, place = batch.column("tree").to_pylist(), np.empty(batch.num_rows, np.int64)
        for i, tree in enumerate(trees):
            if tree != last:
                last, seen = tree, 0
            place[i], seen = seen, seen + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds at (0, 1, ... within ``tree`` by ``order``) and total (rows of the tree); rows have tree, digest and more."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = ranged.mapInArrow(_placed, rows.withColumn("place", F.lit(0).cast("long")).schema).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "merkle-ranged")
    parts = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    tree = F.struct("tree").alias("same")  # nulls equal each other inside a struct
    before = parts.selectExpr(
        "struct(tree) AS same", "part", "coalesce(sum(n) OVER (PARTITION BY tree ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before", "sum(n) OVER (PARTITION BY tree) AS total"
    )
    return ranged.withColumn("same", tree).join(before, ["same", "part"]).withColumn("at", F.col("place") + F.col("before")).drop("same", "part", "place", "before")


def _blocks(rows: DataFrame, keep: list[str], height: int) -> DataFrame:
    """tree, block, total, levels, layout, root and leaves (at and the columns to keep) of each block of numbered rows."""
    kept = F.array_sort(F.collect_list(F.struct("at", "digest", *keep)))
    groups = rows.groupBy("tree", F.floor(F.col("at") / FAN**height).alias("block"), "total").agg(kept.alias("leaves"))
    groups = groups.select("tree", "block", "total", "leaves", F.transform("leaves", lambda x: x["digest"]).alias("digests"))
    fields = groups.drop("digests").schema.add("levels", T.IntegerType()).add("layout", T.BinaryType()).add("root", T.StringType())

    @tidy
    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels, layouts, roots = [], [], []
            for total, digests in zip(batch.column("total").to_pylist(), batch.column("digests").to_pylist(), strict=True):
                levels.append(levels_of(len(digests), total <= FAN**height, height))
                layouts.append(build(digests, levels[-1]))
                roots.append(layouts[-1][:32].hex())
            columns = [batch.column(c) for c in ("tree", "block", "total", "leaves")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(levels, pa.int32()), pa.array(layouts, pa.binary()), pa.array(roots)], fields.names)

    return written(groups.mapInArrow(built, fields), "merkle-blocks")


def grown(rows: DataFrame, keep: list[str], height: int = HEIGHT) -> list[DataFrame]:
    """The blocks of numbered rows (tree, at, total, digest, more), round by round, until each tree has one block."""
    rounds, block = [_blocks(rows, keep, height)], FAN**height
    most = rounds[0].agg(F.max("total")).first()[0] or 0
    while most > block:
        most = -(-most // block)
        above = rounds[-1].where(F.col("total") > block)
        nodes = above.select("tree", F.col("block").alias("at"), F.ceil(F.col("total") / block).alias("total"), F.col("root").alias("digest"))
        rounds.append(_blocks(nodes, [], height))
    return rounds


def roots(rounds: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """tree and root."""
    tops = [r.where(F.col("total") <= FAN**height).select("tree", "root") for r in rounds]
    out = tops[0]
    for more in tops[1:]:
        out = out.union(more)
    return out


def _siblings(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """A row per leaf of a block: tree, at, the columns to keep, above, and path: the siblings inside the block, then ``above``."""
    one = blocks.schema["leaves"].dataType.elementType
    fields = blocks.select("tree").schema.add("at", T.LongType()).add("inside", T.ArrayType(T.StructType.fromDDL("before string, after string")))
    for c in keep:
        fields = fields.add(c, one[c].dataType)
    fields = fields.add("above", blocks.schema["above"].dataType)

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
            for i in range(batch.num_rows):
                leaves = batch.column("leaves").slice(i, 1).flatten()
                n, same = len(leaves), np.full(len(leaves), i)
                found = list(paths(batch.column("layout")[i].as_py(), n, batch.column("levels")[i].as_py()))
                columns = [batch.column("tree").take(pa.array(same)), leaves.field("at"), pa.array(found, kind), *(leaves.field(c) for c in keep), batch.column("above").take(pa.array(same))]
                yield pa.RecordBatch.from_arrays(columns, fields.names)

    out = blocks.select("tree", "leaves", "layout", "levels", "above").mapInArrow(rows, fields)
    return out.select("tree", "at", *keep, F.concat("inside", "above.path").alias("path"), "above")


def proven(rounds: list[DataFrame], above: DataFrame, keep: list[str], height: int = HEIGHT) -> DataFrame:
    """tree, at, the columns to keep, path (the siblings of each level up to the root) and above, one row per leaf.

    ``above`` has, for each tree, a struct with its path from the tree's root on, and whatever the leaves shall carry along."""
    given = above.select(F.struct("tree").alias("same"), F.lit(0).cast("long").alias("block"), "above")
    below: DataFrame | None = None
    for k in range(len(rounds) - 1, -1, -1):
        blocks = rounds[k].withColumn("same", F.struct("tree"))
        tops = blocks.where(F.col("total") <= FAN**height).join(given, ["same", "block"])
        if below is not None:
            rest = below.select(F.struct("tree").alias("same"), F.col("at").alias("block"), F.col("above").withField("path", F.col("path")).alias("above"))
            tops = tops.unionByName(blocks.where(F.col("total") > FAN**height).join(rest, ["same", "block"]))
        below = _siblings(tops, keep if k == 0 else [])
    return below


# ---- documents --------------------------------------------------------------


def leaf(text: Column) -> Column:
    """Of a document's columns, with this text: for each its length in UTF-8, ':' and value, or '-' if null; hashed."""

    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(part(text if c == "text" else F.col(c)) for c in PARTS)).cast("binary"), 256)


def manifest(docs: DataFrame, altered: Callable[[Column], Column] | None = None, height: int = HEIGHT) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """doc_id, leaf, altered (the leaf of the text that ``altered`` gives), subroot, root and path per document; and the stored
    blocks of the sources' trees and of the tree over them. ``path`` has the siblings' digests before and after, level by level."""
    text = altered(F.col("text")) if altered else F.col("text")
    leaves = written(docs.select(F.col("source").alias("tree"), "doc_id", leaf(F.col("text")).alias("digest"), leaf(text).alias("altered")), "merkle-leaves")
    keep = ["doc_id", "altered"]
    rounds = grown(numbered(leaves, ["doc_id", "digest"]), keep, height)
    sources = roots(rounds, height).select(F.lit(0).alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest"))
    upper = grown(numbered(sources, ["source"]), ["source"], height)
    none = F.array().cast(f"array<{LEVEL}>")
    root = roots(upper, height).select("tree", F.struct(none.alias("path"), "root").alias("above"))
    given = proven(upper, root, ["source", "digest"], height).select(F.col("source").alias("tree"), F.struct("path", F.col("above.root").alias("root"), F.col("digest").alias("subroot")).alias("above"))
    rows = proven(rounds, given, ["digest", *keep], height)
    return rows.select("doc_id", F.col("digest").alias("leaf"), "altered", "above.subroot", "above.root", "path"), rounds, upper


def proof_digest(path: Column) -> Column:
    """The hash of all siblings from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "").cast("binary"), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, digest, lambda d, x: F.sha2(F.concat(x["before"], d, x["after"]).cast("binary"), 256))


def verified(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """What the manifest says of documents of which some have lost their line breaks."""
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows, _, _ = manifest(docs, lambda text: F.when(struck, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text), height)
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("altered"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, sf_dir) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"))


_LEAF = "sha256(concat({}))".format(", ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in PARTS))
OP13_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT d.*, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents d
), made AS (
  SELECT doc_id, source, {_LEAF} AS leaf,
    CASE WHEN crc & 1 = 1 THEN {_LEAF.replace("text::VARCHAR", "replace(text, chr(10), '')")} ELSE {_LEAF} END AS altered FROM crc
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY source) AS total FROM made
), nodes AS (
  SELECT source, 0 AS level, spot, leaf AS h, total FROM leaves
  UNION ALL
  SELECT source, level + 1, spot // 3, sha256(string_agg(h, '' ORDER BY spot)), any_value((total + 2) // 3) FROM nodes WHERE total > 1 GROUP BY source, level, spot // 3
), subroots AS (
  SELECT source, h AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spot, count(*) OVER () AS total FROM nodes WHERE total = 1
), upper AS (
  SELECT 0 AS level, spot, subroot AS h, total FROM subroots
  UNION ALL
  SELECT level + 1, spot // 3, sha256(string_agg(h, '' ORDER BY spot)), any_value((total + 2) // 3) FROM upper WHERE total > 1 GROUP BY level, spot // 3
), steps AS (
  SELECT l.source, l.spot AS leaf_at, n.level, n.spot < l.spot // (3 ** n.level)::BIGINT AS before, n.spot, n.h FROM leaves l JOIN nodes n
    ON n.source IS NOT DISTINCT FROM l.source AND n.spot // 3 = l.spot // (3 ** (n.level + 1))::BIGINT AND n.spot <> l.spot // (3 ** n.level)::BIGINT AND n.total > 1
  UNION ALL
  SELECT l.source, l.spot, s.height + n.level, n.spot < s.spot // (3 ** n.level)::BIGINT, n.spot, n.h FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
    JOIN upper n ON n.spot // 3 = s.spot // (3 ** (n.level + 1))::BIGINT AND n.spot <> s.spot // (3 ** n.level)::BIGINT AND n.total > 1
), proofs AS (
  SELECT source, leaf_at AS spot, sha256(string_agg(h, '' ORDER BY level, steps.spot)) AS proof FROM steps GROUP BY source, leaf_at
), sides AS (
  SELECT source, leaf_at AS spot, level, coalesce(string_agg(h, '' ORDER BY steps.spot) FILTER (before), '') AS l, coalesce(string_agg(h, '' ORDER BY steps.spot) FILTER (NOT before), '') AS r
  FROM steps GROUP BY source, leaf_at, level
), fold AS (
  SELECT l.source, l.spot, 0 AS level, altered AS h, (SELECT max(level) FROM upper) + s.height AS height FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
  UNION ALL
  SELECT f.source, f.spot, f.level + 1, sha256(coalesce(s.l, '') || f.h || coalesce(s.r, '')), f.height FROM fold f
    LEFT JOIN sides s ON s.source IS NOT DISTINCT FROM f.source AND s.spot = f.spot AND s.level = f.level WHERE f.level < f.height
)
SELECT l.doc_id, l.leaf, s.subroot, u.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = u.h AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN upper u ON u.total = 1
JOIN fold f ON f.source IS NOT DISTINCT FROM l.source AND f.spot = l.spot AND f.level = f.height
LEFT JOIN proofs p ON p.source IS NOT DISTINCT FROM l.source AND p.spot = l.spot
"""
