"""N-gram Jaccard join: which documents share at least a given part of their word n-grams.

Method: a blocked sparse matrix product of the document by n-gram incidence matrix. Blocks that can hold a link come
from a partition of the n-gram universe. Two sets A and B with ``|A & B| >= t |A | B|`` differ in at most
``k = |smaller| (1 - t) / t`` members, so of ``k + 1 + 2s`` parts of the hash range at least ``1 + 2s`` hold the same
members in both. Every document emits one hash for each part except its ``s`` emptiest ones, so any linked pair keeps a
common hash: the blocking loses no link, at any size and for any common n-gram. ``k`` follows the size class of the
larger set, and a set also enters the next class when a partner there is still within the size bound.

Inside the blocks, overlap counts are accumulated row against row (hash arrays are sorted), after discarding pairs
whose sizes alone forbid a link. First each set is multiplied with one neighbour only, the smallest member of the block
it shares most often, which joins nearly all members of a group of near copies; then blocks that still hold several
components are tiled and multiplied, tile by tile, as strips of the incidence matrix. Copies with equal sets are one row throughout, and no pair of theirs
is ever made.

Defined results: null or empty texts have no n-grams and link with nothing (their component is their own id); shorter
texts than n words form one n-gram; rows with a null doc_id link with nothing and get a null component; repeated rows
are kept, one result row per input row; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from huegrid.llm.common import Vocabulary, by_size, mix, signed, slices, table, tidy, written

#: Above so many candidate sets, their ids are joined by a shuffle instead of a broadcast (8 bytes each).
BROADCAST_ROWS = 500_000
#: Further products with one neighbour in another component, before all pairs that are left are multiplied.
ROUNDS = 1
#: Sets of one side of a product.
TILE = 256


def size_classes(limit: int, percent: int, growth: float = 1.4) -> list[int]:
    """Lower bounds of the size classes up to ``limit``."""
    bounds = [1]
    while bounds[-1] <= limit:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * growth)))
    return bounds


_BOUNDS = np.array(size_classes(1 << 40, 90), np.int64)


def shingle_hashes(ids: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of the n-grams of one text."""
    h = hashes[ids]
    if not len(h):
        return h
    size = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def block_keys(members: np.ndarray, percent: int) -> np.ndarray:
    """The hashes of the parts under which a set is looked up."""
    n, out = len(members), []
    own = int(np.searchsorted(_BOUNDS, n, "right")) - 1
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(members + np.uint64(1)), out=sums[1:])
        for at in (own, own + 1):
            low, high = int(_BOUNDS[at]), int(_BOUNDS[at + 1]) - 1
            if at > own and 100 * n < percent * low:
                break  # too small for any partner of that class
            k = high * (100 - percent) // percent
            if not k:
                continue  # only equal sets could link, and these are one row already
            spare = k // 16
            parts = k + 1 + 2 * spare
            edges = np.searchsorted(members >> np.uint64(32), (np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts))
            edges[-1] = n
            count = np.diff(edges)
            key = mix(sums[edges[1:]] - sums[edges[:-1]] + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            key = mix(key + np.arange(parts, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(at) * np.uint64(0xE7037ED1A0B428DB))
            out.append(key[np.sort(np.argsort(count, kind="stable")[spare:])] if spare else key)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _set_key(members: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(mix(members).sum(dtype=np.uint64) + np.uint64(len(members)))) if len(members) else 0


@tidy
def _sets(batches: Iterator[pa.RecordBatch], n: int, percent: int, keys: bool) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary()
    for batch in batches:
        for part in by_size(batch.column("text")):
            rows = batch.slice(part.start, part.stop - part.start)
            ids, ends = vocabulary.encode(rows.column("text").to_pylist())
            hashes = vocabulary.hashed()
            members = [shingle_hashes(ids[a:b], hashes, n) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            lists = [block_keys(m, percent) if len(m) else m for m in members] if keys else members
            starts = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=starts[1:])
            flat = signed(np.concatenate(lists)) if lists else np.empty(0, np.int64)
            set_key = signed(np.array([_set_key(m) for m in members], np.uint64))
            values = pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))
            if keys:
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(m) for m in members], pa.int64()), pa.array(set_key), values], ["doc_id", "n_shingles", "set_key", "keys"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(set_key), values], ["set_key", "members"])


@tidy
def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows a, b, x, y (sets a and b with their members): keep the linked pairs."""
    for batch in batches:
        keep = []
        x, y = batch.column("x"), batch.column("y")
        xs, ys = x.offsets.to_numpy(), y.offsets.to_numpy()
        xv, yv = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
        for i in range(batch.num_rows):
            p, q = xv[xs[i] : xs[i + 1]], yv[ys[i] : ys[i + 1]]
            small, large = (p, q) if len(p) <= len(q) else (q, p)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            both = int((large[at] == small).sum())
            keep.append(100 * both >= percent * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) reaches, by alternating large and small stars.
    The least neighbours are written, so that Spark may split the join of a star with many edges.

    Every round is a fixed number of joins and groupings, written to the shared folder; stars of any degree are summed
    map-side, and nothing comes to the driver but a count.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    total = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = down.join(low, "a").where("b <> m").select("b", "m").union(low).toDF("a", "b").distinct()
        edges = written(small, "edges")
        # Done once there are stars only: each node has one smaller centre, and no centre has a centre of its own.
        state = edges.agg(F.count(F.lit(1)), F.count_distinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        centres = edges.select(F.col("b").alias("a")).distinct()
        if state == total or (state[0] == state[1] and edges.join(centres, "a", "left_semi").isEmpty()):
            break
        total = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """The product of two blocks of the incidence matrix, summed over strips of ``width`` n-grams that both blocks have."""
    columns = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float32)
    for part in slices(len(columns), width):
        strip, block = columns[part], []
        for sets in (a, b):
            dense = np.zeros((len(sets), len(strip)), np.float32)
            for row, members in enumerate(sets):
                some = members[np.searchsorted(members, strip[0]) : np.searchsorted(members, strip[-1], "right")]
                at = np.searchsorted(strip, some)
                dense[row, at[strip[at] == some]] = 1
            block.append(dense)
        out += block[0] @ block[1].T
    return out


def _joining(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between different components in blocks (family, i, j) of rows with node, tile, label and members."""
    found: list[tuple[int, int]] = []
    for (_, i, j), block in rows.groupby(["family", "i", "j"], sort=False):
        root: dict[int, int] = {}

        def top(x: int, root: dict[int, int] = root) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        left = block[block.tile == i]
        right = left if i == j else block[block.tile == j]
        sets = [[np.asarray(m, np.int64).view(np.uint64) for m in side.members] for side in (left, right)]
        n, m = (np.array([len(x) for x in side]) for side in sets)
        both = _overlaps(*sets)
        apart = left.label.to_numpy()[:, None] != right.label.to_numpy()[None, :]
        for x, y in np.argwhere(apart & (100 * both >= percent * (n[:, None] + m[None, :] - both))):
            p, q = top(left.label.iat[x]), top(right.label.iat[y])
            if p != q:  # enough links to join the components, not all of them
                root[p] = q
                found.append((left.node.iat[x], right.node.iat[y]))
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def _families(open_: DataFrame, members: DataFrame, percent: int) -> DataFrame:  # open_: key, node, size, label, first
    """Links that join components which meet in a block. Blocks that overlap form a family, a family is cut into tiles
    of TILE sets by size, and each pair of tiles whose sizes allow a link is one product in one task."""
    nodes = open_.groupBy("node").agg(F.first("size").alias("size"), F.first("label").alias("label"))
    family = components(open_.select(F.col("node").alias("a"), F.col("first").alias("b"))).withColumnRenamed("label", "family")
    nodes = nodes.join(family, "node", "left").withColumn("family", F.coalesce("family", "node"))
    nodes = written(nodes, "members")
    # A place by size: that of the size (a window over the sizes of a family) and one by hash among the sets of this size.
    sizes = nodes.groupBy("family", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("family").orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("before") + F.pmod(F.xxhash64("node"), F.col("n"))
    nodes = written(nodes.join(written(sizes, "sizes"), ["family", "size"]).withColumn("tile", F.floor(place / TILE).cast("int")).drop("n", "before"), "families")
    tiles = nodes.groupBy("family", "tile").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    i, j = tiles.select("family", F.col("tile").alias("i"), "high"), tiles.select("family", F.col("tile").alias("j"), "low")
    pairs = i.join(j, "family").where(f"i <= j AND 100 * high >= {percent} * low").select("family", "i", "j")
    pairs = pairs.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    slots = max(1, nodes.count() // 1000)
    pairs = pairs.join(tiles.groupBy("family").agg(F.max("tile").alias("top")), "family")
    pairs = pairs.withColumn("slot", F.when(F.col("top") == 0, F.pmod(F.xxhash64("family"), F.lit(slots))).otherwise(F.col("family")))
    rows = nodes.join(pairs, ["family", "tile"]).join(members.withColumnRenamed("set_key", "node"), "node")
    rows = rows.select("slot", "family", "i", "j", "tile", "node", "label", "members")
    return rows.groupBy("slot", "i", "j").applyInPandas(lambda x: _joining(x, percent), "a long, b long")


def jaccard_groups(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text); see the module's text."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be in 51..100")
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    sets = written(source.mapInArrow(lambda b: _sets(b, n, percent, True), f"doc_id {kind}, n_shingles long, set_key long, keys array<long>"), "sets")
    distinct = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.first("keys").alias("keys"), F.first("n_shingles").alias("size"), F.min("doc_id").alias("doc_id"))
    keyed = distinct.select(F.explode("keys").alias("key"), F.col("set_key").alias("node"), "size")
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low")
    blocks = written(keyed.join(written(shared, "keys"), "key").select("key", "node", "size", "low"), "blocks")
    inside = written(blocks.groupBy("node").agg(F.first("size").alias("size")), "inside")
    wanted = sets.join(inside.select(F.col("node").alias("set_key")), "set_key", "left_semi").groupBy("set_key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    small = inside.count() <= BROADCAST_ROWS
    members = source.join(F.broadcast(wanted) if small else wanted, "doc_id", "left_semi")
    members = members.mapInArrow(lambda b: _sets(b, n, percent, False), "set_key long, members array<long>").join(F.broadcast(inside) if small else inside, F.col("set_key") == F.col("node"), "left_semi")
    members = written(members.groupBy("set_key").agg(F.first("members").alias("members")), "members")

    def product(pairs: DataFrame) -> DataFrame:
        x, y = members.select(F.col("set_key").alias("a"), F.col("members").alias("x")), members.select(F.col("set_key").alias("b"), F.col("members").alias("y"))
        return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(lambda b: _linked(b, percent), "a long, b long")

    fits = f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)"
    sizes = inside.select(F.col("node").alias("low"), F.col("size").alias("size_b"))
    star = blocks.where("node <> low").groupBy("node", "low").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size_a")).join(sizes, "low").where(fits)
    star = star.groupBy("node").agg(F.max_by("low", F.struct("n", F.negate("low"))).alias("b")).select(F.col("node").alias("a"), "b")
    links = written(product(star), "links")
    label = components(links)
    for turn in range(ROUNDS + 1):
        named = blocks.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        order = F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), "node", "size", "label")
        named = written(named, "named")
        hubs = named.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min(order).alias("hub"), F.min("node").alias("first")).where("l0 <> l1")
        hubs = written(hubs.select("key", "first", F.col("hub.node").alias("b"), F.col("hub.size").alias("size_b"), F.col("hub.label").alias("label_b")), "hubs")
        open_ = written(named.select("key", "node", "size", "label").join(hubs, "key"), "open")
        if turn == ROUNDS:
            break
        star = open_.where("label <> label_b").withColumnRenamed("size", "size_a").where(fits).groupBy("node", "b").agg(F.count(F.lit(1)).alias("n"))
        star = star.groupBy("node").agg(F.max_by("b", F.struct("n", "b")).alias("b")).select(F.col("node").alias("a"), "b")
        found = written(product(star), "links")
        if found.isEmpty():
            continue
        links = links.union(found)
        label = components(links)
    more = written(_families(open_.select("key", "node", "size", "label", "first"), members, percent), "links")
    label = components(links.union(more))
    named = sets.select("doc_id", "n_shingles", "set_key").join(label, F.col("set_key") == F.col("node"), "left").withColumn("label", F.coalesce("label", "set_key"))
    grouped = F.expr("n_shingles > 0 AND doc_id IS NOT NULL")
    least = written(named.where(grouped).groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    full = named.where(grouped).join(least, "label").select("doc_id", "n_shingles", "component_id")
    return full.union(named.where(~grouped).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op8_ngram_jaccard(spark, sf_dir) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))
