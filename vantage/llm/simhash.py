"""Near duplicates by SimHash: fingerprints of word shingles, linked through broadcast BK-trees.

A BK-tree keeps each child under the integer Hamming distance to its parent; a search within a radius follows only the
edges whose key differs from the query's distance by no more than the radius. The different fingerprints are dealt to
shards of about TREE members and each shard becomes a tree. Trees are broadcast in waves of bounded bytes, and every
fingerprint searches the trees of its shards where it lies; queries are not shuffled and never gathered.

Which shards a fingerprint has is a matter of routing alone: two fingerprints within the radius agree on all bits of some
blocks (pigeonhole), so each takes part in one shard for each choice of blocks, by a hash of their bits. A shard holds many
different values of them, and finding the near ones among its members is up to the tree. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import jaccard
from vantage.llm.common import cut, map_arrow, parts, schema_of, table, utf8
from vantage.llm.components import components, keep_one, spanning

LANES = np.uint64(0x0101010101010101)
#: Fingerprints that a tree aims at; a shard of more becomes several trees, all of which its members search.
TREE = 2048
#: Bytes of trees that are broadcast at once, and bytes of a tree per fingerprint.
WAVE, NODE_BYTES = 16 << 20, 20
#: Pairs of a query and a node, or a child of it, that a search step holds at once.
FRONTIER = 1_000_000
#: Linked pairs that a task holds before it reduces them to trees of links.
PAIRS = 1_000_000


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text: A-Z lower-cased, words parted by ASCII white space, shingles with repeats.

    Null and texts without words give 0; fewer words than the width make one shingle of all of them.
    """
    return majority(jaccard.hashes(text, width, seed))


def majority(h: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes, 0 of none."""
    n = len(h)
    if not n:
        return 0
    starts = np.arange(0, n, 255)  # a byte lane holds 255 ones
    counts = np.empty((8, 8), np.int64)  # [bit in byte, byte]
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & LANES, starts)
        counts[bit] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return sum(1 << (8 * byte + bit) for byte in range(8) for bit in range(8) if 2 * counts[bit, byte] > n)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", width: int = 3) -> DataFrame:
    """docs' columns but the text, and the fingerprint as a signed long."""
    names = [c for c in docs.columns if c not in (text, out)]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, width) for t in utf8(batch, text)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(fps)], [*names, out])

    return map_arrow(docs.select(*names, text), kernel, schema_of(docs, names, f"`{out}` long"))


def bk_forest(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, ...]:
    """BK-trees of all groups at once. Returns (root of each group id, child offsets, children, edge keys); nodes are the rows.

    Level by level: the first row of each open subtree becomes its node, the others are dealt to its children by their
    distance to it.
    """
    n = len(fp)
    parent, edge = np.full(n, -1), np.zeros(n, np.int64)
    rows, slot, above, key = np.arange(n), group.astype(np.int64), np.full(n, -1), np.zeros(n, np.int64)
    roots = None
    while len(rows):
        subtrees, first, inverse = np.unique(slot, return_index=True, return_inverse=True)
        nodes = rows[first]
        parent[nodes], edge[nodes] = above[first], key[first]
        if roots is None:
            roots = np.full(int(group.max()) + 1, -1)
            roots[subtrees] = nodes
        rest = np.ones(len(rows), bool)
        rest[first] = False
        rows, node_of, at = rows[rest], inverse[rest], None
        at = nodes[node_of]
        key = np.bitwise_count(fp[rows] ^ fp[at]).astype(np.int64)
        slot, above = node_of * 65 + key, at
    children = np.argsort(parent, kind="stable")
    children = children[parent[children] >= 0]
    offsets = np.searchsorted(parent[children], np.arange(n + 1))
    return (np.full(1, -1) if roots is None else roots), offsets, children, edge[children]


def bk_search(queries: np.ndarray, asking: np.ndarray, start: np.ndarray, fp: np.ndarray, offsets: np.ndarray, children: np.ndarray, keys: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) index pairs within the radius, in pieces. asking, start: queries and the roots at which they begin."""
    stack = [(asking, start)]
    while stack:
        q, node = stack.pop()
        fan = (offsets[node + 1] - offsets[node]).astype(np.int64)
        if len(q) > 1 and len(q) + int(fan.sum()) > FRONTIER:
            half = len(q) // 2
            stack += [(q[half:], node[half:]), (q[:half], node[:half])]
            continue
        d = np.bitwise_count(queries[q] ^ fp[node]).astype(np.int64)
        hit = d <= radius
        if hit.any():
            yield q[hit], node[hit]
        total = int(fan.sum())
        if not total:
            continue
        reached = np.repeat(offsets[node] - np.concatenate(([0], np.cumsum(fan)[:-1])), fan) + np.arange(total)
        near = np.abs(keys[reached] - np.repeat(d, fan)) <= radius
        if near.any():
            stack.append((np.repeat(q, fan)[near], children[reached[near]]))


def blocks_of(n_rows: int, radius: int) -> list[int]:
    """Bit masks, one per choice of agreeing blocks. Two values within the radius differ in at most `radius` blocks, so they agree
    on all others; more rows take more blocks, hence more bits that agree, so that shards can be told apart by them."""
    blocks = radius + (1 if n_rows <= 1 << 26 else 2 if n_rows <= 1 << 34 else 3)
    bounds = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    return [sum(masks[j] for j in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def shard_of(fp: Column, mask: int, family: int, shards: int) -> Column:
    bits = fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))
    return F.pmod(F.xxhash64(bits, F.lit(family)), F.lit(shards)).cast("int")


@dataclass(frozen=True)
class Wave:
    """Trees of some shards. The roots of the shard that is the i-th of its family lie at roots[first[family][i] :]."""

    shards: list[np.ndarray]
    first: list[np.ndarray]
    roots: np.ndarray
    fp: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    keys: np.ndarray

    def begin(self, family: int, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, root) for queries of the given shards."""
        own, first = self.shards[family], self.first[family]
        if not len(own):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(own, shard), len(own) - 1)
        n = np.where(own[at] == shard, first[at + 1] - first[at], 0)
        q = np.repeat(np.arange(len(shard)), n)
        return q, self.roots[np.repeat(first[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(q))]


def trees(distinct: DataFrame, fp: str, masks: list[int], shards: int, tree: int) -> DataFrame:
    """(family, shard, fps, offsets, children, keys): the BK-trees of all shards, arrays as bytes. A task builds those it is dealt,
    together; a shard of more than `tree` members is dealt by a hash to several trees."""
    families = F.explode(F.array(*[F.struct(F.lit(i).alias("family"), shard_of(F.col(fp), m, i, shards).alias("shard")) for i, m in enumerate(masks)]))
    keyed = distinct.select(F.col(fp).alias("fp"), families.alias("k")).select("fp", "k.family", "k.shard")
    pieces = keyed.groupBy("family", "shard").agg(F.ceil(F.count("*") / (2 * tree)).cast("int").alias("pieces"))
    dealt = keyed.join(pieces, ["family", "shard"]).withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    dealt = dealt.select("fp", "family", "shard", "piece").repartition(parts(distinct.sparkSession, shards * tree * len(masks), 400_000), "family", "shard", "piece")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # rows of 20 bytes; a task gets about 400,000, whatever the shards
        if not held:
            return
        got = pa.Table.from_batches(held)
        f, family, shard, piece = (got.column(c).to_numpy() for c in ("fp", "family", "shard", "piece"))
        order = np.lexsort((f, piece, shard, family))
        f, family, shard, piece = f[order].view(np.uint64), family[order], shard[order], piece[order]
        new = np.ones(len(f), bool)
        new[1:] = (family[1:] != family[:-1]) | (shard[1:] != shard[:-1]) | (piece[1:] != piece[:-1])
        bounds = [*np.flatnonzero(new).tolist(), len(f)]
        _, offsets, children, keys = bk_forest(np.cumsum(new) - 1, f)
        for a, b in zip(bounds, bounds[1:], strict=False):
            lo, hi = offsets[a], offsets[b]
            values = [f[a:b].astype("<u8"), (offsets[a : b + 1] - lo).astype("<i4"), (children[lo:hi] - a).astype("<i4"), keys[lo:hi].astype("u1")]
            yield pa.RecordBatch.from_arrays([pa.array([family[a]], pa.int32()), pa.array([shard[a]], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], ["family", "shard", "fps", "offsets", "children", "keys"])

    return dealt.mapInArrow(build, "family int, shard int, fps binary, offsets binary, children binary, keys binary")


def wave_of(rows: list, families: int) -> Wave:
    """rows of trees(), as one structure. A tree's root is its first node, as bk_forest makes it."""
    rows = sorted(rows, key=lambda r: (r.family, r.shard))
    fps = [np.frombuffer(r.fps, "<u8") for r in rows]
    base = np.concatenate([[0], np.cumsum([len(x) for x in fps])]).astype(np.int32)
    children = [np.frombuffer(r.children, "<i4") for r in rows]
    edges = np.concatenate([[0], np.cumsum([len(x) for x in children])]).astype(np.int32)
    offsets = [np.frombuffer(r.offsets, "<i4")[:-1] + e for r, e in zip(rows, edges, strict=False)]
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    family, shard = np.array([r.family for r in rows], np.int64), np.array([r.shard for r in rows], np.int64)
    shards, first = [], []
    for i in range(families):
        own = np.flatnonzero(family == i)
        names, at = np.unique(shard[own], return_index=True)
        shards.append(names)
        first.append(np.concatenate([own[at], [own[-1] + 1 if len(own) else 0]]))
    keys = join([np.frombuffer(r.keys, "u1") for r in rows], np.uint8)
    return Wave(shards, first, base[:-1].astype(np.int64), join(fps, np.uint64), np.concatenate([join(offsets, np.int32), edges[-1:]]), join([c + b for c, b in zip(children, base, strict=False)], np.int32), keys)


def fingerprint_links(values: DataFrame, fp: str, radius: int = 3, tree: int = TREE, wave: int = WAVE) -> DataFrame:
    """(a, b) edges that connect all different fingerprints within the radius of each other. A task gives at most one edge for each
    fingerprint that it links, whatever the number of links."""
    spark = values.sparkSession
    distinct = cut(values.select(F.col(fp).alias("fp")).where("fp IS NOT NULL").distinct())
    n = distinct.count()
    masks = blocks_of(n, radius)
    shards = max(1, -(-n // tree))
    forest = cut(trees(distinct, "fp", masks, shards, tree))
    waves = max(1, -(-n * len(masks) * NODE_BYTES // wave))
    own = [shard_of(F.col("fp"), m, i, shards).alias(f"s{i}") for i, m in enumerate(masks)]
    asking = distinct.select("fp", *own).repartition(parts(spark, n, 50_000))
    found = None
    for w in range(waves):
        # about `wave` bytes of trees: a shard's place in a wave is by its number, its number by a hash
        rows = list(forest.where(F.pmod("shard", F.lit(waves)) == w).toLocalIterator())
        shared = spark.sparkContext.broadcast(wave_of(rows, len(masks)))
        del rows

        def link(batches: Iterator[pa.RecordBatch], shared=shared, w=w) -> Iterator[pa.RecordBatch]:
            t = shared.value
            a, b, held = [], [], 0
            for batch in batches:
                q = batch.column(0).to_numpy().view(np.uint64)
                for i in range(len(masks)):
                    asks, roots = t.begin(i, batch.column(i + 1).to_numpy().astype(np.int64))
                    for x, node in bk_search(q, asks, roots, t.fp, t.offsets, t.children, t.keys, radius):
                        x, y = q[x], t.fp[node]
                        later = x > y  # the other one finds the pair too
                        a.append(x[later])
                        b.append(y[later])
                        held += len(a[-1])
                        if held >= PAIRS:
                            x, y = spanning(np.concatenate(a), np.concatenate(b))
                            a, b, held = [x], [y], 0
            if held or a:
                x, y = spanning(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        here = reduce(lambda x, y: x | y, [F.pmod(f"s{i}", F.lit(waves)) == w for i in range(len(masks))])
        part = cut(asking.where(here).mapInArrow(link, "a long, b long"))
        shared.destroy()
        found = part if found is None else found.union(part)
    return found.distinct()


def _components(docs: DataFrame, doc_id: str, text: str, radius: int, width: int) -> DataFrame:
    """(doc_id, h, fp, root, component_id): h tells rows of one id apart by a hash of their text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    fps = cut(fingerprints(rows, "text", "fp", width))
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    root = components(fingerprint_links(fps, "fp", radius), "a", "b")
    named = cut(reps.join(root, reps.fp == root.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return fps.join(named.join(least, "root").select("fp", "root", "component_id"), "fp")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row: fp is the signed fingerprint, component_id the smallest id reachable over links.

    Null text counts as empty; all texts without words share fingerprint 0 and so one component. Repeated rows each give a
    row. A null id never names a component: a component of null ids only gives null. Extra columns are not read.
    """
    return _components(docs, doc_id, text, radius, width).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """docs with one row of each component: the one with the smallest id, nulls last, then the smallest hash of its text.

    Of rows that repeat both id and text, one stays. Texts without words form one component.
    """
    return keep_one(docs, cut(_components(docs, doc_id, text, radius, width).select("doc_id", "h", "root")), doc_id, text)


def similar_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, width: int = 5, percent: int = 80) -> DataFrame:
    """As near_dedup, of the components of texts whose sets of shingles have a Jaccard similarity of percent / 100 or more.

    The trees find what lies within the radius; links are verified on the whole texts. Texts of just that similarity may
    differ in more bits than any radius that trees can search, so that the prefix filter of jaccard.py completes the links
    between different components, exactly.
    """
    sets = cut(jaccard.sets(docs, doc_id, text, width, percent, majority))
    distinct = sets.groupBy("s").agg(F.first("n").alias("n"), F.first("print").alias("fp"))
    root = components(fingerprint_links(distinct, "fp", radius), "a", "b")
    named = cut(distinct.join(root, distinct.fp == root.node, "left").select("s", "n", F.coalesce("root", "fp").alias("root")))
    first = named.groupBy("root").agg(F.min(F.struct("s", "n")).alias("f"), F.count("*").alias("c")).where("c > 1")
    pairs = named.join(first, "root").where(F.col("s") != F.col("f.s"))
    alike = 100 * F.least("n", "f.n") >= percent * F.greatest("n", "f.n")
    pairs = pairs.where(alike).select(F.col("f.s").alias("a"), F.col("s").alias("b"))
    return keep_one(docs, jaccard.components_of(docs, sets, pairs, text, width, percent), doc_id, text)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
