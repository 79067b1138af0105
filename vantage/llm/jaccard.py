"""Links by the Jaccard similarity of word shingles, exact: no pair at or over the similarity is missed.

Two sets of n and m shingles that are that similar share one of the first n - ceil(similarity * n) + 1 shingles of each, in
whatever order all sets are sorted (prefix filter). The order is that of the hashes, but for shingles that several texts
have among their first: these are counted over all texts, and the most common ones come last, the more common the later. So
texts that share a passage do not meet under it as long as they have enough shingles of their own. Sets that meet are
candidates if their sizes and the places of the shared shingle leave room for the similarity. Bitmaps of the sets bound what
candidates can share from above, so that few texts are moved for nothing; what is left is verified on the whole texts. A first
round takes pairs that are given, a second one, for each set, that of a few sets of its size under its shingles which seems
nearest, the most typical one among them; this is repeated with sets that a hash picks. A last one takes all candidates of
different components. These grow with the square of a group of texts that are nearly similar enough, so their pairs are not moved:
the sets that candidates connect make a block, whose whole sets are compared where they lie, and a task gives edges that connect
what it has linked, at most one for each component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import cut, join_small, map_arrow, parts, schema_of, small_batches, utf8
from vantage.llm.components import components, spanning

#: Number of common shingles told to tasks at most, texts that a common one has at least, and prefixes that are counted. They
#: only set the order of the shingles, not which pairs are found.
COMMON, TEXTS, REGION = 1_000_000, 3, 2
#: Rounds in which sets hang on others before all candidates are compared.
ROUNDS = 1
#: First hashes of a set under which it looks for the most typical set of its size.
LEAD = 4
#: Pairs that are put out, or held before they are reduced to edges that connect the same, at once.
PAIRS = 100_000
#: Sets of a chunk of a block, chunks of a block unless they are over so many shingles, and shingles of a chunk.
CHUNK, CHUNKS, CHUNK_SHINGLES = 64, 32, 2_000_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def hashes(text: bytes | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles of a UTF-8 text, with repeats: A-Z lower-cased, words parted by ASCII white space. Fewer words
    than the width make one shingle of all of them; null and texts without words have none."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64, len(words) - width + 1)


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    return np.unique(hashes(text, width))


def least_overlap(n, m, percent: int):
    """Shingles that sets of n and m shingles share at least if they are similar enough."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def prefix(own: np.ndarray, common: np.ndarray, times: np.ndarray, percent: int) -> np.ndarray:
    """own, sorted: the hashes of a set; common, sorted, and how many texts have them."""
    return own[np.lexsort((own, texts_of(own, common, times)))[: prefix_length(len(own), percent)]]


def texts_of(own: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How many texts have each hash, 0 if it is not among the common ones."""
    if not len(common) or not len(own):
        return np.zeros(len(own), np.int64)
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    return np.where(common[at] == own, times[at], 0)


def least_count(counted: DataFrame) -> int:
    """The smallest count c from which on no more than COMMON shingles are as common; counted: (t, c)."""
    least, held = 1 << 62, 0
    for c, n in counted.groupBy("c").count().orderBy(F.desc("c")).collect():  # a row per different count
        held += n
        if held > COMMON:
            break
        least = c
    return least


def _common(rows: DataFrame, width: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most texts have among the first of their hashes, sorted, and how many."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [shingles(t, width) for t in utf8(batch, "text")]
        first = [x[: REGION * prefix_length(len(x), percent)].view(np.int64) for x in own]
        return pa.RecordBatch.from_arrays([pa.array(first, pa.list_(pa.int64()))], ["sh"])

    counted = map_arrow(rows.select("text"), kernel, "sh array<long>").select(F.explode("sh").alias("t")).groupBy("t").agg(F.count("*").alias("c")).where(F.col("c") >= TEXTS)
    counted = cut(counted)
    got = counted.where(F.col("c") >= least_count(counted)).toArrow()  # 16 bytes each, without a sort that gathers at the driver
    hashes_, times = got.column("t").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(hashes_)
    return hashes_[order], times[order]


def sketch(own: np.ndarray) -> bytes:
    """A bitmap of a set by the low bits of its hashes, of about two bits a shingle."""
    bits = 1 << max(6, min(16, (2 * len(own)).bit_length()))
    out = np.zeros(bits, bool)
    out[(own & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def most_shared(n: int, m: int, x: bytes, y: bytes) -> int:
    """A bound of what two sets share: a bit of one that the other lacks is a shingle that it lacks."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(p) > len(q):
        p = p[: len(p) // 2] | p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] | q[len(q) // 2 :]
    return min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))


#: Numbers that hold a set's small bitmap, of 64 bits each; tasks compare those of pairs before they give them out.
SMALL = 4


def small_sketch(own: np.ndarray) -> list[int]:
    out = np.zeros(64 * SMALL, bool)
    out[(own & np.uint64(64 * SMALL - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view("<i8").tolist()


def _groups(batches: Iterator[pa.RecordBatch], columns: str) -> list[np.ndarray] | None:
    """The rows of a task by shingle, size and set; rows of 32 bytes, their number bounded by tasks but for a single shingle's."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    got = pa.Table.from_batches(held)
    values = [got.column(c).to_numpy() for c in columns.split()]
    order = np.lexsort((values[1], values[2], values[0]))
    return [v[order] for v in values]


def _pairs(t: np.ndarray, s: np.ndarray, n: np.ndarray, place: np.ndarray, root: np.ndarray, *small: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """(a, b) rows, a < b: sets of different roots that meet under a shingle and leave room for the similarity, also by what their
    small bitmaps say that one has and the other lacks."""
    n, place, small = n.astype(np.int64), place.astype(np.int64), tuple(m.view(np.uint64) for m in small)
    stop = np.searchsorted(t, t, side="right")
    seen: list[np.ndarray] = []
    held, i, step = 0, np.arange(len(t)), 1
    # partners of i are at i + step, as long as one of them is in its group and not too large
    while True:
        i = i[i + step < stop[i]]
        i = i[100 * n[i] >= percent * n[i + step]]
        if not len(i):
            break
        j = i + step
        room = np.minimum(n[i] - place[i], n[j] - place[j])
        ok = np.flatnonzero((root[i] != root[j]) & (room >= least_overlap(n[i], n[j], percent)))
        p, q = i[ok], j[ok]
        lacks = lambda x, y: sum((np.bitwise_count(m[x] & ~m[y]).astype(np.int64) for m in small), np.zeros(len(x), np.int64))
        fits = np.minimum(n[p] - lacks(p, q), n[q] - lacks(q, p)) >= least_overlap(n[p], n[q], percent)
        p, q = p[fits], q[fits]
        if len(p):
            seen.append(np.stack([np.minimum(s[p], s[q]), np.maximum(s[p], s[q])], 1))
            held += len(seen[-1])
        if held >= PAIRS:
            yield np.unique(np.concatenate(seen), axis=0)
            seen, held = [], 0
        step += 1
    if seen:
        yield np.unique(np.concatenate(seen), axis=0)


def _stars(t: np.ndarray, s: np.ndarray, n: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """(centre, set) rows: each set under a shingle with the one of the least rank, then number, of about its size there. A group of
    near copies has the same centre under most of its shingles, so it gives few different pairs."""
    size = np.floor(np.log(np.maximum(n, 1)) / np.log(1.25)).astype(np.int64)
    order = np.lexsort((s, rank, size, t))
    t, s, size = t[order], s[order], size[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (size[1:] != size[:-1])
    least = s[np.flatnonzero(new)][np.cumsum(new) - 1]
    other = least != s
    return np.unique(np.stack([least[other], s[other]], 1), axis=0)


def _centres(tokens: DataFrame, tasks: int) -> DataFrame:
    """(a, b) of tokens (t, s, n, typical): each set under a shingle with the most typical set of about its size there. Of a group of
    near copies that is the text that they were made from, or one much like it, so that most of the group hangs on it."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _groups(batches, "t s n typical")
        if got is not None:
            t, s, n, typical = got
            out = _stars(t, s, n, -typical.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out.min(1)), pa.array(out.max(1))], ["a", "b"])

    return tokens.repartition(tasks, "t").mapInArrow(pair, "a long, b long").distinct()


def _meet(tokens: DataFrame, tasks: int) -> DataFrame:
    """Of tokens (t, s, n, place), the rows whose shingle several sets have first, and rows with a and b: the stars of each
    shingle. A shingle that a set has alone leads nowhere."""

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _groups(batches, "t s n place")
        if got is None:
            return
        t, s, n, place = got
        names = ["t", "s", "n", "place", "a", "b"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        same = np.zeros(len(t) + 1, bool)
        same[1:-1] = t[1:] == t[:-1]
        keep = np.flatnonzero(same[1:] | same[:-1])
        yield pa.RecordBatch.from_arrays([*(pa.array(v[keep]) for v in got), *(pa.nulls(len(keep), k) for k in kinds[4:])], names)
        if len(out := _stars(t[keep], s[keep], n[keep], s[keep])):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(out), k) for k in kinds[:4]), pa.array(out[:, 0]), pa.array(out[:, 1])], names)

    return tokens.repartition(tasks, "t").mapInArrow(several, "t long, s long, n int, place int, a long, b long")


def _candidates(rooted: DataFrame, percent: int, tasks: int) -> DataFrame:
    """(a, b) edges that connect all candidates of rooted (t, s, n, place, root, m0..): sets of different roots that meet under a shingle.
    A task gives at most one edge for each set, whatever the number of its pairs."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _groups(batches, " ".join(["t s n place root", *(f"m{i}" for i in range(SMALL))]))
        u, v = np.empty(0, np.int64), np.empty(0, np.int64)
        for out in _pairs(*got, percent=percent) if got else ():
            u, v = spanning(np.concatenate([u, out[:, 0]]), np.concatenate([v, out[:, 1]]))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    return rooted.repartition(tasks, "t").mapInArrow(pair, "a long, b long").distinct()


def _possible(pairs: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """(a, b, most) of the pairs whose bitmaps leave room for the similarity. named: (s, n, sketch) of rows."""
    pairs = cut(pairs)
    members = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    known = cut(named.select("s", "n", "sketch").join(members, "s", "left_semi").groupBy("s").agg(F.first("n").alias("n"), F.first("sketch").alias("x")))
    side = lambda c: known.select(F.col("s").alias(c), F.col("n").alias(f"n{c}"), F.col("x").alias(f"x{c}"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        most = [(most_shared(n, m, x, y), least_overlap(n, m, percent)) for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in most], pa.int64())], ["a", "b", "most"])
        return out.filter(pa.array([a >= b for a, b in most], pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb")
    return map_arrow(both, kernel, "a long, b long, most long")


def _texts(members: DataFrame, named: DataFrame, docs: DataFrame) -> DataFrame:
    """(s, text): one text of each set of members (s); only their texts are read again and moved. named: (h, s) tells which text has
    a set; docs: (h, text)."""
    wanted = cut(named.select("h", "s").join(members, "s", "left_semi").groupBy("s").agg(F.min("h").alias("h")))
    return cut(join_small(docs, wanted, "h").groupBy("s").agg(F.first("text").alias("text")))


def _verified(pairs: DataFrame, named: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs of sets whose texts are similar enough; named, docs: as of _texts."""
    pairs = cut(pairs.select("a", "b"))
    asked = _texts(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct(), named, docs)
    both = pairs.join(asked.select(F.col("s").alias("a"), F.col("text").alias("x")), "a").join(asked.select(F.col("s").alias("b"), F.col("text").alias("y")), "b")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(utf8(batch, "x"), utf8(batch, "y"), strict=True):
            p, q = shingles(x, width), shingles(y, width)
            keep.append(len(np.intersect1d(p, q, assume_unique=True)) >= least_overlap(len(p), len(q), percent))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(map_arrow(both.select("a", "b", "x", "y"), kernel, "a long, b long"))


def _alike(x: list[np.ndarray], y: list[np.ndarray] | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (p, q) of sets in x and y that are similar enough, or in x alone if y is None; exact, from the whole sets."""
    one = y is None
    y = x if one else y
    order = np.argsort([len(v) for v in y], kind="stable")
    n = np.array([len(y[q]) for q in order], np.int64)
    start = np.concatenate([[0], np.cumsum(n)])
    values, at = np.unique(np.concatenate([y[q] for q in order]), return_inverse=True)
    for p, own in enumerate(x):
        # only sets of about its size
        low, high = np.searchsorted(100 * n, percent * len(own)), np.searchsorted(percent * n, 100 * len(own), side="right")
        if low >= high:
            continue
        there = np.minimum(np.searchsorted(values, own), len(values) - 1)
        has = np.zeros(len(values), np.uint8)
        has[there[values[there] == own]] = 1
        shared = np.add.reduceat(has[at[start[low] : start[high]]], start[low:high] - start[low], dtype=np.int64)
        q = order[low + np.flatnonzero(shared >= least_overlap(len(own), n[low:high], percent))]
        q = q[q > p] if one else q
        yield np.full(len(q), p), q


def _block_links(held: list[pa.RecordBatch], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the roots of similar sets of different roots; held: rows (i, j, c, root, own) of two chunks i and j of a block,
    or of one that is both."""
    got = pa.Table.from_batches(held)
    i, j = got["i"][0].as_py(), got["j"][0].as_py()
    c, root = got["c"].to_numpy(), got["root"].to_numpy()
    own = [np.frombuffer(v, np.uint64) for v in got["own"].to_pylist()]
    left, right = np.flatnonzero(c == i), np.flatnonzero(c == j)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    held_pairs = 0
    if len(left) and len(right):
        for p, q in _alike([own[k] for k in left], None if i == j else [own[k] for k in right], percent):
            p, q = root[left[p]], root[right[q]]
            a.append(p[p != q])
            b.append(q[p != q])
            held_pairs += len(a[-1])
            if held_pairs >= PAIRS:
                u, v = spanning(np.concatenate(a), np.concatenate(b))
                a, b, held_pairs = [u], [v], 0
    return spanning(np.concatenate(a), np.concatenate(b))


def _in_blocks(edges: DataFrame, members: DataFrame, named: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b) edges that connect all sets that are similar enough within the components of edges (a, b). members: (s, n, root) of
    sets, of which those of a root are connected already; named, docs: as of _texts.

    A small block is compared in one task. A larger one is cut into up to CHUNKS chunks, so that a set is moved at most so often,
    and each two of them meet in a task, sorted by block and chunks and taken one after the other.
    """
    spark = docs.sparkSession
    blocks = components(edges, "a", "b").select(F.col("node").alias("s"), F.col("root").alias("block"))
    blocks = cut(members.join(blocks, "s"))
    chunks = F.greatest(F.least(F.ceil(F.col("sets") / CHUNK), F.lit(CHUNKS)), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    several = cut(blocks.groupBy("block").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).select("block", chunks.alias("chunks")).where("chunks > 1"))
    dealt = join_small(blocks, several, "block", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = cut(dealt.withColumn("c", F.pmod(F.xxhash64("s"), "chunks").cast("int")))
    moved = dealt.agg(F.sum(F.col("n") * F.col("chunks"))).first()[0] or 0
    texts = _texts(blocks.select("s"), named, docs)

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = pa.array([shingles(t, width).tobytes() for t in utf8(batch, "text")], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), own], ["s", "own"])

    whole_sets = map_arrow(texts.select("s", "text"), whole, "s long, own binary")
    rows = dealt.join(whole_sets, "s").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("block", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "root", "own")
    small_batches(spark)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        u, v = np.empty(0, np.int64), np.empty(0, np.int64)
        key = None
        for batch in batches:
            names = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            new = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
            for low, high in zip([0, *new], [*new, batch.num_rows], strict=True):
                if low == high:
                    continue
                if held and tuple(names[low]) != key:
                    a, b = _block_links(held, percent)
                    u, v, held = np.concatenate([u, a]), np.concatenate([v, b]), []
                key = tuple(names[low])
                held.append(batch.slice(low, high - low))
        if held:
            a, b = _block_links(held, percent)
            u, v = spanning(np.concatenate([u, a]), np.concatenate([v, b]))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    tasks = parts(spark, moved, 2 * CHUNK_SHINGLES)
    placed = rows.repartition(tasks, "block", "i", "j").sortWithinPartitions("block", "i", "j")
    return cut(placed.mapInArrow(compare, "a long, b long").distinct())


def sets(docs: DataFrame, doc_id: str, text: str, width: int, percent: int, digest: Callable[[np.ndarray], int]) -> DataFrame:
    """(doc_id, h, s, n, firsts, lead, typical, small, sketch, print) per row: a hash of its text and of its set of shingles, the set's size,
    the shingles of its prefix, its first hashes, how common its shingles are on average, its bitmaps, and the digest of its
    shingles with repeats."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(_common(rows, width, percent))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        every = [hashes(t, width) for t in utf8(batch, "text")]
        own = [np.unique(h) for h in every]
        s = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in own], np.uint64).view(np.int64)
        prints = np.array([digest(h) for h in every], np.uint64).view(np.int64)
        firsts = pa.array([prefix(x, *common.value, percent).view(np.int64) for x in own], pa.list_(pa.int64()))
        lead = pa.array([x[:LEAD].view(np.int64) for x in own], pa.list_(pa.int64()))
        typical = pa.array([int(16 * texts_of(x, *common.value).mean()) if len(x) else 0 for x in own], pa.int64())
        columns = [pa.array(s), pa.array([len(x) for x in own], pa.int32()), firsts, lead, typical, pa.array([small_sketch(x) for x in own], pa.list_(pa.int64())), pa.array([sketch(x) for x in own], pa.binary()), pa.array(prints)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], ["doc_id", "h", "s", "n", "firsts", "lead", "typical", "small", "sketch", "print"])

    return map_arrow(rows, kernel, schema_of(rows, ["doc_id", "h"], "s long, n int, firsts array<long>, lead array<long>, typical long, small array<long>, sketch binary, print long"))


def components_of(docs: DataFrame, named: DataFrame, pairs: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """(doc_id, h, root) per row: components of the links of the similarity. named: the materialised sets of docs; pairs (a, b) of
    sets that may be alike."""
    distinct = named.groupBy("s").agg(F.first("n").alias("n"), F.first("firsts").alias("firsts"))
    tasks = parts(docs.sparkSession, named.agg(F.sum(F.size("firsts"))).first()[0] or 0, 400_000)
    tokens = distinct.select(F.posexplode("firsts").alias("place", "t"), "s", "n").select("t", "s", "n", "place")
    met = cut(_meet(tokens, tasks))
    rows = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    links = _verified(_possible(pairs, named, percent), named, rows, percent, width)
    root = cut(components(links, "a", "b"))
    first = named.groupBy("s").agg(F.first("n").alias("n"), F.first("lead").alias("lead"), F.first("typical").alias("typical"))
    centres = _centres(first.select(F.explode("lead").alias("t"), "s", "n", "typical"), tasks)
    stars = met.where("a IS NOT NULL").select("a", "b").union(centres).distinct()
    tokens = met.where("t IS NOT NULL").select("t", "s", "n")
    for turn in range(ROUNDS):
        # of each set's stars in other components the one that seems nearest
        other = lambda c, name, root=root: root.select(F.col("node").alias(c), F.col("root").alias(name))
        near = join_small(join_small(stars, other("a", "ra"), "a", "left"), other("b", "rb"), "b", "left")
        near = _possible(near.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), named, percent)
        ends = F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("o")), F.struct(F.col("b").alias("s"), F.col("a").alias("o")))).alias("e")
        nearest = near.select("most", ends).groupBy("e.s").agg(F.max(F.struct("most", "e.o")).alias("m")).select(F.least("s", "m.o").alias("a"), F.greatest("s", "m.o").alias("b")).distinct()
        links = links.union(_verified(nearest, named, rows, percent, width))
        root = cut(components(links, "a", "b"))
        # then on sets that a hash picks anew
        drawn = F.pmod(F.xxhash64("s", F.lit(turn)), F.lit(1 << 30)).alias("typical")
        stars = _centres(tokens.select("t", "s", "n", drawn), tasks)
    rooted = join_small(met.where("t IS NOT NULL").select("t", "s", "n", "place"), root.select(F.col("node").alias("s"), "root"), "s", "left")
    members = cut(rooted.select("s").distinct())
    maps = cut(join_small(named.select("s", "small"), members, "s", "left_semi").groupBy("s").agg(F.first("small").alias("small")))
    rooted = join_small(rooted, maps, "s").select("t", "s", "n", "place", F.coalesce("root", "s").alias("root"), *[F.col("small")[i].alias(f"m{i}") for i in range(SMALL)])
    sized = first.join(members, "s", "left_semi").select("s", "n")
    sized = join_small(sized, root.select(F.col("node").alias("s"), "root"), "s", "left").select("s", "n", F.coalesce("root", "s").alias("root"))
    links = links.union(_in_blocks(_candidates(rooted, percent, tasks), sized, named, rows, percent, width))
    root = components(links, "a", "b")
    return cut(named.join(root, named.s == root.node, "left").select("doc_id", "h", F.coalesce("root", "s").alias("root")))
