"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are runs of consecutive words. A document contains a window only if it holds all its words, so one word
is a sufficient prefix to join by; words are ordered by rarity (the number of documents that hold them, counted over the
whole corpus) and a window is indexed under its rarest word only. Where a document has an indexed word, the window's place
follows from the word's offset in it; windows that would begin before the document or end after it are passed over
(positional and length bounds), and what is left is verified word by word.

The join is one of hashes against an index that every task holds: the benchmark is dealt to blocks of bounded bytes, a block
becomes an index of a few flat arrays, and all documents stream past it. Documents are not shuffled, so a word that a third
of them has makes no task large.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.common import cut, join_small, map_arrow, schema_of, table, utf8

#: Maps A-Z to a-z, keeps 0-9, a-z and every byte of a non-ASCII character, and turns all else into a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOW = 10
#: UTF-8 bytes of benchmark text that an index holds, about; a larger benchmark takes several indexes, one after the other. An
#: index has about ten bytes for each of its text's.
INDEX_BYTES = 16 << 20
#: Places of a document and windows under their words that are compared at once.
HELD = 1_000_000


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split() if text else []


def document_counts(docs: DataFrame, text: str, vocabulary) -> DataFrame:
    """(word, n): documents that hold each word of the broadcast vocabulary."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, count = vocabulary.value, Counter()
        for t in utf8(batch, text):
            count.update(known.intersection(words(t)))
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

    return map_arrow(docs.select(text), kernel, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Index:
    """Different windows of a block of items. Words are numbers by their order; `text` has all items' words, one after the other.
    Windows lie by the word they are indexed under: those of word w at first[w] up to first[w + 1]."""

    numbers: dict[bytes, int]
    text: np.ndarray
    first: np.ndarray
    at: np.ndarray  # where a window begins in text
    length: np.ndarray
    offset: np.ndarray  # of the word that it is indexed under
    names: list[str]
    owner: np.ndarray  # items of a window: owner[owned[i] : owned[i + 1]]
    owned: np.ndarray

    def lookup(self, w: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of all occurrences in a document's words."""
        doc = np.fromiter((self.numbers.get(x, -1) for x in w), np.int64, len(w))
        places = np.flatnonzero((doc >= 0) & (self.first[doc + 1] > self.first[doc]))
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        fan = self.first[doc[places] + 1] - self.first[doc[places]]
        ends = np.cumsum(fan)
        at = 0
        while at < len(places):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, side="right")))
            n = fan[at:stop]
            window = np.repeat(self.first[doc[places[at:stop]]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            start = np.repeat(places[at:stop], n) - self.offset[window]
            fits = (start >= 0) & (start + self.length[window] <= len(w))
            start, window = start[fits], window[fits]
            for k in range(int(self.length[window].max(initial=0))):
                same = (k >= self.length[window]) | (doc[np.minimum(start + k, len(w) - 1)] == self.text[np.minimum(self.at[window] + k, len(self.text) - 1)])
                start, window = start[same], window[same]
            out.append((start, window))
            at = stop
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])

    def scan(self, w: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged spans [start, end) of hit words and the items with an occurring window, sorted."""
        if self.numbers.keys().isdisjoint(w):
            return [], []
        start, window = self.lookup(w)
        if not len(start):
            return [], []
        order = np.argsort(start, kind="stable")
        begin, reach = start[order], np.maximum.accumulate((start + self.length[window])[order])
        new = np.concatenate([[True], begin[1:] > reach[:-1]])
        ends = reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(begin) - 1]])]
        found = np.unique(window)
        items = {self.names[i] for a, b in zip(self.owned[found], self.owned[found + 1], strict=True) for i in self.owner[a:b].tolist()}
        return list(zip(begin[new].tolist(), ends.tolist(), strict=True)), sorted(items)


def build_index(items: list[tuple[str, bytes]], counts: dict[bytes, int], size: int) -> Index:
    """counts: documents that hold each word. A window with a word that no document holds needs no entry."""
    texts = [(name, own) for name, text in items if (own := words(text))]
    numbers = {w: i for i, w in enumerate(sorted({w for _, own in texts for w in own}))}
    names = sorted({name for name, _ in texts})
    place = {name: i for i, name in enumerate(names)}
    text = np.array([numbers[w] for _, own in texts for w in own], np.int64)
    lengths = np.array([len(own) for _, own in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.empty(0, np.int64)
    n = np.minimum(lengths, size)
    each = lengths - n + 1
    owner = np.repeat(np.arange(len(texts)), each)
    at = begins[owner] + np.arange(len(owner)) - np.concatenate([[0], np.cumsum(each)[:-1]])[owner] if len(owner) else np.empty(0, np.int64)
    length = n[owner] if len(owner) else np.empty(0, np.int64)
    rarity = np.array([counts.get(w, 0) for w in numbers], np.int64)  # numbers are in the order of the words
    best, offset = np.full(len(at), np.iinfo(np.int64).max), np.zeros(len(at), np.int64)
    digest, known = length.astype(np.uint64), np.ones(len(at), bool)
    for k in range(int(length.max(initial=0))):
        inside = k < length
        word = text[np.minimum(at + k, max(0, len(text) - 1))]
        digest = np.where(inside, (digest ^ word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1), digest)
        known &= ~inside | (rarity[word] > 0)
        rank = rarity[word] * len(numbers) + word
        offset = np.where(inside & (rank < best), k, offset)
        best = np.where(inside, np.minimum(best, rank), best)
    at, length, offset, digest, owner = (x[known] for x in (at, length, offset, digest, owner))
    owner = np.array([place[texts[i][0]] for i in range(len(texts))], np.int64)[owner] if len(texts) else owner
    key = text[at + offset] if len(at) else np.empty(0, np.int64)
    order = np.lexsort((owner, digest, key))
    at, length, offset, digest, owner, key = (x[order] for x in (at, length, offset, digest, owner, key))
    new = np.ones(len(at), bool)
    if len(at) > 1:  # a window is the one before it if all their words are the same
        same = (digest[1:] == digest[:-1]) & (length[1:] == length[:-1]) & (key[1:] == key[:-1])
        for k in range(size):
            same &= (k >= length[1:]) | (text[np.minimum(at[1:] + k, len(text) - 1)] == text[np.minimum(at[:-1] + k, len(text) - 1)])
        new[1:] = ~same
    once = np.ones(len(at), bool)
    once[1:] = new[1:] | (owner[1:] != owner[:-1])
    window = np.cumsum(new) - 1
    owned = np.searchsorted(window[once], np.arange(int(new.sum()) + 1))
    first = np.searchsorted(key[new], np.arange(len(numbers) + 2))
    return Index(numbers, text.astype(np.int32), first, at[new].astype(np.int32), length[new].astype(np.int16), offset[new].astype(np.int16), names, owner[once].astype(np.int32), owned)


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def occurrences(docs: DataFrame, text: str, index) -> DataFrame:
    """docs' other columns, n_words, spans of hit words and items for one broadcast index."""
    kept = [c for c in docs.columns if c not in (text, "n_words", "spans", "items")]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, spans, items = [], [], []
        for t in utf8(batch, text):
            w = words(t)
            s, i = index.value.scan(w)
            n_words.append(len(w))
            spans.append([{"a": a, "b": b} for a, b in s])
            items.append(i)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))],
            [*kept, "n_words", "spans", "items"],
        )

    return map_arrow(docs.select(*kept, text), kernel, schema_of(docs, kept, "n_words long, spans array<struct<a:int,b:int>>, items array<string>"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """(doc_id, h, n_words, spans, items) per row of docs; h is a hash of its text, spans are in words, merged and sorted.

    Null texts have no words. An item without words has no window; one of fewer than `size` words is one window. Items that
    share an id count as one; a null id is the item "". Repeated rows each give a row. The benchmark is read in blocks of
    about INDEX_BYTES, dealt by a hash; results of several blocks are merged.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = 1 + total // INDEX_BYTES
    results = []
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        own = [(r.i, r.t.encode()) for r in part.toLocalIterator()]
        vocabulary = spark.sparkContext.broadcast({w for _, t in own for w in words(t)})
        counts = {bytes(r.word): r.n for r in document_counts(rows, "text", vocabulary).toLocalIterator()}  # no more than the block's words
        vocabulary.unpersist()
        results.append(occurrences(rows, "text", spark.sparkContext.broadcast(build_index(own, counts, size))))
    if blocks == 1:
        return results[0]
    results = [cut(r) for r in results]
    hits = results[0].where("false")
    for r in results:
        hits = hits.unionByName(r.where("size(items) > 0"))
    merged = hits.groupBy(F.col("doc_id").alias("__vantage_id"), F.col("h").alias("__vantage_h")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    fold = """aggregate(spans, cast(array() AS array<struct<a:int,b:int>>), (acc, x) -> CASE
        WHEN size(acc) > 0 AND x.a <= element_at(acc, -1).b
        THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, x.b))))
        ELSE concat(acc, array(x)) END)"""
    merged = merged.withColumn("spans", F.expr(fold))
    base = results[0].select("doc_id", "h", "n_words")
    none = "cast(array() AS array<struct<a:int,b:int>>)"
    joined = base.join(merged, base.doc_id.eqNullSafe(F.col("__vantage_id")) & (base.h == F.col("__vantage_h")), "left")
    return joined.select("doc_id", "h", "n_words", F.coalesce("spans", F.expr(none)).alias("spans"), F.coalesce("items", F.expr("cast(array() AS array<string>)")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that hold a window of the benchmark; all other rows stay, repeated ones too."""
    hit = cut(contamination(docs, benchmark, doc_id, text).where("size(items) > 0").select(F.col("doc_id").alias("__vantage_id"), F.col("h").alias("__vantage_h")).distinct())
    return join_small(docs, hit, docs[doc_id].eqNullSafe(F.col("__vantage_id")) & (F.xxhash64(docs[text]) == F.col("__vantage_h")), "left_anti")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s.b - s.a))
    digest = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontamination_sql(size: int = WINDOW) -> str:
    split = "coalesce(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
    return f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {split.format("text")} AS w FROM documents),
        b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {split.format("text")} AS w FROM benchmark),
        win AS MATERIALIZED (SELECT DISTINCT item, w[i : i + least(len(w), {size}) - 1] AS k FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {size}) + 2)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT len(k) AS n FROM win),
        dw AS (SELECT r, i, n, w[i : i + n - 1] AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)),
        hit AS MATERIALIZED (SELECT r, i, n, item FROM dw JOIN win USING (k)),
        pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
        its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)"""
