"""Token ids in patched frame-of-reference files.

A file holds whole documents. Their ids, one stream, are cut into blocks; a block stores its minimum, the differences from
it packed at the bit width that covers a percentile of them, and a list of exceptions: places and full differences of the
values that need more bits. An index of block starts makes every block readable by itself.

File layout, little-endian:
    magic "VPF1", u32 block size, u32 documents, u64 ids, u32 blocks
    u64[blocks + 1] starts of the blocks, from the first block's first byte
    i64[documents] document ids, u8[documents] whether the id is null, u64[documents] ids of each document
    blocks: u32 minimum, u8 width, u16 exceptions, packed differences, u16[exceptions] places, u32[exceptions] differences
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.common import map_arrow, shared_dir, small_batches, table

MAGIC, HEAD = b"VPF1", struct.Struct("<4sIIQI")
BLOCK, PERCENTILE = 512, 90
#: Ids after which a file is closed; a longer document makes a longer file.
FILE_IDS = 1 << 20
#: Bytes of input for a task, about.
TASK_BYTES = 16 << 20
END = 2
#: Bytes of rows that are encoded together, about.
ENCODE_BYTES = 16 << 20
#: Words whose ids a worker remembers; twice as many for a while.
CACHE = 400_000
#: New words that go to the library as one text; it takes far more memory for long ones, and no less time.
TOGETHER = 10_000
#: In place of the ids of a word that cannot be encoded by itself.
ODD = b""


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> list[bytes]:
    """ids: u32. All full blocks are handled together, grouped by width; a shorter last block is a group of its own."""
    full = len(ids) // block
    out: list[bytes] = []
    for part in (ids[: full * block].reshape(full, block), ids[full * block :].reshape(1, -1)):
        if not part.size:
            continue
        low = part.min(1)
        diff = (part - low[:, None]).astype("<u4")
        k = min(part.shape[1] - 1, part.shape[1] * percentile // 100)
        width = np.frexp(np.partition(diff, k, axis=1)[:, k].astype(np.float64))[1]
        packed: list[bytes] = [b""] * len(part)
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            x = diff[rows]
            extra = x >> np.uint32(w) != 0 if w < 32 else np.zeros(x.shape, bool)
            kept = np.where(extra, np.uint32(0), x)
            if w:
                flat = np.unpackbits(kept.view(np.uint8).reshape(*x.shape, 4), axis=2, bitorder="little", count=w)
                body = np.packbits(flat.reshape(len(rows), -1), axis=1, bitorder="little")
            else:
                body = np.empty((len(rows), 0), np.uint8)
            at_row, at = np.nonzero(extra)
            cut = np.searchsorted(at_row, np.arange(len(rows) + 1)).tolist()
            places, values = at.astype("<u2"), x[at_row, at].astype("<u4")
            for i, (r, minimum) in enumerate(zip(rows.tolist(), low[rows].tolist(), strict=True)):
                a, b = cut[i], cut[i + 1]
                packed[r] = struct.pack("<IBH", minimum, w, b - a) + body[i].tobytes() + places[a:b].tobytes() + values[a:b].tobytes()
        out += packed
    return out


def decode_blocks(body: bytes, starts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """All ids of a file's blocks, as u32."""
    out = np.empty(n, np.uint32)
    raw = np.frombuffer(body, np.uint8)
    heads = [struct.unpack_from("<IBH", body, s) for s in starts[:-1].tolist()]
    width = np.array([h[1] for h in heads])
    size = np.full(len(heads), block)
    if len(heads):
        size[-1] = n - block * (len(heads) - 1)
    for w, m in {(int(a), int(b)) for a, b in zip(width, size, strict=True)}:
        rows = np.flatnonzero((width == w) & (size == m))
        length = (w * m + 7) // 8
        packed = raw[starts[rows].astype(np.int64)[:, None] + 7 + np.arange(length)]
        flat = np.unpackbits(packed, axis=1, bitorder="little", count=w * m).reshape(len(rows), m, w)
        value = np.zeros((len(rows), m), np.uint32)
        for b in range(w):
            value |= flat[:, :, b].astype(np.uint32) << np.uint32(b)
        for i, r in enumerate(rows):
            if k := heads[r][2]:
                at = int(starts[r]) + 7 + length
                value[i, np.frombuffer(body, "<u2", k, at)] = np.frombuffer(body, "<u4", k, at + 2 * k)
            out[block * r : block * r + m] = value[i] + np.uint32(heads[r][0])
    return out


def write_file(doc_ids: list[int | None], docs: list[np.ndarray], block: int = BLOCK) -> bytes:
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    blocks = encode_blocks(ids.astype(np.uint32), block)
    starts = np.zeros(len(blocks) + 1, "<u8")
    starts[1:] = np.cumsum([len(b) for b in blocks])
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([HEAD.pack(MAGIC, block, len(docs), len(ids), len(blocks)), starts.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), np.array([len(d) for d in docs], "<u8").tobytes(), *blocks])


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, their lengths, all ids)."""
    magic, block, n_docs, n, n_blocks = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    starts = np.frombuffer(data, "<u8", n_blocks + 1, at)
    at += starts.nbytes
    ids = np.frombuffer(data, "<i8", n_docs, at)
    at += ids.nbytes
    null = np.frombuffer(data, np.uint8, n_docs, at)
    at += null.nbytes
    lengths = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
    at += 8 * n_docs
    return [None if z else int(i) for i, z in zip(ids, null, strict=True)], lengths, decode_blocks(data[at:], starts, n, block)


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian u32 bytes.

    A byte-level pre-tokeniser never joins what stands on both sides of a space between two non-space characters, so a text
    whose spaces all stand so is encoded word by word: the distinct words of a batch are looked up among those met before,
    and only new ones go to the library. Any other text goes to it as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}  # with a space before the word; ODD: empty, or has white space at an end
        self.older: dict[str, bytes] = {}  # the known words of before; one that is met again is known again
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a character per byte
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Encode words, each with the space before it, as one text, and cut its ids where the bytes of a word end."""
        joined = self.library(["".join(texts)])[0] if texts else b""
        at = np.cumsum(self.n_bytes[np.frombuffer(joined, "<u4")])
        ends = np.cumsum([len(t.encode()) for t in texts]).astype(np.int64)
        cuts = np.searchsorted(at, ends)
        if len(ends) and (cuts[-1] >= len(at) or not np.array_equal(at[cuts], ends)):
            return self.library(texts)
        bounds = [0, *(4 * (cuts + 1)).tolist()]
        return [joined[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _look_up(self, words: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = list(map(known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            w = words[i]
            ids = older.get(w)
            if ids is None:
                if not w or w[0].isspace() or w[-1].isspace():
                    ids = ODD
                else:
                    new.append(i)
                    continue
            known[w] = found[i] = ids
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            for i, ids in zip(part, self._joined([f" {words[i]}" for i in part]), strict=True):
                known[words[i]] = found[i] = ids
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Null encodes as empty."""
        texts = texts.fill_null("")
        words = pc.split_pattern(texts, " ")
        flat = pc.dictionary_encode(words.flatten())
        starts = np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy())))
        distinct = flat.dictionary.to_pylist()
        places = flat.indices.to_numpy()
        ids = pa.array(self._look_up(distinct), pa.large_binary()).take(flat.indices)
        offsets = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)
        odd = np.concatenate(([0], np.cumsum(np.diff(offsets) == 0)))
        data = memoryview(ids.buffers()[2]) if ids.buffers()[2] else memoryview(b"")
        # the first word of a text has no space before it
        first = [distinct[i] for i in places[starts[:-1]].tolist()]
        heads = dict(zip(plain := sorted({w for w in first if w}), self.library(plain), strict=True))
        out = []
        for i, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist(), strict=False)):
            if odd[b] - odd[a]:
                out.append(self.library([texts[i].as_py()])[0])
            else:
                out.append(heads[first[i]] + data[offsets[a + 1] : offsets[b]])
        return out


def joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to so many bytes: the more text at once, the fewer words are looked up again."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


@cache
def encoder(path: str) -> Encoder:
    """One per worker process, which remembers its words from task to task."""
    return Encoder(path)


def write(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END, file_ids: int = FILE_IDS) -> None:
    """Write docs' ids as files in ascending order of doc_id, nulls first, ties by a hash of the text.

    Each file is a row (part, seq, before, n_ids, n_docs, data) of a Parquet table, so that Spark's committer makes the
    output whole although tasks fail and repeat, in any store. `before` counts the ids of the files before it in its part.
    Null texts encode as empty: the end id alone. Rows that repeat an id, or both id and text, each have their ids. Columns but
    the two are not read, whatever their names; an empty table gives a table of files without rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # not known without a look at the rows
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // TASK_BYTES)
    ordered = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    small_batches(spark)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        own = encoder(tokenizer)
        tail = np.array([end], "<u4").tobytes()
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        n_ids = 0

        def close() -> pa.RecordBatch:
            values = [[part], [seq], [before], [n_ids], [len(ids)], [write_file(ids, held)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "before", "n_ids", "n_docs", "data"])

        for batch in joined(batches, ENCODE_BYTES):
            for i, data in zip(batch.column(0).to_pylist(), own.encode(batch.column(2)), strict=True):
                ids.append(i)
                held.append(np.frombuffer(data + tail, "<u4"))
                n_ids += len(held[-1])
                if n_ids >= file_ids:
                    yield close()
                    seq, before, n_ids, ids, held = seq + 1, before + n_ids, 0, [], []
        if ids:
            yield close()

    ordered.mapInArrow(kernel, "part int, seq long, before long, n_ids long, n_docs long, data binary").write.option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files. The ids of whole parts are summed first:
    one number per part, so that a file's start is its part's start and `before`."""
    files = spark.read.parquet(folder)
    starts, total = {}, 0
    for r in sorted(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        starts[r.part], total = total, total + r.n
    small_batches(spark)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for part, before, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            ids, lengths, values = read_file(data)
            ends = np.cumsum(lengths)
            out[0] += ids
            out[1] += (starts[part] + before + ends - lengths).tolist()
            out[2] += lengths.tolist()
            raw = memoryview(values.astype("<u4").tobytes())
            out[3] += [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    few = files.select("part", "before", "data")
    return map_arrow(few, kernel, "doc_id long, start long, n_tokens long, ids_crc32 long", rows=4)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, folder)
