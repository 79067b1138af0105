"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the mean of the embeddings of its subwords: runs of 2 to 4 characters inside its lower-cased words, word ends
included, hashed into a fixed number of buckets. Embeddings and softmax are trained together by stochastic gradient descent
in numpy, on whole texts and on short excerpts of them, so that short texts are judged well too. Since the classifier is
linear in the mean, embeddings and softmax weights are multiplied once after training: predicting takes one table lookup
per subword, over the whole text.

Rejection is calibrated on texts set aside, from two sides: clean ones, whole and excerpts, and scrambled ones, whose
letters are dealt anew to their places, as a stand-in for what is of no learned language. Short and long texts have a
threshold each, as a score means more the more subwords it rests on. A long text of several learned languages scores low as
a whole, too; so one in doubt is judged again by its parts, and stays if they are sure on average.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.common import cut, join_small, map_arrow, schema_of, table

UNKNOWN = "und"
#: Labelled rows that the classifier is fitted on at most, on average: rows are taken by a hash of their id at this rate.
SAMPLE_ROWS = 2000
BUCKETS, WIDTH, EPOCHS, RATE, EXCERPTS, HELD = 1 << 15, 16, 6, 0.5, 2, 0.2
#: Share of the rightly judged calibration texts, whole ones and short excerpts, that rejection may lose, and share of the
#: scrambled ones that it finds where that costs no more clean ones.
LOST, FOUND = 0.0005, 0.5
#: Subwords from which a text is long, and characters of the parts in which a long text that is in doubt is judged again.
LONG, PART = 512, 200
#: Characters handled at once, so that memory is bounded on very long texts. It does not change what is counted.
PIECE = 1 << 20


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers, in pieces. Characters that are not letters part words. What a piece leaves unfinished goes on in the next:
    the subwords are those of the whole text wherever it is cut."""
    tail = np.full(1, 32, np.uint32)
    for at in range(0, len(text), PIECE):
        lower = text[at : at + PIECE].replace("Σ", "σ").lower()  # the one letter whose lower case depends on its neighbours
        code = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.concatenate([tail, np.where(letters()[code], code, np.uint32(32)), tail[:0] if at + PIECE < len(text) else np.full(1, 32, np.uint32)])
        space = code == 32
        keep = np.ones(len(code), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        own, code, space = len(tail), code[keep].astype(np.uint64), space[keep]
        tail = code[-3:].astype(np.uint32)
        h, inner = code, None
        for n in (2, 3, 4):
            if len(code) < n:
                break
            h = (h[:-1] * np.uint64(1_000_003) ^ code[n - 1 :]) & np.uint64(0xFFFFFFFFFFFF)
            # a space may end a subword, not lie inside it
            inner = np.zeros(len(h), bool) if n == 2 else inner[:-1] | space[n - 2 : len(code) - 1]
            first = max(0, own - n + 1)  # those that end in the tail were counted with the piece before
            good = h[first:][~inner[first:]]
            mixed = (good ^ (good >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)
            yield (mixed >> np.uint64(49)).astype(np.int64) % BUCKETS


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, times) of a text's subwords, by rising bucket."""
    times = np.zeros(BUCKETS, np.int64)
    for found in subwords(text):
        times += np.bincount(found, minlength=BUCKETS)
    ids = np.flatnonzero(times)
    return ids.astype(np.uint16), times[ids]


def scrambled(text: str, rng: np.random.Generator) -> str:
    """The text with its letters dealt anew to the places of letters."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    places = np.flatnonzero(letters()[code])
    code[places] = code[rng.permutation(places)]
    return code.tobytes().decode("utf-32-le", "surrogatepass")


def excerpt(text: str, words: list[int], rng: np.random.Generator) -> str:
    a = int(rng.integers(0, len(words) - 1))
    return text[words[a] : words[min(len(words) - 1, a + int(rng.integers(1, 30)))]]


def examples(text: str, key: int) -> tuple[bool, list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """What is learned from a text: whether it is set aside for calibration, the counts of the whole text and of excerpts of it, and
    of the same scrambled if it is set aside. key seeds the draws. The size is bounded by the buckets, not by the text."""
    rng = np.random.default_rng(key % (1 << 63))
    held = bool(rng.random() < HELD)
    words = [m.start() for m in re.finditer(r"\S+", text)]
    own = [text, *(excerpt(text, words, rng) for _ in range(EXCERPTS if len(words) > 4 else 0))]
    none = [counts(scrambled(x, rng)) for x in own] if held else []
    return held, [counts(x) for x in own], none


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # buckets x labels: embedding times softmax weight
    bias: np.ndarray
    temperature: float
    thresholds: tuple[float, float]  # of short and of long texts

    def scores(self, text: str | None) -> tuple[np.ndarray, int] | None:
        """Calibrated probabilities and the number of subwords; null if the text is null or has no letter."""
        if not text or not self.labels:
            return None
        ids, times = counts(text)
        n = int(times.sum())
        return (softmax((times @ self.table[ids] / n + self.bias) / self.temperature), n) if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        got = self.scores(text)
        if got is None:
            return UNKNOWN, 0.0, True
        p, n = got
        best, threshold = int(p.argmax()), self.thresholds[int(n >= LONG)]
        return self.labels[best], float(p[best]), bool(p[best] < threshold) and not (n >= LONG and self.by_parts(text) >= threshold)

    def by_parts(self, text: str) -> float:
        """The mean score of a text's parts, weighted by their subwords."""
        judged = [got for part in parts(text) if (got := self.scores(part)) is not None]
        return float(np.average([p.max() for p, _ in judged], weights=[n for _, n in judged])) if judged else 0.0


def parts(text: str) -> Iterator[str]:
    """Runs of at least PART characters that end before white space."""
    at = 0
    for m in re.finditer(r"\s+", text):
        if m.start() - at >= PART:
            yield text[at : m.start()]
            at = m.start()
    yield text[at:]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    return learn([(lang, *examples(text, i)) for i, (text, lang) in enumerate(zip(texts, langs, strict=True))], seed)


def learn(rows: list[tuple], seed: int = 7) -> Model:
    """Fit on rows (language, set aside, own counts, scrambled counts); those set aside calibrate the temperature and the rejection
    thresholds: what loses LOST of all clean ones, and for long texts more where scrambled ones ask for it: what finds FOUND of
    those, or what loses LOST of the long clean ones if that is less."""
    rng = np.random.default_rng(seed)
    labels = sorted({r[0] for r in rows})
    target = {name: i for i, name in enumerate(labels)}
    shares = lambda found: [(ids, (times / times.sum()).astype(np.float32), times.sum() >= LONG) for ids, times in found if len(ids)]
    fit = [(c, target[lang]) for lang, held, own, _ in rows if not held for c in shares(own)]
    held = [(c, target[lang]) for lang, held, own, _ in rows if held for c in shares(own)]
    none = [c for _, _, _, scrambles in rows for c in shares(scrambles)]
    fit = fit or held
    if not fit:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, (0.0, 0.0))
    emb = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    w, bias = np.zeros((WIDTH, len(labels))), np.zeros(len(labels))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for k in rng.permutation(len(fit)):
            (ids, share, _), y = fit[k]
            mean = share @ emb[ids]
            g = softmax(mean @ w + bias)
            g[y] -= 1
            back = w @ g
            w -= rate * np.outer(mean, g)
            bias -= 0.01 * rate * g
            emb[ids] -= rate * len(ids) ** 0.5 * share[:, None] * back
    folded = emb @ w
    judged = held or fit
    scored = lambda found: np.array([share @ folded[ids] + bias for ids, share, _ in found]).reshape(len(found), -1)
    logits, y = scored([c for c, _ in judged]), np.array([t for _, t in judged])
    temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).sum())
    p = softmax(logits / temperature)
    right, long = p.argmax(1) == y, np.array([c[2] for c, _ in judged])
    junk, long_junk = softmax(scored(none) / temperature).max(1) if none else np.empty(0), np.array([c[2] for c in none], bool)
    short = float(np.quantile(p[right].max(1), LOST)) if right.any() else 0.0
    clean, lost = p[right & long].max(1), junk[long_junk]
    higher = min(np.quantile(clean, LOST), np.quantile(lost, FOUND)) if len(clean) and len(lost) else 0.0
    return Model(labels, folded, bias, float(temperature), (short, max(short, float(higher))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Train on a hash sample, of about `rows` rows, of the labelled texts that are not held out. Whole texts are counted in the
    tasks; the driver gets their counts, whose size the buckets bound."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    n = usable.count()
    place = F.xxhash64(F.col(doc_id), F.lit("sample"))
    share = min(1.0, rows / max(1, n))
    usable = usable.where(F.pmod(place, F.lit(1 << 30)) <= int(share * (1 << 30)))
    sample = usable.select(F.col(doc_id).cast("string").alias("i"), F.xxhash64(doc_id, text).alias("k"), F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))
    pack = lambda found: [{"b": ids.astype("<u2").tobytes(), "n": times.astype("<u4").tobytes()} for ids, times in found]
    kind = pa.list_(pa.struct([("b", pa.binary()), ("n", pa.binary())]))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [examples(t, k) for k, t in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        columns = [pa.array([g[0] for g in got], pa.bool_()), *(pa.array([pack(g[i]) for g in got], kind) for i in (1, 2))]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["i", "k", "l", "held", "own", "none"])

    seen = map_arrow(sample, kernel, "i string, k long, l string, held boolean, own array<struct<b:binary,n:binary>>, none array<struct<b:binary,n:binary>>")
    read = lambda found: [(np.frombuffer(x.b, "<u2"), np.frombuffer(x.n, "<u4")) for x in found]
    got = [((r.i or "", r.k), r.l, r.held, read(r.own), read(r.none)) for r in seen.toLocalIterator()]
    return learn([row[1:] for row in sorted(got, key=lambda r: r[0])])


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, lang_pred, score, rejected. Null texts and texts without letters are `und`, scored 0 and rejected.

    Without any labelled text to learn from, everything is `und`. Repeated rows each give a row; columns of docs with these
    three names are replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "rejected")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [shared.value.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        columns = list(zip(*got, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    return map_arrow(docs.select(*names, F.col(text).alias("__vantage_text")), kernel, schema_of(docs, names, "lang_pred string, score double, rejected boolean"))


def drop_unknown(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the rows that identification rejects; learns from docs' own labels."""
    rows = docs.select(F.col(doc_id).alias("__vantage_id"), F.xxhash64(text).alias("__vantage_h"), F.col(text).alias("__vantage_t"))
    judged = identify(rows, fit(docs, doc_id, text, lang), "__vantage_t", ["__vantage_id", "__vantage_h"])
    gone = cut(judged.where("rejected").select("__vantage_id", "__vantage_h").distinct())
    return join_small(docs, gone, docs[doc_id].eqNullSafe(F.col("__vantage_id")) & (F.xxhash64(docs[text]) == F.col("__vantage_h")), "left_anti")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = identify(docs, fit(docs), "text", ["doc_id"])
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
