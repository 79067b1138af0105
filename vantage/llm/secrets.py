"""Secret scanning: fixed patterns, and novelty by dictionary-primed zstandard.

A string in a sensitive context (after a word such as key, credential or bearer) is a candidate. What it adds to the
compressed size of the code around it, under a dictionary of common identifiers, measures how much of it is new: names
and paths are built of what the dictionary and the surroundings already hold and add little; random strings add nearly
their length. Candidates that add at least a given share of their length are reported.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from itertools import islice, pairwise, takewhile
from string import ascii_lowercase

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.common import map_arrow, schema_of, table, utf8

KINDS = ["assign", "access", "hex", "novel"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"cred", b"bearer", b"private", b"signature", b"cookie", b"session")
CANDIDATE = re.compile(
    r"""(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth\w*|cred\w*|bearer|private|signature|cookie|session)\w{0,24}["']?[\x20\t]*(?:[:=]|=>|:=|is)?[\x20\t]*["']?([A-Za-z0-9+/_.=~!@#$%^&*-]{12,})""",
    re.IGNORECASE | re.ASCII,
)
#: Share of a candidate's bytes that have to be new, the bytes that any short string is spared, and characters of surroundings
#: on either side.
NOVELTY, SPARED, AROUND = 0.66, 3, 512
#: Characters of a candidate that are measured at once; a longer one is cut into equal pieces.
MEASURED = 4096
_HEX_RUN = bytes(120 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))
IDENTIFIERS = b"""
access account action active address admin api app application args array async attribute auth authorization await base
begin body bool boolean break buffer byte cache call callback case catch char class client close code collection column
com common compile component config configuration connect connection const constructor container content context cookie
count create credential credentials current data database date debug default define delete dependency description dev
development directory disable document domain double dynamic element else email enable encode encoding end endpoint entry
enum environment error event example exception execute export extends extension false field file filter final finally find
float folder format from function generate get global group handle handler hash header headers host http https identifier
image import include index info init input insert instance int integer interface internal item iterator json key kind
label lambda last length level library line link list load local localhost location log logger login long loop main
manager map match max message method min mode model module name namespace new next node none not null number object option
options order org output override package page param parameter parameters parent parse password path pattern permission
placeholder pointer policy port position post prefix print private process production profile project property protected
provider public query queue random range read record reference register release remote remove replace repository request
required reset resource response result return role root route row rule run save schema scope script search secret section
select self send server service session set settings setup signature size sort source start state static status storage
store str stream string struct style subject success suffix super switch sync system table tag target task template test
text this thread throw time timeout timestamp title token tool total transaction transform true try type undefined union
unit update upload uri url usage user username users utf8 util utils valid validate value values var variable vector
version view void wait warning web while width window with write www xml yaml your_api_key_here changeme xxxxxxxxxxxxxxxx
0123456789 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ os.environ[" process.env. System.getenv("
"""
#: Common words and syllables of other languages, which with IDENTIFIERS tell the letter pairs of names.
WORDS = """
schaft heit keit ung lich isch chen zeit einheit sicherheit schluessel verfahren verwaltung zugang benutzer kennwort dieser
welche zwischen nicht auch durch werden wurde rechnung beschreibung gesellschaft freiheit wichtigkeit anmeldung berechtigung
tion ment eur eux aux elle ance ence ique utilisateur connexion securite motdepasse toujours beaucoup gouvernement
cion dad mente ado ido aje usuario contrasena seguridad tambien desarrollo gobierno conocimiento clave conexion
characteristics considerations understanding negotiations performance relationship knowledge authentication requirements
"""


@cache
def _pairs() -> dict[tuple[str, str], float]:
    """By how many bits each letter is likelier after the other in names than in random strings."""
    seen = Counter(pair for w in re.findall("[a-z]+", (IDENTIFIERS.decode() + WORDS).lower()) for pair in pairwise(w))
    first: Counter = Counter()
    for (x, _), n in seen.items():
        first[x] += n
    return {(x, y): math.log2(26 * (seen[x, y] + 0.3) / (first[x] + 26 * 0.3)) for x in ascii_lowercase for y in ascii_lowercase}


def named(candidate: str) -> bool:
    """Whether the pairs of its letters are those of names, more than those of random strings."""
    weights = [_pairs()[pair] for run in re.findall("[a-z]+", candidate.lower()) for pair in pairwise(run)]
    return sum(weights) > 0


def needed(candidate: str) -> float:
    """Bytes that a candidate has to add: fewer for a long one of few classes of characters, as random ones compress too."""
    full, n = NOVELTY * len(candidate), len(candidate)
    size = 10 * any(c.isdigit() for c in candidate) + 26 * any(c.islower() for c in candidate) + 26 * any(c.isupper() for c in candidate)
    return min(full, full * math.log2(size) / math.log2(62) + 10) if 0 < size < 62 else full


@cache
def _compressor() -> zstandard.ZstdCompressor:
    priming = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    # matches from three bytes on, so that names put together of short known words compress
    settings = zstandard.ZstdCompressionParameters(compression_level=19, min_match=3, strategy=zstandard.STRATEGY_BTULTRA2, window_log=17, hash_log=17, chain_log=17, search_log=9, target_length=256, write_content_size=False)
    return zstandard.ZstdCompressor(dict_data=priming, compression_params=settings)


def marginal_bytes(before: str, candidate: str, after: str) -> int:
    """Compressed bytes that the candidate adds to its surroundings."""
    c = _compressor()
    around = (after + "\n" + before).encode("utf-8", "surrogatepass")
    return len(c.compress(around + candidate.encode())) - len(c.compress(around))


def novel(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of the candidate text[start:end] that are new: all of it, or those of its pieces that are, joined."""
    n = -(-(end - start) // MEASURED)
    bounds = [start + (end - start) * i // n for i in range(n + 1)]
    added = [marginal_bytes(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND]) + SPARED for a, b in zip(bounds, bounds[1:], strict=False)]
    if sum(added) >= sum(needed(text[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)):
        return [(start, end)]
    out: list[tuple[int, int]] = []
    for a, b, new in zip(bounds, bounds[1:], added, strict=False):
        if new >= needed(text[a:b]):
            out = [*out[:-1], (out[-1][0], b)] if out and out[-1][1] == a else [*out, (a, b)]
    return out


def find(data: bytes | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered by start and then by KINDS. Null is empty.

    Patterns run only over texts that hold a literal they need, found on the bytes.
    """
    if not data:
        return []
    low = data.lower()
    sensitive = any(s in low for s in SENSITIVE)
    access, run = b"AKIA" in data, b"x" * 24 in data.translate(_HEX_RUN)
    if not (sensitive or access or run):
        return []
    text = data.decode("utf-8", "replace")
    found = []
    if sensitive:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if access:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if run:
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if sensitive:
        base = sorted(found, key=lambda s: s[1])
        at = 0
        for m in CANDIDATE.finditer(text):
            a, b = m.span(1)
            while at < len(base) and base[at][2] <= a:
                at += 1
            if any(e > a for _, s, e in takewhile(lambda x: x[1] < b, islice(base, at, None))):
                continue
            word = m[1]
            if not any(c.isdigit() for c in word) and named(word):
                continue  # words
            if len(set(word)) < 4 and (not any(c.isdigit() for c in word) or sum(c.isalpha() for c in word) < 2):
                continue  # a ruler, which is too short to show that it repeats
            found += [("novel", *span) for span in novel(text, a, b)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the text by default) and spans: array of (kind, start, end), end exclusive, in code points.

    Null and empty texts have no spans. Repeated rows each give a row. An existing column spans is replaced. A sensitive
    context is a word of the pattern with up to 24 more word characters before the string; what surrounds a candidate, and is
    measured with it, are AROUND characters on either side.
    """
    names = [c for c in docs.columns if c not in (text, "spans")] if keep is None else keep

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t)] for t in utf8(batch, "__vantage_text")]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, SPANS)], [*names, "spans"])

    return map_arrow(docs.select(*names, F.col(text).alias("__vantage_text")), kernel, schema_of(docs, names, "spans array<struct<kind:string,start:bigint,end:bigint>>"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s.kind != "novel")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count("novel"))
