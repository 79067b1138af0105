"""Main text of web pages with site template removal.

Each page is read into a flat list of elements and text runs. Every element's subtree is hashed (tag and text below it).
Spark counts, per host, on how many different pages a subtree occurs. What recurs on most of a host's pages is its template
and is deleted wherever it stands; what recurs on many pages, though a small part of a large host (the menu of a section, a
rotating notice), is deleted outside the block that holds most of the page's text. Pages that are copies of each other count
once, so that a copied article does not become a template of its host.

Before that, elements that name themselves as something else than the article (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments) are dropped, by tag, role and class name. On hosts of few pages only these lists
tell what is not the article. The article is chosen by the mass of its text: see Page.text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from array import array
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.common import cut, join_small, map_arrow, schema_of, table

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td template tfoot th thead title tr ul".split()
)
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form frame frameset head header iframe input label legend map menu meter nav noframes noembed noscript object optgroup option output progress script search select style svg template textarea title video xmp".split()
)
#: What an opening tag closes first: (tags that end, tags that stop the search).
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset()),
}
CLOSES_P = BLOCK - frozenset("body br caption col colgroup head html option optgroup tbody td tfoot th thead title tr template".split())
P_SCOPE = frozenset("html body table td th caption button object article section main div blockquote li".split())
#: Parts of class names and ids that mark what is not the article.
MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs byline captcha comment comments commentary consent cookie cookies copyright disqus dropdown footer gdpr header hidden legal login masthead menu menus modal nav navbar navigation navi newsletter notice notices notification alert outbrain overlay pager pagination paywall popup popups privacy promo promoted promotion recommended recommendations related reply replies respond search share sharing shares sidebar signup skip social sponsor sponsored sponsors subscribe subscription taboola tags toolbar topbar tracking widget widgets".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar tablist".split())
#: Elements that hold the page and are never dropped by a class name.
FRAME = frozenset("html body main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A template recurs on this share of a host's different pages, and on so many at least; or on so many, whatever their share.
SHARE, LEAST, MANY = 0.6, 5, 20
#: Hashes of recurring subtrees that a join may broadcast, for all pages together.
BROADCAST_HASHES = 2_000_000


class Page:
    """Elements in document order: tag, parent, whether marked as not the article, whether the head of an article, hash of the
    subtree. runs: (element, text) and (element, None) for a block's border."""

    def __init__(self, source: str):
        self.tags, self.parents, self.marked, self.heads, self.hashes = [""], array("q", [-1]), bytearray(1), bytearray(1), [b""]
        self.runs: list[tuple[int, str | None]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, inner = [0], [hashlib.blake2b(digest_size=8)]
        has_text = [False]
        places: dict[str, list[int]] = {}  # of the open elements of each name in the stack
        self.hashes = [None]
        at = 0

        def text(value: str) -> None:
            if value:
                if not value.isspace():
                    inner[-1].update(" ".join(value.split()).encode("utf-8", "surrogatepass"))
                    has_text[-1] = True
                self.runs.append((stack[-1], value))

        def end() -> None:
            node = stack.pop()
            places[self.tags[node]].pop()
            digest, full = inner.pop().digest(), has_text.pop()
            if full:
                self.hashes[node] = digest
                inner[-1].update(b"<" + self.tags[node].encode("utf-8", "surrogatepass") + b">" + digest)
                has_text[-1] = True
            if self.tags[node] in BLOCK:
                self.runs.append((stack[-1], None))

        def top(names: Iterable[str]) -> int:
            """Place of the innermost open element of these names, 0 if none."""
            return max((places[name][-1] for name in names if places.get(name)), default=0)

        while True:
            m = MARKUP.search(source, at)
            if m is None:
                text(entities.unescape(source[at:]))
                break
            if m.start() > at:
                text(entities.unescape(source[at : m.start()]))
            at = m.end()
            if m["tag"] is None:
                if m["cdata"]:
                    text(m["cdata"])
                continue
            tag = m["tag"].lower()
            if m["close"]:
                if tag == "br":
                    self.runs.append((stack[-1], None))
                elif tag in VOID:
                    continue
                else:
                    depth = top([tag])
                    while depth and len(stack) > depth:
                        end()
                continue
            if tag in CLOSES_P:
                ends, stops = frozenset(["p"]), P_SCOPE
            else:
                ends, stops = frozenset(), frozenset()
            for ends, stops in ((ends, stops), ENDS.get(tag, (frozenset(), frozenset()))):
                if ends:
                    while (depth := top(ends)) > top(stops):
                        while len(stack) > depth:
                            end()
                        if tag not in ("tr", "body"):
                            break
            if tag in BLOCK:
                self.runs.append((stack[-1], None))
            attrs = m["attrs"]
            if tag in VOID:
                continue
            node = len(self.tags)
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.hashes.append(None)
            head = tag == "header" and bool(places.get("article"))
            self.heads.append(head)
            self.marked.append(not head and (tag in DROPPED or (len(attrs) > 1 and self._marks(tag, attrs))))
            if attrs.endswith("/>") and tag not in BLOCK and tag not in RAW:
                continue  # an empty element of foreign markup
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
            inner.append(hashlib.blake2b(digest_size=8))
            has_text.append(False)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
                at = close.end() if close else len(source)
                end()
        while len(stack) > 1:
            end()
        self.hashes[0] = inner[0].digest()

    @staticmethod
    def _marks(tag: str, attrs: str) -> bool:
        for name, *values in ATTRIBUTE.findall(attrs.rstrip(">")):
            name, value = name.lower(), "".join(values)
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                return True
            if name == "role" and value.lower().strip() in ROLES and tag not in FRAME:
                return True
            if name in ("class", "id") and tag not in FRAME:
                for token in value.split():
                    parts = re.split(r"[-_:.]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])", token)
                    parts = [p.lower() for p in parts]
                    if parts[0] not in ("has", "no", "with", "is", "js", "not") and not MARKS.isdisjoint(parts):
                        return True
        return False

    def text(self, templates: frozenset[bytes] = frozenset(), elsewhere: frozenset[bytes] = frozenset()) -> str:
        """Blocks of the article: of the live article elements, else of the main element, else of all that is live.

        Of an article's header the headings stay. An article inside another, larger one is a comment on it, and articles
        inside a main element whose own text outweighs theirs are asides of it; both go. templates: hashes of subtrees that
        are deleted anywhere. elsewhere: hashes deleted outside the innermost element that holds over half of the text, where
        neither an article nor a main element tells the place of the text.
        """
        n = len(self.tags)
        dead, article, main, link, heading, head = bytearray(n), array("q", [0]) * n, bytearray(n), bytearray(n), bytearray(n), bytearray(n)
        for i in range(1, n):
            p, tag = self.parents[i], self.tags[i]
            head[i], heading[i], link[i] = head[p] or self.heads[i], heading[p] or tag in HEADINGS, link[p] or tag == "a"
            dead[i] = dead[p] or self.marked[i] or self.hashes[i] in templates
            article[i], main[i] = (i if tag == "article" else article[p]), main[p] or tag == "main"
        mass = array("q", [0]) * n  # characters of an element's own live text outside links
        for node, value in self.runs:
            if value is not None and not dead[node] and not link[node] and not (head[node] and not heading[node]):
                mass[node] += len("".join(value.split()))
        own: dict[int, int] = {}  # by innermost article
        for i in range(n):
            if mass[i]:
                own[article[i]] = own.get(article[i], 0) + mass[i]
        dropped = set()
        for a in sorted(set(article) - {0}):
            outer = article[self.parents[a]]
            if outer and (outer in dropped or own.get(outer, 0) > own.get(a, 0)):
                dropped.add(a)
        inside = sum(mass[i] for i in range(n) if main[i] and article[i] and article[i] not in dropped)
        if inside and sum(mass[i] for i in range(n) if main[i] and not article[i]) > inside:
            dropped |= {a for a in set(article) - {0} if main[a]}
        live = lambda i: not dead[i] and article[i] not in dropped and not (head[i] and not heading[i])
        for flags in (article, main, None):
            found = self._joined(live if flags is None else lambda i, flags=flags: flags[i] and live(i))
            if found and flags is None and elsewhere:
                return self._joined(lambda i, out=self._recurring(live, mass, elsewhere): live(i) and not out[i])
            if found:
                return found
        return ""

    def _joined(self, live: Callable[[int], bool]) -> str:
        blocks, run = [], []
        for node, value in self.runs:
            if value is None:
                if run:
                    blocks.append(" ".join("".join(run).split()))
                    run = []
            elif live(node):
                run.append(value)
        if run:
            blocks.append(" ".join("".join(run).split()))
        return " ".join(b for b in blocks if b)

    def _recurring(self, live: Callable[[int], bool], mass: array, hashes: frozenset[bytes]) -> bytearray:
        """Elements below those of the hashes that neither lie in the block of most of the text nor hold it."""
        n = len(self.tags)
        below = array("q", [mass[i] if live(i) else 0 for i in range(n)])
        for i in range(n - 1, 0, -1):
            below[self.parents[i]] += below[i]
        block = 0
        for i in range(1, n):  # a child of the block so far that holds over half of the whole is the block
            if self.parents[i] == block and 2 * below[i] > below[0]:
                block = i
        inside, out = bytearray(n), bytearray(n)
        inside[block] = 1
        holds = {block}
        while (up := self.parents[min(holds)]) >= 0:
            holds.add(up)
        for i in range(1, n):
            p = self.parents[i]
            inside[i] = inside[i] or inside[p]
            out[i] = out[p] or (not inside[i] and i not in holds and self.hashes[i] in hashes)
        return out


def host_of(url: str) -> Column:
    """Lower-cased host of a URL; null and unreadable URLs share the host ""."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_key(html: Column, host: Column) -> Column:
    return F.xxhash64(host, html)


def subtrees(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, key, page, subtree): hashes of the host, of the page's source, of its whole text, and of each different subtree with
    text below it."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[int]] = [[], [], [], []]
        for host, key, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if source:
                page = Page(source)
                found = {h for h in page.hashes[1:] if h}
                out[0] += [host] * len(found)
                out[1] += [key] * len(found)
                out[2] += [int.from_bytes(page.hashes[0], "little", signed=True)] * len(found)
                out[3] += [int.from_bytes(h, "little", signed=True) for h in found]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["host", "key", "page", "subtree"])

    rows = pages.select(F.xxhash64(host_of(url)).alias("host"), page_key(F.col(html), host_of(url)).alias("key"), F.col(html).alias("html"))
    return map_arrow(rows, kernel, "host long, key long, page long, subtree long")


def templates(pages: DataFrame, url: str = "url", html: str = "html", share: float = SHARE, least: int = LEAST, many: int = MANY) -> DataFrame:
    """(key, always, elsewhere) of pages with recurring subtrees: hashes of those that recur on enough of their host's different
    pages, and of those that recur on many. A page has no more of them than elements, however many its host has."""
    found = cut(subtrees(pages, url, html))
    each = found.select("host", "subtree", "page").distinct()
    counts = each.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min(least, many))
    n_pages = found.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    template = (F.col("n") >= least) & (F.col("n") >= share * F.col("pages"))
    often = join_small(counts, cut(n_pages), "host").select("host", "subtree", template.alias("template"), F.col("n").alias("n")).where(F.col("template") | (F.col("n") >= many))
    often = cut(often.select("host", "subtree", "template"))
    mine = join_small(found.select("host", "subtree", "key").distinct(), often, ["host", "subtree"])
    listed = lambda flag: F.collect_set(F.when(flag, F.col("subtree")))
    return mine.groupBy("key").agg(listed(F.col("template")).alias("always"), listed(~F.col("template")).alias("elsewhere"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", share: float = SHARE, least: int = LEAST, many: int = MANY) -> DataFrame:
    """pages without html, and text: the page's main text, empty if none. Null html is empty.

    Repeated rows each give a row. Pages without a readable URL share a host. An existing column named text is replaced.
    Pages of any length and depth are read whole.
    """
    kept = [c for c in pages.columns if c not in (html, "text")]
    known = cut(templates(pages, url, html, share, least, many).withColumnsRenamed({c: f"__vantage_{c}" for c in ("key", "always", "elsewhere")}))
    hashes = known.agg(F.sum(F.size("__vantage_always") + F.size("__vantage_elsewhere"))).first()[0] or 0
    rows = pages.select(*kept, page_key(F.col(html), host_of(url)).alias("__vantage_at"), F.col(html).alias("__vantage_html"))
    rows = rows.join(F.broadcast(known) if hashes <= BROADCAST_HASHES else known, F.col("__vantage_at") == F.col("__vantage_key"), "left")
    rows = rows.select(*kept, "__vantage_always", "__vantage_elsewhere", "__vantage_html")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.num_columns - 3
        read = lambda found: frozenset(h.to_bytes(8, "little", signed=True) for h in found or ())
        out = [Page(source).text(read(always), read(elsewhere)) if source else "" for always, elsewhere, source in zip(*(batch.column(at + i).to_pylist() for i in range(3)), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.string())], [*kept, "text"])

    return map_arrow(rows, kernel, schema_of(pages, kept, "text string"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
