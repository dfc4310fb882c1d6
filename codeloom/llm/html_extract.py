"""HTML extraction by equivalence-class template deduction.

Each page is read into block elements, each with the path of tags and class names above it
(as a hash), and into runs of text in them. Within a host, paths whose occurrence vectors over
the host's different pages are equal form an equivalence class; a vector is kept as the
exclusive-or of hashes of (page, number of occurrences), which partial aggregation can build,
so no task sees a whole host. A class is valid if it has LEAST pages or more, if its paths
occur equally often on each page or are several, and if it nests: its paths that do not lie in
one another lie in paths of one and the same class. The paths of valid classes are the
template; what they hold are its slots (`templates`).

The template decides on each page. Of the paths that stand once on every page of the host, the
deepest that holds more than HALF of the text outside links is the content slot (an `article`
or `main` is not entered further). Text outside it goes, and where articles or a main element stand
in it only these are kept. Inside it nothing goes for repeating itself or for its links (table heads,
labels, bylines and reference lists do), but slots of the template that have a name of role
(`related`, `share-bar`) and whose text repeats over pages, and outside articles and main elements
those that are lists of the same links on each page. Pages whose main text by marks of role is
equal (mirrors, print views) count once in all of this.

Marks of role that always drop: navigation, asides, forms and footers by tag or ARIA role, hidden elements, and
adverts, consent boxes and reader comments by class name or id, alone (`comments`) or with words of structure
(`comment-list`), at any depth. Other names of role (`search`, `notice`) drop only what the template
shows to repeat; where there is no template, only blocks outside articles and main elements, and no paragraphs or headings.

Pages of hosts without LEAST different pages, or without a content slot, and pages that lack
it, are judged by marks of role alone; the column `by` says which (`template` or `roles`).

White space in a block becomes one space; blocks are joined by line feeds, in page order.
Null and empty html, and pages without main text, give the empty text; broken or cut markup
is read as far as it goes; long pages are read whole; null urls are a host of their own; equal
pages of a host count once in its template, a path's text then being that of the page of least hash; repeated rows repeat; other columns are ignored,
whatever their names; no rows give none.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_side, staged
from .url_filter import host

LEAST = 3
#: The content slot holds more than this share of a host's text outside links.
HALF = 0.5
#: A path's text repeats if it has fewer different texts than this share of its pages; a list of links holds more than this share in links.
REPEATS, LINKS = 0.5, 0.9

_BLOCK = set("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript template iframe".split())
#: What closes an open element of the same group that its author left open.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = set("ul ol dl table tbody thead article main section div body select".split())
#: Blocks that can be a content slot.
_HOLDERS = set("html body main article section div td blockquote center details figure".split())
_DROPPED = set("nav footer aside form button select object canvas svg dialog head".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names of adverts, consent boxes and reader comments; other names of roles; words of structure that stand beside them in compound names.
_DEFINITE = set("ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr comment comments reply replies respond disqus".split())
_NAMES = set("nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager toolbar share sharing social footer masthead sidebar related notice notices alert popup modal overlay banner promo promotion subscribe newsletter signup login search".split())
_STRUCTURE = set("area articles bar block bottom box button buttons col column container content form global group header icons inner item items left link links list main page panel posts primary results right row secondary section side site slot stories thread top unit user widget wrap wrapper".split())
#: Blocks of running text, which no name of role but the definite ones drops.
_PROSE = set("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th figcaption".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w:]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
_BITS = (1 << 64) - 1
#: Path of a page as a whole.
ROOT = 1


class Element:
    """An open element. path: hash of the blocks' tags and class names down to it; block: the nearest block at or above it."""

    __slots__ = ("block", "chars", "drop", "inside", "link", "linked", "loose", "main", "parent", "path", "tag", "text")

    def __init__(self, tag: str, path: int, parent: Element | None):
        self.tag, self.path, self.parent, self.block = tag, path, parent, self
        self.drop = self.inside = self.loose = self.link = self.main = False
        self.chars = self.linked = self.text = 0


def _named(value: str) -> tuple[bool, bool]:
    """Whether a class name or id is a definite name of role, and whether it is one of the others; compound names with words of structure only."""
    words = {w.lower() for w in _WORDS.findall(value)} if value.lower() not in _NAMES | _DEFINITE else {value.lower()}
    if not words <= _DEFINITE | _NAMES | _STRUCTURE:
        return False, False
    return bool(words & _DEFINITE), bool(words & _NAMES)


def _roles(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """Whether an element's marks of role drop it, whether they may (if the template agrees), and its class names."""
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    names = found.get("class", "")
    marks = [_named(x) for x in [*names.split(), found.get("id", "")] if x]
    drop = tag in _DROPPED or found.get("role", "").lower() in _ROLES or any(d for d, _ in marks) or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    solid = tag in ("html", "body", "article", "main")
    return drop and not solid, any(m for _, m in marks) and not solid, names


class Page:
    """A page as it is read. content, boiler: paths of the host's template.

    blocks: (text, inside the content slot, in article or main, dropped, dropped or with a name of role).
    paths: of each block path: parent, occurrences, hash of its text, code points, those in links, depth, tag, and
    whether it lies below an article or main, and has a name of role.
    """

    def __init__(self, page: str, content: int | None = None, boiler: frozenset[int] = frozenset(), count: bool = False):
        self.blocks: list[tuple[str, bool, bool, bool, bool]] = []
        self.paths: dict[int, list] = {}
        self.has_content = self.has_main = False
        self._content, self._boiler, self._count = content, boiler, count
        self._root = Element("", ROOT, None)
        self._stack = [self._root]
        self._at: dict[str, list[int]] = {}  # places of open elements in the stack, by tag
        self._stops: list[int] = []
        self._text: list[str] = []
        self._linked = self._links = 0
        self._read(page)
        self._flush()
        self._close(0)

    def _flush(self) -> None:
        whole = " ".join(entities.unescape("".join(self._text)).split())
        if whole:
            e = self._stack[-1]
            block, linked = e.block, min(self._linked, len(whole))
            self.blocks.append((whole, e.inside, e.main, e.drop, e.drop or e.loose))
            if self._count:
                block.chars += len(whole)
                block.linked += linked
                block.text = (block.text * 1_000_003 ^ xxhash.xxh64_intdigest(whole)) & _BITS
        self._text.clear()
        self._linked = 0

    def _close(self, depth: int) -> None:
        """Closes the open elements from a place in the stack on."""
        if any(e.block is e or e.drop != e.parent.drop for e in self._stack[depth:] if e.parent):
            self._flush()
        while len(self._stack) > depth:
            e = self._stack.pop()
            if not e.parent:
                self._account(e, len(self._stack))
                break
            self._at[e.tag].pop()
            if self._stops and self._stops[-1] == len(self._stack):
                self._stops.pop()
            self._links -= e.link
            if e.block is e:
                self._account(e, len(self._stack))
                above = e.parent.block
                above.chars += e.chars
                above.linked += e.linked
                above.text = (above.text * 1_000_003 ^ e.text) & _BITS

    def _account(self, e: Element, depth: int) -> None:
        if not self._count:
            return
        entry = self.paths.get(e.path)
        if entry is None:
            above = e.parent.block if e.parent else None
            entry = self.paths[e.path] = [above.path if above else None, 0, 0, 0, 0, depth, e.tag, bool(above and above.main), e.loose and not (above and above.loose)]
        entry[1] += 1
        entry[2] = (entry[2] * 1_000_003 ^ e.text) & _BITS
        entry[3] += e.chars
        entry[4] += e.linked

    def _last(self, tag: str) -> int:
        """Where the innermost open element of a tag stands; -1 if there is none."""
        places = self._at.get(tag)
        return places[-1] if places else -1

    def _open(self, tag: str, attributes: str) -> None:
        stop = self._stops[-1] if self._stops else -1
        if tag in _BLOCK:
            self._flush()
            if self._last("p") > stop:
                self._close(self._last("p"))
                stop = self._stops[-1] if self._stops else -1
        left_open = max((self._last(t) for t in _CLOSES.get(tag, ())), default=-1)
        if left_open >= 0 and left_open >= stop:
            self._close(left_open)
        above = self._stack[-1]
        drop, loose, names = _roles(tag, attributes)
        is_block = tag in _BLOCK
        e = Element(tag, above.path, above)
        if is_block:
            name = ".".join([tag, *_DIGITS.sub("0", names).split()])
            e.path = xxhash.xxh64_intdigest(name, seed=above.path)
        else:
            e.block = above.block
        e.main = above.main or tag in ("article", "main") or 'role="main"' in attributes
        self.has_main |= e.main
        if tag == "header" and not above.main:
            drop = True
        if drop and not above.drop:
            self._flush()
        e.inside = above.inside or (is_block and e.path == self._content)
        self.has_content |= e.inside
        e.drop = above.drop or drop or (is_block and e.path in self._boiler)
        e.loose = above.loose or (loose and (self._count or (not above.main and tag not in _PROSE)))
        e.link = tag == "a"
        self._links += e.link
        self._at.setdefault(tag, []).append(len(self._stack))
        if tag in _STOPS:
            self._stops.append(len(self._stack))
        self._stack.append(e)

    def _read(self, page: str) -> None:
        at = 0
        while at < len(page):
            m = _TOKEN.search(page, at)
            run = page[at : m.start() if m else len(page)]
            if run:
                self._text.append(run)
                self._linked += len(run) if self._links else 0
            if not m:
                break
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                place = self._last(tag)
                if place > 0:
                    self._close(place)
                elif tag in _BLOCK:
                    self._flush()
            elif m[2]:
                tag = m[2].lower()
                if tag in _RAW:
                    end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else len(page)
                    self._text.append(" ")
                elif tag in _VOID:
                    if tag == "hr":
                        self._flush()
                    self._text.append(" ")
                else:
                    self._open(tag, m[3] or "")

    def by_template(self) -> bool:
        return self.has_content

    def core(self) -> str:
        """What mirrors of a page share: the text that no definite mark of role drops, of articles and main elements if there are any."""
        kept = [b for b in self.blocks if not b[3]]
        return "\n".join(b[0] for b in kept if b[2] or not self.has_main)

    def main_text(self) -> str:
        """The text of the content slot; without one, by marks of role."""
        kept = [b for b in self.blocks if not b[3] and b[1]] if self.has_content else [b for b in self.blocks if not b[4]]
        if any(b[2] for b in kept) or (self.has_main and not self.has_content):
            kept = [b for b in kept if b[2]]
        return "\n".join(b[0] for b in kept)


def main_text(page: str | None, content: int | None = None, boiler: frozenset[int] = frozenset()) -> str:
    """The main text of a page, given its host's content slot and the slots in it that go."""
    return Page(page or "", content, boiler).main_text()


_TOKENS = "host string, page bigint, core bigint, path bigint, parent bigint, n bigint, text bigint, chars bigint, linked bigint, depth int, holder boolean, below boolean, loose boolean"


def _signed(value: int | None) -> int | None:
    return None if value is None else value - (1 << 64) if value >> 63 else value


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path tokens of each page, with what they hold."""
    fields = [c.split() for c in _TOKENS.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for h, page, source in zip(*(batch.slice(at, 256).column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
                read = Page(source or "", count=True)
                core = read.core()
                core = _signed(xxhash.xxh64_intdigest(core)) if core else page
                for path, (parent, n, text, chars, linked, depth, tag, below, loose) in read.paths.items():
                    rows.append((h, page, core, _signed(path), _signed(parent), n, _signed(text), chars, linked, depth, tag in _HOLDERS, below, loose))
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def template_paths(pages: DataFrame) -> DataFrame:
    """One row for each path of each host: host, path, pages, texts, n (least and greatest on a page), chars, linked, holder, below,
    depth, and fixed: whether it belongs to the template. pages: host, page, html.
    """
    # pages of equal main text count once: of each path the row of the least page
    rest = [c.split()[0] for c in _TOKENS.split(", ") if c.split()[0] not in ("host", "path", "core")]
    tokens = pages.mapInArrow(_tokens, _TOKENS).groupBy("host", "path", "core").agg(F.min(F.struct(*rest)).alias("x")).select("host", "path", F.col("core").alias("page"), *(F.col(f"x.{c}").alias(c) for c in rest if c != "page"))
    # two steps, so that different texts are counted by partial sums
    flags = [F.first(c).alias(c) for c in ("parent", "depth", "holder", "below", "loose")]
    texts = tokens.groupBy("host", "path", "text").agg(F.count(F.lit(1)).alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), *flags)
    seen = texts.groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("texts"), F.bit_xor("vector").alias("vector"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), *flags)
    seen = staged(seen, "paths")
    # a class is its vector; it nests if those of its paths that lie in paths of other classes lie in one of these
    above = seen.select("host", F.col("path").alias("parent"), F.col("vector").alias("above"))
    placed = seen.join(above, ["host", "parent"], "left")
    outer = F.when(F.col("above") != F.col("vector"), F.col("above"))
    classes = placed.groupBy("host", "vector").agg(F.max("pages").alias("support"), F.count(F.lit(1)).alias("size"), F.min("least").alias("c_least"), F.max("most").alias("c_most"), F.min(outer).alias("low"), F.max(outer).alias("high"))
    valid = (F.col("support") >= LEAST) & ((F.col("c_least") == F.col("c_most")) | (F.col("size") > 1)) & F.coalesce(F.col("low") == F.col("high"), F.lit(True))
    return placed.join(classes, ["host", "vector"]).withColumn("fixed", valid).select("host", "path", "pages", "texts", "least", "most", "chars", "linked", "holder", "below", "loose", "depth", "fixed")


def templates(pages: DataFrame) -> DataFrame:
    """One row per host with a content slot: host, content (its path), boiler (paths of the slots that go). pages: host, page, html."""
    paths = staged(template_paths(pages), "template")
    whole = paths.where(F.col("path") == _signed(ROOT)).select("host", F.col("pages").alias("all_pages"), (F.col("chars") - F.col("linked")).alias("all_text"))
    repeats = F.col("texts") < REPEATS * F.col("pages")
    holds = F.col("fixed") & F.col("holder") & ~F.col("below") & (F.col("least") == 1) & (F.col("most") == 1) & ~repeats
    slots = paths.where(holds).join(whole, "host").where((F.col("pages") == F.col("all_pages")) & (F.col("chars") - F.col("linked") > HALF * F.col("all_text")))
    # two such paths lie in one another, for both hold more than half; the deepest is the slot
    content = slots.groupBy("host").agg(F.max_by("path", "depth").alias("content"))
    menu = (F.col("linked") > LINKS * F.col("chars")) & ~F.col("below")
    goes = F.col("fixed") & repeats & (F.col("loose") | menu) & (F.col("pages") > 1) & (F.col("chars") > 0)
    boiler = paths.where(goes).groupBy("host").agg(F.collect_list("path").alias("boiler"))  # template paths only
    return content.join(boiler, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, by."""
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), "html")
    known = staged(templates(rows.select("host", F.xxhash64("html").alias("page"), "html").where("html is not null")), "templates")
    joined = rows.join(small_side(known), "host", "left").select("page_id", "url", "content", "boiler", "html")
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("by", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, by = [], []
                for source, content, boiler in zip(*(part.column(c).to_pylist() for c in ("html", "content", "boiler")), strict=True):
                    page = Page(source or "", None if content is None else content & _BITS, frozenset(x & _BITS for x in boiler or ()) - {0 if content is None else content & _BITS})
                    texts.append(page.main_text())
                    by.append("template" if page.by_template() else "roles")
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(by, pa.string())], schema.names)

    return joined.mapInArrow(run, schema)
