"""Main text of web pages by consensus of each host's pages.

Every page is parsed once to score its containers: a block of text gives its length, less
that of links, to its parent and less to what stands above. The path of the best container,
tags with generalised classes, is the page's vote, weighted by its share of the page's score;
Spark sums votes per host, and all paths with at least ``LEAST_SHARE`` of them win. On the
second pass a page's text is taken from the elements at the first winning path that holds
nearly all of what its own best container does or, where it lies apart from that, at least
half as much; else from that container.

Inside, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out, by tag, role and class words. Words that articles use too (``DOUBTFUL``)
decide alone only while containers are scored; in the text such an element is left out if it
is mostly links, or if the host agrees: most of its pages that differ and have an element at
that path repeat its text.

Text: character references are decoded, white space within a block becomes one space, blocks
are trimmed and joined in page order by newlines; line breaks inside a block count as white
space; formulas and drawings are part of their line. Defined cases: null html is empty and
gives an empty text; null or odd URLs share the host of the empty string; broken markup is
read as far as it goes (unclosed elements end with their parents, an unclosed comment ends
with the page); repeated rows vote each; an empty table gives an empty result; further columns
pass through. Time and memory are linear in a page's length, however deep it nests.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import add_columns, materialise, maybe_broadcast

LEAST_SHARE, LINKS = 0.02, 0.5
DECAY, DEEP = 0.5, 3
NEARLY = 0.95

# What elements are, and words that mark them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template annotation annotation-xml desc".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mo mn ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics "
    "svg g text tspan textpath path circle ellipse line polyline polygon rect use".split()
)
CUT_TAGS = frozenset("nav footer aside form button select dialog menu object audio video canvas datalist input".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored banner sidebar sidebars aside menu menus nav navbar navigation topbar breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription share sharing comment comments disqus replies pagination pager outbrain taboola".split()
)
DOUBTFUL = frozenset("promo promos promotion alert alerts overlay signup login signin social respond related recommended recommendations widget widgets toolbar search hidden copyright disclaimer".split())
COMMENT_WORDS = frozenset("comment comments reply replies disqus ad advert sponsored promo".split())
GOOD_WORDS = frozenset("article articles content post entry story main text body blog page news".split())
SCOPES = frozenset("html body main article section div td th table ul ol dl blockquote figure details fieldset".split())
CLOSES = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
SHAPES = frozenset("path circle ellipse line polyline polygon rect use mspace".split())

_TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[!?/][^>]*>?)", re.S)
_LOOSE = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>?)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?=[\s/]|\Z))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HOST = re.compile(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


@dataclass
class Page:
    """Elements (parent, tag, classes, marked by words) and blocks (element, text, link characters)."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    soft: set[int] = field(default_factory=set)
    weak: set[int] = field(default_factory=set)
    kept: set[int] = field(default_factory=set)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def label(self, node: int) -> str:
        own = self.classes[node]
        return self.tag[node] + ("." + own.replace(" ", ".") if own else "")

    def paths(self) -> list[int]:
        """The number of each element's path."""
        out: list[int] = []
        for k, parent in enumerate(self.parent):
            out.append(step(out[parent] if parent >= 0 else 0, self.label(k)))
        return out


def step(above: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), above)


def path_number(path: str) -> int:
    number = 0
    for label in path.split(">"):
        number = step(number, label)
    return number


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def class_words(found: dict[str, str]) -> set[str]:
    return {w.lower() for w in _WORD.findall(found.get("class", "") + " " + found.get("id", ""))}


class Open:
    """The open elements, and by tag, by kind and by mark where they stand."""

    def __init__(self, page: Page):
        self.page = page
        self.stack: list[int] = []
        self.cut: list[bool] = []  # is it, or what holds it, left out for good
        self.by_tag: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.blocks: list[int] = []
        self.marked: list[int] = []  # numbers of elements that words mark and no article has cleared

    def place(self, *tags: str) -> int:
        """Where the innermost of these tags stands, -1 if nowhere."""
        return max(((self.by_tag.get(t) or [-1])[-1] for t in tags), default=-1)

    def count(self, *tags: str) -> int:
        return sum(len(self.by_tag.get(t, ())) for t in tags)

    def push(self, number: int, gone: bool) -> None:
        tag, at = self.page.tag[number], len(self.stack)
        self.stack.append(number)
        self.cut.append(gone)
        self.by_tag.setdefault(tag, []).append(at)
        if tag in SCOPES:
            self.scopes.append(at)
        if tag not in INLINE:
            self.blocks.append(at)

    def close(self, at: int) -> None:
        for k in self.stack[at:]:
            self.by_tag[self.page.tag[k]].pop()
        for places in (self.scopes, self.blocks):
            while places and places[-1] >= at:
                places.pop()
        while self.marked and self.marked[-1] >= self.stack[at]:
            self.marked.pop()
        del self.stack[at:], self.cut[at:]


def parse(html: str) -> Page:
    page = Page()
    open_ = Open(page)
    held: list[str] = []
    held_links = 0

    def flush():
        nonlocal held_links
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                page.blocks.append((open_.stack[open_.blocks[-1]] if open_.blocks else -1, text, min(held_links, len(text))))
            held.clear()
        held_links = 0

    def add(text):
        nonlocal held_links
        if text and not (open_.cut and open_.cut[-1]):
            held.append(text)
            if open_.by_tag.get("a"):
                held_links += len(text.strip())

    at, size, token = 0, len(html), _TOKEN
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        m = token.match(html, lt)
        if m is None and token is _TOKEN and (m := _LOOSE.match(html, lt)):
            token = _LOOSE  # a quote is never closed: from here on quotes don't count
        if m is None and html.find(">", lt) < 0:
            add(html[at:])
            break
        if m is None:  # not markup
            add(html[at : lt + 1])
            at = lt + 1
            continue
        add(html[at:lt])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        inline = tag in INLINE
        if m[1]:
            if tag == "br" or tag == "p" and not open_.by_tag.get("p"):
                held.append(" ") if tag == "br" else flush()
                continue
            place = open_.place(tag)
            if place >= 0 and not ((inline or tag == "p") and open_.scopes and open_.scopes[-1] > place):
                if not inline:
                    flush()
                open_.close(place)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at) if not m[3].endswith("/") else None
            at = end.end() if end else at if m[3].endswith("/") else size
            continue
        if inline:
            if tag == "br":
                add(" ")
                continue
        else:
            flush()
            # an open paragraph ends where a block starts
            if open_.blocks and page.tag[open_.stack[open_.blocks[-1]]] == "p":
                open_.close(open_.blocks[-1])
            if tag in CLOSES:
                like, within = CLOSES[tag]
                if (place := open_.place(*like)) > open_.place(*within):
                    open_.close(place)
        if tag in VOID or tag in SHAPES and m[3].endswith("/"):
            continue
        found = attributes(m[3]) if m[3] else {}
        words = class_words(found) if found else set()
        number = len(page.tag)
        inside = open_.count("article", "main") > 0
        page.parent.append(open_.stack[-1] if open_.stack else -1)
        page.tag.append(tag)
        page.classes.append(" ".join(sorted(re.sub(r"\d+", "0", found.get("class", "").replace(">", "")).split())))
        gone = bool(open_.cut and open_.cut[-1]) or tag in CUT_TAGS or tag == "header" and not inside
        if found and not gone:
            gone = found.get("role", "").lower() in CUT_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            if tag == "article":
                if words & COMMENT_WORDS:
                    page.soft.add(number)
            elif tag not in ("html", "body", "main") and (words & CUT_WORDS or "header" in words and not inside):
                page.soft.add(number)
            elif tag not in ("html", "body", "main") and words & DOUBTFUL:
                page.weak.add(number)
        if (tag in ("h1", "main") or tag == "article" and number not in page.soft) and open_.marked:
            page.kept.update(open_.marked)  # what holds the article isn't beside it
            open_.marked.clear()
        open_.push(number, gone)
        if number in page.soft or number in page.weak:
            open_.marked.append(number)
    flush()
    return page


def subtrees(page: Page, blocks: list[tuple[int, str, int]]) -> list[tuple[int, int, int]]:
    """For each element the characters inside, those of links, and a digest of the texts."""
    out = [[0, 0, 0] for _ in page.parent]
    for node, text, link in blocks:
        if node >= 0:
            own = out[node]
            own[0] += len(text)
            own[1] += link
            own[2] += xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    for k in range(len(out) - 1, -1, -1):  # children come after their parents
        if (parent := page.parent[k]) >= 0:
            for i in range(3):
                out[parent][i] += out[k][i]
    return [(n, links, digest & (1 << 64) - 1) for n, links, digest in out]


def certain(page: Page) -> list[tuple[int, str, int]]:
    """Blocks outside of all elements that words mark."""
    return outside(page, (page.soft | page.weak) - page.kept)


def wanted(page: Page, repeated: frozenset[int] = frozenset()) -> list[tuple[int, str, int]]:
    """Blocks that stay; repeated: paths whose text the host's pages repeat."""
    out, weak = page.soft - page.kept, page.weak - page.kept
    if weak:
        paths, inside = page.paths(), subtrees(page, page.blocks)
        out = out | {k for k in weak if paths[k] in repeated or inside[k][1] >= LINKS * inside[k][0]}
    return outside(page, out)


def outside(page: Page, nodes: set[int]) -> list[tuple[int, str, int]]:
    if not nodes:
        return page.blocks
    gone = below(page, nodes)
    return [b for b in page.blocks if not gone[b[0]]]


def below(page: Page, nodes: set[int]) -> list[bool]:
    """For each element: is it one of these, or inside one? The last entry is for no element."""
    out = [False] * (len(page.parent) + 1)
    for k, parent in enumerate(page.parent):  # parents come first
        out[k] = k in nodes or out[parent]
    return out


def scores(page: Page, blocks: list[tuple[int, str, int]]) -> dict[int, float]:
    out: dict[int, float] = {}
    for node, text, link in blocks:
        worth = float(len(text) - link)
        if page.tag[node] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "dd") if node >= 0 else False:
            node = page.parent[node]
        for k in range(DEEP):
            if node < 0:
                break
            out[node] = out.get(node, 0.0) + worth * DECAY**k
            node = page.parent[node]
    for node in out:
        if page.tag[node] in ("article", "main"):
            out[node] *= 1.5
        elif page.classes[node] and {w.lower() for w in _WORD.findall(page.classes[node])} & GOOD_WORDS:
            out[node] *= 1.25
    return out


def path_of(page: Page, node: int) -> str:
    parts = []
    while node >= 0:
        parts.append(page.label(node))
        node = page.parent[node]
    return ">".join(reversed(parts))


def best_of(found: dict[int, float]) -> int:
    return max(found, key=lambda k: (found[k], -k)) if found else -1


def votes(html: str | None) -> tuple[list[tuple[str, float]], list[tuple[int, int]]]:
    """The path of a page's best container with its share of the score, and (path, digest of
    the text) of each element that doubtful words mark."""
    page = parse(html or "")
    found = scores(page, certain(page))
    best = best_of(found)
    vote = [(path_of(page, best), found[best] / sum(found.values()))] if best >= 0 and found[best] > 0 else []
    weak = sorted(page.weak - page.kept)
    if not weak:
        return vote, []
    paths, inside = page.paths(), subtrees(page, page.blocks)
    return vote, [(paths[k], inside[k][2]) for k in weak if inside[k][0]]


def extract(html: str | None, leaders: list[str], repeated: frozenset[int] = frozenset()) -> tuple[str, str | None]:
    """The text, and the path it was taken from."""
    page = parse(html or "")
    blocks = wanted(page, repeated)
    if not blocks:
        return "", None
    sure = certain(page)
    best = best_of(scores(page, sure or blocks))
    inside = within(page, {best}, blocks)
    most = sum(len(b[1]) for b in inside)
    at = {id(b) for b in inside}
    paths = page.paths() if leaders else []
    for path in leaders:
        number = path_number(path)
        nodes = {k for k, own in enumerate(paths) if own == number}
        own = within(page, nodes, blocks) if nodes else []
        shared = sum(len(b[1]) for b in own if id(b) in at)
        if nodes and (shared >= NEARLY * most if shared else 2 * sum(len(b[1]) for b in own) >= most):
            return "\n".join(b[1] for b in own), path
    return "\n".join(b[1] for b in inside), path_of(page, best)


def within(page: Page, nodes: set[int], blocks: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    if -1 in nodes:
        return blocks
    inside = below(page, nodes)
    return [b for b in blocks if inside[b[0]]]


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def consensus(pages: DataFrame) -> DataFrame:
    """host, its winning paths, best first, and the paths whose text its pages repeat."""
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("share", pa.float64()), ("number", pa.int64()), ("digest", pa.int64()), ("page", pa.int64())])

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def run(batches):
        for batch in batches:
            rows = []
            for url, html in zip(*batch.columns, strict=True):
                host, html = host_of(url.as_py()), html.as_py()
                best, weak = votes(html)
                rows += [(host, path, share, None, None, None) for path, share in best]
                page = signed(xxhash.xxh3_64_intdigest((html or "").encode("utf-8", "surrogatepass"))) if weak else None
                rows += [(host, None, None, signed(number), signed(digest), page) for number, digest in weak]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)

    # votes, and how many differing pages of a host have each text at a path, are all that is kept
    fields = "host string, path string, share double, number long, digest long, page long"
    said = pages.select("url", "html").mapInArrow(run, fields).groupBy("host", "path", "number", "digest", "page").agg(F.sum("share").alias("share"))
    said = materialise(said, "host-votes")
    sums = said.filter("path is not null").select("host", "path", F.round("share", 6).alias("share"))
    many = sums.join(sums.groupBy("host").agg(F.sum("share").alias("all")), "host").filter(F.col("share") >= LEAST_SHARE * F.col("all"))
    leaders = many.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "path"))).path.alias("leaders"))
    texts = said.filter("number is not null").groupBy("host", "number", "digest").agg(F.count("*").alias("n"))
    paths = texts.groupBy("host", "number").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("again"))
    repeated = paths.filter((F.col("again") > 0) & (2 * F.col("again") >= F.col("n"))).groupBy("host").agg(F.array_sort(F.collect_list("number")).alias("repeated"))
    return leaders.join(repeated, "host", "full")


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages with text (the main text), host and path (where the text was taken from)."""
    winners = materialise(consensus(pages), "host-paths")
    keyed = add_columns(pages, lambda urls: [[host_of(u.as_py()) for u in urls]], "_host string", ["url"])
    size = winners.agg(F.count("*"), F.sum(F.size("leaders")), F.sum(F.size("repeated"))).first()
    joined = keyed.join(maybe_broadcast(winners.withColumnsRenamed({"host": "_host", "leaders": "_leaders", "repeated": "_repeated"}), sum(x or 0 for x in size)), "_host", "left")

    def make(html, leaders, repeated):
        out = [extract(h.as_py(), x or [], frozenset(y & (1 << 64) - 1 for y in r or ())) for h, x, r in zip(html, leaders.to_pylist(), repeated.to_pylist(), strict=True)]
        return [[t for t, _ in out], [p for _, p in out]]

    return add_columns(joined, make, "text string, path string", ["html", "_leaders", "_repeated"]).drop("_leaders", "_repeated").withColumnRenamed("_host", "host")
