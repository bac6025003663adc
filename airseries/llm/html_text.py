"""Main text of web pages, with site templates removed.

A tolerant parser builds the element tree of a page. Elements that are never
article text (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) go by tag, role or class. What a site repeats
goes by count: every container subtree is hashed, Spark counts the distinct
pages of each (host, hash), and subtrees that recur on many pages of their host
are deleted. Article text proper (``article``/``main`` themselves, paragraphs,
headings, lists, quotations inside them, and what holds one of these) is never
taken for a template, nor is the block that holds most of a page's text, so a
passage that many articles share stays.

Character references are decoded, white space inside a block becomes one space,
blocks are joined by an empty line. Nothing is capped.

Defined results: NULL or empty html gives an empty text; a page without a host
takes part in no template count; broken markup is closed where HTML implies it;
repeated rows are each extracted (equal pages count as one page of a template,
whatever their page_ids); other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airseries.llm.common import prepare, written
from airseries.llm.url_filter import host_of

#: A subtree is a template of a host if it recurs on so many of its pages, and on this share of them
#: (which bounds a host's templates to 1 / MANY_SHARE times the subtrees of a page).
MANY_PAGES, MANY_SHARE = 5, 0.01

# fixed values: HTML's element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCK = frozenset("""address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure
 footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary
 table tbody td tfoot th thead tr ul caption center""".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot option optgroup body html caption".split())
#: A start tag ends an open element of these names (up to the nearest scope element).
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
           "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table div section article main body html aside nav form".split())
# never article text, by tag, role and words of class or id
DROPPED = frozenset("""head script style noscript template iframe object embed svg canvas audio video map nav footer aside
 form button select input textarea label menu dialog fieldset""".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
DROPPED_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies
 consent gdpr notice notices popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead
 comment comments respond reply replies disqus share sharing social related recommended newsletter subscribe signup login
 widget pagination pager toolbar skip""".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption article main body html".split())
PAGE_TAGS = frozenset("article main body html".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD_SPLIT = re.compile(r"[^a-z]+")


class Element:
    __slots__ = ("tag", "attrs", "nodes")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.nodes = tag, attrs, []


def parse(page: str) -> Element:
    """Element tree; texts are plain strings, still with character references."""
    root = Element("#root")
    stack = [root]
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].nodes.append(page[at:])
            break
        if m.start() > at:
            stack[-1].nodes.append(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            _close(stack, ("p",))
        if tag in IMPLIED:
            _close(stack, IMPLIED[tag])
        e = Element(tag, m[3])
        stack[-1].nodes.append(e)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            e.nodes.append(page[at:close.start()] if close else page[at:])
            at = close.end() if close else end
            continue
        stack.append(e)
    return root


def _close(stack: list[Element], names: tuple[str, ...]) -> None:
    """End open elements of these names; inline elements inside them end too."""
    found = None
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in names:
            found = i
        elif stack[i].tag in SCOPE and stack[i].tag not in names:
            break
    if found is not None:
        del stack[found:]


def dropped(e: Element, in_article: bool) -> bool:
    """Not article text by tag, role, class or id."""
    if e.tag in DROPPED or e.tag == "header" and not in_article:
        return True
    if not e.attrs or e.tag in ("html", "body", "main"):
        return False
    for m in ATTR.finditer(e.attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in DROPPED_ROLES:
            return True
        if name in ("class", "id") and (words := DROPPED_WORDS.intersection(WORD_SPLIT.split(value))):
            # an article's own heading block may be called a header
            if not (words <= {"header"} and in_article):
                return True
    return False


def _articles(e: Element, out: list[Element], tag: str) -> None:
    stack = [(e, False)]
    while stack:
        node, _ = stack.pop()
        if node.tag != "#root" and dropped(node, False):
            continue
        if node.tag == tag or tag == "main" and 'role="main"' in node.attrs:
            out.append(node)
            continue
        stack.extend((n, False) for n in reversed(node.nodes) if isinstance(n, Element))


def content_roots(root: Element) -> list[Element]:
    """The main elements and the articles outside them; without a main element, the whole page."""
    mains: list[Element] = []
    _articles(root, mains, "main")
    if not mains:
        return [root]
    out: list[Element] = []
    _outermost(root, out, {id(m) for m in mains})
    return out


def _outermost(e: Element, out: list[Element], mains: set[int]) -> None:
    stack = [e]
    while stack:
        node = stack.pop()
        if id(node) in mains or node.tag == "article" and not dropped(node, False):
            out.append(node)
        elif node.tag == "#root" or not dropped(node, False):
            stack.extend(n for n in reversed(node.nodes) if isinstance(n, Element))


def main_block(root: Element) -> tuple[set[int], Element]:
    """By identity: the elements that hold more than half of a page's text outside dropped
    elements; and the innermost container of them."""
    size: dict[int, int] = {}
    stack: list = [(root, False)]
    while stack:
        e, done = stack.pop()
        if e.tag != "#root" and dropped(e, True) or e.tag == "title":
            size[id(e)] = 0
        elif not done:
            stack.append((e, True))
            stack.extend((n, False) for n in e.nodes if isinstance(n, Element))
        else:
            size[id(e)] = sum(size[id(n)] if isinstance(n, Element) else len("".join(n.split())) for n in e.nodes)
    most, at, block = {id(root)}, root, root
    while inner := [n for n in at.nodes if isinstance(n, Element) and 2 * size[id(n)] > size[id(root)]]:
        at = inner[0]
        most.add(id(at))
        if at.tag in BLOCK and at.tag not in TEXT_TAGS - PAGE_TAGS:
            block = at
    return most, block


def subtree_hashes(root: Element) -> dict[int, tuple[int, Element]]:
    """By identity: signed 64-bit hash and element, of every subtree that may be a template.

    Bottom-up in one walk: a subtree's hash is made of its tag, texts and the
    hashes below (attributes do not count). Left out are article text, the block
    that holds most of the page's text, whatever inside them holds a paragraph,
    heading or list, and subtrees that hold an article."""
    out: dict[int, tuple[int, Element]] = {}
    digest: dict[int, bytes] = {}
    holds: set[int] = set()
    texts: set[int] = set()
    most, block = main_block(root)
    stack: list = [(root, False, False)]
    while stack:
        e, in_article, done = stack.pop()
        bare = e is block and e.tag in ("#root", "html", "body")
        inside = in_article or e.tag in ("article", "main") or e is block and not bare
        if not done:
            stack.append((e, in_article, True))
            stack.extend((n, inside or bare and n.tag in TEXT_TAGS - PAGE_TAGS, False) for n in e.nodes if isinstance(n, Element))
            continue
        h = xxhash.xxh64(e.tag)
        for n in e.nodes:
            if isinstance(n, Element):
                h.update(digest.pop(id(n)))
                if id(n) in holds:
                    holds.add(id(e))
                if id(n) in texts:
                    texts.add(id(e))
            else:
                h.update(" ".join(n.split()).encode("utf-8", "replace"))
        digest[id(e)] = h.digest()
        if e.tag in ("article", "main"):
            holds.add(id(e))
        if e.tag in TEXT_TAGS:
            texts.add(id(e))
        free = id(e) not in texts if in_article else e.tag not in ("html", "body")
        if e.tag in BLOCK and free and id(e) not in holds and id(e) not in most:
            v = h.intdigest()
            out[id(e)] = v - (1 << 64) if v >> 63 else v, e
    return out


def candidates(root: Element) -> set[int]:
    """Hashes of the subtrees that could be a site's template."""
    return {h for h, _ in subtree_hashes(root).values()}


def prune(root: Element, templates: frozenset[int]) -> Element:
    """``root`` without the subtrees whose hash is in ``templates``."""
    gone = {i for i, (h, _) in subtree_hashes(root).items() if h in templates} if templates else set()
    stack = [root] if gone else []
    while stack:
        e = stack.pop()
        # a rule in its place still ends the block before it
        e.nodes = [Element("hr") if isinstance(n, Element) and id(n) in gone else n for n in e.nodes]
        stack.extend(n for n in e.nodes if isinstance(n, Element))
    return root


def text_of_page(page: str, templates: frozenset[int] = frozenset()) -> str:
    """Main text of a page; ``templates``: hashes of the subtrees its site repeats."""
    blocks: list[str] = []
    open_: list[str] = []

    def end_block() -> None:
        if open_:
            t = " ".join(html_lib.unescape("".join(open_)).split())
            if t:
                blocks.append(t)
            open_.clear()

    for top in content_roots(prune(parse(page), templates)):
        stack: list = [(n, top.tag != "#root") for n in reversed(top.nodes)]
        while stack:
            n, in_article = stack.pop()
            if n is None:
                end_block()
            elif isinstance(n, str):
                open_.append(n)
            elif n.tag == "br":
                open_.append(" ")
            elif not dropped(n, in_article) and n.tag != "title":
                block = n.tag in BLOCK
                if block:
                    end_block()
                    stack.append((None, False))
                inside = in_article or n.tag in ("article", "main")
                stack.extend((m, inside) for m in reversed(n.nodes))
        end_block()
    return "\n\n".join(blocks)


def site_templates(pages: DataFrame) -> DataFrame:
    """(host, hashes): the subtrees that recur on many pages of a host.

    ``pages``: page_id, host, html. A host has at most 1 / MANY_SHARE times the
    subtrees of a page, so the array stays short however many pages it has."""
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hosts, found = [], [], []
            for host, page in zip(*(c.to_pylist() for c in b.columns)):
                # copies of a whole page are one page
                whole = xxhash.xxh64(page.encode("utf-8", "replace")).intdigest()
                for h in candidates(parse(page)):
                    ids.append(whole - (1 << 64) if whole >> 63 else whole)
                    hosts.append(host)
                    found.append(h)
            yield pa.RecordBatch.from_pydict({"page": pa.array(ids, pa.int64()), "host": pa.array(hosts, pa.string()),
                                              "hash": pa.array(found, pa.int64())})

    known = pages.where("host <> '' AND html IS NOT NULL AND page_id IS NOT NULL")
    seen = known.select("host", "html").mapInArrow(hashes, "page long, host string, hash long")
    # distinct pages, counted in two steps so that a common subtree of a large host is split over tasks
    counts = seen.distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= MANY_PAGES)
    total = known.select("host", F.xxhash64("html").alias("page")).distinct().groupBy("host").agg(F.count("*").alias("of"))
    return (counts.join(total, "host").where(F.col("n") >= F.col("of") * MANY_SHARE)
            .groupBy("host").agg(F.collect_list("hash").alias("hashes")))


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text of every page."""
    prepare(pages.sparkSession)
    src = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                       host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    templates = written(site_templates(src.select("page_id", "host", "html")), "site-templates")
    # a plain join of two scans: Spark broadcasts the table by its measured size, or splits a large host
    both = src if templates.isEmpty() else src.join(templates, "host", "left")
    hashes = F.lit(None).cast("array<long>").alias("hashes") if both is src else F.col("hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [text_of_page(p or "", frozenset(t or ())) for p, t in
                     zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    return both.select("page_id", "url", "html", hashes).mapInArrow(run, "page_id long, url string, text string")
