"""Main text of web pages; subtrees that recur across many pages of a host are removed as its template."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from heapq import nlargest
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm._common import detached, in_slices, table, written

#: A subtree outside the article is template if so many different pages of its host hold it. Inside, headings, lists,
#: tables and quotations recur in real articles: only boxes of links or fields are template by that number, and paragraphs
#: that stand on this share of the host's pages as well.
MIN_PAGES, LEAF_SHARE = 5, 0.5
#: Share of links in a box of links.
LINKED = 0.3
#: An element that its name, role or tag (form) tells as furniture but that holds this share of the page's text outside
#: links, and so many characters of it, is a wrapper of the page.
WRAPS, WRAPPED = 0.8, 200
#: Longest blocks by which pages are told apart.
TELLING = 3
#: Articles beside which the rest of the page holds more than this many times their text are teasers.
TEASER = 4
#: A list or box with so many links, which make up this share of its text, is a menu where no element is marked as content.
MENU_LINKS, MENU_SHARE = 3, 0.6
#: Template subtrees that are broadcast, at most; beyond, they are joined with the subtrees of each page.
BROADCAST = 100_000

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Start tags that close an open element of the listed kinds.
CLOSES = {
    **{t: {"p"} for t in BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary"}},
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"},
    "option": {"option"}, "tbody": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th"},
}
#: An implied end looks no further up than these.
SCOPE = {"table", "ul", "ol", "dl", "div", "section", "article", "main", "aside", "nav", "body", "html", "blockquote", "header", "footer", "form", "button", "figure", "fieldset", "details"}
DROPPED = {"nav", "aside", "footer", "form", "script", "style", "noscript", "template", "iframe", "button", "select", "textarea", "svg", "canvas", "object", "head", "title", "dialog", "menu", "audio", "video"}
#: Of these a form can be a wrapper around a whole page; the others' text is never read.
UNREAD = DROPPED - {"form"}
FIELDS = {"input", "textarea", "select", "button", "form"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Words of class names and ids that tell furniture, and words that may stand beside them in one name.
FURNITURE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "submenu", "sidebar", "comment", "comments",
    "disqus", "respond", "reply", "replies", "cookie", "cookies", "consent", "gdpr", "banner", "notice", "notices", "alert", "alerts", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
    "share", "sharing", "social", "related", "recommended", "recommendations", "breadcrumb", "breadcrumbs", "footer", "masthead", "toolbar", "widget", "widgets", "pagination", "pager", "login", "search", "skip",
}
BESIDE = {
    "site", "page", "top", "bottom", "left", "right", "global", "primary", "secondary", "main", "header", "container", "wrapper", "wrap", "list", "box", "area", "section", "bar", "block", "inner", "outer", "content",
    "group", "panel", "item", "items", "link", "links", "button", "buttons", "form", "slot", "unit", "post", "posts", "article", "articles", "stories", "user", "users", "reader", "readers", "thread", "media", "fixed",
    "sticky", "mobile", "desktop", "col", "column", "row", "module", "to", "by", "us", "body", "cta", "this", "story", "reading", "more", "v", "holder", "zone", "now",
}
#: Beginnings of words that tell furniture, as in "commentlist".
BEGINNINGS = re.compile("comment(?!ar|at)|advert|adsby|sponsor|taboola|outbrain|disqus|sharedaddy|addthis|newsletter|breadcrumb")
COMMENTS = re.compile("comment(?!ar|at)|disqus|respond|repl(?:y|ies)", re.IGNORECASE)
#: Names that say how a page is laid out around its content, as "has-sidebar" does.
LAYOUT = re.compile("(?:has|with|without|no|show|hide|is)[-_]", re.IGNORECASE)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What recurs in articles of a host without being its template.
SOLID = HEADINGS | {"ul", "ol", "dl", "li", "table", "blockquote", "figure", "pre"}


class Node:
    """An element; ``measured`` tells its digest, characters, characters in links, links, and what stands below."""

    __slots__ = ("tag", "attrs", "parts", "digest", "chars", "linked", "links", "blocks", "headings", "fields", "solid", "inside", "wraps")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.parts, self.digest = tag, attrs, [], 0
        self.chars = self.linked = self.links = self.blocks = self.headings = self.fields = self.solid = 0
        self.inside = self.wraps = False


class _Builder(HTMLParser):
    """A tree from any markup: void elements, implied ends and stray end tags are handled; depth costs no recursion."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag)
        if ends:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in ends:
                    del self.open[k:]
                    if tag not in ("li", "dt", "dd", "td", "th", "tr", "tbody", "tfoot"):
                        break
                elif self.open[k].tag in SCOPE or (self.open[k].tag in ("td", "th", "li", "tr") and tag not in ("tr", "tbody", "tfoot", "td", "th", "li")):
                    break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if tag not in SCOPE and self.open[k].tag in ("article", "main", "td", "body"):
                return  # a stray end doesn't leave the article

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


@lru_cache(maxsize=8192)
def _told(names: str) -> bool:
    """Whether one of the names of an element, of its class and id, tells furniture. Pages of a site share their names."""
    return any(_tells(n) for n in names.split() if not LAYOUT.match(n))


def _tells(name: str) -> bool:
    parts = [p for p in re.split(r"[-_:.]+|\d+", name.lower()) if p]
    told = [p in FURNITURE or bool(BEGINNINGS.match(p)) for p in parts]
    return any(told) and all(t or p in BESIDE for t, p in zip(told, parts, strict=True))


def furniture(node: Node) -> bool:
    """Whether an element is told to be no part of an article by its tag, role, class or id, or is hidden."""
    if node.wraps:
        return False
    if node.tag in DROPPED:
        return True
    a = node.attrs
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or ("style" in a and re.search(r"display\s*:\s*none", a["style"])):
        return True
    names = f"{a.get('class', '')} {a.get('id', '')}"
    if node.tag == "article":
        return any(re.search("comment|teaser|related", n, re.IGNORECASE) for n in names.split() if not LAYOUT.match(n))
    return node.tag not in ("html", "body", "main") and names != " " and _told(names)


def _walk(root: Node, skip) -> Iterator[tuple[Node | str, bool]]:
    """Nodes and texts in page order; (node, False) comes again after its parts."""
    stack: list = [(root, True)]
    while stack:
        node, enters = stack.pop()
        yield node, enters
        if enters and isinstance(node, Node):
            if skip(node):
                continue
            stack.append((node, False))
            stack.extend((p, True) for p in reversed(node.parts))


def measured(root: Node) -> None:
    """Give each element a digest of its tag, class, id and all below it, and its measures."""
    nodes = [root]
    for node in nodes:  # parents before their parts
        nodes.extend([p for p in node.parts if isinstance(p, Node)])
    for node in reversed(nodes):
        h = blake2b(f"{node.tag}\0{node.attrs.get('class', '')}\0{node.attrs.get('id', '')}".encode("utf-8", "replace"), digest_size=8)
        unread = node.tag in UNREAD
        for p in node.parts:
            if isinstance(p, Node):
                h.update(b"\1" + p.digest.to_bytes(8, "little", signed=True))
                node.blocks += p.blocks + (p.tag in BLOCKS)
                node.headings += p.headings + (p.tag in HEADINGS)
                node.fields += p.fields + (p.tag in FIELDS)
                node.solid += p.solid + (p.tag in SOLID)
                if not unread:
                    node.chars, node.linked, node.links = node.chars + p.chars, node.linked + p.linked, node.links + p.links
            else:
                said = " ".join(p.split())
                h.update(b"\2" + said.encode("utf-8", "replace"))
                if not unread:
                    node.chars += len(said)
        if node.tag == "a":
            node.linked, node.links = node.chars, 1
        node.digest = int.from_bytes(h.digest(), "little", signed=True)
    least = max(WRAPPED, WRAPS * (root.chars - root.linked))
    for node, enters in _walk(root, lambda n: n.tag in UNREAD or n.chars - n.linked < least):
        if isinstance(node, Node) and enters and node.tag not in UNREAD and node.chars - node.linked >= least and "hidden" not in node.attrs:
            node.wraps = not COMMENTS.search(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}")


def _found(root: Node, tag: str, gone) -> list[Node]:
    """The outermost elements of a tag or role that aren't gone."""
    out: list[Node] = []

    def skip(n: Node) -> bool:
        if n is not root and gone(n):
            return True
        if n is not root and (n.tag == tag or n.attrs.get("role", "").lower() == tag):
            out.append(n)
            return True
        return False

    for _ in _walk(root, skip):
        pass
    return out


def _length(tops: list[Node], gone) -> int:
    """Characters of what isn't gone."""
    return sum(len(node.strip()) for top in tops for node, _ in _walk(top, lambda n, top=top: n is not top and gone(n)) if isinstance(node, str))


def contents(root: Node, gone=furniture) -> tuple[list[Node], bool]:
    """The elements that hold the article, and whether the page marks them, by what is left when ``gone`` elements go.

    Main elements, or the articles in them where these hold half of the text; else articles, unless the rest of the page
    holds far more text; else the whole page.
    """
    mains = _found(root, "main", gone)
    if mains:
        articles = [a for m in mains for a in _found(m, "article", gone)]
        return (articles if articles and 2 * _length(articles, gone) >= _length(mains, gone) else mains), True
    articles = _found(root, "article", gone)
    if articles and (TEASER + 1) * _length(articles, gone) >= _length([root], gone):
        return articles, True
    return [root], False


def _densest(root: Node) -> Node:
    """The element whose own paragraphs, and half of those one level below, hold most text outside links."""
    points: dict[int, float] = {}
    best, above = root, [root]
    for node, enters in _walk(root, lambda n: n is not root and furniture(n)):
        if isinstance(node, str) or node.tag not in BLOCKS:
            continue
        if not enters:
            if above[-1] is node:
                above.pop()
            continue
        if not node.blocks and not furniture(node):
            for k, part in ((1, 1.0), (2, 0.5)):
                if len(above) >= k:
                    parent = above[-k]
                    points[id(parent)] = points.get(id(parent), 0.0) + part * (node.chars - node.linked)
                    if points[id(parent)] > points.get(id(best), 0.0):
                        best = parent
        above.append(node)
    return best


def _mark(root: Node) -> tuple[list[Node], bool]:
    """The article before templates are known; its elements are marked as inside. Where a page marks none, the densest
    element is taken for it."""
    tops, marked = contents(root)
    for top in tops if marked else [_densest(root)]:
        for node, enters in _walk(top, lambda n: False):
            if enters and isinstance(node, Node):
                node.inside = True
    return tops, marked


def _kind(node: Node) -> int | None:
    """How often a block subtree must recur to be template: 0 outside the article and 1 for boxes of links or fields inside
    it, on MIN_PAGES pages; 2 for a paragraph inside it, on LEAF_SHARE of the pages as well. Nothing else inside it can be
    template, and no element that wraps the page."""
    if node.wraps or node.tag not in BLOCKS or node.tag in ("html", "body"):
        return None
    if not node.inside:
        return 0
    if node.fields or (node.links and node.linked >= LINKED * node.chars):
        return 1
    return 2 if node.tag in ("p", "div", "section") and not node.solid else None


def candidates(root: Node) -> tuple[set[tuple[int, int]], int]:
    """(digest, kind) of all block subtrees of a measured page that can be template, and a digest of its TELLING longest
    blocks of text, by which pages are told apart: copies agree in them, also some edited ones."""
    _mark(root)
    found: set[tuple[int, int]] = set()
    texts: set[tuple[int, int]] = set()
    for node, enters in _walk(root, lambda n: n.tag in ("script", "style", "head")):
        if enters and isinstance(node, Node) and node.tag in BLOCKS and node.tag not in ("html", "body"):
            if node.chars and (kind := _kind(node)) is not None:
                found.add((node.digest, kind))
            if not node.blocks:
                texts.add((node.chars, node.digest))
    page = blake2b(digest_size=8)
    for _, digest in nlargest(TELLING, texts):
        page.update(digest.to_bytes(8, "little", signed=True))
    return found, int.from_bytes(page.digest(), "little", signed=True)


def main_text(root: Node, template: frozenset | set = frozenset()) -> tuple[str, int]:
    """The article's blocks in page order: white space collapsed, blocks joined by an empty line; and how many subtrees
    were deleted as template. ``template`` holds (digest, kind) as ``candidates`` tells them.

    Template subtrees go first. The article is chosen by what is left of the page. An element that holds nearly all of a
    page's text isn't furniture, whatever its name.
    """
    measured(root)
    tops, marked = _mark(root)
    deleted = 0
    digests = {d for d, _ in template}
    nodes = [root] if digests else []
    for node in nodes:
        for p in node.parts:
            if isinstance(p, Node):
                if p.digest in digests and (p.digest, _kind(p)) in template:
                    deleted += 1
                    p.parts, p.attrs = [], {"hidden": ""}
                else:
                    nodes.append(p)
    if deleted:
        tops, marked = contents(root)

    def drop(n: Node) -> bool:
        if furniture(n) or n.tag == "header" and not (marked and n.headings):
            return True
        return not marked and n.tag in BLOCKS and n.links >= MENU_LINKS and n.linked >= MENU_SHARE * n.chars and n.tag not in ("html", "body")

    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks.append(text)

    for top in tops:
        for node, enters in _walk(top, lambda n, top=top: n is not top and drop(n)):
            if isinstance(node, str):
                held.append(node)
            elif node.tag in BLOCKS:
                close()
            elif node.tag == "br" or node.tag in DROPPED:
                held.append(" ")
        close()
    return "\n\n".join(blocks), deleted


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def subtrees(pages: DataFrame) -> DataFrame:
    """pages (host, row, html) -> (host, row, page, digest, kind): all block subtrees that can be template, and for each
    page one row with digest null. page tells different pages apart."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, row, html in zip(batch["host"], batch["row"], batch["html"]):
                root = parse(html)
                measured(root)
                found, page = candidates(root)
                rows += [(host, row, page, None, 0), *((host, row, page, digest, kind) for digest, kind in found)]
            host, row, page, digest, kind = zip(*rows)
            yield pd.DataFrame({"host": host, "row": row, "page": page, "digest": pd.array(digest, dtype="Int64"), "kind": kind})

    return in_slices(pages.select("host", "row", "html"), cut, "host string, row long, page long, digest long, kind int")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, leaf_share: float = LEAF_SHARE) -> DataFrame:
    """(host, digest, kind): the template subtrees of pages (host, row, html), by the different pages that hold them.

    Copies of a page count once, so a page that is served often doesn't become its own template.
    """
    seen = subtrees(pages).groupBy("host", "digest", "kind", "page").agg(F.lit(1).alias("one"))
    counted = written(seen.groupBy("host", "digest", "kind").agg(F.count("one").alias("n")).filter(F.col("digest").isNull() | (F.col("n") >= min_pages)), "subtrees")
    hosts = counted.filter("digest IS NULL").select(F.col("host").alias("h"), F.col("n").alias("pages"))
    often = counted.filter("digest IS NOT NULL").join(hosts, F.col("host") == F.col("h"))
    return written(often.filter((F.col("kind") < 2) | (F.col("n") >= leaf_share * F.col("pages"))).select("host", "digest", "kind"), "templates")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, leaf_share: float = LEAF_SHARE, most: int = BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars of the main text and n_template (subtrees deleted as template), a row for each page.

    * null or empty html, or a page without text: empty text, 0 characters. Broken markup is read as far as it goes.
    * null url: host "", whose pages make up a site of their own.
    * repeated rows: one result each. Null page_id: kept as null. Empty table: no rows. Extra columns are ignored.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).withColumn("row", F.xxhash64("host", F.coalesce("html", F.lit(""))))
    known = templates(rows, min_pages, leaf_share)
    entry = F.struct("digest", "kind")
    if known.count() <= most:
        per_host = known.groupBy(F.col("host").alias("h")).agg(F.collect_list(entry).alias("template"))  # at most ``most`` in all
        rows = rows.join(F.broadcast(per_host), F.col("host") == F.col("h"), "left")
    else:
        held = subtrees(rows).filter("digest IS NOT NULL").groupBy("host", "digest", "kind", "row").agg(F.lit(1).alias("one"))
        of = known.select(F.col("host").alias("h"), F.col("digest").alias("d"), F.col("kind").alias("l"))
        held = held.join(of, (F.col("host") == F.col("h")) & (F.col("digest") == F.col("d")) & (F.col("kind") == F.col("l")), "left_semi")
        per_page = held.groupBy(detached(F.col("row")).alias("r")).agg(F.collect_list(entry).alias("template"))  # one page's
        rows = rows.join(per_page, F.col("row") == F.col("r"), "left")
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_template", T.LongType())])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, deleted = [], []
            last, known = None, frozenset()
            for html, template in zip(batch["html"], batch["template"]):
                if template is not last:
                    last, known = template, frozenset() if template is None else frozenset((x["digest"], x["kind"]) for x in template)
                text, n = main_text(parse(html), known)
                texts.append(text)
                deleted.append(n)
            yield batch[["page_id", "url"]].assign(text=pd.Series(texts, index=batch.index, dtype=object), n_template=pd.Series(deleted, index=batch.index, dtype="int64"))

    out = in_slices(rows.select("page_id", "url", "html", "template"), read, schema)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
