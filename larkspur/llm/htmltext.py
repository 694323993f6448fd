"""Main text of web pages, by removing each site's template.

The html is read into a tree. Every container element (a division, list, table, navigation, footer ...) is
hashed in two ways: with all the words below it, and by its skeleton: the tags, classes and depth of what is below it, a run of equal
ones counting once, and whether most of its text is in links. Spark counts, per host, on how many differently worded pages
each hash occurs, and subtrees that recur on many pages of a host, or of a section (first path part) of it,
are that host's template and are deleted. A copied page counts once, so that copies don't make an article a template.

A page's core is its article and main elements, or without these the innermost container of most of its prose (text of headings and
paragraphs, outside of links). What holds the core is never deleted. Skeletons count only where they tell a frame:
outside the core, where no prose stands below, or where most text is in links; in the core, classed containers of links.
In the core, lists, tables and figures without attributes may hold the same words on many pages. What a single page shows to be no content
goes as well: scripts, styles, forms, navigation, footers, headers outside of an article, and what is hidden or has such a role.
A container whose class or id says so (notices, adverts, menus, comments ...) goes if this name is on ``NAMED_PAGES`` pages of the host; a name
of several words joined by hyphens says so if all its words do.

What then remains is the text. Only where a host has fewer than ``LEAST_PAGES`` pages, too few to tell its template by, is it
limited to the article and main elements, if there are any, and names alone decide. Character
references are decoded, white space inside a block becomes one space, blocks are joined by a newline in page order.

Null or empty html gives an empty text, and very long html is worked on whole. A page without a host belongs to the host ''. Rows that
repeat are each extracted. An empty table gives an empty table. Further columns may have any name.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import arrow_map, durable, fresh, with_fields

#: A subtree is template if it occurs on so many distinct pages of its host at least, and on this share of them, or so of a section's pages;
#: a container whose name says that it's no content, if the name does on ``NAMED_PAGES``.
LEAST_PAGES, LEAST_SHARE, NAMED_PAGES = 4, 0.3, 2
#: Template hashes (8 bytes each) up to this number are broadcast; beyond it they are joined.
BROADCAST_MOST = 1_000_000
#: A container belongs to the core's way if it holds this share of the page's prose, and is one of links if this share of its text is in them.
CORE_SHARE, LINK_SHARE = 0.5, 0.5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>?|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"\s+")
NUMBER = re.compile(r"[0-9]+")

# Kinds of elements in HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes"}
DROPPED = {"script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "form", "button", "select", "textarea", "nav", "aside", "footer", "head", "title", "dialog", "xmp", "noembed", "noframes"}
#: Dropped outside of an article or main element only.
DROPPED_OUTSIDE = {"header", "menu"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote"}
#: Elements that a skeleton names; others count as the text that they hold.
NAMED = {"a", "img", "video", "audio", "input"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br_block", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CONTAINER = {"address", "aside", "center", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "header", "menu", "nav", "ol", "section", "table", "ul"}
#: An element of the key is closed by the beginning of one of these.
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
NOT_CONTENT = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "share", "sharing", "social", "related", "recommended", "comment", "comments", "reply", "replies", "disqus", "widget", "toolbar", "hidden", "disclaimer", "alert"}
#: Words that say nothing beside those of NOT_CONTENT.
BESIDE = {"site", "page", "main", "top", "bottom", "left", "right", "global", "primary", "secondary", "user", "reader", "list", "box", "bar", "block", "area", "wrapper", "container", "inner", "outer", "section", "item", "items", "posts", "links", "buttons", "slot", "unit", "form", "header", "skip", "js", "the", "thread"}
NOT_CONTENT_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar", "toolbar"}


class Node:
    """An element. After ``measured``: its text's length, the parts of it in links and in prose, the hashes of its words and its skeleton."""

    __slots__ = ("tag", "attributes", "below", "parent", "chars", "linked", "prose", "words", "skeleton")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.below: list[Node | str] = []
        self.chars = self.linked = self.prose = self.words = self.skeleton = 0


def parse(source: str) -> Node:
    """A tree of elements and texts; what is never closed ends with its parent."""
    root = here = Node("html", {}, None)
    position = 0
    match = TOKEN.match
    while found := match(source, position):
        position = found.end()
        tag = found[2]
        if tag is None:
            text = found[0]
            if text[0] != "<" or len(text) == 1:
                here.below.append(text)
            continue
        tag = tag.lower()
        if found[1]:
            node = here
            while node is not root and node.tag != tag:
                # a block's end tag closes what is open inside it; an inline one doesn't reach out of its block
                node = root if tag not in BLOCK and node.tag in BLOCK else node.parent
            if node is not root:
                here = node.parent
            continue
        if tag in BLOCK:
            # a block ends an open paragraph, with the inline elements inside it
            node = here
            while node is not root and node.tag not in BLOCK:
                node = node.parent
            if node.tag in CLOSED_BY and tag in CLOSED_BY[node.tag]:
                here = node.parent
        if tag == "html":
            continue
        raw = found[3]
        node = Node(tag, {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(raw)} if "=" in raw or raw.strip() else {}, here)
        if "hidden" in raw.lower().split():
            node.attributes["hidden"] = ""
        here.below.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, position)
            node.below.append(source[position : end.start() if end else len(source)])
            position = end.end() if end else len(source)
        elif tag not in VOID and not raw.endswith("/"):
            here = node
    return root


def says(name: str) -> bool:
    """Whether a class or id says that its element is no content."""
    parts = [x for x in re.split(r"[-_0-9]+", name) if x]
    return not NOT_CONTENT.isdisjoint(parts) and all(x in NOT_CONTENT or x in BESIDE for x in parts)


def said(node: Node, inside: bool) -> bool:
    """Whether the element's kind says that it's no content; ``inside`` an article or main element or not."""
    if node.tag in DROPPED or not inside and node.tag in DROPPED_OUTSIDE:
        return True
    a = node.attributes
    if not a:
        return False
    return "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in NOT_CONTENT_ROLE or "display:none" in a.get("style", "").replace(" ", "")


def named(node: Node) -> bool:
    """Whether a container's class or id says that it's no content."""
    a = node.attributes
    return bool(a) and node.tag in CONTAINER and any(map(says, f"{a.get('class', '')} {a.get('id', '')}".lower().split()))


def cores(root: Node) -> list[Node]:
    """The outermost article and main elements."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main"):
            found.append(node)
        else:
            todo += [x for x in reversed(node.below) if isinstance(x, Node) and (x.tag in ("article", "main", "form") or not (said(x, False) or named(x)))]
    return found


def measured(root: Node) -> list[Node]:
    """All elements, outer ones first, with what is known of each set."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.below if isinstance(x, Node)]
    hashed = xxhash.xxh64_intdigest
    for node in reversed(order):
        if node.tag in RAW or node.tag == "head":
            node.words = node.skeleton = 1
            continue
        words, shape, last = [node.tag.encode()], [], b""
        chars = linked = prose = 0
        for x in node.below:
            if isinstance(x, str):
                text = SPACE.sub(" ", x).strip(" ")
                if not text:
                    continue
                chars += len(text)
                words.append(text.encode())
                own = b"t"
            else:
                chars, linked, prose = chars + x.chars, linked + x.linked, prose + x.prose
                words.append(x.words.to_bytes(8, "big"))
                own = x.skeleton.to_bytes(8, "big") if x.tag in BLOCK or x.tag in NAMED else b"t" if x.chars else b""
            if own and own != last:
                shape.append(own)
                last = own
        if node.tag == "a":
            linked = chars
        if node.tag in PROSE:
            prose = chars - linked
        node.chars, node.linked, node.prose = chars, linked, prose
        a = node.attributes
        name = NUMBER.sub("#", f"{a.get('class', '')}|{a.get('role', '')}") if a else ""
        node.words = hashed(b"\0".join(words), 1)
        node.skeleton = hashed(b"\0".join(shape), xxhash.xxh32_intdigest(f"{node.tag}|{name}|{linked >= LINK_SHARE * chars > 0}"))
    return order


class Page:
    """A page's tree, its core, and its containers that may be template, with the hashes that tell it."""

    def __init__(self, source: str | None, host: str):
        self.root = parse(source or "")
        self.given = cores(self.root)
        order = measured(self.root)
        self.core = self.given or [self.inner()]
        self.holds, self.inside = set(), set()
        for node in self.core:
            todo = [node]
            while todo:
                x = todo.pop()
                self.inside.add(id(x))
                todo += [y for y in x.below if isinstance(y, Node)]
            while node is not None:
                self.holds.add(id(node))
                node = node.parent
        #: A page is as its core reads: what differs only in its frame is a copy.
        self.digest = xxhash.xxh64_intdigest("\n".join(str(x.words) for x in (self.given or [self.root])))
        #: (container, hashes): hashes are of the host's own.
        salt = xxhash.xxh32_intdigest(host)
        depth: dict[int, int] = {}
        self.may: list[tuple[Node, list[int]]] = []
        for x in order:
            depth[id(x)] = depth.get(id(x.parent), 0) + 1
            if x.tag not in CONTAINER or id(x) in self.holds or not x.chars:
                continue
            inside, links = id(x) in self.inside, x.linked >= LINK_SHARE * x.chars
            found = []
            if not inside or x.attributes or x.tag not in ("ul", "ol", "dl", "table", "figure"):
                found.append(xxhash.xxh64_intdigest(b"w%d" % x.words, salt))
            if links and (not inside or x.attributes) or not inside and not x.prose:
                found.append(xxhash.xxh64_intdigest(b"s%d,%d" % (x.skeleton, depth[id(x)]), salt))
            # the lowest bit tells hashes of names
            found = [d & ~1 for d in found]
            if named(x):
                found.append(xxhash.xxh64_intdigest(f"{x.tag} {NUMBER.sub('#', x.attributes.get('class', '') + ' ' + x.attributes.get('id', ''))}", salt) | 1)
            if found:
                self.may.append((x, found))

    def inner(self) -> Node:
        """The innermost container of most of the prose, or of most of the text if there's no prose."""
        kind = "prose" if self.root.prose else "chars"
        node, whole = self.root, getattr(self.root, kind)
        while True:
            most = max((x for x in node.below if isinstance(x, Node) and not (said(x, False) or named(x))), key=lambda x: getattr(x, kind), default=None)
            if most is None or most.tag not in CONTAINER and most.tag not in ("body", "html") or getattr(most, kind) <= CORE_SHARE * whole:
                return node
            node = most

    def text(self, template, few: bool) -> str:
        """What remains. ``template``: whether a hash is the host's; ``few``: the host has too few pages to tell."""
        gone = {id(x) for x, found in self.may if any(map(template, found))}
        blocks: list[str] = []
        open_block: list[str] = []

        def close():
            text = SPACE.sub(" ", html.unescape("".join(open_block))).strip(" ")
            if text:
                blocks.append(text)
            open_block.clear()

        given = bool(self.given)
        holds = {id(y) for x in self.given for y in up(x)}
        todo: list = [*reversed(self.given if given and few else [self.root])]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                open_block.append(x)
            elif x is None:
                close()
            elif id(x) not in holds and (id(x) in gone or said(x, given and id(x) in self.inside) or few and named(x)):
                if x.tag in BLOCK:
                    close()
            elif x.tag == "br":
                open_block.append("\n")
            else:
                if x.tag in BLOCK:
                    close()
                    todo.append(None)
                todo += reversed(x.below)
        close()
        return "\n".join(blocks)


def up(node: Node | None):
    """An element and all that hold it."""
    while node is not None:
        yield node
        node = node.parent


def host_of(url):
    """Column: the lower-cased host, without the port; '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def section_of(url):
    """Column: the first part of the path, if more of the path follows; null if there is none."""
    part = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1)
    return F.when(part != "", part)


def signed(values) -> pa.Array:
    return pa.array([None if v is None else v - (1 << 64) if v >> 63 else v for v in values], pa.int64())


def templates(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, digest): hashes of the subtrees that recur on many pages of a host, or of one of its sections; the null digest tells that the host has pages enough."""
    rows = pages.select(host_of(F.col(url)).alias("host"), section_of(F.col(url)).alias("section"), F.col(source).alias("html"))

    def work(batch: pa.RecordBatch):
        found: set = set()
        for host, section, text in zip(*(c.to_pylist() for c in batch.columns)):
            page = Page(text, host)
            digests = {d for _, own in page.may for d in own}
            for part in {None, section}:
                found.add((host, part, page.digest, None))
                found.update((host, part, page.digest, d) for d in digests)
        hosts, sections, digest_of, digest = zip(*found) if found else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(sections, pa.string()), signed(digest_of), signed(digest)], ["host", "section", "page", "digest"])

    # one row per host, section, page and subtree; the null section is the host as a whole, the null digest counts the pages themselves
    once = arrow_map(rows, work, "host string, section string, page long, digest long").distinct()
    of_name = F.coalesce(F.col("digest").bitwiseAND(F.lit(1)) == 1, F.lit(False))
    counts = durable(once.groupBy("host", "section", "digest").count().filter(F.col("count") >= F.when(of_name, NAMED_PAGES).otherwise(LEAST_PAGES)))
    pages_of = counts.filter("digest IS NULL").select(F.col("host").alias("of"), F.col("section").alias("part"), F.col("count").alias("pages"))
    met = counts.join(pages_of, (F.col("host") == F.col("of")) & F.col("section").eqNullSafe(F.col("part")))
    return met.filter(of_name | (F.col("count") >= LEAST_SHARE * F.col("pages"))).select("host", "digest").distinct()


def extract(pages: DataFrame, url: str = "url", source: str = "html", text: str = "text", broadcast_most: int = BROADCAST_MOST) -> DataFrame:
    """``pages`` with the main text of ``source``; a column of this name is replaced."""
    found = durable(templates(pages, url, source))
    kept = [c for c in pages.columns if c != text]
    names = fresh(pages, "host", "html", "digests", "enough")
    rows = pages.select(*kept, host_of(F.col(url)).alias(names[0]), F.col(source).alias(names[1]))
    schema = with_fields(pages.select(*kept), f"`{text}` string")
    # the null digest becomes a hash of the host, as the others are
    known = F.coalesce("digest", F.xxhash64("host")).alias("digest")

    if found.count() <= broadcast_most:
        shared = pages.sparkSession.sparkContext.broadcast(np.sort(found.select(known).toArrow()["digest"].to_numpy()))
        lists = rows.select("*", F.xxhash64(names[0]).alias(names[3]), F.lit(None).cast("array<long>").alias(names[2]))
    else:
        # too many to broadcast: a host's templates are few, for each stands on a share of its pages
        shared = None
        own = found.groupBy("host").agg(F.collect_list(known).alias(names[2])).withColumnRenamed("host", names[0])
        lists = rows.join(own, names[0], "left").select(*kept, *names[:2], F.xxhash64(names[0]).alias(names[3]), names[2])

    def work(batch: pa.RecordBatch):
        hosts, sources, enough, own = (c.to_pylist() for c in batch.columns[-4:])
        out = []
        for host, s, mark, digests in zip(hosts, sources, enough, own):
            page = Page(s, host)
            known = np.sort(np.array(digests or [], np.int64)) if shared is None else shared.value

            def template(digest: int, known=known) -> bool:
                value = digest - (1 << 64) if digest >> 63 else digest
                at = int(known.searchsorted(value))
                return at < len(known) and int(known[at]) == value

            out.append(page.text(template, not template(mark)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array(out, pa.string())], [*batch.schema.names[:-4], text])

    return arrow_map(lists, work, schema)
