"""Main text of web pages by a site style tree.

The DOMs of a host are merged: a style node is the path of tags and classes from the root, and text that stands in an element is
a leaf below it. The entropy of an element's child sequences over the host's pages is its presentation importance, the entropy of
a leaf's blocks its content importance; both are combined from the leaves up. Branches in which nothing is important are removed from each page.

Additions to the method: blocks that a tag or class names as furniture, and all outside the article of a page that has one, are in the
tree but are left out of the text whatever their importance.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import stage

_TAG = re.compile(r"</?+([a-zA-Z][^\s/>]*+)")
_INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTR = re.compile(r"(?<![^\s=/\"'>])([^\s=/\"'>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
#: Elements whose text is not read at all; the first group holds raw text, in which no tag counts.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
NO_TEXT = RAW | {"head", "template", "noscript", "svg", "canvas", "audio", "video", "select", "datalist"}
#: Elements that are furniture by their tag or role.
FURNITURE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "search", "fieldset", "input"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "mfrac", "mi", "mn", "mo", "mrow", "msqrt", "msub", "msup", "mtext", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: What an opening tag closes if it is open and nothing in the second set lies between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Words of a class, id or role that name furniture, as a whole name or at its end (site-header, cookie-notice).
NAMES = re.compile(
    r"^(ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|header|masthead|footer|sidebar|aside|comment|comments|commentlist|disqus|reply|replies|respond|"
    r"cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|buttons|social|related|recommended|recommendations|widget|widgets|pagination|pager|toolbar|skip|legal|copyright|disclaimer)$"
)
#: Words that name furniture at the beginning of a longer name too (ad-slot, comment-list), and those that name a part of the article whatever follows (article-header).
LEADING = {"ad", "ads", "advert", "advertisement", "comment", "comments", "cookie", "cookies", "disqus", "nav", "navbar", "newsletter", "sidebar", "sponsored"}
CONTENT = {"article", "body", "chapter", "content", "entry", "main", "page", "post", "section", "story", "text"}


def _names_furniture(name: str) -> bool:
    words = [w for w in re.split(r"[-_]+", name) if w]
    return bool(words) and (len(words) == 1 or words[0] not in CONTENT) and (bool(NAMES.match(words[-1])) or (len(words) > 1 and words[0] in LEADING))


def _furniture(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is furniture by its names, and its label in the style path."""
    if not attributes.strip():
        return tag in FURNITURE, tag
    found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(attributes)}
    names = [x for k in ("class", "id") for x in found.get(k, "").lower().split()]
    noisy = tag in FURNITURE or found.get("role", "").lower() in ROLES or found.get("aria-hidden") == "true" or bool(re.search(r"(^|\s)hidden(\s|=|$)", attributes)) or "display:none" in found.get("style", "").replace(" ", "").lower()
    if tag not in {"html", "body", *MAIN} or (tag == "article" and names):
        noisy = noisy or any(map(_names_furniture, names))
    return noisy, f"{tag}.{'.'.join(_DIGITS.sub('0', x) for x in names[:2])}" if names else tag


def _digest(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _past(html: str, mark: str, at: int) -> int:
    """Where the next mark ends, or the end of the page."""
    found = html.find(mark, at)
    return found + len(mark) if found >= 0 else len(html)


def _tags(html: str):
    """(text before, tag or None, its name, its attributes, where it ends) over a page; the next search begins where send() says, if anything is sent.

    Comments and declarations have no name. A tag whose quote is never closed ends at the next >, one without > at the page's end: no quote can be left
    open twice, so the whole takes linear time. A < before anything else is text.
    """
    at = begin = 0
    while (lt := html.find("<", begin)) >= 0:
        name, attributes = None, ""
        if html.startswith("<!--", lt):
            end = _past(html, "-->", lt + 4)
        elif html.startswith("<![CDATA[", lt):
            end = _past(html, "]]>", lt + 9)
        elif html.startswith(("<!", "<?"), lt):
            end = _past(html, ">", lt)
        elif m := _TAG.match(html, lt):
            stop = _INSIDE.match(html, m.end()).end()
            end = _past(html, ">", stop)
            name, attributes = m[1].lower(), html[m.end() : end].removesuffix(">")
        elif html.startswith("</", lt):
            end = _past(html, ">", lt)
        else:
            begin = lt + 1
            continue
        at = begin = (yield html[at:lt], html.startswith("</", lt), name, attributes, end) or end
    yield html[at:], False, None, "", len(html)


class _Stack(list):
    """The open elements (tag, node, furniture, main, unread), with the places of each tag and of the blocks among them."""

    def __init__(self):
        super().__init__()
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def open(self, element: tuple[str, int, bool, bool, bool]) -> None:
        self.places.setdefault(element[0], []).append(len(self))
        if element[0] not in INLINE:
            self.blocks.append(len(self))
        self.append(element)

    def cut(self, k: int) -> None:
        """Close all from place k on."""
        while len(self) > k:
            tag = self.pop()[0]
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def last(self, tags) -> int:
        """The place of the innermost element of these tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)


@dataclass
class Node:
    """A style node of one page: key (a hash of its whole path), the parent's place in the page's list, depth, and its elements' children, each element after a bar."""

    key: int
    up: int
    depth: int
    style: list[str]


def page_tree(html: str | None) -> tuple[list[Node], list[tuple[int, str, str, bool]]]:
    """The style nodes of a page, the root first, and (node, text, text outside named furniture, inside article or main) of each text block, in page order.

    Browsers' rules for tags that are left open hold as far as blocks depend on them: a block tag ends a paragraph, list
    items and cells end each other, an end tag closes what is open inside its element, and a stray one is ignored.
    """
    out: list[tuple[int, str, str, bool]] = []
    nodes, places = [Node(0, -1, 0, [])], {}
    stack = _Stack()
    text: list[str] = []
    named: list[str] = []
    html, where = html or "", None

    def plain(pieces: list[str]) -> str:
        return _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()

    def flush() -> None:
        nonlocal where
        if text and where is not None and (t := plain(text)):
            out.append((where[1], t, plain(named), where[3]))
            nodes[where[1]].style.append("#")
        text.clear()
        named.clear()
        where = None

    def add(piece: str) -> None:
        nonlocal where
        if piece and not (stack and stack[-1][4]):
            where = where or (stack[stack.blocks[-1]] if stack.blocks else ("", 0, False, False, False))
            text.append(piece)
            if not (stack and stack[-1][2]):
                named.append(piece)

    def node(up: int, label: str) -> int:
        if (up, label) not in places:
            places[up, label] = len(nodes)
            nodes.append(Node(_digest(f"{nodes[up].key}/{label}"), up, nodes[up].depth + 1, []))
        nodes[places[up, label]].style.append("|")
        return places[up, label]

    tags, jump = _tags(html), None
    while True:
        try:
            before, closing, tag, attributes, at = tags.send(jump)
        except StopIteration:
            break
        jump = None
        add(before)
        if tag is None:
            continue
        if tag not in INLINE:
            flush()
        if closing:
            k = stack.last([tag])
            # an inline end tag doesn't reach past the block it stands in
            if k >= 0 and (tag not in INLINE or k > (stack.blocks[-1] if stack.blocks else -1)):
                stack.cut(k)
            continue
        if tag in CLOSES_P:
            ends, stops = {"p"}, {"button", "table", "td", "th", "caption", "object"}
        else:
            ends, stops = CLOSES.get(tag, ((), ()))
        while ends and (k := stack.last(ends)) > stack.last(stops):
            stack.cut(k)
        up = stack[-1] if stack else ("", 0, False, False, False)
        unread = up[4] or tag in NO_TEXT
        if tag in VOID or attributes.endswith("/") and tag in {"svg", "path", "use"}:
            if not unread and tag not in INLINE:
                nodes[up[1]].style.append(tag)
            continue
        noisy, label = _furniture(tag, attributes)
        at_node = up[1]
        if tag not in INLINE and not unread:
            nodes[up[1]].style.append(label)
            at_node = node(up[1], label)
        stack.open((tag, at_node, up[2] or noisy, up[3] or (tag in MAIN and not noisy), unread))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            jump = end.start() if end else len(html)
    flush()
    return nodes, out


def _article(found: list[tuple[int, str, str, bool]]) -> list[tuple[int, str]]:
    """(node, text) of the blocks inside article or main, or of all blocks of a page that has neither, without named furniture."""
    kept = [(k, t, a) for k, _, t, a in found if t]
    main = any(a for *_, a in kept)
    return [(k, t) for k, t, a in kept if a or not main]


def article_blocks(html: str | None) -> list[tuple[int, str]]:
    """(key of the style node, text) of the blocks that the name rules leave."""
    nodes, found = page_tree(html)
    return [(nodes[k].key, t) for k, t in _article(found)]


def _leaf(key: int) -> int:
    return _digest(f"{key}#")


_FEATURE = "struct<node: long, parent: long, depth: int, kind: int, value: long>"


def _features(batches):
    """Per page: its host, the page's own key (of its article blocks) and its features, from all blocks: for each style node with text below
    it (kind 0) the hash of its children, and for each leaf (kind 1) those of its blocks."""
    kind = pa.list_(pa.struct([("node", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("kind", pa.int32()), ("value", pa.int64())]))
    for batch in batches:
        keys, rows = [], []
        for h in batch.column("html").to_pylist():
            nodes, found = page_tree(h)
            keys.append(_digest("\n".join(t for _, t in _article(found))))
            leaves, live = {}, set()
            for k, t, *_ in found:
                leaves.setdefault(k, set()).add(_digest(t))
                while k >= 0 and k not in live:
                    live.add(k)
                    k = nodes[k].up
            row = [(n.key, nodes[n.up].key if n.up >= 0 else None, n.depth, 0, _digest("/".join(n.style))) for k in live for n in [nodes[k]]]
            for k, values in leaves.items():
                at = (_leaf(nodes[k].key), nodes[k].key, nodes[k].depth + 1)
                row += [(*at, 0, _digest(str(sorted(values)))), *((*at, 1, v) for v in values)]
            rows.append([dict(zip(("node", "parent", "depth", "kind", "value"), r)) for r in row])
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(keys, pa.int64()), pa.array(rows, kind)], ["host", "page", "features"])


def style_nodes(pages: DataFrame) -> DataFrame:
    """pages(host, html) -> host, node, parent, depth, m (distinct pages that have it), n_styles, importance of its own.

    Pages of a host whose article blocks are equal count once. A node of one page has importance 1. An element's is the entropy of its child sequences over its m pages,
    to the base m: 0 if they are always the same. A leaf's is 1 minus the mean of log k / log m over its distinct blocks, k pages having the block.
    """
    found = pages.select("host", "html").mapInArrow(_features, f"host string, page long, features array<{_FEATURE}>")
    flat = found.select("host", "page", F.explode("features").alias("f")).select("host", "page", "f.*")
    flat = flat.groupBy("host", "page", "node", "parent", "depth", "kind", F.when(F.col("kind") == 1, F.col("value")).alias("block")).agg(F.min("value").alias("value"))
    spread = flat.groupBy("host", "node", "parent", "depth", "kind", "value").agg(F.count("*").alias("k"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0))
    k = F.col("k")
    node = spread.groupBy("host", "node", "parent", "depth").agg(of(0, k).alias("m"), of(0, F.lit(1)).alias("n_styles"), of(0, k * F.log(k)).alias("spread"), of(1, F.lit(1)).alias("n_blocks"), of(1, F.log(k)).alias("logs"))
    log_m = F.log("m")
    own = F.when(F.col("m") == 1, 1.0).when(F.col("n_blocks") > 0, 1 - F.col("logs") / F.col("n_blocks") / log_m).otherwise(1 - F.col("spread") / (F.col("m") * log_m))
    return node.select("host", "node", "parent", "depth", "m", "n_styles", (F.col("n_blocks") > 0).alias("leaf"), own.alias("own"))


def importances(nodes: DataFrame, fade: float = 0.9) -> DataFrame:
    """style_nodes(), staged -> host, node, parent, m, importance (of the whole branch) and top, the largest importance in it.

    A leaf's importance is its own. An element with l distinct child sequences weighs its own by 1 - fade ** l, and the mean of its
    children's, by their pages, by the rest. What one page alone has is important as a whole, so levels are joined from the deepest that two pages share.
    """
    shared = nodes.filter("m > 1")
    deepest = shared.agg(F.max("depth")).first()[0]
    single = nodes.filter("m = 1").select("host", "node", "parent", "m", "depth", F.lit(1.0).alias("importance"), F.lit(1.0).alias("top"))
    done = []
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        below = single.filter(F.col("depth") == depth + 1).drop("depth")
        below = below.unionByName(done[-1]) if done else below
        sums = below.groupBy("host", F.col("parent").alias("node")).agg((F.sum(F.col("m") * F.col("importance")) / F.sum("m")).alias("mean"), F.max("top").alias("most"))
        level = shared.filter(F.col("depth") == depth).join(sums, ["host", "node"], "left")
        rest = F.pow(F.lit(fade), F.col("n_styles"))
        level = level.withColumn("importance", F.when(F.col("leaf") | F.col("mean").isNull(), F.col("own")).otherwise((1 - rest) * F.col("own") + rest * F.col("mean")))
        done.append(stage(level.select("host", "node", "parent", "m", "importance", F.greatest("importance", F.coalesce("most", "importance")).alias("top")), "level"))
    out = single.drop("depth")
    for level in done:
        out = out.unionByName(level)
    return out


def template_nodes(pages: DataFrame, prior: float = 3.0, importance: float = 0.3) -> DataFrame:
    """pages(host, html) -> host, node: the tops of the branches in which every node's importance is below the threshold.

    On few pages, what is common can't be told from what is alike by chance, so a branch's importance is shrunk towards 1 as by `prior` more pages on which it is important:
    what never changes goes where 8 pages show it, and what changes a little needs more. A node must occur on half of the host's pages.
    """
    nodes = stage(style_nodes(pages), "nodes")
    size = nodes.filter("depth = 0").select("host", F.col("m").alias("pages"))
    found = importances(nodes).filter((F.col("m") * F.col("top") + prior) / (F.col("m") + prior) < importance).join(size, "host").filter("2 * m >= pages").select("host", "node", "parent")
    found = stage(found, "low")
    return found.join(found.select("host", F.col("node").alias("parent")), ["host", "parent"], "left_anti").select("host", "node")


def _texts(batches):
    for batch in batches:
        out = []
        for html, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist()):
            nodes, found = page_tree(html)
            gone, off = set(gone or ()), []
            for n in nodes:  # parents come before their children
                off.append(n.key in gone or (n.up >= 0 and off[n.up]))
            out.append(" ".join(t for k, t in _article(found) if not (off[k] or gone and _leaf(nodes[k].key) in gone)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame, most_broadcast: int = 50_000, **options) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars.

    The host's template branches are left out (see template_nodes(); the tree holds all blocks). So is, by name rules, named furniture (menus, headers,
    footers, sidebars, notices, adverts, forms, comments); of a page with text inside article or main, that is the article; other pages give what is left of the body. Character references are
    decoded, white space in a block becomes one space, blocks are joined by a space. A null or empty html gives an
    empty text. A null url is a host of its own. Repeated rows give repeated rows; an empty table gives none; other columns are ignored.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    gone = stage(template_nodes(pages, **options), "templates")
    # Templates go to all executors only if they are few in all; else the pages meet them by host.
    few = gone.limit(most_broadcast + 1).count() <= most_broadcast
    gone = gone.groupBy("host").agg(F.collect_set("node").alias("gone"))
    read = pages.join(F.broadcast(gone) if few else gone, "host", "left").select("page_id", "url", "html", "gone")
    out = read.mapInArrow(_texts, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
