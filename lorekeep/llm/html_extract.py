"""Main text of web pages by composite text density.

Every block of the parsed page has C characters and T tags in its subtree, LC
characters and LT tags of links. Its density is the characters per tag, adjusted
by links (Sun, Song, Liao: DOM based content extraction via text density)::

    C / T * log(C/LC * T/LT) / log(ln(C/(C-LC) * LC + LCb/Cb * C + e))

with LCb and Cb of the body. Inline formatting counts as text: only blocks and
links are tags. A block's density sum adds the densities of its child blocks and
of the text that it holds itself, as if that were a block. The block of the
largest sum is content. The lowest density on the path from below the body to it is the
threshold: subtrees that reach it give their block of largest sum as content too,
with what lies between two such blocks of one parent, and the nearest heading
before the first. Whether a page has an ``article`` element makes no difference.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are taken out before densities are computed, as far as the tag,
class, id or role says so; a header inside an article or around its h1 stays.

Pages are independent: one narrow stage of Arrow batches, no shuffle. Defined
results: null or empty html gives the empty text; unclosed and stray tags are
tolerated; very long and very deep pages are read whole; a page without any text
that stays gives the empty text; repeated pages are extracted each; an empty
table gives an empty table; extra columns stay, whatever their names, but for
``text`` and ``n_chars``, which are replaced, and the html, which goes.
"""

from __future__ import annotations

import math
import re
from html import unescape

from pyspark.sql import DataFrame

from lorekeep.llm.common import set_aside

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that never hold article text.
DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select option input textarea iframe object embed svg canvas audio video dialog menu title math noframes".split()
)
#: A whole part of a class, id or role that marks what is no article: menus, headers, footers, sidebars, notices, adverts, forms, comments.
MARKED = re.compile(
    r"(?:^|[\s_-])(menu|nav|navbar|navigation|breadcrumbs?|header|masthead|topbar|footer|contentinfo|sidebar|aside|complementary|"
    r"notices?|cookies?|consent|gdpr|banner|ads?|adverts?|advertisement|advertising|sponsor(?:ed|s)?|promos?|promotion|"
    r"form|newsletter|subscribe|signup|login|search|comments?|commentlist|replies)(?:$|[\s_-])",
    re.I,
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}
SIBLINGS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th")}

TAG = re.compile(r"""<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
UNFINISHED = re.compile(r"</?[a-zA-Z][^<>]*$")
ATTR = re.compile(r"""(?:^|[\s/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "chars", "tags", "lchars", "ltags", "own", "block", "density", "sum", "out")

    def __init__(self, tag: str, attrs: str, parent: "Node | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list = []
        self.out = False


def parse(html: str) -> Node:
    """A tolerant tree: implied end tags, void elements, raw text, stray end tags."""
    root = Node("#root", "", None)
    here, pos, n = root, 0, len(html)
    search = TAG.search
    while pos < n:
        m = search(html, pos)
        if m is None:
            rest = UNFINISHED.search(html, pos)
            here.kids.append(unescape(html[pos : rest.start() if rest else n]))
            break
        start, end = m.span()
        if start > pos:
            here.kids.append(unescape(html[pos:start]))
        tag = m[2] or m[5]
        if tag is None:
            what = m[0]
            if what == "<!--":
                stop = html.find("-->", max(start + 2, end - 2))
                pos = n if stop < 0 else stop + 3
            elif what == "<![CDATA[":
                stop = html.find("]]>", end)
                here.kids.append(html[end : n if stop < 0 else stop])
                pos = n if stop < 0 else stop + 3
            else:
                stop = html.find(">", end)
                pos = n if stop < 0 else stop + 1
            continue
        pos = end
        tag = tag.lower()
        attrs = m[3] if m[2] else m[6]
        if m[1] or m[4]:
            if tag == "br":
                here.kids.append(Node("br", "", here))
                continue
            at = here
            inline = tag in INLINE
            while at is not root and at.tag != tag and not (inline and at.tag not in INLINE):
                at = at.parent
            if at is not root and at.tag == tag:
                here = at.parent
            continue
        if tag in CLOSES_P:
            at = here
            while at is not root and (at.tag in INLINE):
                at = at.parent
            if at.tag == "p":
                here = at.parent
        if tag in SAME:
            at, stop_at, wanted = here, SAME[tag], SIBLINGS.get(tag, (tag,))
            found = None
            while at is not root and at.tag not in stop_at:
                if at.tag in wanted:
                    found = at
                at = at.parent
            if found is not None:
                here = found.parent
        node = Node(tag, attrs or "", here)
        here.kids.append(node)
        if tag in VOID or (attrs and attrs.endswith("/") and tag not in INLINE and tag not in CLOSES_P and tag not in RAW):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, pos)
            body = html[pos : stop.start() if stop else n]
            node.kids.append(body)
            pos = stop.end() if stop else n
            continue
        here = node
    return root


def is_marked(node: Node, in_article: bool) -> bool:
    """Whether the page itself says that this is no article text."""
    tag = node.tag
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not node.attrs or tag in ("html", "body", "article", "main", "p", "h1"):
        return False
    for name, a, b, c in ATTR.findall(node.attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name != "aria-hidden" and value and (m := MARKED.search(value)):
            # an article has headers of its own; and "with-sidebar" and the like name what holds the article
            if not (in_article and m[1].lower() == "header") and not holds_article(node):
                return True
    return False


def holds_article(node: Node) -> bool:
    stack = [node]
    while stack:
        for k in stack.pop().kids:
            if type(k) is Node:
                if k.tag in ("article", "main", "h1"):
                    return True
                stack.append(k)
    return False


def measure(root: Node) -> list[Node]:
    """Takes marked nodes out and counts upwards, without recursion. Returns the nodes that stay, parents first."""
    order: list[Node] = []
    stack = [(root, False, False)]
    linked: set[int] = set()
    while stack:
        node, in_article, in_link = stack.pop()
        order.append(node)
        in_article = in_article or node.tag in ("article", "main")
        in_link = in_link or node.tag == "a"
        if in_link:
            linked.add(id(node))
        for k in node.kids:
            if type(k) is Node:
                if is_marked(k, in_article):
                    k.out = True
                else:
                    stack.append((k, in_article, in_link))
    for node in reversed(order):
        total, own = [0, 0, 0, 0], [0, 0, 0, 0]  # characters, tags, characters and tags of links
        node.block = node.tag not in INLINE and node.tag not in VOID
        for k in node.kids:
            if type(k) is not Node:
                n = len(" ".join(k.split()))
                counts, block = (n, 0, n * (id(node) in linked), 0), False
            elif k.out:
                continue
            else:
                link = k.tag == "a"
                counts, block = (k.chars, k.tags + (k.block or link), k.lchars, k.ltags + link), k.block
            for x in (total,) if block else (total, own):
                for i in range(4):
                    x[i] += counts[i]
            node.block = node.block or block
        node.chars, node.tags, node.lchars, node.ltags = total
        node.own = own
    return order


def density(chars: int, tags: int, lchars: int, ltags: int, body_links: float) -> float:
    """Characters per tag, adjusted by links; ``body_links``: the body's share of characters in links."""
    if not chars:
        return 0.0
    base = math.log(math.log(chars / max(chars - lchars, 1) * lchars + body_links * chars + math.e) + 1e-9)
    # the base is ln(...) >= 1; at 1 (no link at all) the plain characters per tag stand
    plain = chars / max(tags, 1)
    return plain if base < 0.1 else plain * max(math.log(chars / max(lchars, 1) * max(tags, 1) / max(ltags, 1)), 0.0) / base


def densities(blocks: list[Node], body: Node) -> None:
    """Density and density sum of every block."""
    body_links = body.lchars / body.chars if body.chars else 0.0
    for x in blocks:
        x.density = density(x.chars, x.tags, x.lchars, x.ltags, body_links)
    for x in blocks:
        x.sum = density(*x.own, body_links) + sum(k.density for k in x.kids if type(k) is Node and not k.out and k.block)


def content(root: Node) -> list[Node]:
    """The content blocks in page order; none holds another."""
    order = measure(root)
    body = next((x for x in order if x.tag == "body"), root)
    if not body.chars:
        body = root
    if not body.chars:
        return []
    inside, blocks = {id(body)}, [body]
    for x in order:
        if x is not body and x.block and x.parent is not None and id(x.parent) in inside:
            inside.add(id(x))
            blocks.append(x)
    densities(blocks, body)
    best = max(blocks, key=lambda x: x.sum)
    threshold, at = best.density, best
    while at is not body:  # the body itself averages over whatever else the page holds
        threshold, at = min(threshold, at.density), at.parent
    top: dict[int, Node] = {}  # by block: the block of the largest sum in its subtree
    for x in reversed(blocks):
        mine = x
        for k in x.kids:
            if type(k) is Node and id(k) in top and top[id(k)].sum > mine.sum:
                mine = top[id(k)]
        top[id(x)] = mine
    chosen = {id(best)}
    stack = [body]
    while stack:
        x = stack.pop()
        if x.density >= threshold and x.chars and top[id(x)] is x:
            chosen.add(id(x))
        else:
            stack += [k for k in x.kids if type(k) is Node and id(k) in inside]
    for x in blocks:  # what lies between the content blocks of one parent
        at = [n for n, k in enumerate(x.kids) if type(k) is Node and id(k) in chosen]
        for k in x.kids[at[0] : at[-1]] if at else ():
            if type(k) is Node and not k.out:
                chosen.add(id(k))
    first = next(x for x in order if id(x) in chosen)
    if (heading := heading_before(first, body)) is not None:
        chosen.add(id(heading))
    kept = []
    for x in order:
        if id(x) in chosen:
            at = x.parent
            while at is not None and id(at) not in chosen:
                at = at.parent
            if at is None:
                kept.append(x)
    return kept


def heading_before(node: Node, body: Node) -> Node | None:
    """The nearest h1 in front of a node, next to it or to what holds it; a smaller heading only right in front of it."""
    while node is not body and node.parent is not None:
        earlier = []
        for k in node.parent.kids:
            if k is node:
                break
            if type(k) is Node and not k.out:
                earlier.append(k)
        if earlier and earlier[-1].tag in HEADINGS:
            return earlier[-1]
        stack = earlier
        found = None
        while stack and found is None:
            x = stack.pop()
            if x.tag == "h1":
                found = x
            stack += [k for k in x.kids if type(k) is Node and not k.out]
        if found is not None:
            return found
        node = node.parent
    return None


def text_of(nodes: list[Node]) -> str:
    """Blocks in page order, white space as one space."""
    wanted = {id(x) for x in nodes}
    parts: list[str] = []
    stack: list = [(nodes[0], False)] if len(nodes) == 1 else []
    if len(nodes) > 1:
        root = nodes[0]
        while root.parent is not None:
            root = root.parent
        stack = [(root, True)]
    while stack:
        k, seek = stack.pop()
        if type(k) is str:
            if not seek:
                parts.append(k)
            continue
        if k.out:
            continue
        seek = seek and id(k) not in wanted
        if k.tag not in INLINE:
            parts.append(" ")
            stack.append((" ", False))
        stack += [(x, seek) for x in reversed(k.kids)]
    return " ".join("".join(parts).split())


def main_text(html: str | None) -> str:
    """The article's text of one page."""
    if not html:
        return ""
    nodes = content(parse(html))
    return text_of(nodes) if nodes else ""


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (replaced if there) to every page; drops the html column."""
    import pyarrow as pa
    from pyspark.sql import types as T

    away, back = set_aside(pages, ("text", "n_chars"), (html_col,), (html_col,))
    keep = [f for f in away.schema.fields if f.name != html_col]
    schema = T.StructType([*keep, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            out = [main_text(h) for h in b.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keep], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [*[f.name for f in keep], "text", "n_chars"])

    return back(away.mapInArrow(run, schema), "text", "n_chars")


def query(spark, sf_dir: str) -> DataFrame:
    from lorekeep.llm.common import table

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
