"""Main text of web pages by tree scoring.

Every paragraph passes points for its length and its commas to its ancestors, halved from one to the next; a
container's points are discounted by the share of its text that stands in links.  The container with the most
points is kept, with siblings that score well themselves, paragraphs that end as sentences do, and lists, tables, headings and the like that
are no link lists.  An article element around it is kept whole, with other articles of running text beside it.

Class and id names never drop a heading or paragraph.  Inside an article only names of foreign matter (adverts, comments, sidebars) drop a part; other
doubtful names do so where the part is mostly links or holds no running sentence.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements that never hold main text.
DROPPED = frozenset("nav footer aside form button select input option object canvas audio video dialog menu head label fieldset".split()) | RAW
#: Class and id words of parts that are never the article's own text, wherever they stand.
FOREIGN = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|comments?|replies|disqus|sidebars?|newsletters?|subscribe|subscription)(?=$|[\s_-])", re.I)
#: Class and id words of parts that are no article text outside an article; inside one they count only for parts that look like boilerplate.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banners?|sponsor(?:ed|s)?|promos?|promotion|sidebars?|side|comments?|replies|respond|discussion|disqus|"
    r"cookies?|consent|gdpr|notices?|newsletters?|subscribe|subscription|signup|sign-up|popups?|modals?|overlay|nav|navs|navbar|navigation|menus?|breadcrumbs?|footers?|headers?|masthead|"
    r"shar(?:e|ing)|socials?|related|recommended|recommendations?|widgets?|pagination|pager|toolbar|skip|login|search|alerts?|legal|copyright|hidden|metabar)(?=$|[\s_-])", re.I)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|story|entry|body|text)(?=$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: An opening tag in the key closes an open element of the values that is in the same parent.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
#: Text that scores as a paragraph.
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
LEAST_CHARS = 25
#: Headings and paragraphs, which no name can drop.
KEPT = frozenset("h1 h2 h3 h4 h5 h6 p article".split())
#: Text of so many characters with the end of a sentence is running text.
RUNNING_CHARS = 50
SENTENCE = re.compile(r"[.!?。！？…](?:\s|$|[\"'”’)])")
#: Siblings of the best container that belong to it unless they are mostly links.
PARTS = frozenset("ul ol dl table blockquote pre figure h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "parent", "children", "attributes", "points", "chars", "linked", "commas", "suspect", "running")

    def __init__(self, tag: str, parent: "Node | None", attributes: str = ""):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list = []
        self.points = 0.0
        self.chars = self.linked = self.commas = 0
        self.suspect = self.running = False


def parse(html: str) -> Node:
    """A tree of elements and text; tolerant of tags left open or closed out of order."""
    root = here = Node("root", None)
    at, end = 0, len(html)
    search = _TOKEN.search
    while at < end:
        m = search(html, at)
        if m is None:
            here.children.append(unescape(html[at:]))
            break
        if m.start() > at:
            here.children.append(unescape(html[at:m.start()]))
        at = m.end()
        tag = m[2]
        if tag is None:
            if html.startswith("<![CDATA[", m.start()):
                here.children.append(html[m.start() + 9:at].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        if tag in BLOCKS:
            node = here         # a block ends an open paragraph
            while node is not root and node.tag != "p":
                if node.tag in BLOCKS:
                    break
                node = node.parent
            if node.tag == "p":
                here = node.parent
        if tag in CLOSES:
            node, stop = here, _SCOPE.get(tag, {"table"})
            while node is not root and node.tag not in stop:
                if node.tag in CLOSES[tag]:
                    here = node.parent
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                node = node.parent
        new = Node(tag, here, m[3])
        here.children.append(new)
        if tag in RAW and not m[3].rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(html, at)
            at = close.end() if close else end
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCKS):
            here = new
    return root


def _dropped(node: Node, inside: bool) -> bool:
    """Whether a part goes for its kind or name alone; ``inside`` an article a doubtful name only makes it suspect."""
    if node.tag in DROPPED:
        return True
    if node.tag == "header":        # a page's header; an article's own header holds its title
        up = node.parent
        while up is not None and up.tag not in ("article", "main", "section") and not LIKELY.search(" ".join(re.findall(r"[\w-]+", up.attributes))):
            up = up.parent
        return up is None
    if not node.attributes or node.tag in ("html", "body", "root", "main"):
        return False
    found = {}
    for m in _ATTRIBUTE.finditer(node.attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    if node.tag in KEPT:
        return False
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if FOREIGN.search(names) and not LIKELY.search(names):
        return True
    node.suspect = inside and UNLIKELY.search(names) is not None
    return not inside and bool(UNLIKELY.search(names)) and not (node.tag == "article" or LIKELY.search(names) and not re.search(r"comment|sidebar|advert|footer|nav", names, re.I))


def _measure(root: Node) -> list[Node]:
    """Take unlikely parts out, count text, link text and commas bottom-up; the elements in page order."""
    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        order.append(node)
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not _dropped(c, inside)]
        stack.extend((c, inside) for c in reversed(node.children) if not isinstance(c, str))
    for node in reversed(order):
        node.children = [c for c in node.children if isinstance(c, str) or not (c.suspect and _boilerplate(c))]
        for c in node.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                node.chars += len(text)
                node.commas += text.count(",") + text.count("、") + text.count("，")
                node.running = node.running or len(text) >= RUNNING_CHARS and SENTENCE.search(text) is not None
            else:
                node.chars += c.chars
                node.linked += c.linked
                node.commas += c.commas
                node.running = node.running or c.running
        if node.tag == "a":
            node.linked, node.running = node.chars, False
    return order


def _boilerplate(node: Node) -> bool:
    """A suspect part that is mostly links or holds no running sentence."""
    return 3 * node.linked > node.chars or not node.running


def _score(order: list[Node]) -> Node | None:
    """Paragraphs pass points upwards; the best container, None when there is no paragraph of some length."""
    for node in order:
        inner = any(not isinstance(c, str) and c.tag in BLOCKS for c in node.children)
        own = node.tag in PARAGRAPHS or node.tag in BLOCKS and not inner
        if not own or node.chars < LEAST_CHARS or node.tag[0] == "h" and node.tag[1:].isdigit():
            continue
        points = 1 + node.commas + min(node.chars // 100, 3)
        up, share = node.parent, 1.0
        while up is not None and up.tag != "root" and share > 0.01:
            up.points += points * share
            up, share = up.parent, share / 2
    best, most = None, 0.0
    for node in order:
        if node.points:
            node.points *= 1 - node.linked / max(1, node.chars)
            bonus = 1.25 if node.tag in ("article", "main") else 1.0
            if node.points * bonus > most:
                best, most = node, node.points * bonus
    return best


def _kept(best: Node) -> list[Node]:
    """The best container, raised to the article around it, with the siblings that belong to it."""
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None and up.tag == "article":
        # a page may hold its text in several articles next to each other
        beside = [c for c in up.parent.children if not isinstance(c, str)] if up.parent is not None else [up]
        return [c for c in beside if c is up or c.tag == "article" and c.running and 3 * c.linked <= c.chars]
    if up is not None and not any(not isinstance(c, str) and c.tag == "article" for c in up.children):
        return [up]
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    least, out = max(2.0, 0.2 * best.points), []
    for c in best.parent.children:
        if isinstance(c, str):
            continue
        linky = 4 * c.linked >= max(1, c.chars)
        sentence = c.tag == "p" and SENTENCE.search(_plain(c)[-2:] + " ") is not None
        if c is best or c.points >= least or not linky and (c.tag in PARTS and c.chars or sentence):
            out.append(c)
    return out


def _plain(node: Node) -> str:
    return "\n".join(_blocks([node]))


def _blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order, white space squeezed."""
    out: list[str] = []
    piece: list[str] = []

    def flush():
        text = " ".join("".join(piece).split())
        if text:
            out.append(text)
        piece.clear()

    stack: list = [c for n in reversed(nodes) for c in (None, n, None)]
    while stack:
        c = stack.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            piece.append(c)
        elif c.tag == "br":
            piece.append(" ")
        else:
            edge = [None] if c.tag in BLOCKS else []
            stack.extend([*edge, *reversed(c.children), *edge])
    flush()
    return out


def main_text(html: str | None) -> str:
    """Main text of one page, blocks joined by a newline; empty when there is none."""
    if not html:
        return ""
    root = parse(html)
    order = _measure(root)
    best = _score(order)
    if best is None:        # only short text: an article or main element, else the whole body
        best = next((n for t in ("article", "main", "body") for n in order if n.tag == t), root)
        return "\n".join(_blocks([best]))
    return "\n".join(_blocks(_kept(best)))


def _extract(batches):
    for batch in batches:
        texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                         names=[*batch.schema.names[:-1], "text", "n_chars"])


def extract_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep`` with text and n_chars (code points) of every page.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go; inside a block white space
    becomes one space and line breaks count as such.  A null or empty page has an empty text.  Rows are neither dropped nor
    merged, nulls in other columns stay.  Each page is one row's work; nothing is shuffled.
    """
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(html).alias("_html"))
    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[:-1]))
    return rows.mapInArrow(_extract, f"{kinds}, text string, n_chars bigint").withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
