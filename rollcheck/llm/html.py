"""Main text of web pages by scoring the tree of their elements.

Each paragraph gives points for its length and its commas to its parent and, halved, to its
grandparent; link density discounts a container's points. The best container is kept with those of
its siblings that score well or read like prose.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# fixed values: element names and class or id words of web pages
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of an article.
DROPPED = frozenset("script style noscript template head title svg math iframe object canvas audio video select option button input textarea form fieldset label nav footer aside menu dialog".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCKS = frozenset("p div section article main header h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr br body html center details summary".split())
#: Starting one of these ends an open paragraph.
ENDS_PARAGRAPH = BLOCKS - {"br"} | {"nav", "footer", "aside", "form", "fieldset", "menu", "dialog"}
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
#: An open element of the same kind ends where the next starts.
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose end tag may be left out.
OPEN_ENDED = frozenset("p li dt dd tr td th option".split())
FORMS = frozenset("form fieldset".split())
SCOPES = frozenset("ul ol dl table article section main div body nav aside footer".split())
#: First or last part of a class or id word of what surrounds an article.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar side widget widgets footer foot masthead topbar comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login modal popup overlay pagination pager toolbar skip legal copyright disclaimer".split()
)
PAGE_HEADS = frozenset("header site-header page-header top-header global-header".split())
LAYOUT = frozenset("has with without no".split())
#: Of these, what other readers or sellers wrote; the rest only tells of a place on the page, which an article may have too.
NEVER = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr comment comments commentlist disqus respond reply replies "
    "newsletter subscribe subscription signup login modal popup pagination pager copyright disclaimer".split()
)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text|blog)(?:$|[\s_-])", re.IGNORECASE)
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL)
LOOSE = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
NAMES = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
SPACE = re.compile(r"\s+")


def surrounds(words: str, names: frozenset = AROUND) -> bool:
    """Whether class and id words name what surrounds an article: post-footer and comment-list do, has-sidebar doesn't."""
    for word in words.lower().split():
        parts = re.split("[-_]+", word)
        if (word in PAGE_HEADS and names is AROUND) or (parts[0] not in LAYOUT and (parts[0] in names or parts[-1] in names)):
            return True
    return False


class Node:
    __slots__ = ("name", "marks", "parent", "children", "points")

    def __init__(self, name: str, marks: str, parent: Node | None) -> None:
        self.name, self.marks, self.parent = name, marks, parent
        self.children: list[Node | str] = []
        self.points = 0.0


def _attributes(raw: str) -> tuple[str, bool]:
    """Class and id words, and whether the element is not for readers."""
    if not raw.strip():
        return "", False
    words, gone = [], False
    for m in ATTRIBUTE.finditer(raw):
        if m.start() and not raw[m.start() - 1].isspace() and raw[m.start() - 1] not in "\"'/":
            continue
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            words.append(value)
        elif name == "role":
            gone |= value.strip().lower() in ROLES
        elif name == "hidden":
            gone = True
        elif name == "aria-hidden":
            gone |= value.strip().lower() == "true"
        else:
            gone |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
    return " ".join(words), gone


def parse(page: str, names: frozenset = AROUND, dropped: frozenset = DROPPED) -> Node:
    """The element tree of a page, however badly nested; comments, dropped elements and their content are left out.

    So are elements whose class or id has one of the names.
    """
    root = Node("html", "", None)
    here, at, skip, depth, inner = root, 0, "", 0, 0
    token = TOKEN
    while True:
        m = token.search(page, at)
        if token is TOKEN and (lt := page.find("<", at)) >= 0 and (m is None or m.start() > lt) and re.match(r"<[A-Za-z/]", page[lt : lt + 2] + " "):
            token = LOOSE  # a quote is left open: from here tags end at the next >
            m = token.search(page, at)
        if not m:
            break
        if m.start() > at and not skip:
            here.children.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if skip in OPEN_ENDED and not inner:  # it may end without its own end tag
            if m[1]:
                over = name != skip and (name in SCOPES or name in FORMS)
            else:
                over = skip in SAME.get(name, ()) or (skip == "p" and name in ENDS_PARAGRAPH)
            skip = "" if over else skip
        if m[1]:
            if skip:
                inner -= name in SCOPES and inner > 0
                if name == skip:
                    depth -= 1
                    skip = skip if depth else ""
                continue
            node = here
            while node is not root and node.name != name:
                node = node.parent
            if node is not root and not (name == "p" and _between(here, node, SCOPES)):
                here = node.parent
            continue
        if skip:
            depth += name == skip and not m[3].rstrip().endswith("/")
            inner += name in SCOPES and name != skip
            if name in RAW and name != skip:
                at = _after_raw(page, at, name)
            continue
        if name in RAW:
            at = _after_raw(page, at, name)
            continue
        words, gone = _attributes(m[3])
        if name in ENDS_PARAGRAPH:
            node = here
            while node is not root and node.name != "p" and node.name not in SCOPES and node.name not in ("li", "td", "th", "blockquote"):
                node = node.parent
            if node.name == "p":
                here = node.parent
        if name in SAME:
            node = here
            while node is not root and node.name not in SAME[name] and node.name not in SCOPES:
                node = node.parent
            if node.name in SAME[name]:
                here = node.parent
        if name in VOID:
            if name in ("br", "hr"):
                here.children.append(Node(name, "", here))
            continue
        if (name in dropped or gone or (name not in ("article", "main") and surrounds(words, names))) and name not in ("html", "body"):
            if not m[3].rstrip().endswith("/") or name not in ("svg", "math"):
                skip, depth, inner = name, 1, 0
            continue
        if name in ("html", "body") and here is not root:
            continue
        node = Node(name, words, here)
        here.children.append(node)
        here = node
    if not skip and at < len(page):
        here.children.append(page[at:])
    return root


def _between(low: Node, high: Node, names: frozenset) -> bool:
    while low is not high:
        if low.name in names:
            return True
        low = low.parent
    return False


def _after_raw(page: str, at: int, name: str) -> int:
    m = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
    return m.end() if m else len(page)


def _nodes(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def _score(root: Node) -> dict[int, tuple[int, int]]:
    """Points of all nodes; text length and length within links by node."""
    nodes = _nodes(root)
    sizes: dict[int, list[int]] = {}
    for node in reversed(nodes):
        own = [0, 0, 0, 0]  # length, in links, commas, length of direct text
        for c in node.children:
            if isinstance(c, str):
                n = len(SPACE.sub(" ", c).strip())
                own[0] += n
                own[3] += n
                own[2] += sum(c.count(x) for x in ",،、，;؛")
            else:
                for k in range(3):
                    own[k] += sizes[id(c)][k]
        if node.name == "a":
            own[1] = own[0]
        sizes[id(node)] = own
    for node in nodes:
        length, _, commas, direct = sizes[id(node)]
        if node.name in PARAGRAPHS or (node.name in ("div", "section", "article", "main", "body") and direct >= 25):
            if length < 25 or (node.name not in ("p", "pre", "blockquote") and any(isinstance(c, Node) and c.name in PARAGRAPHS for c in node.children)):
                continue
            points = 1 + commas + min(length / 100, 3)
            holder = node.parent if node.name in PARAGRAPHS else node
            if holder is not None:
                holder.points += points
                if holder.parent is not None:
                    holder.parent.points += points / 2
    for node in nodes:
        if node.name in ("article", "main"):
            node.points = node.points * 1.5 + 10
        if LIKELY.search(node.marks):
            node.points += 10
        length, linked = sizes[id(node)][:2]
        node.points *= 1 - (linked / length if length else 0)
        if surrounds(node.marks) and node.name not in ("html", "body", "article", "main"):
            node.points /= 2
    return {k: (v[0], v[1]) for k, v in sizes.items()}


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, character references decoded and white space made one."""
    out, run = [], []

    def end() -> None:
        text = SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [node]
    while todo:
        c = todo.pop()
        if c is None:
            end()
        elif isinstance(c, str):
            run.append(c)
        elif c.name in BLOCKS:
            end()
            todo.append(None)
            todo.extend(reversed(c.children))
        else:
            todo.extend(reversed(c.children))
    end()
    return out


def _prose(node: Node) -> int:
    """Length of the text below a node in blocks that read like prose, links left out."""
    length, todo = 0, [node]
    while todo:
        n = todo.pop()
        own = SPACE.sub(" ", "".join(c if isinstance(c, str) else " ".join(_blocks(c)) if c.name not in BLOCKS and c.name != "a" else "" for c in n.children)).strip()
        length += len(own) if len(own) >= 25 else 0
        todo += [c for c in n.children if isinstance(c, Node) and c.name in BLOCKS]
    return length


def main_text(page: str | None) -> str:
    """The article's text; empty where a page has none.

    Where elements left out by their names held more than three times the prose that was found, the page is read
    again with those names kept that only tell of a place; what readers or sellers wrote (NEVER) stays out. A form
    is part of the text only if the best container of the page lies inside it, as on pages that stand in one form.
    """
    if not page:
        return ""
    text = _article(parse(page))
    if surrounds_any(page):
        placed = parse(page, NEVER)
        if _prose(placed) > 3 * len(text):
            text = _article(placed) or text
    if "<form" in page.lower() or "<fieldset" in page.lower():
        whole = parse(page, AROUND, DROPPED - FORMS)
        best = _best(whole)
        above = []
        while best is not None and best.parent is not None:
            best = best.parent
            above.append(best)
        if any(n.name in FORMS for n in above):
            for node in _nodes(whole):
                node.children = [c for c in node.children if isinstance(c, str) or c.name not in FORMS or c in above]
                node.points = 0.0
            text = _article(whole) or text
    return text


def _best(root: Node, scored: bool = False) -> Node | None:
    """The block with most points, None if none has any."""
    if not scored:
        _score(root)
    nodes = [n for n in _nodes(root) if n.name in BLOCKS and n.name not in ("br", "hr", "tr", "thead", "tbody", "tfoot")]
    best = max(nodes, key=lambda n: n.points, default=None)
    return best if best is not None and best.points > 0 else None


def surrounds_any(page: str) -> bool:
    """Whether some tag of the page may be left out by its names."""
    return any(surrounds(html.unescape(m[1] or m[2] or m[3])) for m in NAMES.finditer(page))


def _article(root: Node) -> str:
    sizes = _score(root)
    best = _best(root, scored=True)
    if best is None:
        whole = [n for n in _nodes(root) if n.name in ("article", "main")] or [root]
        return " ".join(x for n in whole if not _inside(n, whole) for x in _blocks(n))
    while best.parent is not None and best.name not in ("article", "main") and _holder(best) is not None:
        best = _holder(best)
    if best.parent is None:
        return " ".join(_blocks(best))
    need = max(10.0, best.points * 0.2)
    kept = []
    for c in best.parent.children:
        if c is best:
            kept += _blocks(best)
        elif isinstance(c, Node):
            length, linked = sizes[id(c)]
            density = linked / length if length else 1.0
            text = " ".join(_blocks(c)) if c.points >= need or c.name in ("p", "article") else ""
            if c.points >= need or (c.name == "article" and text) or (c.name == "p" and ((length > 80 and density < 0.25) or (0 < length <= 80 and density == 0 and re.search(r"[.!?。？！](?:\s|$)", text)))):
                kept.append(text)
    return " ".join(t for t in kept if t)


def _holder(node: Node) -> Node | None:
    """The article or main element around a node, if there is one."""
    node = node.parent
    while node is not None and node.name not in ("article", "main"):
        node = node.parent
    return node


def _inside(node: Node, others: list[Node]) -> bool:
    up = node.parent
    while up is not None:
        if up in others:
            return True
        up = up.parent
    return False


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page, from the whole html; a null or empty page, or one without text, has the empty text.

    Repeated rows and null ids stay; other columns are not read; an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(p) for p in b.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    cols = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return cols.mapInArrow(run, "page_id long, url string, text string")
