"""Main-text extraction from HTML by scoring the containers of paragraphs."""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from taktwerk.llm.common import map_column

# Elements without content, elements whose content isn't markup, elements never part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NEVER = frozenset(
    "nav header footer aside form script style noscript iframe template button select option textarea input svg math "
    "canvas object embed audio video dialog menu head title fieldset label".split()
)
# Elements that part one block of text from the next.
BLOCK = frozenset(
    "address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
# An open p ends where one of these starts; an open li, td and so on where its like starts.
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "figcaption"}
LIKE = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Names of class, id or role that mark what is no article: a core, alone or with these words before or behind it.
CORE = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|popups?|modal|overlay|newsletter|subscribe|"
    r"sign-?up|log-?in|nav|navbar|navigation|menu|breadcrumbs?|side-?bar|footer|header|masthead|top-?bar|copyright|colophon|"
    r"comments?|disqus|replies|reply|respond|share|sharing|social|related|recommend\w*|pagination|pager|widgets?|toolbar|"
    r"skip-link|search|complementary|contentinfo|banner|alert|disclaimer"
)
AROUND = (
    r"site|page|main|global|top|bottom|left|right|primary|secondary|user|reader|post|list|section|area|box|bar|form|wrap|wrapper|"
    r"container|block|links?|items?|menu|posts?|articles?|stories|content|thread|body|banner|notice|inner|widget|nav|reader|\d+"
)
UNLIKELY = re.compile(rf"(?:(?:{AROUND})[_-]+)*({CORE})(?:[_-]+(?:{AROUND}|{CORE}))*", re.IGNORECASE)
TALK = re.compile(r"comments?|disqus|replies|reply|respond", re.IGNORECASE)  # of those, what readers say
OWN_HEADER = re.compile(r"(?:post|article|story|section|content|body)[_-]+(?:.*[_-])?header", re.IGNORECASE)  # of those, an article's own
# Elements that a name can mark; an article only as what a reader says. Never one inside a line of text.
NAMED = frozenset("div section ul ol dl p table details center article".split())
# Headings above lists of links that belong to an article.
SOURCES = re.compile(r"(?:\W|\d)*(?:references?|sources?|notes?|footnotes?|bibliography|works cited|citations?|further reading|literature|quellen|literatur|einzelnachweise|références|fuentes|referencias)\W*", re.IGNORECASE)
LEGAL = re.compile(r"©|\bcopyright\b|\ball rights reserved\b", re.IGNORECASE)
TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--(?:>|->)?|[!?/])")
REST = re.compile(r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>")  # of a start tag
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|style|hidden|aria-hidden)(?![^\s=/])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE) for tag in RAW}
COMMAS = re.compile("[,،、，;]")
SCORED = frozenset("p pre td blockquote li dd div section article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What an end tag of something else doesn't reach across; where the search for an open p ends.
TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
P_SCOPE = frozenset("button td th caption table object template".split())
MAX_DEPTH = 500  # elements nested deeper become siblings, as in browsers
# After so many start tags on a page whose quotes take in all that follows up to its last >, quotes count no more on that page: a tag then
# ends at the next >. Each of them is read to the page's end, so without a bound such a page would take quadratic time.
MAX_FAILS = 20


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "named", "p", "depth", "size", "linked", "commas", "block", "main", "points", "score")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, named: str = ""):
        self.tag, self.parent, self.drop, self.named = tag, parent, drop, named
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        self.p = self if tag == "p" else None if parent is None or tag in P_SCOPE else parent.p  # the open p around it


def marks(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether attributes hide an element, and the core of a name that marks it as no article."""
    hidden, named = False, ""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.lower().replace(" ", "")
        elif name in ("class", "id", "role") and tag in NAMED:
            for word in value.split():
                m = UNLIKELY.fullmatch(word)
                if m and (tag != "article" or TALK.fullmatch(m[1])):
                    core = "own header" if OWN_HEADER.fullmatch(word) else m[1].lower()
                    named = named if TALK.fullmatch(named) else core
    return hidden, named


def parse(page: str) -> Node:
    """The tree of a page: its open elements end where HTML lets them, and comments and markup are gone. Its time is linear."""
    root = Node("html", None)
    here, at, fails = root, 0, 0
    last_end = page.rfind(">")
    is_open: Counter = Counter()
    unclosed: set[str] = set()  # raw elements whose end is nowhere ahead

    def leave(to: Node) -> Node:
        node = here
        while node is not to:
            is_open[node.tag] -= 1
            node = node.parent
        return to

    while True:
        m = TAG.search(page, at)
        if m is None or m.start() > last_end:
            here.children.append(page[at:])
            return root
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:  # a comment, a declaration or a stray mark
            if m[0].startswith("<!--"):
                end = page.find("-->", max(m.start() + 4, at - 3)) if len(m[0]) == 4 else at - 3
                at = len(page) if end < 0 else end + 3
            else:
                end = page.find(">", at)
                at = len(page) if end < 0 else end + 1
            continue
        tag = tag.lower()
        if m[1]:
            at = page.find(">", at) + 1 or len(page)
            if is_open[tag] > 0:
                node = here
                while node.tag != tag and (node.tag not in TABLE or tag in TABLE):
                    node = node.parent
                if node.tag == tag:
                    here = leave(node.parent)
            continue
        rest = REST.match(page, at) if fails < MAX_FAILS else None
        if rest is None:
            fails += 1
            end = page.find(">", at)
            attributes, at = page[at:end], end + 1
        else:
            attributes, at = page[at : rest.end() - 1], rest.end()
        if tag == "html" and here is root:
            continue
        if tag in ENDS_P and here.p is not None:
            here = leave(here.p.parent)
        if tag in LIKE:
            own, stop = LIKE[tag]
            if any(is_open[x] > 0 for x in own):
                node = here
                while node.parent is not None and node.tag not in stop:
                    if node.tag in own:
                        here = leave(node.parent)
                    node = node.parent
        hidden, named = marks(tag, attributes) if attributes else (False, "")
        node = Node(tag, here, tag in NEVER or (hidden and tag != "body"), named)
        here.children.append(node)
        if tag in RAW and tag not in unclosed:
            end = RAW_END[tag].search(page, at)
            if end is not None:
                at = end.end()
                continue
            if tag in ("script", "style"):
                return root
            unclosed.add(tag)
            node.drop = tag != "noscript" and node.drop
        if tag not in VOID and node.depth < MAX_DEPTH and tag not in RAW:
            here = node
            is_open[tag] += 1


def counted(root: Node) -> list[Node]:
    """The kept nodes in page order, with counts of all that is below each: letters, those in links, commas, blocks, marks of an article."""
    nodes, stack = [], [root]
    while stack:
        n = stack.pop()
        n.size = n.linked = n.commas = 0
        n.block = n.main = False
        n.points = n.score = 0.0
        nodes.append(n)
        for c in n.children:
            if isinstance(c, str):
                n.size += len(c.strip())
                n.commas += len(COMMAS.findall(c))
        stack += [c for c in reversed(n.children) if not isinstance(c, str) and not c.drop]
    for n in reversed(nodes):
        if n.tag == "a":
            n.linked = n.size
        n.main |= n.tag in ("h1", "article", "main") and not n.named
        if n.parent is not None and n is not root:
            up = n.parent
            up.size += n.size
            up.linked += n.linked
            up.commas += n.commas
            up.block |= n.block or n.tag in BLOCK
            up.main |= n.main
    return nodes


def inside(node: Node, tag: str) -> Node | None:
    """The outermost element of a kind that holds a node, or is it."""
    found, n = None, node
    while n is not None:
        found = n if n.tag == tag and not n.named else found
        n = n.parent
    return found


def keep_headings(header: Node) -> None:
    """What stays of the header of an article: its headings."""
    found, stack = [], [header]
    while stack:
        n = stack.pop()
        if n.tag in HEADINGS:
            found.append(n)
        else:
            stack += [c for c in reversed(n.children) if not isinstance(c, str)]
    header.children, header.drop, header.named = list(found), False, ""
    for n in found:
        n.parent = header


def holds_links(node: Node) -> bool:
    """Whether a node holds a link, a menu or a form."""
    stack = [node]
    while stack:
        n = stack.pop()
        if n.tag in ("a", "nav", "form", "menu"):
            return True
        stack += [c for c in n.children if not isinstance(c, str)]
    return False


def settle_names(root: Node) -> None:
    """Decides what a name means: a marked element goes, unless it holds most of the page's text and the article with it.

    A header leaves its headings if it stands in an article or main element, if its name is that of an article's header, or if it
    holds no links and isn't the page's.
    """
    stack, headers = [(root, False)], []
    while stack:
        n, article = stack.pop()
        article |= n.tag in ("article", "main") and not n.named
        for c in n.children:
            if not isinstance(c, str):
                if c.named == "own header" or (article and (c.tag == "header" or c.named == "header")):
                    headers.append(c)
                elif c.tag == "header" and n is not root and n.tag != "body" and not holds_links(c):
                    headers.append(c)
                elif not c.drop:
                    stack.append((c, article))
    for header in headers:
        keep_headings(header)
    nodes = counted(root)
    plain = root.size - root.linked
    for n in nodes:
        if n.named:
            most = 2 * (n.size - n.linked) > plain
            holds = n.main or (not root.main and not TALK.fullmatch(n.named))
            n.drop = not (most and holds)


def dense(n: Node) -> bool:
    """Whether a node is rather a list of links than text."""
    return n.size > 0 and 2 * n.linked > n.size and n.tag not in HEADINGS


def aside_of(node: Node, top: Node) -> None:
    """Drops the lists of links beside a node and beside what holds it, below top, but for an article's sources."""
    while node is not top and node.parent is not None:
        heading = False
        for c in node.parent.children:
            if isinstance(c, str):
                continue
            if c is not node and not c.drop and dense(c) and not heading and not (c.tag in ("section", "div") and sources(c)):
                c.drop = True
            if not c.drop and c.size:
                heading = c.tag in HEADINGS and bool(SOURCES.fullmatch(" ".join(blocks_of([c]))))
        node = node.parent


def sources(n: Node) -> bool:
    """Whether a section starts with a heading of sources."""
    first = next((c for c in n.children if not isinstance(c, str) and not c.drop), None)
    return first is not None and first.tag in HEADINGS and bool(SOURCES.fullmatch(" ".join(blocks_of([first]))))


def choose(root: Node) -> list[Node | str]:
    """The best container and its siblings, in page order; the root if nothing scores.

    Paragraphs give points for length and commas, less for links: all to the parent, half to the next, a quarter to the third.
    The main element around the best container is taken whole, or else the article, with the articles and sections beside it.
    Otherwise the best container goes with all its siblings, and so do its ancestors as long as they add a tenth to the points.
    Lists of links beside the best container and what holds it stay out, unless a heading names them as sources.
    """
    settle_names(root)
    nodes = counted(root)
    candidates: dict[int, Node] = {}
    for n in nodes:
        if n.tag not in SCORED or not n.size or (n.block and n.tag not in ("p", "pre", "td")):
            continue
        points = (1 + n.commas + min(n.size / 100, 3)) * (1 - n.linked / n.size)
        n.points += points
        up, share = n.parent, 1.0
        while up is not None and share >= 0.25:
            up.score += points * share
            candidates[id(up)] = up
            up, share = up.parent, share / 2
    for n in reversed(nodes):
        if n.parent is not None and n is not root:
            n.parent.points += n.points
    if not candidates:
        return [root]
    for n in candidates.values():
        n.score *= (1 - n.linked / max(n.size, 1)) * (2 if n.tag in ("article", "main") else 0.5 if n.tag in ("ul", "ol", "dl") else 1)
    order = {id(n): i for i, n in enumerate(nodes)}
    best = max(candidates.values(), key=lambda n: (n.score, -order[id(n)]))
    main, article = inside(best, "main"), inside(best, "article")
    if main is not None:
        aside_of(article or best, main)
        return [main]
    if article is not None:
        beside = article.parent.children if article.parent else [article]
        beside = [c for c in beside if not isinstance(c, str) and c.tag in ("article", "section") and not c.drop]
        return [n for n in beside if n is article or (n.size and not (dense(n) and not sources(n)))]
    kept: list[Node | str] = [best]
    levels = 0
    while best.parent is not None and (levels == 0 or best.parent.points - best.points >= 0.1 * best.points):
        aside_of(best, best.parent)
        at = next(i for i, c in enumerate(best.parent.children) if c is best)
        around = [c if isinstance(c, str) or not (c.drop or legal(c)) else " " for c in best.parent.children]
        kept = [*around[:at], *kept, *around[at + 1 :]]
        best, levels = best.parent, levels + 1
    return kept


def legal(n: Node) -> bool:
    """Whether a short element is a line about rights."""
    return n.size < 300 and bool(LEGAL.search(" ".join(blocks_of([n]))))


def blocks_of(nodes: list[Node | str]) -> list[str]:
    """The text of each block below the nodes, references decoded, white space folded; empty ones left out."""
    blocks: list[str] = []
    parts: list[str] = []

    def close() -> None:
        words = "".join(parts).split()
        parts.clear()
        if words:
            blocks.append(" ".join(words))

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        n = stack.pop()
        if n is None:
            close()
        elif isinstance(n, str):
            parts.append(html.unescape(n) if "&" in n else n)
        elif n.drop:
            parts.append(" " if n.tag in BLOCK else "")
        elif n.tag == "br":
            parts.append(" ")
        else:
            if n.tag in BLOCK:
                close()
                stack.append(None)
            stack += reversed(n.children)
    close()
    return blocks


def extract(page: str | None) -> str:
    """The article's blocks, joined by blank lines; empty for a null page or one without text."""
    return "\n\n".join(blocks_of(choose(parse(page)))) if page else ""


def extract_text(pages: DataFrame, keep: list[str], html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Carries `keep` and adds the main text and n_chars, its code points, in one pass without a shuffle.

    What stays is the best container by tree scoring and what stands beside it. Elements that are never text of an article go
    (menus, headers, footers, asides, forms, scripts and the like), and so do those that a class, id or role names as such; a name
    on a wrapper that holds most of the text and the article with it means nothing, and so does one on an element inside a line or on a
    figure. The header of an article leaves its headings. A null or empty page has an empty text; a page without scored paragraphs gives all its text outside of what goes. Pages of any
    length and nesting are read whole, in linear time; repeated rows each.
    """

    def setup():
        def work(values: list) -> dict[str, list]:
            texts = [extract(v) for v in values]
            return {text_col: texts, "n_chars": [len(t) for t in texts]}

        return work

    fields = [T.StructField(text_col, T.StringType()), T.StructField("n_chars", T.LongType())]
    return map_column(pages, html_col, keep, fields, setup)
