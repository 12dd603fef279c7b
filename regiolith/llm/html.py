"""Main text of web pages by composite text density.

Each page becomes a tree of its block elements. For every node the composite text density is the number of
characters for each tag, lowered where characters and tags lie in links; the density sum of a node adds up its
children's densities. Element names, roles and class words of menus, footers, adverts, notices, comments and the
like are evidence against a node, which takes its density away wholly or in part, unless its content speaks for it:
an article or a main element inside, or most of the page's text with a heading. The subtree with the largest sum is
the article, among nodes at least as dense as the sparsest node on the path from the body to the densest one. It is
widened to an enclosing article or main element, and to a parent whose other children carry a like share of the sum.
Blocks inside it that stay in doubt are cut off.

A null or empty page gives the empty text. Character references are decoded, white space inside a block becomes
one space, blocks are joined by a newline in page order. Cut-off pages are read as far as they go. Repeated rows
give repeated results; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiolith.llm.common import map_rows, table

#: A comment, a tag with its attributes, or a declaration. Groups are atomic, so that a tag is read in one pass.
TAG = re.compile(r"""<!--|<(/?)([A-Za-z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>""")
#: The same where a quote is left open: the tag ends at the next >.
OPEN_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)([^>]*)>""")
SPACE = re.compile(r"\s+")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD = re.compile(r"[A-Za-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math object canvas video audio".split())
#: Of these, the ones that may hold others of their name.
NESTED = frozenset("template svg math object canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br img picture map area".split()
)
#: Elements that are never part of an article, and roles and words of class and id that speak against one.
NEVER = frozenset("head nav footer aside menu dialog button select option fieldset".split())
AGAINST_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
AGAINST_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice "
    "notices gdpr popup modal overlay newsletter subscribe signup nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar sidenav rail widget footer comments comment disqus respond reply replies share sharing social related recommended "
    "pagination pager toolbar".split()
)
#: In front of such a word in a name, these say that there is none of it, or that the element only has some of it.
NOT_IT = frozenset("no not non has with without hide hidden disable open".split())
NONE, WEAK, STRONG, FINAL = range(4)
#: What the evidence leaves of a node's density.
LEFT = {NONE: 1.0, WEAK: 0.3, STRONG: 0.0, FINAL: 0.0}
BLOCKS_OF_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote li dd td pre".split())
#: An opening tag of these ends an open element of the same list.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
SCOPE = frozenset("table ul ol dl article section div body main td th".split())
#: A parent takes the place of the best subtree if its other children carry this share of the sum.
WIDEN = 0.25


class Node:
    __slots__ = ("tag", "parent", "children", "doubt", "chars", "tags", "link_chars", "link_tags", "holds_main", "holds_heading", "density", "total")

    def __init__(self, tag: str, parent: Node | None, doubt: int = NONE):
        self.tag, self.parent, self.children, self.doubt = tag, parent, [], doubt
        self.chars = self.link_chars = self.link_tags = 0
        self.tags = 1
        self.holds_main, self.holds_heading = tag in ("article", "main"), tag == "h1"
        self.density = self.total = 0.0


def words_against(value: str, inside_article: bool) -> int:
    """Evidence of a class or id: a name that is such a word is strong, one with such a word among others is weak."""
    found = NONE
    for name in value.split():
        words = WORD.findall(name)
        hits = [w for i, w in enumerate(words) if (w in AGAINST_WORDS or (w == "header" and not inside_article)) and not (i and words[i - 1] in NOT_IT)]
        found = max(found, NONE if not hits else STRONG if len(hits) == len(words) else WEAK)
    return found


def evidence(tag: str, attributes: str, inside_article: bool) -> int:
    """How much speaks against an element by its name and attributes."""
    if tag in NEVER:
        return FINAL
    found = STRONG if tag == "header" and not inside_article else WEAK if tag == "form" else NONE
    if not attributes or tag in ("body", "html", "article", "main"):
        return found
    if re.search(r"(?i)(?:^|\s)hidden(?:\s|$|=)", attributes):
        return FINAL
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value.strip() in AGAINST_ROLES:
            found = max(found, STRONG)
        elif name in ("class", "id"):
            found = max(found, words_against(value, inside_article))
        elif name == "aria-hidden" and value == "true":
            return FINAL
    return found


def end_of_raw(page: str, tag: str, at: int) -> int:
    """Where the content of an element without markup of its own ends; such elements may hold others of their name."""
    depth = 1
    for m in re.compile(rf"(?i)<(/?){re.escape(tag)}(?=[\s/>])[^>]*>").finditer(page, at):
        depth += -1 if m[1] else 0 if m[0].endswith("/>") or tag not in NESTED else 1
        if depth == 0:
            return m.end()
    return len(page)


def parse(page: str) -> tuple[Node, list[tuple[Node, str, bool, int]]]:
    """The tree of blocks and (block, text, inside a link, number of the run of text) in page order."""
    root = Node("html", None)
    stack: list[tuple[str, Node, bool, bool]] = [("html", root, False, False)]  # name, its block, dropped, in an article
    texts: list[tuple[Node, str, bool, int]] = []
    links = run = 0
    at, end, quotes_close = 0, len(page), True

    def add(text: str) -> None:
        if text and not stack[-1][2]:
            texts.append((stack[-1][1], text, links > 0, run))

    while at < end:
        start = page.find("<", at)
        while start >= 0 and start + 1 < end and not (page[start + 1].isascii() and (page[start + 1].isalpha() or page[start + 1] in "/!?")):
            start = page.find("<", start + 1)
        m = TAG.match(page, start) if start >= 0 and quotes_close else None
        if m is None and start >= 0:
            quotes_close = quotes_close and not page[start + 1 : start + 2].isalpha()  # an open quote: once is enough
            m = TAG.match(page, start) if page[start + 1 : start + 2] in ("!", "?") else OPEN_TAG.match(page, start) if page.find(">", start) >= 0 else None
        if m is None and start >= 0 and page.find(">", start) >= 0:  # </ without a name
            add(page[at : start + 1])
            at = start + 1
            continue
        if m is None:
            add(page[at:] if start < 0 else page[at:start])  # a tag that the end of the page cuts off is left out
            break
        add(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            close = page.find("-->", at)
            at = end if close < 0 else close + 3
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and all(s[0] != "p" for s in stack):
                run += 1
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    links -= sum(s[0] == "a" for s in stack[i:])
                    del stack[i:]
                    break
            if tag not in INLINE:
                run += 1
            continue
        if tag in RAW:
            at = end_of_raw(page, tag, at)
            continue
        if tag == "br":
            add(" ")
        if tag in VOID:
            if tag == "hr":
                run += 1
            continue
        block = tag not in INLINE
        if block:
            run += 1
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i][0] == "p":
                    links -= sum(s[0] == "a" for s in stack[i:])
                    del stack[i:]
                    break
                if stack[i][0] in SCOPE:
                    break
            if tag in ENDS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ENDS[tag]:
                        del stack[i:]
                        break
                    if stack[i][0] in SCOPE and stack[i][0] not in ENDS[tag]:
                        break
        above = stack[-1]
        if tag == "a":
            links += 1
            if not above[2]:
                above[1].link_tags += 1
        inside = above[3] or tag in ("article", "main")
        doubt = evidence(tag, m[3], above[3])
        dropped = above[2] or doubt == FINAL or doubt == STRONG and not block
        node = above[1]
        if block and not dropped:
            node = Node(tag, above[1], doubt)
            above[1].children.append(node)
        stack.append((tag, node, dropped, inside))
    return root, texts


def measure(root: Node, texts: list[tuple[Node, str, bool, int]]) -> list[Node]:
    """Fills in counts, densities and density sums; returns all nodes, parents before children."""
    for node, text, linked, _ in texts:
        n = len(SPACE.sub(" ", text.strip()))
        node.chars += n
        if linked:
            node.link_chars += n
    nodes = [root]
    for node in nodes:
        nodes.extend(node.children)
    for node in reversed(nodes):
        if node.parent is not None:
            for name in ("chars", "tags", "link_chars", "link_tags"):
                setattr(node.parent, name, getattr(node.parent, name) + getattr(node, name))
            node.parent.holds_main |= node.holds_main
            node.parent.holds_heading |= node.holds_heading
    body = max(root.chars, 1)
    share = root.link_chars / body
    for node in nodes:
        c, t, lc, lt = node.chars, node.tags, node.link_chars, max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            x = (c / max(lc, 1)) * (t / lt)
            node.density = c / t * max(math.log(x) / base, 0.0) if x > 0 else 0.0
    left = {}
    for node in nodes:  # evidence against a node counts for all that it holds
        node.doubt = NONE if node.doubt and vouched(node, root) else node.doubt
        left[id(node)] = LEFT[node.doubt] * (left[id(node.parent)] if node.parent is not None else 1.0)
        node.density *= left[id(node)]
    for node in reversed(nodes):
        node.total = sum(k.density for k in node.children) if node.children else node.density
        if node.children:  # text of its own counts like a child
            own = node.chars - sum(k.chars for k in node.children)
            node.total += left[id(node)] * own / node.tags if own > 0 else 0.0
    return nodes


def vouched(node: Node, root: Node) -> bool:
    """Whether the content of a node in doubt outweighs the evidence of its name and attributes."""
    if node.doubt == FINAL or not node.chars:
        return False
    if node.holds_main:
        return True
    own_text = node.chars - node.link_chars
    most = 2 * own_text > root.chars - root.link_chars and 2 * node.link_chars < node.chars
    if node.doubt == STRONG:
        return most and node.holds_heading
    if node.tag in BLOCKS_OF_TEXT and own_text >= 40 and 5 * node.link_chars < node.chars:
        return True
    return most and (node.holds_heading or node.density >= root.density)


def article_node(nodes: list[Node]) -> Node:
    root = nodes[0]
    densest = max(nodes, key=lambda n: n.density)
    threshold, n = densest.density, densest
    while n is not None and n is not root:
        threshold, n = min(threshold, n.density), n.parent
    best = max((n for n in nodes if n.density >= threshold), key=lambda n: n.total, default=root)
    named, n = None, best
    while n is not None:
        # an outer article, and a main element of which the inner one is the lesser part, take its place
        if n.tag in ("article", "main") and (named is None or n.tag == "article" or 2 * named.chars < n.chars):
            named = n
        n = n.parent
    if named is not None:
        return named
    while best.parent is not None:
        rest = sum(k.total for k in best.parent.children if k is not best)
        if rest < WIDEN * best.total:
            break
        best = best.parent
    return best


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root, texts = parse(page)
    if not texts:
        return ""
    chosen = article_node(measure(root, texts))
    inside = {id(chosen)}
    reach = [chosen]
    for node in reach:
        kept = [k for k in node.children if not k.doubt]
        reach.extend(kept)
        inside.update(map(id, kept))
    blocks: list[str] = []
    runs: list[tuple[int, int]] = []
    for node, text, _, run in texts:
        if id(node) not in inside:
            continue
        key = (run, id(node))
        if runs and runs[-1] == key:
            blocks[-1] += text
        else:
            runs.append(key)
            blocks.append(text)
    made = (SPACE.sub(" ", entities.unescape(b)).strip() for b in blocks)
    return "\n".join(b for b in made if b)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def task():
        def step(block):
            made = [main_text(h) for h in block["html"]]
            return {"page_id": block["page_id"], "url": block["url"], "text": made, "n_chars": [len(t) for t in made]}

        return step

    return map_rows(pages.select("page_id", "url", "html"), task, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", "html"))
