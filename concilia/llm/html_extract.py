"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks at block-level tags. A linear classifier
scores each block (log-odds of being content) from its surroundings and
its text; the score becomes its terminal capacity: a positive one joins
the block to the source (content), a negative one to the sink
(boilerplate). Blocks next to each other are joined by an adjacency edge,
blocks under one parent element by a DOM proximity edge; both are weak
between a block of links and one of text. The maximum flow
from source to sink gives the minimum cut, the labelling of least total
cost: a lone block that the classifier gets wrong goes with its
neighbours unless its own evidence outweighs them. Blocks on the source
side, in page order, are the text.

Boilerplate marks have levels. Forms and class words that speak of layout or
mix content and boilerplate (``with-sidebar``, ``main-search``) are WEAK: a
content word below resets them. Other class words are MARKED: an article
resets those of wrappers, as it does weak ones. Navigation, comments, related
items and advertisements are FIRM: only main or an articleBody below resets
them. What is not displayed is HIDDEN for good. Negated words
(``no-comments``) and taxonomy (``category-ads``) say nothing. All but hidden
blocks can be overruled by their text and neighbours.

Character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by a newline; scripts, styles, other
non-text elements, comments and markup go. ``<br>`` is white space inside
its block. Nothing is capped: a page of any length is labelled whole, a
broken page is read as far as it goes (open elements end with the page).

Null html is empty (text ""); null urls and ids are kept; repeated rows
keep one result each; an empty table gives no rows; other columns are ignored. Map only, no shuffle.
"""

from __future__ import annotations

import html as _html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, map_rows

#: Capacities of the smoothness edges.
ADJACENT, SIBLING, ACROSS = 1.0, 1.0, 0.25
#: Classifier weights (log-odds).
INSIDE, LINK, WORDS, SENTENCE, BIAS, HEADING = 6.0, -5.0, 1.1, 1.0, -1.5, 1.0
#: Levels of boilerplate marks, and their weights.
NONE, WEAK, MARKED, FIRM, HIDDEN = range(5)
OUTSIDE = (0.0, -2.0, -5.0, -5.0, -14.0)

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul".split())
#: Block tags that hold one block; their parent is what their siblings share.
LEAF_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption legend address summary".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no page text; the first group's content is raw.
RAW_TAGS = frozenset("script style textarea title xmp noembed noframes iframe".split())
SKIP_TAGS = RAW_TAGS | frozenset("head noscript template svg math object audio video canvas select button datalist".split())
OUT_TAGS = frozenset("nav footer aside form menu dialog".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
IN_TAGS = frozenset("article main".split())
#: Words of class and id that mark boilerplate, and content.
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright dialog disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification overlay pager pagination popup promo promoted promotion related reply replies respond search "
    "share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Those that an article does not reset: articles inside them are comments, teasers or advertisements.
FIRM_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising comment comments disqus promo promoted promotion related reply "
    "replies respond sponsor sponsored".split())
#: Words that say, beside a mark, that it is absent, a taxonomy, or a matter of layout.
VOID_WORDS = frozenset("no without not non category tag type format status".split())
LAYOUT_WORDS = frozenset("with has layout wrapper container page site".split())
IN_WORDS = frozenset("article articlebody content entry main post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag of the key ends open elements of the value, up to the limits.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
          "tfoot": {"tr", "td", "th", "tbody"}}
LIMITS = frozenset("ul ol dl table select menu".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
                  r"""|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|/[^>]*(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ATTRS = frozenset("class id role itemprop style hidden aria-hidden".split())
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"[ \t-\r]+")


class _Element:
    __slots__ = ("tag", "out", "inside", "link", "skip", "number", "block")

    def __init__(self, tag, parent, number, attrs):
        self.tag, self.number = tag, number
        self.inside = bool(parent and parent.inside) or tag in IN_TAGS
        self.link = bool(parent and parent.link) or tag == "a"
        self.skip = bool(parent and parent.skip) or tag in SKIP_TAGS
        self.block = number if parent is None or tag in BLOCK_TAGS and tag not in LEAF_TAGS else parent.block
        # marks of wrappers up to this level end here
        resets = FIRM if tag == "main" else MARKED if tag == "article" else NONE
        own = WEAK if tag == "form" else FIRM if tag in OUT_TAGS else MARKED if tag == "header" and not self.inside else NONE
        if attrs and tag not in ("html", "body"):
            own, resets = self.read(attrs, own, resets)
        # what an element is, its own layout words do not change
        if resets and own <= WEAK:
            own = NONE
        out = parent.out if parent else NONE
        self.out = max(own, out if out > resets else NONE)

    def read(self, attrs, own, resets):
        """Level of the element's own marks, and of the wrappers' marks that it resets."""
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name not in _ATTRS:
                continue
            if name in ("class", "id"):
                for token in value.split():
                    words = _WORD.findall(token)
                    found = OUT_WORDS.intersection(words)
                    if "header" in words and not self.inside:
                        found |= {"header"}
                    if found and VOID_WORDS.isdisjoint(words):
                        if not LAYOUT_WORDS.isdisjoint(words) or not IN_WORDS.isdisjoint(words):
                            own = max(own, WEAK)
                        else:
                            own = max(own, MARKED if FIRM_WORDS.isdisjoint(found) else FIRM)
                    elif not found and not IN_WORDS.isdisjoint(words):
                        self.inside, resets = True, max(resets, WEAK)
            elif name == "role":
                if value in OUT_ROLES:
                    own = max(own, MARKED if value in ("form", "search") else FIRM)
                elif value in ("main", "article"):
                    self.inside, resets = True, max(resets, FIRM if value == "main" else MARKED)
            elif name == "itemprop":
                if value == "articlebody":
                    self.inside, resets = True, FIRM
            elif name == "hidden" and value != "false":
                own = HIDDEN
            elif name == "aria-hidden" and value == "true":
                own = max(own, FIRM)
            elif name == "style" and "display:none" in value.replace(" ", ""):
                own = HIDDEN
        return own, resets


class Block:
    __slots__ = ("text", "parent", "out", "inside", "linked", "heading")

    def __init__(self, text, element, linked):
        self.text, self.parent, self.linked = text, element.block, linked
        self.out, self.inside, self.heading = element.out, element.inside, element.tag in HEADINGS


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order."""
    stack = [_Element("", None, 0, "")]
    found, parts, links, number, at, n = [], [], 0, 0, 0, len(page)
    first, paragraphs = None, 0  # paragraphs: open <p> elements

    def end(i):
        nonlocal paragraphs
        paragraphs -= sum(e.tag == "p" for e in stack[i:])
        del stack[i:]

    def text(s):
        nonlocal first, links
        top = stack[-1]
        if s and not top.skip:
            s = _html.unescape(s)
            if first is None and not s.isspace():
                first = top
            parts.append(s)
            if top.link:
                links += len(s)

    def flush():
        nonlocal parts, links, first
        if parts:
            if t := _SPACE.sub(" ", "".join(parts)).strip(" "):
                found.append(Block(t, first or stack[-1], links))
            parts, links, first = [], 0, None

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        attrs = m[3] or m[6] or ""
        if m[1] or m[4]:
            if tag in BLOCK_TAGS:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    end(i)
                    break
                # an inline or paragraph end tag does not end the sections around it
                if stack[i].tag in BLOCK_TAGS and tag not in BLOCK_TAGS:
                    break
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            if paragraphs:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        end(i)
                        break
                    if stack[i].tag in BLOCK_TAGS:
                        break
            if tag in CLOSES:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in CLOSES[tag]:
                        end(i)
                    elif stack[i].tag in LIMITS:
                        break
        if tag in VOID_TAGS:
            continue
        number += 1
        if tag == "body":  # an unclosed head ends here
            end(1)
        stack.append(_Element(tag, stack[-1], number, attrs))
        paragraphs += tag == "p"
        if tag in RAW_TAGS:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else n
    flush()
    return found


def score(b: Block) -> float:
    """Log-odds of being content."""
    words = b.text.count(" ") + 1
    s = BIAS + WORDS * math.log1p(words) + LINK * min(1.0, b.linked / len(b.text))
    if b.text[-1] in ".!?…\"'”»":
        s += SENTENCE
    if b.heading:
        s += HEADING
    if b.out:
        return OUTSIDE[b.out] + min(4.0, max(-4.0, s))
    return (INSIDE if b.inside else 0.0) + min(4.0, max(-4.0, s))


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut; nodes that no cut
    decides go to the sink. Maximum flow by levels (Dinic): a search from all
    nodes with source capacity left gives levels, and all shortest paths are
    filled in one pass before the next search. Edges join near neighbours and
    carry little, so few searches are needed."""
    n = len(scores)
    spare = [abs(s) for s in scores]
    near: list[list[list]] = [[] for _ in range(n)]  # [to, capacity left, reverse entry]
    for i, j, w in edges:
        a, b = [j, w, None], [i, w, None]
        a[2], b[2] = b, a
        near[i].append(a)
        near[j].append(b)
    least = 1e-9
    while True:
        level = [0 if s > 0 and c > least else -1 for s, c in zip(scores, spare)]
        front, ends, depth = [i for i in range(n) if level[i] == 0], False, 0
        while front and not ends:
            depth += 1
            after = []
            for i in front:
                for e in near[i]:
                    j = e[0]
                    if e[1] > least and level[j] < 0:
                        level[j] = depth
                        ends = ends or (scores[j] < 0 and spare[j] > least)
                        after.append(j)
            front = after
        if not ends:
            return [x >= 0 for x in level]
        at = [0] * n  # edges of each node that are used up in this pass
        for start in range(n):
            path: list[list] = []
            while level[start] == 0 and scores[start] > 0 and spare[start] > least:
                i = path[-1][0] if path else start
                if path and scores[i] < 0 and spare[i] > least:
                    flow = min(spare[start], spare[i], min(e[1] for e in path))
                    spare[start] -= flow
                    spare[i] -= flow
                    for e in path:
                        e[1] -= flow
                        e[2][1] += flow
                    full = next((k for k, e in enumerate(path) if e[1] <= least), len(path))
                    if full == len(path):  # the end node is full
                        at[i] = len(near[i])
                        full -= 1
                    del path[full:]
                    continue
                while at[i] < len(near[i]):
                    e = near[i][at[i]]
                    if e[1] > least and level[e[0]] == level[i] + 1:
                        break
                    at[i] += 1
                if at[i] < len(near[i]):
                    path.append(near[i][at[i]])
                elif path:
                    path.pop()
                    at[path[-1][0] if path else start] += 1
                else:
                    break


def extract(page: str) -> str:
    """The main text of one page."""
    found = blocks(page)
    edges, last = [], {}
    # blocks of one kind hold together, those of different kinds hardly
    kinds = [(b.out > 0, b.inside, 2 * b.linked > len(b.text)) for b in found]
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, ADJACENT if kinds[i - 1] == kinds[i] else ACROSS))
        if b.parent in last:
            j = last[b.parent]
            edges.append((j, i, SIBLING if kinds[j][2] == kinds[i][2] else ACROSS))
        last[b.parent] = i
    keep = min_cut([score(b) for b in found], edges)
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars (code points)."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def make(ids, urls, htmls):
        texts = [extract(h) for h in htmls]
        return ids, urls, texts, [len(t) for t in texts]

    rows = pages.select(F.col(id_col), F.col(url_col), body(html_col))
    return map_rows(rows, make, f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars long")
