"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at block-level tags.  A block has its word count
and link density, those of its neighbours, its place and depth, and what its
surroundings say: whether it stands in an article or main element, in a heading, before
the page's title, beside an article that holds most of the page's words, and in an
element named as furniture.  For the name (tag, role, id or class) around it that
speaks most of furniture (menus, notices, adverts, comments) a block has the share of
the name's words that do so ("site-footer": all, since words that only say where
something stands don't count; "popular-science": half), the share of the page's words
inside that element, whether it is of comments, and whether it holds the page's main
element, title or largest article.  A link is an ``a`` with href, up to
its end; one that is not closed ends at the next ``a`` or where its block ends.
A decision tree, grown by Gini impurity on the blocks of the small labelled table
of pages below, weighs all this and alone tells main text from the rest.  The tree is
the same for every page and size; Spark deals out the pages.  A page is read in time
linear in its length.

Cases: a null or empty page, or one without main text, gives an empty text; markup
that breaks off or is not closed is read as far as it goes; every page gives one
row, repeated pages too; a leaf of the tree with as many main blocks as others
says main; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm.common import pick
from lakeloom.llm.textkernels import text_blocks

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z0-9]+")
_LINK_TAG = re.compile(r"<(/?)a(?=[\s/>])", re.I)

#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select option button".split())
#: Raw text: markup inside does not count.
OPAQUE = frozenset("script style title textarea noscript iframe template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new element of the key ends an open one of the values, up to a container.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FURNITURE = frozenset("nav footer aside menu".split())
#: Furniture too, but pages may stand in one as a whole.
WRAPPERS = frozenset("form dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words of an id or class that speak of page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners"
    " nav navbar navigation menu menus breadcrumb breadcrumbs crumbs header masthead topbar footer foot colophon bottombar copyright"
    " sidebar sidebars side aside widget widgets rail related recommended recommendations trending popular"
    " cookie cookies consent gdpr notice notices alert notification popup modal overlay newsletter subscribe subscription signup login"
    " comment comments disqus reply replies respond discussion share sharing social toolbar pagination pager tags legal disclaimer skip".split()
)
#: Words of a name that say neither: where or how something stands.
PLAIN_WORDS = frozenset(
    "site page area box block section wrap wrapper container inner outer content main body item items list links link left right top bottom primary secondary global"
    " post posts article articles story stories entry text buttons button form bar icons slot unit col column row grid fixed sticky slide js id".split()
)
#: Words that name the page's content; a heading block "header" inside an article is one of them.
CONTENT_WORDS = frozenset("article content post entry story main body text".split())


#: Words before which a name tells of an element's neighbours, not of itself.
LAYOUT_WORDS = frozenset("has have with no without hide hidden show".split())
#: Words of readers' comments, which may be most of a page.
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond discussion".split())


class Name(NamedTuple):
    """What the name that speaks most of furniture says of a block: ordered from the weakest evidence."""

    strength: float = 0.0  # 0 if the element holds the page's main text
    comments: bool = False
    share: float = 0.0  # of the page's words outside links that stand in the element
    holds: bool = False


class Block(NamedTuple):
    text: str
    words: int
    linked: int  # words inside links
    article: bool
    furniture: bool  # by tag or role
    heading: bool
    depth: int
    name: Name = Name()
    beside: bool = False
    before_title: bool = False


class Element:
    """An element with a name that speaks of furniture, or an article or main element."""

    def __init__(self, parent: int, tag: str, strength: float, comments: bool):
        self.parent, self.tag, self.strength, self.comments = parent, tag, strength, comments
        self.words = 0  # outside links and furniture by tag or role
        self.title = False  # holds an h1


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _speaks(name: str) -> tuple[float, set[str]]:
    """The share of one id's or class's words that speak of furniture, and these words."""
    words = _NAME.findall(name.replace("_", " ").replace("-", " "))
    found = {w for i, w in enumerate(words) if w in FURNITURE_WORDS and not (i and any(x in LAYOUT_WORDS for x in words[:i]))}
    # Page builders call every part a widget: "elementor-widget-text-editor".
    if not (words[:1] and words[0] in ("widget", "widgets")):
        found -= {"widget", "widgets"}
    said = [w for w in words if w not in PLAIN_WORDS and not w.isdigit()]
    return (sum(w in found for w in said) / len(said) if found else 0.0), found


def _kind(tag: str, raw: str, in_article: bool) -> tuple[bool, bool, float, bool, bool]:
    """Whether an element is an article, is furniture by its tag or role, how much its names speak of furniture, whether of comments, whether it is hidden."""
    own = _attributes(raw) if raw else {}
    role = own.get("role", "").lower()
    names = f"{own.get('id', '')} {own.get('class', '')}".lower()
    words = set(_NAME.findall(names.replace("_", " ").replace("-", " ")))
    hidden = "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")) is not None
    furniture = tag in FURNITURE or (tag == "header" and not in_article) or role in ROLES
    strength, named = max(map(_speaks, names.split()), key=lambda x: x[0], default=(0.0, set())) if words & FURNITURE_WORDS else (0.0, set())
    if words & CONTENT_WORDS and named <= {"header", "side", "text"}:
        # "post-header" in an article is its title, "article-comments" are still comments.
        strength, named = 0.0, set()
    if tag in WRAPPERS:
        strength = 1.0
    if tag in ("article", "main", "body", "html") and not role:
        furniture = False
        if tag != "article" or not named & COMMENT_WORDS:
            strength, named = 0.0, set()
    return tag in ("article", "main") or role in ("article", "main"), furniture, strength, bool(named & COMMENT_WORDS), hidden


def _settle(blocks: list[Block], places: list[tuple[int, str]], elements: list[Element]) -> list[Block]:
    """The blocks, with what the elements around them (``places``: the innermost one, and the block's heading tag) say of the page as a whole."""
    for b, (at, heading) in zip(blocks, places):
        if not b.furniture and at >= 0:
            elements[at].words += b.words - b.linked
            elements[at].title |= heading == "h1"
    total = sum(b.words - b.linked for b in blocks if not b.furniture)
    for e in reversed(elements):  # parents come before their children
        if e.parent >= 0:
            elements[e.parent].words += e.words
            elements[e.parent].title |= e.title
    largest = {}
    for kind in ("main", "article"):
        mine = [i for i, e in enumerate(elements) if e.tag == kind and not e.comments and e.words]
        if mine:
            largest[kind] = max(mine, key=lambda i: elements[i].words)
    if len(largest) == 2:
        main, article = largest["main"], largest["article"]
        at = elements[article].parent
        while at >= 0 and at != main:
            at = elements[at].parent
        if at < 0 and 2 * elements[article].words < elements[main].words:  # a teaser outside the main element
            del largest["article"]
    holds = set()
    for i in largest.values():
        at = elements[i].parent
        while at >= 0:
            e = elements[at]
            # A list of teasers holds an article too, but more of the others.
            if elements[i].tag == "main" or e.title or (2 * elements[i].words >= e.words and 10 * elements[i].words >= total):
                holds.add(at)
            at = e.parent
    within: list[bool] = []
    names: list[Name] = []
    for i, e in enumerate(elements):
        within.append(i in largest.values() or (e.parent >= 0 and within[e.parent]))
        most = 2 * e.words > total and (within[i] or not largest)
        wrapper = (i in holds or most) and (not e.comments or e.title)
        own = Name(0.0 if wrapper else e.strength, e.comments and not wrapper, e.words / total if total and e.strength else 0.0, wrapper and e.strength > 0)
        names.append(max(own, names[e.parent]) if e.parent >= 0 else own)
    of = [names[at] if at >= 0 else Name() for at, _ in places]
    plain = [not b.furniture and n.strength < 1 for b, n in zip(blocks, of)]
    total = sum(b.words - b.linked for b, t in zip(blocks, plain) if t)
    most = any(2 * elements[i].words > total and names[i].strength < 1 for i in largest.values())
    title = next((i for i, (b, (_, heading)) in enumerate(zip(blocks, places)) if heading == "h1" and not b.furniture), 0)
    return [b._replace(name=n, beside=most and not (at >= 0 and within[at]), before_title=i < title) for i, (b, n, (at, _)) in enumerate(zip(blocks, of, places))]


class State(NamedTuple):
    """What holds inside an open element."""

    tag: str
    article: bool
    furniture: bool
    dropped: bool
    heading: str
    element: int  # index of the innermost Element, or -1


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    places: list[tuple[int, str]] = []
    elements: list[Element] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[State] = []
    outside = State("", False, False, False, "", -1)
    now = outside
    link = unclosed = False

    def flush() -> None:
        nonlocal link, unclosed
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            words = text.count(" ") + 1
            out.append(Block(text, words, min(words, len("".join(linked).split())), now.article, now.furniture, now.heading != "", len(block_at)))
            places.append((now.element, now.heading))
        parts.clear()
        linked.clear()
        if unclosed:
            link = unclosed = False

    # Of the open elements: how many of each block tag, where the blocks stand in the
    # stack, and the inline tags open inside each block; an end tag that ends nothing
    # costs one look.
    open_blocks: Counter[str] = Counter()
    block_at: list[int] = []
    inline: list[Counter[str]] = [Counter()]

    def push(state: State) -> None:
        nonlocal now
        if state.tag in BLOCK:
            open_blocks[state.tag] += 1
            block_at.append(len(stack))
            inline.append(Counter())
        else:
            inline[-1][state.tag] += 1
        stack.append(state)
        now = state

    def pop_to(size: int) -> None:
        nonlocal now
        while len(stack) > size:
            tag = stack.pop().tag
            if tag in BLOCK:
                open_blocks[tag] -= 1
                block_at.pop()
                inline.pop()
            else:
                inline[-1][tag] -= 1
        now = stack[-1] if stack else outside

    def end_implied(tag: str) -> None:
        """End the open paragraph, and the open item or cell that a new one ends, with all inline elements in them."""
        if block_at and (stack[block_at[-1]].tag == "p" or stack[block_at[-1]].tag in CLOSES.get(tag, ())):
            pop_to(block_at[-1])
            if tag == "tr" and stack and stack[-1].tag == "tr":
                pop_to(len(stack) - 1)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece and not now.dropped:
            parts.append(piece)
            if link:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "br":
            parts.append(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif closing:
            if tag == "a":
                link = unclosed = False
            if tag in BLOCK and open_blocks[tag]:
                flush()
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            elif tag not in BLOCK and inline[-1][tag]:
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            elif tag == "p":
                flush()
        else:
            if tag in OPAQUE:
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else end
                continue
            if tag in BLOCK:
                flush()
                end_implied(tag)
            if tag == "a":
                link = "href" in _attributes(m[3])
                following = _LINK_TAG.search(page, at)
                unclosed = link and not (following and following[1])
            is_article, is_furniture, strength, comments, hidden = _kind(tag, m[3], now.article)
            element = now.element
            if (is_article or strength) and not now.furniture:
                role = "main" if tag == "main" or (is_article and "main" in _attributes(m[3]).get("role", "").lower()) else "article" if is_article else tag
                elements.append(Element(element, role, strength, comments))
                element = len(elements) - 1
            heading = now.heading or (tag if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else "")
            state = State(tag, now.article or is_article, now.furniture or is_furniture, now.dropped or hidden or tag in RAW, heading, element)
            if not m[3].endswith("/") or tag in BLOCK:
                push(state)
    flush()
    return _settle(out, places, elements)


FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "article", "heading", "depth", "place", "name", "name_share", "comments", "holds", "beside", "before_title",
)

#: Small labelled table: pages of the common layouts, made by hand.  ``{n}`` stands for n words, and each
#: block of main text begins with the mark.  The blocks' features are those the parser finds.
MARK = "\u00a7"
_MENU = "<a href='/'>{1}</a></li><li><a href='/'>{2}</a></li><li><a href='/'>{1}</a></li>"
LABELLED_PAGES = (
    # an article element, everything else marked
    f"<nav><ul><li>{_MENU}</ul></nav><div class='ad'>{{6}}</div><article><h1>§{{9}}</h1><p>§{{60}}</p><p>§{{35}}</p><p>§{{8}}</p></article><footer>{{14}}</footer>",
    "<header><a href='/'>{2}</a></header><article><h1>§{5}</h1><p>§{20}</p><ul><li>§{2}</li><li>§{3}</li><li>§{1}</li></ul><h2>§{2}</h2><p>§{4}</p><div class='ad'>{9}</div><p>§{30}</p></article><aside><p>{25}</p></aside>",
    "<article><h1>§{7}</h1><p>§{15} <a href='/'>{6}</a></p><p>§{1}</p><ul><li><a href='/'>§{3}</a></li><li><a href='/'>§{4}</a></li></ul></article><section id='comments'><p>{30}</p><p>{45}</p><p>{3}</p></section>",
    "<main><h1>§{6}</h1><p>§{12}</p><figure><figcaption>§{7}</figcaption></figure><pre>§{2}</pre><p>§{50}</p><form><label>{2}</label><p>{12}</p></form></main><footer><p>{8}</p></footer>",
    "<article><h1>§{6}</h1><p><a href='/'>§{3}</a></p><p>§{40}</p><h2>§{2}</h2><p><a href='/'>§{5}</a></p><p>§{30}</p><p>§{4}</p><p><a href='/'>§{6}</a></p></article>",
    "<article><h1>§{4}</h1><p>§{25}</p><p><a href='/'>§{3}</a></p><p>§{5}</p><p><a href='/'>§{2}</a></p><h2>§{1}</h2><ul><li><a href='/'>§{3}</a></li><li>§{2}</li><li><a href='/'>§{4}</a></li></ul></article>",
    # no article element; menus and notes unmarked, told by their neighbours and links
    f"<div><ul><li>{_MENU}</ul></div><div>{{2}}</div><div><ul><li>{_MENU}</ul></div><h1>§{{6}}</h1><p>§{{45}}</p><p>§{{30}}</p><p>§{{9}}</p><p>§{{40}}</p><div><a href='/'>{{2}}</a></div><div>{{3}}</div><div><a href='/'>{{3}}</a></div>",
    "<div><a href='/'>{1}</a></div><div><a href='/'>{2}</a></div><div>{1}</div><div><a href='/'>{1}</a></div><h1>§{4}</h1><div>§{25}</div><div>§{18}</div><div>§{22} <a href='/'>{6}</a></div><div><a href='/'>{2}</a></div><div>{4}</div><div><a href='/'>{2}</a></div>",
    "<table><tr><td><a href='/'>{2}</a></td><td><a href='/'>{1}</a></td><td><a href='/'>{3}</a></td></tr><tr><td><p>§{28}</p><p>§{33}</p><p>§{14}</p><p>§{6}</p><p>§{41}</p></td></tr><tr><td><a href='/'>{2}</a></td><td>{2}</td><td><a href='/'>{1}</a></td></tr></table>",
    "<div id='menu'><a href='/'>{1}</a></div><div class='cookie-banner'><p>{22}</p><a href='/'>{1}</a></div><h1>§{8}</h1><p>§{38}</p><h2>§{3}</h2><p>§{26}</p><p>§{5}</p><p>§{31}</p><div class='newsletter'><h3>{3}</h3><p>{18}</p></div><div class='footer'>{9}</div>",
    "<h1>§{5}</h1><p>§{40}</p><p>§{10}</p><div><a href='/'>{2}</a></div><div>{1}</div><div><a href='/'>{1}</a></div>",
    "<div><a href='/'>{2}</a></div><div>{3}</div><div><a href='/'>{1}</a></div><p>§{35}</p><p>§{50}</p><p>§{6}</p><ul><li><a href='/'>{3}</a></li><li><a href='/'>{2}</a></li></ul>",
    "<div><a href='/'>{4}</a></div><div>{2}</div><div><a href='/'>{5}</a></div><div>{3}</div><div><a href='/'>{3}</a></div><p>§{60}</p><p>§{45}</p>",
    "<p>§{30}</p><p>§{3}</p><p><a href='/'>{4}</a></p><p>{2}</p><p><a href='/'>{4}</a></p>",
    # links in running text, and lists of links
    "<div><p>§{20} <a href='/'>{4}</a></p><p>§{10} <a href='/'>{7}</a> {8}</p><p>§{24}</p><p>§{9} <a href='/'>{3}</a> {12}</p></div><div><a href='/'>{4}</a> {1}</div><div><a href='/'>{6}</a> {1}</div><div><a href='/'>{5}</a></div>",
    "<h2>{1}</h2><ul><li><a href='/'>{4}</a></li><li><a href='/'>{6}</a></li><li><a href='/'>{5}</a></li></ul><p>§{55}</p><p>§{48}</p><h3><a href='/'>{3}</a></h3><ul><li><a href='/'>{7}</a></li><li><a href='/'>{2}</a></li></ul>",
    # teasers and notes beside an article that holds most of the words
    "<div><p>{12}</p></div><main><h1>§{6}</h1><p>§{90}</p><p>§{75}</p><p>§{7}</p></main><div><h3>{4}</h3><p>{25}</p></div><div><article><h3>{5}</h3><p>{20}</p></article><article><p>{16}</p></article></div><p>{6}</p>",
    "<div>{5}</div><article><h1>§{4}</h1><p>§{120}</p></article><p>{30}</p><div><article><p>{18}</p></article></div><div>{8} <a href='/'>{4}</a></div>",
    # little text
    "<p>§{14}</p>",
    "<div>§{4}</div><p>§{9}</p><p>§{3}</p>",
    "<h1>§{5}</h1><p>§{7}</p><p>§{2}</p>",
    "<article>§{2}</article>",
    "<div><p>§{80}</p></div><div class='share'>{2}</div><div class='related'><h3>{2}</h3><p>{15}</p><p>{11}</p></div>",
    "<p><a href='/'>{5}</a></p><p>§{30}</p><p>§{2}</p><p>§{26}</p><p><a href='/'>{2}</a></p>",
    # names that share a word with furniture, around main text; and furniture of such names beside it
    "<article><h1>§{6}</h1><p>§{40}</p><section class='popular-science'><h2>§{3}</h2><p>§{50}</p><p>§{4}</p></section><div class='share-buttons'>{3}</div></article>",
    "<article><h1>§{5}</h1><p>§{20}</p><div class='legal-analysis'><p>§{30}</p><p>§{7}</p></div><div class='legal-notice'><p>{20}</p></div><div class='popular-posts'><p>{6}</p></div></article>",
    "<article><h1>§{9}</h1><div class='share-holders-meeting'><p>§{50}</p><p>§{12}</p><ul><li>§{2}</li><li>§{4}</li></ul></div><p>§{25}</p><div class='share'>{4}</div></article>",
    "<main><h1>§{4}</h1><div id='side-effects'><p>§{35}</p><p>§{3}</p></div><div class='alert-systems'><p>§{18}</p></div><div class='side-box'><p>{12}</p></div></main><div class='footer-note'>{9}</div>",
    "<div class='entry'><h1>§{7}</h1><p>§{60}</p><div class='banner-history'><p>§{22}</p><p>§{31}</p></div><p>§{40}</p></div><div class='banner-large'><p>{8}</p></div><div class='comment-7'><p>{28}</p></div>",
    "<div class='story'><h1>§{3}</h1><p>§{35}</p><p>§{44}</p><div class='social-policy'><p>§{38}</p></div></div><div class='social-follow'>{3}</div><div class='newsletter-offer'><p>{15}</p></div><div class='reader-comments'><p>{40}</p><p>{6}</p></div>",
    # lines and lists before the title, without a name
    "<div>{2}</div><h1>§{6}</h1><p>§{50}</p><p>§{31}</p><p>§{4}</p>",
    "<p>{3}</p><p>{5}</p><h1>§{4}</h1><p>§{28}</p><p>§{22}</p><div>{2} <a href='/'>{2}</a></div>",
    "<div>{2}</div><div>{12}</div><div><h1>§{8}</h1></div><div>§{33}</div><div>§{5}</div><div>§{41}</div><div>§{19}</div>",
    "<div>{1}</div><article><h1>§{5}</h1><p>§{34}</p><p>§{3}</p><p>§{3}</p><p>§{28}</p></article><div>{6}</div>",
    # no title
    "<article><p>§{30}</p><p>§{3}</p><div class='recommended'><p>{14}</p></div><p>§{40}</p></article><div class='tags'>{4}</div>",
    "<main><p>§{4}</p><p>§{44}</p><div class='pager'>{2}</div></main><nav><p>{6}</p></nav>",
)


def labelled_rows() -> list[tuple]:
    """The features of each block of the labelled pages, then 1 for main text.

    Each page stands alone and in two elements more, so depth alone tells nothing.
    """
    rows = []
    for page in (before + page + after for before, after in (("", ""), ("<div><div>", "</div></div>")) for page in LABELLED_PAGES):
        blocks = blocks_of(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page.replace("§", MARK)))
        rows += [(*f, int(b.text.startswith(MARK))) for b, f in zip(blocks, features_of(blocks))]
    return rows


def fitted() -> Node:
    return grow(labelled_rows())


class Node(NamedTuple):
    feature: int  # -1 at a leaf
    cut: float
    low: object
    high: object
    share: float  # of main text among the table's rows that came here


def grow(rows, depth: int = 8, least: int = 2) -> Node:
    """A binary tree by Gini impurity; the first best split counts."""
    share = sum(r[-1] for r in rows) / len(rows)
    gini = lambda part: (lambda p: len(part) * p * (1 - p))(sum(r[-1] for r in part) / len(part))
    best = (gini(rows), None)
    if depth and 0 < share < 1:
        for f in range(len(FEATURES)):
            values = sorted({r[f] for r in rows})
            for a, b in zip(values, values[1:]):
                low, high = [r for r in rows if r[f] <= (a + b) / 2], [r for r in rows if r[f] > (a + b) / 2]
                if min(len(low), len(high)) >= least and (score := gini(low) + gini(high)) < best[0] - 1e-12:
                    best = (score, (f, (a + b) / 2, low, high))
    if best[1] is None:
        return Node(-1, 0.0, None, None, share)
    f, cut, low, high = best[1]
    return Node(f, cut, grow(low, depth - 1, least), grow(high, depth - 1, least), share)


def is_main(tree: Node, features: tuple) -> bool:
    while tree.feature >= 0:
        tree = tree.low if features[tree.feature] <= tree.cut else tree.high
    return tree.share >= 0.5


def features_of(blocks: list[Block]) -> list[tuple]:
    """Features of each block; beyond the ends stand blocks without words."""
    size = [(b.words, b.linked / b.words) for b in blocks]
    padded = [(0, 0.0), *size, (0, 0.0)]
    around = lambda i, b: (int(b.article), int(b.heading), b.depth, i / len(blocks), max(b.name.strength, float(b.furniture)), b.name.share, int(b.name.comments), int(b.name.holds), int(b.beside), int(b.before_title))
    return [(*padded[i + 1], *padded[i], *padded[i + 2], *around(i, b)) for i, b in enumerate(blocks)]


def main_text(page: str | None, tree: Node) -> str:
    """The main text blocks, joined by an empty line."""
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, f in zip(blocks, features_of(blocks)) if is_main(tree, f))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = fitted()
        for batch in batches:
            for block in text_blocks(batch, "html"):
                texts = [main_text(page, tree) for page in block.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pick(pages, "page_id", "url", "html").selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
