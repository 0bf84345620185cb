"""Main text of HTML pages by tree scoring.

A tolerant tokenizer builds the tree of block elements. Each paragraph earns
points for its length and its commas and passes them to the containers around it
(all to the first, half to the second, a third to the third, and so on; lists,
tables and their parts are no containers), and each element's sum is discounted
by the share of its text that lies in links. The best element and its good
siblings are kept: of an ``article`` or ``main`` others of its kind, elsewhere
whatever stands beside it and is not links. Where that is a fifth of its text or
more, at its own level or beside a parent, the choice is lifted to the parent.

Menus, page headers, footers, sidebars, notices, adverts, forms and comments are
left out wherever the tag, role, class or id names them. What a tag, a role or
``hidden`` names is never read. A class or id lowers the points of the block that
it names, and counts when the choice is made: it leaves out no element that has a
wanted name too, holds the article, or is a layout's wrapper with more than half
of the text, and nothing at all where otherwise no text, or headings only, would
be left. A name counts as a whole: all its parts must be known ones ("related-posts",
not "social-history"), and names of inline elements never count. Comments without
such a name are known by their heading, if they end the article.

Defined results: a null or empty page, or one without text, gives "". Character
references are decoded once; white space inside a block becomes one space; blocks
are joined in page order by one line feed. Unclosed and stray tags, cut pages
and raw ``<`` characters are read the way browsers do. Ties go to the element
that begins first. Very long pages are read whole.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

OUTPUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Elements that hold text for the container around them.
INNER = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption table ul ol dl figure figcaption".split())

# The tags of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp svg math".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol option p pre search section select summary
    table tbody td tfoot th thead tr ul""".split()
)
LEFT_OUT = frozenset("nav aside footer form menu dialog select button datalist object audio video canvas head search".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
P_SCOPE = frozenset("html body article section div td th li table blockquote main aside footer header nav form button".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
UNWANTED = frozenset(
    """ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner
    nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidenav aside rail footer foot header masthead topbar
    cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login
    share sharing social follow comment comments commentlist reply replies respond disqus discussion related
    recommended recommendations widget widgets pager pagination toolbar skip search paywall disclaimer copyright""".split()
)
#: Parts of names that say where or how, and so take nothing from an unwanted part beside them.
NEUTRAL = frozenset(
    """site page main box list lists wrap wrapper container area block section inner outer left right top bottom center
    item items link links post posts article articles story stories bar panel col column row group global primary secondary
    mobile desktop sticky fixed small large big text title heading form button buttons icons thread count new wp js the""".split()
)
#: Headings of readers' comments.
COMMENTS = re.compile(r"(?:\d+\s+)?(?:(?:reader|user)s?'?\s+)?(?:comments?|replies|responses)(?:\s*\(\d+\)|\s+\d+)?|leave a (?:reply|comment)|post a comment", re.I)
#: Names that also stand on wrappers of a whole page.
LAYOUT = frozenset("nav navbar navigation menu menus sidebar sidenav aside rail footer foot header masthead topbar banner widget widgets toolbar search overlay modal".split())
#: Parts of names that tell a state ("no-sidebar", "has-menu"), not what an element is.
STATES = frozenset("no not has with without hide".split())
#: Points of text in an element with an unwanted name.
WEAK = 0.25
#: Longer text beside headings shows that names alone had left the article out.
ONLY_NAMED = 200
#: Where a choice ends that is lifted to the parent.
TOP = frozenset(["#document", "html", "body"])
#: Share of links from which what stands beside the article is no text, and share of its text that lifts the choice.
MOST_LINKS, LEAST_PART = 0.3, 0.2
HEADERS = frozenset("header masthead banner".split())
WANTED = frozenset("article content post entry story main body text".split())

TAG = re.compile(
    r"""<(?:!--(?:.*?--!?>|.*)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|["'])*+)>?)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?=[\s=/"']|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
HEADING = re.compile("h[1-6]")
COMMAS = re.compile("[,،、，;]")


def judged(tag: str, attributes: str, in_article: bool) -> tuple[bool, int, float]:
    """(left out, named, bonus) of an element by its tag and attributes; named is 1 beside a wanted name, 2 for layout names, 3 for other unwanted ones."""
    if tag in LEFT_OUT or (tag == "header" and not in_article):
        return True, 0, 0
    bonus = 25.0 if tag in ("article", "main") else -5.0 if tag in ("ul", "ol", "table", "li") else 0.0
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False, 0, bonus
    parts: set[str] = set()
    wanted = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, 0, 0
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, 0, 0
        elif name == "role":
            if value.lower() in ROLES:
                return True, 0, 0
            bonus += 25 * (value.lower() in ("main", "article"))
        else:
            for word in value.split():
                said = {x.lower() for x in NAME_PART.findall(word)}
                wanted |= bool(said & WANTED) and not said & STATES
                if said <= UNWANTED | NEUTRAL:
                    parts |= said & UNWANTED
    if tag in ("html", "body", "article", "main"):
        return False, 0, bonus + 25 * wanted
    named = parts - HEADERS if in_article else parts
    if not named:
        return False, 0, bonus + 25 * wanted
    return False, 1 if wanted else 2 if named <= LAYOUT else 3, bonus


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    texts, plain = read(page, True)
    if not plain:
        again, _ = read(page, False)
        if not texts or sum(map(len, again)) - sum(map(len, texts)) >= ONLY_NAMED:
            texts = again
    return "\n".join(texts)


def read(page: str, by_name: bool) -> tuple[list[str], bool]:
    """The blocks of the main text, and whether any is no heading; classes and ids leave things out only ``by_name``."""
    # Elements: parent, tag, bonus, left out, named. Element 0 is the document.
    parent, tags, bonus, out, named = [-1], ["#document"], [0.0], [False], [0]
    stack, at = [0], 0  # open elements; the innermost block of them is ``at``
    inline: list[tuple[str, int]] = []  # open inline elements with the stack depth they opened at
    blocks: list[tuple[int, str, int]] = []  # (element, text, characters in links)
    buffer: list[str] = []
    linked = 0
    in_link = hidden = in_article = 0
    hidden_inline: list[int] = []  # how many inline elements were open with each that is left out

    def flush() -> None:
        nonlocal buffer, linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                blocks.append((stack[-1], text, min(linked, len(text))))
            buffer, linked = [], 0

    def pop_to(depth: int) -> None:
        nonlocal hidden, in_article, in_link
        flush()
        while len(stack) > depth:
            gone = stack.pop()
            hidden -= out[gone]
            in_article -= tags[gone] in ("article", "main")
        while inline and inline[-1][1] > depth:
            name, _ = inline.pop()
            if name == "a":
                in_link -= 1
            if hidden_inline and hidden_inline[-1] > len(inline):
                hidden_inline.pop()
                hidden -= 1

    pos, end = 0, len(page)
    find = TAG.search
    while pos < end:
        m = find(page, pos)
        start = m.start() if m else end
        if start > pos and not hidden:
            text = page[pos:start]
            if "&" in text:
                text = entities.unescape(text)
            buffer.append(text)
            if in_link:
                linked += len(text.strip())
        if not m:
            break
        pos = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK:
                depth = len(stack) - 1
                while depth > 0 and tags[stack[depth]] != name:
                    if name in ("p", "li", "dd", "dt") and tags[stack[depth]] in P_SCOPE:
                        depth = 0
                        break
                    depth -= 1
                if depth > 0:
                    pop_to(depth)
                elif name == "p":
                    flush()
            else:
                for i in range(len(inline) - 1, -1, -1):
                    if inline[i][1] < len(stack):
                        break
                    if inline[i][0] == name:
                        del inline[i]
                        in_link -= name == "a"
                        if hidden_inline and hidden_inline[-1] > len(inline):
                            hidden_inline.pop()
                            hidden -= 1
                        break
            continue
        if name in RAW:
            if m[3].rstrip().endswith("/") and name in ("svg", "math"):
                continue
            close = RAW_END[name].search(page, pos)
            if close is None:
                pos = end
            else:
                gt = page.find(">", close.end())
                pos = end if gt < 0 else gt + 1
            continue
        if name == "br" or name == "hr":
            if name == "hr":
                flush()
            else:
                buffer.append(" ")
            continue
        if name in VOID:
            continue
        if name in BLOCK:
            if name in CLOSES:
                closing, scope = CLOSES[name]
                depth = len(stack) - 1
                found = 0
                while depth > 0 and tags[stack[depth]] not in scope:
                    if tags[stack[depth]] in closing:
                        found = depth
                    depth -= 1
                if found:
                    pop_to(found)
            else:
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] == "p":
                        pop_to(depth)
                        break
                    if tags[stack[depth]] in P_SCOPE:
                        break
            flush()
            gone, called, extra = judged(name, m[3], in_article > 0)
            parent.append(stack[-1])
            tags.append(name)
            bonus.append(extra)
            out.append(gone)
            named.append(called if by_name else 0)
            stack.append(len(tags) - 1)
            hidden += gone
            in_article += name in ("article", "main")
        else:
            gone = bool(m[3] or name in LEFT_OUT) and judged(name, m[3], in_article > 0)[0]
            inline.append((name, len(stack)))
            if name == "a":
                in_link += 1
            if gone:
                hidden += 1
                hidden_inline.append(len(inline))
    flush()
    if not blocks:
        return [], False
    kept = without_comments(chosen(parent, tags, bonus, named, blocks), parent, tags)
    return [text for _, text, _ in kept], any(not HEADING.fullmatch(tags[element]) for element, _, _ in kept)


def without_comments(kept: list[tuple[int, str, int]], parent: list[int], tags: list[str]) -> list[tuple[int, str, int]]:
    """The blocks before the comments: those under a comments' heading that no like or higher heading follows.

    They go up to the end of the element that the heading stands in; what follows
    that element stays.
    """
    for at, (element, text, _) in enumerate(kept):
        if not at or not HEADING.fullmatch(tags[element]) or not COMMENTS.fullmatch(text.strip(" :")):
            continue
        around, last = parent[element], at + 1
        while last < len(kept) and inside(kept[last][0], around, parent):
            last += 1
        if not any(HEADING.fullmatch(tags[e]) and tags[e] <= tags[element] for e, _, _ in kept[at + 1 : last]):
            return kept[:at] + kept[last:]
    return kept


def inside(element: int, around: int, parent: list[int]) -> bool:
    while element > around:
        element = parent[element]
    return element == around


def chosen(parent: list[int], tags: list[str], bonus: list[float], named: list[int], blocks: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The blocks in the best element and its good siblings."""
    n = len(parent)
    points, chars, links = [0.0] * n, [0] * n, [0] * n
    for element, text, linked in blocks:
        chars[element] += len(text)
        links[element] += linked
    holds = [tag in ("article", "main") for tag in tags]
    for i in range(n - 1, 0, -1):  # children come after their parents
        chars[parent[i]] += chars[i]
        links[parent[i]] += links[i]
        if holds[i] and chars[i]:
            holds[parent[i]] = True
    half = (chars[0] - links[0]) / 2
    named = [0 if name < 3 and chars[i] - links[i] > half else name for i, name in enumerate(named)]
    weak = [False] * n
    for i in range(1, n):
        weak[i] = weak[parent[i]] or named[i] > 0
    for element, text, _ in blocks:
        # Text directly in a container counts as a paragraph of it.
        own = 1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)
        if weak[element]:
            own *= WEAK
        up = element
        share = 1
        while up >= 0:
            if tags[up] not in INNER:
                points[up] += own / share
                share += 1
            up = parent[up]
    density = [links[i] / chars[i] if chars[i] else 0.0 for i in range(n)]
    score = [(points[i] + (bonus[i] * (WEAK if weak[i] else 1) if chars[i] else 0)) * (1 - density[i]) for i in range(n)]
    candidates = [i for i in range(n) if points[i] > 0]
    best = max(candidates, key=lambda i: (score[i], -i))
    lifted = best
    while lifted >= 0 and tags[lifted] not in ("article", "main"):
        lifted = parent[lifted]
    in_article = lifted >= 0
    if in_article:  # an article is kept whole
        best = lifted
    else:
        best = whole(best, parent, tags, named, chars, links, density)
    # A box with an unwanted name goes, unless it holds what may be the article.
    within = [False] * n
    within[best] = True
    for i in range(best + 1, n):
        within[i] = within[parent[i]]
    has_article = tags[best] == "article" or any(within[i] and tags[i] == "article" and chars[i] and not weak[i] for i in range(n))
    goes = [named[i] > 1 and (has_article or not holds[i]) for i in range(n)]
    keep = [False] * n
    least = 0.2 * score[best]
    for i in range(1, n):
        if parent[i] == parent[best] and i != best and not goes[i]:
            keep[i] = chars[i] > 0 and density[i] < MOST_LINKS and (not in_article or tags[i] == tags[best] and score[i] >= least)
    keep[best] = True
    for i in range(1, n):
        if parent[i] >= 0 and keep[parent[i]] and i != best:
            # A list or box made of links is a menu, wherever it stands.
            keep[i] = not (goes[i] or tags[i] in ("ul", "ol", "div") and density[i] > 0.8)
    beside = -1 if in_article else parent[best]  # also text that stands directly beside the best element
    return [block for block in blocks if keep[block[0]] or block[0] == beside and block[2] < MOST_LINKS * len(block[1])]


def whole(best: int, parent: list[int], tags: list[str], named: list[int], chars: list[int], links: list[int], density: list[float]) -> int:
    """The element that holds the best one and all parts of the text that stand beside it or its parents."""
    beside: dict[int, list[int]] = {}
    for i in range(1, len(parent)):
        if chars[i] and density[i] < MOST_LINKS and named[i] < 2:
            beside.setdefault(parent[i], []).append(i)
    top = at = best
    while parent[at] >= 0 and tags[at] not in TOP:
        up = parent[at]
        least = LEAST_PART * (chars[at] - links[at])
        if chars[up] == chars[at] or sum(chars[i] - links[i] for i in beside.get(up, []) if i != at) >= max(1, least):
            # Of a page's top, the good children are kept and not all.
            top = at if tags[up] in TOP else up
        at = up
    return top


def extract_pages(pages: DataFrame) -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points) to rows that have ``html``."""

    def compute(htmls: list[str | None]) -> list[list]:
        texts = [extract(h) for h in htmls]
        return [texts, [len(t) for t in texts]]

    return add_columns(pages, ["html"], OUTPUT, compute)
