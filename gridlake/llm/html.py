"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A linear classifier gives each block a balance: what calling it boilerplate costs (if it
looks like content) or calling it content (if it looks like boilerplate); these are the capacities from the source and
to the sink. Neighbouring blocks are joined by smoothness edges, stronger the closer they are in the document tree. The
minimum cut, found by maximum flow, separates content (source side) from boilerplate.

The classifier looks at a block's words (an item of a list or table counts with the whole list), share of link text,
heading, marks of a legal line, and at the elements around it. All of its evidence is finite and calibrated against the
edges: a one-word paragraph, or one that is all link, is boilerplate by itself and content among paragraphs of prose,
and a long line between the links of a menu goes with the menu. Elements such as nav and footer, and class and id names
that are words for boilerplate, weigh more than any prose; a vaguer name (related-work, has-sidebar) weighs less than
prose. Where nearly all of a page's prose stands inside elements of such names, or of a form, these are
wrappers, and their weight falls with their share of the page's text; and words that layouts use for anything (widget,
posts) weigh the less the more of the page's prose stands in elements of that name, so that prose can outweigh them.
Reader comments without a telling name are known by their head (`12 responses`, or `Comments` over entries that repeat
with a date or a reply link): what follows it under the same parent counts as named. Only what is never shown as text (controls, hidden
elements, raw elements) is left out before.

Defined results: null or empty html, or a page without content, gives the empty text; null ids and urls are kept;
repeated rows get equal results; other columns are ignored; broken markup is read as browsers do where it matters
(unclosed elements, stray ends, raw text in script and style). Time grows in proportion to the page, however deep.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More than all else together: for what is never shown as text.
HARD = 10_000
#: Balance of a block: words that count at most, words that make it neutral, and what else speaks for or against content.
WORDS, NEUTRAL, IN_MAIN, IN_GOOD, HEADING = 40, 10, 8, 6, 8
LINKED, LEGAL, ITEM = 28, 24, 6
#: Weight of an element or clear name for boilerplate, and of a vague name (times the square of such words' share in it).
BOILERPLATE, MIXED = 160, 64
#: Prose outside all such elements (words in blocks of NEUTRAL words or more) that shows that they aren't wrappers.
PROSE = 30
#: Edges: of next neighbours by closeness in the tree, what siblings get besides, and the divisor where the evidence around two blocks differs.
EDGE, SIBLING, CONTRAST = 24, 14, 8
#: Elements that are never shown as text.
DROP = frozenset("button select textarea iframe noscript template svg canvas object audio video head title option datalist".split())
#: Elements for boilerplate, and those that may also wrap a whole page.
SIDE = frozenset("nav footer aside menu dialog".split())
FORM = frozenset(("form", "fieldset"))
LISTS = frozenset("ul ol dl table".split())
ITEMS = frozenset("li dt dd td th".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
MAIN = frozenset(("article", "main"))
#: Words in class and id that name boilerplate.
BAD = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget widgets related recommended recommendations share sharing social comment comments commentlist discussion disqus reply replies respond "
    "footer toolbar pagination pager paging login search copyright legal disclaimer skip tags tagcloud rail posts stories links teaser teasers".split())
#: Those that say little in a name with other words, and words that turn a name into one for what is around.
VAGUE = frozenset("related recommended recommendations side share sharing social notice notices alert search legal copyright disclaimer tags rail skip reply replies respond paging pager login posts stories links".split())
AROUND = frozenset("has with no without open".split())
#: Those that layouts also use for their text.
LOOSE_WORDS = frozenset("widget widgets posts stories links teaser teasers side rail banner overlay modal".split()) | VAGUE
#: Heads of reader comments: with a number, and without one over entries that have a mark of an entry.
COUNTED = re.compile(r"\(?\d+\)?\s+(?:reader\s+)?(?:responses?|comments?|replies|reply|kommentare?|antworten|commentaires?|réponses?|comentarios?|respuestas?)(?:\s+(?:to|on|zu|sur|a)\s.*)?", re.I)
BARE = re.compile(r"(?:(?:reader|user|your)\s+)?(?:comments|responses|replies|discussion|kommentare|commentaires|comentarios)(?:\s*\(\d+\))?:?", re.I)
ENTRY = re.compile(r"\b(?:says|said|wrote|ago|reply|\d{4}-\d\d?-\d\d?|\d\d?[:.]\d\d|\d\d?[./]\d\d?[./]\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? \d)", re.I)
#: Words that name a site's head; inside an article they may hold its title.
HEAD_WORDS = frozenset("header masthead topbar hero".split())
GOOD = frozenset("article content entry post story body text main prose markdown".split())
ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "form": -1, "dialog": -1, "alert": -1, "main": 1, "article": 1}

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTR = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))|(?<![\w-])(hidden)(?![\w-])", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Element:
    """One element. Filled in by weigh: cost (of its own and all around it), share of text."""

    __slots__ = ("tag", "parent", "depth", "hidden", "side", "named", "loose", "head", "main", "good", "size", "words", "prose", "inside", "cost", "list")

    def __init__(self, tag: str, attrs: str, parent: Element | None):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.size = self.words = self.prose = 0
        self.loose: dict[str, float] = {}
        self.hidden, self.main, self.side, self.head = tag in DROP, tag in MAIN, tag in SIDE, tag == "header"
        self.named = float(BOILERPLATE) if tag in FORM else 0.0
        self.good = False
        self.list = self if tag in LISTS else parent.list if parent else None
        if attrs.strip(" /\n\t"):
            for name, a, b, c, bare in _ATTR.findall(attrs):
                name, value = (name or bare).lower(), unescape(a or b or c)
                if name in ("class", "id"):
                    if tag not in ("html", "body"):  # theirs speak of the page, not of its text
                        for one in value.split():
                            self.name(one)
                elif name == "role":
                    r = ROLES.get(value.strip().lower(), 0)
                    self.side |= r < 0
                    self.main |= r > 0
                elif name == "hidden" and not value or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    self.hidden = True

    def name(self, one: str) -> None:
        words = [w.lower() for w in _WORD.findall(one)]
        if words:
            share = sum(w in BAD for w in words) / len(words)
            clear = share == 1 or (any(w in BAD and w not in VAGUE for w in words) and AROUND.isdisjoint(words))
            weight = float(BOILERPLATE) if clear else MIXED * share * share
            if weight and LOOSE_WORDS.issuperset(w for w in words if w in BAD):
                self.loose[one] = weight
            else:
                self.named = max(self.named, weight)
            self.head |= any(w in HEAD_WORDS for w in words)
            self.good |= any(w in GOOD for w in words)


class Block:
    __slots__ = ("text", "link", "at", "words")

    def __init__(self, text: str, link: int, at: Element | None):
        self.text, self.link, self.at, self.words = text, link, at, text.count(" ") + 1


def blocks(html: str) -> tuple[list[Block], list[Element]]:
    """Text blocks in page order, each with the element it stands in, and all elements, outer ones first."""
    out: list[Block] = []
    made: list[Element] = []
    path: list[Element] = []
    is_open: dict[str, int] = {}
    parts: list[str] = []
    link_chars = links = 0
    at = 0

    def text(piece: str) -> None:
        nonlocal link_chars
        if piece:
            parts.append(unescape(piece) if "&" in piece else piece)
            if links:
                link_chars += len(piece.strip())

    def flush() -> None:
        nonlocal link_chars
        if parts:
            t = " ".join("".join(parts).split())
            if t:
                out.append(Block(t, link_chars, path[-1] if path else None))
            parts.clear()
        link_chars = 0

    def close(tags, stop=()) -> None:
        if not any(is_open.get(t) for t in tags):
            return
        for k in range(len(path) - 1, -1, -1):
            if path[k].tag in tags:
                for x in path[k:]:
                    is_open[x.tag] -= 1
                del path[k:]
                return
            if path[k].tag in stop:
                return

    while True:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        m = _MARK.match(html, lt) or _LOOSE.match(html, lt)
        if not m:
            # a bare < is text, and so is an end cut off in a tag's middle unless it looks like a tag
            if re.match(r"</?[a-zA-Z!]", html[lt : lt + 3]) and ">" not in html[lt:]:
                text(html[at:lt])
                break
            text(html[at : lt + 1])
            at = lt + 1
            continue
        text(html[at:lt])
        at = m.end()
        if m.lastindex is None or not m.group(2):
            continue
        tag, end = m.group(2).lower(), m.group(1)
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in INLINE or "-" in tag:
            if tag == "a":
                links = max(0, links - 1) if end else 1
            continue
        if tag in RAW and not end:
            flush() if tag not in ("script", "style") else None
            stop = re.compile(rf"</{tag}\b", re.I).search(html, at)
            at = html.find(">", stop.end()) + 1 if stop else 0
            at = at or len(html)
            continue
        flush()
        if end:
            if tag == "p":
                close(("p",), ("article", "section", "div", "body"))
            else:
                close((tag,))
            links = 0
            continue
        if tag in CLOSES_P:
            close(("p",), ("article", "section", "div", "td", "li", "blockquote", "body"))
        if tag == "li":
            close(("li",), ("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            close(("dt", "dd"), ("dl",))
        elif tag in ("td", "th"):
            close(("td", "th"), ("tr", "table"))
        elif tag == "tr":
            close(("tr",), ("table",))
        elif tag == "option":
            close(("option",), ("select",))
        elif tag == "body":
            close(("head",))
        e = Element(tag, m.group(3), path[-1] if path else None)
        path.append(e)
        made.append(e)
        is_open[tag] = is_open.get(tag, 0) + 1
    flush()
    return out, made


def weigh(found: list[Block], made: list[Element]) -> None:
    """Sets each element's cost, from its own evidence and that of all around it."""
    name_comments(found, made)
    holds_main = set()
    for x in reversed(made):  # what holds an article is no page head
        if x.parent and (x.main or x in holds_main):
            holds_main.add(x.parent)
    clean: dict[Element | None, bool] = {None: True}
    for x in made:
        up = x.parent
        x.hidden |= bool(up and up.hidden)
        x.inside = x.main or bool(up and up.inside)
        x.good |= bool(up and up.good)
        x.head &= not x.inside and x not in holds_main
        clean[x] = clean[up] and not (x.hidden or x.side or x.head or x.named or x.loose)
    prose = total = 0
    main = False
    for b in found:
        if b.at:
            b.at.words += b.words
        if not (b.at and b.at.hidden):
            total += len(b.text)
            if b.at:
                b.at.size += len(b.text)
                b.at.prose += b.words if b.words >= NEUTRAL and 2 * b.link < len(b.text) else 0
            if clean[b.at]:
                prose += b.words if b.words >= NEUTRAL and 2 * b.link < len(b.text) else 0
                main |= bool(b.at and b.at.inside)
    for x in reversed(made):
        if x.parent:
            x.parent.size += x.size
            x.parent.words += x.words
            x.parent.prose += x.prose
    share = shares(made, sum(x.prose for x in made if x.parent is None))
    for x in made:
        x.named = max([x.named, *(w * (1 - share[one]) ** 2 for one, w in x.loose.items())])
    wrapped = not main and prose < PROSE
    for x in made:
        own = max(BOILERPLATE if x.side or x.head else 0, x.named * (1 - x.size / total) ** 2 if wrapped and total else x.named)
        x.cost = HARD if x.hidden else min(BOILERPLATE, own + (x.parent.cost if x.parent else 0))


def shares(made: list[Element], total: int) -> dict[str, float]:
    """For each name of loose words, the share of the page's prose in elements of that name, nested ones once."""
    at = {x: i for i, x in enumerate(made)}
    last = list(range(len(made)))
    for x in reversed(made):
        if x.parent:
            last[at[x.parent]] = max(last[at[x.parent]], last[at[x]])
    seen: dict[str, int] = {}
    got: dict[str, float] = {}
    for i, x in enumerate(made):
        for one in x.loose:
            if i > seen.get(one, -1):
                seen[one] = last[i]
                got[one] = got.get(one, 0.0) + x.prose / max(1, total)
    return got


def name_comments(found: list[Block], made: list[Element]) -> None:
    """Reader comments by their head: the elements after it under its parent count as named, and so does the head."""
    heads = [b for b in found if b.at and b.at.parent and b.words <= 12 and (COUNTED.fullmatch(b.text) or BARE.fullmatch(b.text))]
    if not heads:
        return
    below: dict[Element, list[Element]] = {}
    for x in made:
        if x.parent:
            below.setdefault(x.parent, []).append(x)
    marks = {id(b.at) for b in found if b.words <= 12 and ENTRY.search(b.text)}
    marked: dict[Element, bool] = {}
    for x in reversed(made):
        marked[x] = id(x) in marks or x.tag == "time" or any(marked[y] for y in below.get(x, ()))
    for b in heads:
        after = below[b.at.parent]
        after = after[after.index(b.at) + 1 :]
        entries = [y for x in after for y in ([x] if x.tag not in LISTS else below.get(x, []))]
        if COUNTED.fullmatch(b.text) and entries or sum(marked[y] for y in entries) > 1:
            for x in (b.at, *after):
                x.named = float(BOILERPLATE)


def balance(b: Block) -> int:
    """Capacity from the source less capacity to the sink: above zero for content."""
    x = b.at
    words, tag = b.words, x.tag if x else ""
    linked = min(1.0, b.link / max(1, len(b.text)))
    if linked > 0.4:
        s = min(words, 2 * NEUTRAL) - NEUTRAL - int(LINKED * linked)
    else:
        if tag in ITEMS and x.list:
            words = max(words, x.list.words)
        s = (min(words, WORDS) - NEUTRAL) * (2 if words > NEUTRAL else 1)
    if x:
        s += IN_MAIN * x.inside + IN_GOOD * x.good - int(x.cost)
    if tag in HEADINGS:
        s += HEADING
    elif tag == "li" and not x.inside:
        s -= ITEM
    if b.text[0] == "©" or (b.words < 25 and "©" in b.text):
        s -= LEGAL
    return s


def steps(x: Element | None, y: Element | None, most: int) -> int:
    """Steps in the tree from x to y, or more than most."""
    n = 0
    while x is not y and n <= most:
        if y is None or (x is not None and x.depth >= y.depth):
            x = x.parent
        else:
            y = y.parent
        n += 1
    return n


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness: each block with the next two, by closeness in the tree; weak across the border of an article or a sidebar."""
    around = [(bool(b.at and b.at.inside), b.at.cost if b.at else 0) for b in found]
    out = []
    for i, b in enumerate(found):
        for j in (i + 1, i + 2):
            if j < len(found):
                apart = steps(b.at, found[j].at, EDGE)
                w = EDGE // ((1 + apart) * (j - i)) + (SIBLING if apart <= 2 and j == i + 1 else 0)
                if around[i][0] != around[j][0] or abs(around[i][1] - around[j][1]) > MIXED // 4:
                    w //= CONTRAST
                if w:
                    out.append((i, j, w))
    return out


def minimum_cut(balance_of: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """True for nodes on the source side: the largest set that residual paths to the sink do not reach."""
    n = len(balance_of)
    s, t = n, n + 1
    to, cap, adj = [], [], [[] for _ in range(n + 2)]

    def arc(a, b, c, back):
        adj[a].append(len(to))
        to.append(b)
        cap.append(c)
        adj[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, v in enumerate(balance_of):
        arc(s, i, v, 0) if v > 0 else arc(i, t, -v, 0)
    for i, j, w in links:
        arc(i, j, w, w)
    while True:  # Dinic: layers, then blocking flow
        level = [-1] * (n + 2)
        level[s] = 0
        q = deque([s])
        while q:
            u = q.popleft()
            for e in adj[u]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    q.append(to[e])
        if level[t] < 0:
            break
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if not cap[e])
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[u] < len(adj[u]):
                e = adj[u][at[u]]
                if cap[e] and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(adj[u]):
                path.append(adj[u][at[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                break
    reach = [False] * (n + 2)  # what still reaches the sink
    reach[t] = True
    q = deque([t])
    while q:
        u = q.popleft()
        for e in adj[u]:
            if cap[e ^ 1] and not reach[to[e]]:
                reach[to[e]] = True
                q.append(to[e])
    return [not reach[i] for i in range(n)]


def main_text(html: str | None) -> str:
    found, made = blocks(html) if html else ([], [])
    weigh(found, made)
    found = [b for b in found if not (b.at and b.at.hidden)]
    if not found:
        return ""
    keep = minimum_cut([balance(b) for b in found], edges(found))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each page."""

    def run(batches):
        for b in batches:
            text = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
