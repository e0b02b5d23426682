"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a tree of block elements and text slots. Repeats in it are folded: neighbours of one form become a repeated
element (+), flow elements that come again after others a repeated group of optional ones. Pages of equal form are
counted once with what their slots hold, and forms are aligned child list by child list: what only one side has
becomes optional (?), what both have is aligned further. The result is the host's expression, one slot for each place of
text in it, with its mean length over all pages and whether it holds the same text on all of them (template) or data.

To read a page it is matched against its host's expression in the same way. Each of its texts then counts as much as its
slot holds on the host's pages, so that a short article isn't outweighed by a long advert beside it. The article is the
smallest element that holds most of this; from its data slots come the blocks. Names of elements and classes weigh in,
and mark menus, adverts and the like wherever they stand.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator, Sequence
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SLOT = "#"
#: Elements of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object canvas select datalist button annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
#: Formulas stand in running text.
INLINE |= frozenset("math mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
CHROME = frozenset("nav aside footer form dialog menu head".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice notices pagination popup "
    "promo promoted recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: What a name may say besides, about a part's form or place. A name of other words isn't one of a menu or the like by itself.
PART_WORDS = frozenset(
    "area article articles bar block blocks body bottom box btn button buttons card cards col column container content count entry fixed float foot form group head heading hidden holder icon icons inner item items "
    "left legal lg link links list main md mobile modal module new overlay outer page pane panel post posts primary region right row secondary section site slot sm sticky story stories strip tags text thread title "
    "tools top unit ul user view wrap wrapper xl".split()
)
#: Of these, the ones that an article may have inside.
HEAD_WORDS = frozenset("banner header masthead".split())
MAIN = frozenset("article main".split())
MAIN_WORDS = frozenset("articlebody".split())
#: A closing element of the second kind may be left out before the opening of the first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Elements of running text; what repeats among them is one group. Items of lists and tables fold whatever they hold.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure figcaption hr address details".split())
ITEMS = frozenset("li dt dd tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: A tag that the page ends in.
CUT_TAG = re.compile(r"<[A-Za-z/!?][^>]*\Z")
SPACE = re.compile(r"\s+")
#: A slot is of the template if so many different pages at least have the same text in it.
SAME = 3
#: So many neighbours of one form are a repeat whatever their element; fewer only with a class of their own.
RUN = 4
#: Weights of text in article and main elements against other text, and share of an element that the article needs.
MARKS, MOST = (1.0, 10.0, 100.0), 0.5
#: A repeated slot of links is a menu if this share of its characters is linked, on the whole host.
LINKED = 0.8
#: Forms of a host that a task merges at once, pages of a host that one task reads (or a
#: LARGE-th of all pages, if these are more), cells of an alignment's table, and
#: sums that a task holds.
FORMS, PAGES, LARGE, CELLS, FLUSH = 64, 1000, 10_000, 40_000_000, 50_000


def label(name: str, attributes: str) -> str:
    """Tag name and the words of class, id, role and itemprop by which it is known, numbers left out."""
    if not attributes or "=" not in attributes:
        return name
    words = []
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id", "role", "itemprop"):
            words += re.findall(r"[a-z]+", (a or b or c).lower())
    return ".".join([name, *sorted(set(words))])


class Node:
    """An element or a text slot (label SLOT) of a page or an expression.

    texts: numbers of the page's texts in the slot. stats: of a slot, over the host's pages: pages, different pages (at
    most SAME), low and high CRC-32 of its text, characters, linked characters.
    """

    __slots__ = ("label", "kids", "repeat", "optional", "group", "texts", "stats", "key", "has")

    def __init__(self, label: str):
        self.label, self.kids, self.repeat, self.optional, self.group = label, [], False, False, 0
        self.texts, self.stats, self.key, self.has = [], None, 0, frozenset()


@lru_cache(maxsize=1 << 16)
def _code(label: str) -> int:
    return zlib.crc32(label.encode("utf-8", "replace"))


@lru_cache(maxsize=1 << 16)
def _tag(label: str) -> str:
    return label.split(".")[0]


def parse(source: str) -> tuple[list[Node], list[str], list[int]]:
    """Nodes of a page, parents before children and the root first; its texts in order, and how much of each is linked."""
    root = Node("")
    nodes, path = [root], [root]
    open_tags: dict[str, int] = {}
    texts: list[str] = []
    linked: list[int] = []
    held: list[str] = []
    links, in_link = 0, False
    at, raw, size = 0, None, len(source)

    def close() -> None:
        open_tags[_tag(path.pop().label)] -= 1

    def text() -> None:
        nonlocal links
        line = SPACE.sub(" ", html.unescape("".join(held))).strip() if held else ""
        held.clear()
        if line:
            slot = Node(SLOT)
            slot.texts.append(len(texts))
            texts.append(line)
            linked.append(min(links, len(line)))
            path[-1].kids.append(slot)
            nodes.append(slot)
        links = 0

    def hold(piece: str) -> None:
        nonlocal links
        if piece:
            held.append(piece)
            links += len(piece) if in_link else 0

    while at < size:
        if raw:
            end = re.compile(rf"</{raw}\s*>", re.I).search(source, at)
            at, raw = (end.end() if end else size), None
            continue
        m = TOKEN.search(source, at)
        if not m:
            hold(CUT_TAG.sub("", source[at:]))
            break
        hold(source[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in RAW:
            if not m[1] and not m[3].endswith("/"):
                raw = re.escape(name)
            continue
        if name in INLINE:
            if name == "br":
                held.append(" ")
            elif name == "a":
                in_link = not m[1]
            continue
        text()
        if not m[1]:
            last = _tag(path[-1].label)
            if (name in ENDS_P and last == "p") or (name in CLOSES and last in CLOSES[name]):
                close()
            if name in VOID:
                continue
            node = Node(label(name, m[3]))
            path[-1].kids.append(node)
            nodes.append(node)
            path.append(node)
            open_tags[name] = open_tags.get(name, 0) + 1
        elif open_tags.get(name):
            while _tag(path[-1].label) != name:
                close()
            close()
    text()
    return nodes, texts, linked


def finish(node: Node) -> None:
    """Key and labels of a node whose children have theirs."""
    node.key = hash((_code(node.label), *(k.key for k in node.kids)))
    node.has = frozenset(x for k in node.kids for x in (k.label, *(g.label for g in k.kids)))


def absorb(into: Node, other: Node) -> None:
    """Adds the texts of a node of the same key."""
    stack = [(into, other)]
    while stack:
        a, b = stack.pop()
        a.texts += b.texts
        a.repeat |= b.repeat
        stack += zip(a.kids, b.kids, strict=True)


def folded(source: str) -> tuple[Node, list[str], list[int]]:
    """The folded tree of a page, its texts and their linked characters."""
    nodes, texts, linked = parse(source)
    for node in reversed(nodes):
        if len(node.kids) > 1:
            node.kids = _grouped(_runs(node.kids))
        finish(node)
    return nodes[0], texts, linked


def _runs(kids: list[Node]) -> list[Node]:
    out: list[Node] = []
    begin = 0
    while begin < len(kids):
        first, end = kids[begin], begin + 1
        tag = _tag(first.label)
        item = tag in ITEMS
        while end < len(kids) and (kids[end].key == first.key or (item and kids[end].label == first.label)):
            end += 1
        if end - begin > 1 and (first.label == SLOT or item or tag in FLOW or "." in first.label or end - begin >= RUN):
            for other in kids[begin + 1 : end]:
                if other.key == first.key:
                    absorb(first, other)
                else:
                    merge(first, other)
            first.repeat = True
            out.append(first)
        else:
            out += kids[begin:end]
        begin = end
    return out


def _grouped(kids: list[Node]) -> list[Node]:
    """Flow elements that come again make one group of what lies between their first and last place."""
    last: dict[int, int] = {}
    flow = [k.label == SLOT or _tag(k.label) in FLOW for k in kids]
    for i, k in enumerate(kids):
        if flow[i]:
            last[k.key] = i
    out: list[Node] = []
    i, group = 0, 0
    while i < len(kids):
        if not flow[i] or last[kids[i].key] == i:
            out.append(kids[i])
            i += 1
            continue
        group += 1
        end, seen = last[kids[i].key], {}
        while i <= end:
            k = kids[i]
            if flow[i]:
                end = max(end, last[k.key])
            if flow[i] and k.key in seen:
                absorb(seen[k.key], k)
            else:
                k.group, k.optional = group, True
                out.append(k)
                if flow[i]:
                    seen[k.key] = k
            i += 1
    return out


def likeness(a: Node, b: Node) -> float:
    """0 for different elements, 1 for the same form, between them by the elements that both hold."""
    if a.label != b.label:
        return 0.0
    if a.key == b.key or not (a.has or b.has):
        return 1.0
    return 0.25 + 0.7 * len(a.has & b.has) / len(a.has | b.has)


def aligned(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Pairs of places in both lists, in order, of the greatest sum of likenesses."""
    begin, ends = 0, 0
    while begin < min(len(a), len(b)) and a[begin].key == b[begin].key:
        begin += 1
    while ends < min(len(a), len(b)) - begin and a[-1 - ends].key == b[-1 - ends].key:
        ends += 1
    pairs = [(i, i) for i in range(begin)] + [(len(a) - i, len(b) - i) for i in range(ends, 0, -1)]
    left, right = a[begin : len(a) - ends], b[begin : len(b) - ends]
    if not left or not right:
        return pairs
    return pairs[:begin] + [(i + begin, j + begin) for i, j in _best(left, right)] + pairs[begin:]


def _gains(left: list[Node], right: list[Node]) -> Iterator[np.ndarray]:
    """Likenesses of each node on the left to all on the right."""
    columns: dict[str, list[int]] = {}
    for j, x in enumerate(right):
        columns.setdefault(x.label, []).append(j)
    for x in left:
        gain = np.zeros(len(right), dtype=np.float32)
        for j in columns.get(x.label, ()):
            gain[j] = likeness(x, right[j])
        yield gain


def _next(row: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The row of the alignment's table after one more node on the left."""
    return np.concatenate([row[:1], np.maximum.accumulate(np.maximum(row[1:], np.where(gain > 0, row[:-1] + gain, 0)))])


def _best(left: list[Node], right: list[Node]) -> list[tuple[int, int]]:
    """Pairs of the greatest sum. Where the table would have more than CELLS cells, the left half's last row and the right
    half's first one tell where to part the right side, so that memory grows with the lists, not with their product."""
    if not left or not right:
        return []
    if len(left) > 1 and len(left) * len(right) > CELLS:
        middle = len(left) // 2
        rows = []
        for one, other in ((left[:middle], right), (left[middle:][::-1], right[::-1])):
            row = np.zeros(len(other) + 1, dtype=np.float32)
            for gain in _gains(one, other):
                row = _next(row, gain)
            rows.append(row)
        at = int(np.argmax(rows[0] + rows[1][::-1]))
        return _best(left[:middle], right[:at]) + [(i + middle, j + at) for i, j in _best(left[middle:], right[at:])]
    gains = list(_gains(left, right))
    table = [np.zeros(len(right) + 1, dtype=np.float32)]
    for gain in gains:
        table.append(_next(table[-1], gain))
    i, j, out = len(left), len(right), []
    while i and j:
        if gains[i - 1][j - 1] > 0 and table[i][j] == table[i - 1][j - 1] + gains[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _sum(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return a or b
    return (a[0] + b[0], min(SAME, a[1] + b[1]), min(a[2], b[2]), max(a[3], b[3]), a[4] + b[4], a[5] + b[5])


def merge(into: Node, other: Node) -> None:
    """The least generalisation of both by alignment, in place; a node that one side lacks is optional."""
    stack, done = [(into, other)], []
    while stack:
        a, b = stack.pop()
        done.append(a)
        a.repeat |= b.repeat
        a.optional |= b.optional
        a.texts += b.texts
        a.stats = _sum(a.stats, b.stats)
        if not b.kids and not a.kids:
            continue
        pairs = aligned(a.kids, b.kids)
        stack += [(a.kids[i], b.kids[j]) for i, j in pairs]
        kids, i, j = [], 0, 0
        top = max([k.group for k in a.kids], default=0)
        for x, y in [*pairs, (len(a.kids), len(b.kids))]:
            for k in a.kids[i:x] + b.kids[j:y]:
                k.optional = True
            for k in b.kids[j:y]:
                k.group += top if k.group else 0
            kids += a.kids[i:x] + b.kids[j:y] + a.kids[x : x + 1]
            i, j = x + 1, y + 1
        a.kids = kids
    for node in reversed(done):
        finish(node)


def walk(root: Node) -> list[Node]:
    """All nodes in the order of the expression."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += reversed(node.kids)
    return out


def written(root: Node, stats: bool = True) -> str:
    """A tree as text: label, number of children, marks and group of each node in order, and a slot's statistics."""
    rows = [[n.label, len(n.kids), n.repeat + 2 * n.optional, n.group, *(n.stats or () if stats else ())] for n in walk(root)]
    return json.dumps(rows, ensure_ascii=False)


def read(text: str) -> Node:
    root = Node("")
    nodes, waits = [], [(root, 1)]
    for label_, n, marks, group, *stats in json.loads(text):
        node = Node(label_)
        node.repeat, node.optional, node.group, node.stats = bool(marks & 1), bool(marks & 2), group, tuple(stats) or None
        parent, left = waits.pop()
        parent.kids.append(node)
        if left > 1:
            waits.append((parent, left - 1))
        if n:
            waits.append((node, n))
        nodes.append(node)
    for node in reversed(nodes):
        finish(node)
    return root.kids[0]


def expression(root: Node) -> str:
    """A tree in the notation of regular expressions, for people."""
    out: list[str] = []
    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        mark = {(True, True): "*", (True, False): "+", (False, True): "?"}.get((x.repeat, x.optional), "")
        if x.label == SLOT:
            out.append(SLOT + mark)
            continue
        inner: list = []
        for n, k in enumerate(x.kids):
            before, after = (x.kids[n - 1].group if n else 0), (x.kids[n + 1].group if n + 1 < len(x.kids) else 0)
            inner += (["("] if k.group and before != k.group else []) + [k] + ([")+"] if k.group and after != k.group else [])
        stack += reversed([f"<{x.label}>", *inner, f"</{_tag(x.label)}>{mark}"] if x.label else inner)
    return "".join(out)


@lru_cache(maxsize=1 << 16)
def _mark(label: str) -> int:
    """2 for an article element, 1 for another main one, else 0."""
    name, *words = label.split(".")
    return 2 if name == "article" else 1 if name in MAIN or MAIN_WORDS & set(words) else 0


@lru_cache(maxsize=1 << 16)
def _chrome(label: str, inside: bool) -> int:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form or comments: 3 if its tag alone says so,
    2 if its tag or its whole name does, but it may be what the page is built in, 1 if its name does among other words."""
    name, *words = label.split(".")
    if name in CHROME - {"form"} or (name == "header" and not inside):
        return 3
    if name == "form":
        return 2
    if name in ("html", "body") or _mark(label) or not CHROME_WORDS & set(words) - (HEAD_WORDS if inside else set()):
        return 0
    return 2 if set(words) <= CHROME_WORDS | PART_WORDS else 1


def placed(page: Node, texts: Sequence[str], linked: Sequence[int]) -> tuple[list[Node], dict[int, int], dict[int, bool]]:
    """The nodes in order, and for each (by id) its mark and whether it lies in a menu or the like.

    A name never takes away what the page is about: an element that holds most of the text in article elements, else main
    ones, is no menu, nor one that holds most of all text and a heading where there are none; and one whose name has other
    words besides isn't where most of its text isn't linked. Only elements that are menus, asides, footers and the like by
    their tag are so in any case.
    """
    order = walk(page)
    mark = {id(page): 0}
    for node in order:
        for k in node.kids:
            mark[id(k)] = max(mark[id(node)], _mark(k.label))
    top = max(mark.values())
    chars, links, core, headed = {}, {}, {}, {}
    for node in reversed(order):
        i = id(node)
        chars[i] = sum(len(texts[t]) for t in node.texts) + sum(chars[id(k)] for k in node.kids)
        links[i] = sum(linked[t] for t in node.texts) + sum(links[id(k)] for k in node.kids)
        core[i] = chars[i] if top and mark[i] == top else sum(core[id(k)] for k in node.kids)
        headed[i] = _tag(node.label) in HEADINGS or any(headed[id(k)] for k in node.kids)
    all_, all_core = chars[id(page)], core[id(page)]
    chrome = {id(page): False}
    for node in order:
        for k in node.kids:
            i = id(k)
            sure = _chrome(k.label, mark[i] > 0)
            built_in = core[i] > MOST * all_core if all_core else chars[i] > MOST * all_ and headed[i]
            within = mark[i] == top and top > 0  # inside the article, which as a whole is no menu
            chrome[i] = chrome[id(node)] or sure == 3 or (sure == 2 and (within or not built_in)) or (sure == 1 and links[i] > MOST * chars[i])
    return order, mark, chrome


def matched(page: Node, wrapper: Node | None) -> dict[int, Node]:
    """The slot of the expression that each slot of the page (by id) is read as."""
    out: dict[int, Node] = {}
    stack = [(page, wrapper)] if wrapper is not None else []
    while stack:
        a, w = stack.pop()
        if a.label == SLOT:
            out[id(a)] = w
        elif a.kids and w.kids:
            stack += [(a.kids[i], w.kids[j]) for i, j in aligned(a.kids, w.kids)]
    return out


def extract(source: str, wrapper: Node | None = None) -> str:
    """The article's blocks, joined by line feeds, as the host's expression tells (without one, as the page alone does).

    The article is found from the root downwards: the child that holds more than half of what its parent holds is entered,
    unless that would leave a heading outside. What a text counts is its slot's mean length on the host's pages, by MARKS
    in article and main elements; nothing in menus and the like, in template slots and in repeated slots of links. Blocks
    are the texts inside that count; in article elements, else main ones, where the found element holds such.
    """
    page, texts, linked = folded(source)
    slots = matched(page, wrapper)
    order, mark, chrome = placed(page, texts, linked)
    inside: dict[int, bool] = {}
    own: dict[int, float] = {}
    for node in order:
        if node.label != SLOT or chrome[id(node)]:
            continue
        chars, links = sum(len(texts[t]) for t in node.texts), sum(linked[t] for t in node.texts)
        w = slots.get(id(node))
        n, different, low, high, all_chars, all_links = w.stats if w is not None and w.stats else (1, 1, 0, 1, chars, links)
        known = w if w is not None else node
        template = different >= SAME and low == high
        menu = known.repeat and all_links > LINKED * all_chars
        inside[id(node)] = mark[id(node)] > 0 or not (template or menu)
        own[id(node)] = max(all_chars / n, 1.0) * MARKS[mark[id(node)]] if inside[id(node)] else 0.0
    total, headed = dict(own), set()
    for node in reversed(order):
        if node.kids:
            total[id(node)] = sum(total.get(id(k), 0.0) for k in node.kids)
            if total[id(node)] and (_tag(node.label) in HEADINGS or any(id(k) in headed for k in node.kids)):
                headed.add(id(node))
    at = page
    while at.kids:
        best = max(at.kids, key=lambda k: total.get(id(k), 0.0))
        if best.label == SLOT or _tag(best.label) in FLOW | ITEMS or best.repeat or total.get(id(best), 0.0) <= MOST * total[id(at)]:
            break
        if mark[id(best)] <= mark[id(at)] and any(id(k) in headed for k in at.kids if k is not best):
            break
        at = best
    for kept in (inside, {k: True for k in own}):
        found = [n for n in walk(at) if kept.get(id(n))]
        if found:
            most = max(mark[id(n)] for n in found)
            return "\n".join(texts[t] for t in sorted(t for n in found if mark[id(n)] == most for t in n.texts))
    return ""


def host(url: F.Column) -> F.Column:
    """Host of an address in lower case; addresses without one share the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def forms(pages: DataFrame) -> DataFrame:
    """host, form (number of a folded tree), slot (-1: the tree itself, as text), and what the slot holds over its pages.

    Copies of a page count as one page: different is 1, 2 or SAME for three or more different ones. A task adds up its own
    pages first, FLUSH rows at once.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def add(key: tuple, low: int, one: int, two: int, tree: str | None = None) -> None:
            own = held.get(key)
            if own is None:
                held[key] = [tree, 1, low, low, one, two]
            else:
                own[1:] = own[1] + 1, min(own[2], low), max(own[3], low), own[4] + one, own[5] + two

        def flush() -> pa.RecordBatch:
            columns = zip(*[(*k, *v[:4], Decimal(v[4]), Decimal(v[5])) for k, v in held.items()], strict=True)
            types = [pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 3, *[pa.decimal128(38)] * 2]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "form", "slot", "tree", "n", "low", "high", "one", "two"])

        for batch in batches:
            for name, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page, texts, linked = folded(source or "")
                order, _, chrome = placed(page, texts, linked)
                form = hash(tuple((_code(n.label), len(n.kids), n.repeat, n.optional, n.group) for n in order))
                slots = [n for n in order if n.label == SLOT]
                # copies of a page, whatever their menus, are one page
                body = zlib.crc32("\n".join(texts[t] for n in slots if not chrome[id(n)] for t in n.texts).encode("utf-8", "replace")) >> 1
                add((name, form, -1), body, body, body * body, None if (name, form, -1) in held else written(page))
                for no, slot in enumerate(slots):
                    own = "\n".join(texts[t] for t in slot.texts)
                    add((name, form, no), zlib.crc32(own.encode("utf-8", "replace")), len(own), sum(linked[t] for t in slot.texts))
                if len(held) > FLUSH:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    schema = "host string, form long, slot int, tree string, n long, low long, high long, one decimal(38,0), two decimal(38,0)"
    seen = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(each, schema)
    sums = seen.groupBy("host", "form", "slot").agg(
        F.max("tree").alias("tree"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("one").cast("decimal(38,0)").alias("one"), F.sum("two").cast("decimal(38,0)").alias("two")
    )
    # (page - first) * (last - page) sums to more than 0 if there is a third page between the first and the last
    third = F.expr("one * (low + high) - n * cast(low as decimal(38,0)) * high > two")
    different = 1 + (F.col("low") < F.col("high")).cast("long") + third.cast("long")
    return sums.withColumn("different", F.when(F.col("slot") < 0, different)).withColumns({"one": F.col("one").cast("string"), "two": F.col("two").cast("string")})


def wrappers(pages: DataFrame) -> DataFrame:
    """host, n (pages) and wrapper (the expression with its slots' statistics, as text), a row a host.

    Forms are merged in rounds of FORMS or so a task, whatever the number of a host's forms.
    """

    def assemble(key, df: pd.DataFrame) -> pd.DataFrame:
        trees = df[df["slot"] < 0]
        slots = {form: g.sort_values("slot") for form, g in df[df["slot"] >= 0].groupby("form")}
        rows = []
        for r in trees.itertuples():
            tree = read(r.tree)
            own = slots.get(r.form)
            for slot, s in zip((n for n in walk(tree) if n.label == SLOT), own.itertuples() if own is not None else (), strict=True):
                slot.stats = (int(s.n), int(r.different), int(s.low), int(s.high), int(s.one), int(s.two))
            rows.append((int(r.n), tree))
        return _merged(key[0], rows)

    def again(key, df: pd.DataFrame) -> pd.DataFrame:
        return _merged(key[0], [(int(n), read(w)) for n, w in zip(df["n"], df["wrapper"], strict=True)])

    schema = "host string, n long, wrapper string"
    by_form = cut(forms(pages))
    per_host = by_form.filter("slot = -1").groupBy("host").agg(F.ceil(F.count("*") / FORMS).cast("int").alias("parts"))
    most = per_host.agg(F.max("parts")).first()[0] or 1
    dealt = by_form.join(per_host, "host").withColumn("part", F.pmod(F.xxhash64("form"), F.col("parts")).cast("int"))
    out = dealt.groupBy("host", "part").applyInPandas(assemble, schema)
    while most > 1:
        out = cut(out)
        most = -(-most // FORMS)
        part = F.pmod(F.xxhash64("wrapper"), F.lit(most)).cast("int")
        out = out.withColumn("part", part).groupBy("host", "part").applyInPandas(again, schema)
    return out


def _merged(name: str, rows: Sequence[tuple[int, Node]]) -> pd.DataFrame:
    """The most frequent first, then by their text."""
    ordered = [tree for _, tree in sorted(rows, key=lambda r: (-r[0], written(r[1])))]
    wrapper = ordered[0]
    for tree in ordered[1:]:
        merge(wrapper, tree)
    return pd.DataFrame([(name, sum(n for n, _ in rows), written(wrapper))], columns=["host", "n", "wrapper"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: its article's blocks by its host's wrapper (see extract).

    A null html is empty and gives an empty text; null addresses share the empty host. Repeated rows are answered row by
    row; extra columns are left out; an empty table gives no rows. Blocks may be nested to any depth.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrapper = None
        for batch in batches:
            at, found = [], []
            for i, (role, source) in enumerate(zip(batch.column("role").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                if role == 0:  # stands before its host's pages
                    wrapper = read(source)
                else:
                    at.append(i)
                    found.append(extract(source or "", wrapper))
            if at:
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([own.column("page_id"), own.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType
    made = cut(wrappers(pages))
    # of the hosts with more than a LARGE-th of all pages there are LARGE at most; only they are read in parts
    large = max(PAGES, (made.agg(F.sum("n")).first()[0] or 0) // LARGE)
    made = made.withColumn("parts", F.ceil(F.col("n") / large).cast("int"))
    first = made.select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.lit(None).cast(kind).alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("wrapper").alias("html"))
    own = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(F.broadcast(made.filter("parts > 1").select("host", "parts")), "host", "left")
    own = own.select("host", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(1).alias("role"), "page_id", "url", "html")
    dealt = first.unionByName(own).repartition("host", "part").sortWithinPartitions("host", "part", "role")
    return dealt.mapInArrow(answer, f"page_id {kind.simpleString()}, url string, text string, n_chars long")
