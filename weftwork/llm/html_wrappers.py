"""HTML extraction by inference of union-free regular expressions.

A page is a tree of block elements and text slots; markup inside a line of text belongs to its slot.
The children of an element are a stream of symbols. Streams of the pages of a host are aligned one
after another with what has been inferred so far, element by element: a mismatch becomes an optional
item, repeats become repeated items, and symbols that come again among others become a repeated
group of optional ones, as in ``(p? h2? ul?)+``. The result is the host's wrapper, an expression
without unions for all its pages. Equal trees of a host are one before any alignment, and a
host's trees are aligned in parts of bounded size until one is left.

All pages are then matched with their host's wrapper, in time linear in the page, and each slot
gathers evidence from them: which texts come again on nearly every page (the template's own, not the
page's), and how much of it is link text. A page's main text are the slots in its ``article`` or
``main`` element, or in all of the page if there is none, but for those whose text is the
template's, lists of links outside of an article, and what elements and their class, id or role
name as something else. Names count as whole values, or as the first or last part of one, and never
for an element that holds the article.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.session import materialize

SLOT = "#"
#: Elements inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn del em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Inline elements that separate words.
_GAPS = frozenset(("br", "img", "wbr"))
#: Block elements without content.
VOID = frozenset("area base basefont bgsound col command embed frame hr input keygen link meta param source track".split())
#: Elements that have no part in the tree.
_UNMARKED = frozenset(("html", "head", "body", "tbody", "thead", "tfoot"))
#: Elements that end where one of the named begins in the same parent.
_ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "option": ("option", "optgroup"), "optgroup": ("optgroup",)}
#: Elements that don't end a paragraph.
_IN_PARAGRAPH = frozenset("object svg math canvas button select textarea option optgroup audio video map iframe noscript template script style label".split())
#: Elements of running text, whose order is free; others have a place in the page.
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd blockquote pre figure figcaption table caption tr td th hr address details summary".split()) | {SLOT}
#: Content of these is not markup.
_RAW = "script|style|textarea|xmp"
#: Elements that aren't main text.
OUTSIDE = frozenset("nav header footer aside form script style noscript template title iframe object svg math canvas button select textarea dialog menu audio video map fieldset xmp".split())
#: Values of class, id or role that aren't main text.
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright dialog disqus footer gdpr header masthead menu"
    " modal nav navbar navigation navigator newsletter notice notices notification overlay pagination pager popup promo promotion recommended related reply replies respond search share sharing"
    " sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget".split()
)
#: Words that do so as the first or last part of a value too, unless another part is one of these states.
_PART_WORDS = frozenset("ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu nav navbar newsletter pagination popup promo related respond share sharing sidebar social sponsor sponsored subscribe".split())
_STATES = frozenset("has no with without is not in on off open closed enabled disabled count active visible category tag type format status theme layout left right page template".split())
MAIN = frozenset(("article", "main"))
MAIN_WORDS = frozenset(("article", "main", "content", "post", "entry", "story"))
_MAIN_PARTS = frozenset(("body", "content", "text", "main"))
#: Elements of a path; what is deeper belongs to the last one.
DEEP = 40
#: Items and symbols of an element in a wrapper, before items become one group and symbols lose their names.
ITEMS, SYMBOLS = 40, 64
#: Trees that one task aligns at once.
ALIGNED = 400
#: Pages that evidence needs; the share of them that have a text of the template; the share of link text of a list of links.
LEAST, SAME, LINKED = 5, 0.8, 0.8

#: A tag as most are, which has no other mark inside, so that a miss is found at the next mark; or a mark by itself.
_COMMON = re.compile(rf"""<(?:(?!(?:{_RAW})\b)(/?)([a-zA-Z][^\s/<>"']*+)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>|)""", re.I)
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[\"'>]")
_RAW_TAG = re.compile(rf"({_RAW})\b", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW.split("|")}
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")


class _Tags:
    """The markup of a page, one piece after another, in time linear in the page whatever is left open in it.

    A comment, a CDATA section or the content of a raw element that isn't closed reaches to the end. A tag ends at the
    first ``>`` outside of quotes, or, if a quote is never closed, at the first one; without one it is text.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.next = page.find(">")
        # Where attributes go on outside of quotes but never reach a ``>``, and from where on a quote doesn't come again.
        self.dead: set[int] = set()
        self.none = {'"': len(page), "'": len(page)}

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name or empty, whether it is an end tag, attributes)."""
        at = 0
        while m := _COMMON.search(self.page, at):
            ends, name, attributes = m.groups()
            at = m.end()
            if name:
                yield m.start(), at, name, bool(ends), attributes
            else:
                piece, at = self.odd(m.start())
                if piece:
                    yield piece

    def odd(self, i: int) -> tuple[tuple[int, int, str, bool, str] | None, int]:
        """What begins at a mark that isn't a common tag's, if it isn't text, and where to go on."""
        page = self.page
        x = page[i + 1 : i + 2]
        if page.startswith("<!--", i):
            at = self._past("-->", i + 4)
        elif page.startswith("<![CDATA[", i):
            at = self._past("]]>", i + 9)
        elif not (x in ("!", "?", "/") or x.isascii() and x.isalpha()):
            return None, i + 1
        elif (close := self._next(i)) < 0:
            # No tag is closed any more; comments and CDATA sections may follow.
            return None, min((k for k in (page.find("<!--", i + 1), page.find("<![CDATA[", i + 1)) if k >= 0), default=len(page))
        elif m := _RAW_TAG.match(page, i + 1):
            m = _RAW_END[m[1].lower()].search(page, close + 1)
            at = m.end() if m else len(page)
        elif m := _TAG.match(page, i + 1):
            end = self._end(m.end())
            if end >= 0:
                return (i, end + 1, m[2], bool(m[1]), page[m.end() : end]), end + 1
            at = close + 1
        elif x == "/":
            return None, i + 1
        else:
            at = close + 1
        return (i, at, "", False, ""), at

    def _past(self, mark: str, at: int) -> int:
        k = self.page.find(mark, at)
        return len(self.page) if k < 0 else k + len(mark)

    def _next(self, at: int) -> int:
        """The first ``>`` from ``at`` on; places come in ascending order."""
        if 0 <= self.next < at:
            self.next = self.page.find(">", at)
        return self.next

    def _end(self, at: int) -> int:
        """The ``>`` that ends a tag whose attributes begin at ``at``, or -1."""
        begun = []
        while at not in self.dead:
            begun.append(at)
            m = _STOP.search(self.page, at)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            k = -1 if m.end() >= self.none[m[0]] else self.page.find(m[0], m.end())
            if k < 0:
                self.none[m[0]] = min(self.none[m[0]], m.end())
                break
            at = k + 1
        self.dead.update(begun)
        return -1


class Page:
    """``root``, a tree of ``(symbol, children)``, the texts of its slots in order, and their characters in links.

    A symbol is ``tag`` or ``tag|values``, of class, id and role, without those that hold digits. A
    child is an element or the number of a slot.
    """

    def __init__(self, page: str) -> None:
        self.texts: list[str] = []
        self.links: list[int] = []
        self.root: tuple[str, list] = ("", [])
        self.has_main = False
        self.open: list[tuple[str, tuple]] = [("", self.root)]
        self.of: Counter[str] = Counter()
        self._read(page)

    def _read(self, page: str) -> None:
        run: list[str] = []
        linked = 0
        in_link = False

        def close() -> None:
            nonlocal linked
            if run:
                text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
                run.clear()
                if text:
                    self.open[-1][1][1].append(len(self.texts))
                    self.texts.append(text)
                    self.links.append(min(linked, len(text)))
            linked = 0

        at = next_ = 0
        search, tags = _COMMON.search, _Tags(page)
        while m := search(page, next_):
            ends, name, attributes = m.groups()
            if name:
                start, next_ = m.start(), m.end()
            else:
                piece, next_ = tags.odd(m.start())
                if piece is None:
                    continue
                start, next_, name, ends, attributes = piece
            if start > at:
                run.append(page[at:start])
                if in_link:
                    linked += start - at
            at = next_
            if not name:
                continue
            name = name.lower()
            if name in INLINE:
                if name in _GAPS:
                    run.append(" ")
                elif name == "a":
                    in_link = not ends
                continue
            close()
            if name in VOID or name in _UNMARKED:
                continue
            if ends:
                self._end(name)
            else:
                self._start(name, attributes)
        run.append(page[at:])
        close()

    def _pop(self) -> str:
        name = self.open.pop()[0]
        self.of[name] -= 1
        return name

    def _end(self, name: str) -> None:
        if self.of[name]:
            while self._pop() != name:
                pass

    def _start(self, name: str, attributes: str) -> None:
        top = self.open[-1][0]
        while top in _ENDED_BY and name in _ENDED_BY[top] or top == "p" and name not in _IN_PARAGRAPH:
            self._pop()
            top = self.open[-1][0]
        self.of[name] += 1
        parent = self.open[-1][1]
        if len(self.open) > DEEP:
            self.open.append((name, parent))
            return
        symbol = name
        if name in MAIN:
            self.has_main = True
        elif attributes:
            values = {v for x in _NAMED.finditer(attributes) for v in (x[1] or x[2] or x[3] or "").lower().split()}
            values = sorted(v for v in values if not any(c.isdigit() for c in v))
            if values:
                self.has_main |= "main" in values and "role" in attributes.lower() and _is_role_main(attributes)
                symbol = f"{name}|{' '.join(values)}"
        node = (symbol, [])
        parent[1].append(node)
        self.open.append((name, node))


def _is_role_main(attributes: str) -> bool:
    return bool(re.search(r"""\brole\s*=\s*["']?main\b""", attributes, re.I))


def _bare(symbol: str) -> str:
    return symbol.partition("|")[0]


class Node:
    """The expression of an element's children: items of ``(symbols, optional, repeated)``, each with a node for each symbol."""

    __slots__ = ("items", "below", "steps", "at", "needed")

    def __init__(self, items: list[tuple[tuple[str, ...], bool, bool]], below: list[dict[str, Node]]) -> None:
        self.items, self.below = items, below
        self.steps: dict[tuple[int, str], int] = {}
        self.at: dict[str, list[int]] | None = None
        self.needed: list[int] = []

    # Matching: the items reached after each child are bits of a number; steps are found once and kept.

    def _ready(self) -> None:
        self.at = {}
        self.needed = [0]
        for k, (symbols, optional, _) in enumerate(self.items):
            for x in symbols:
                self.at.setdefault(x, []).append(k)
            self.needed.append(self.needed[-1] + (not optional))

    def _follows(self, j: int, k: int) -> bool:
        return k == j and self.items[k][2] or k > j and self.needed[k] == self.needed[j + 1]

    def match(self, symbols: list[str]) -> list[int] | None:
        """The item of each child, or None if the expression doesn't accept them."""
        if self.at is None:
            self._ready()
        reached, passed = 1, []  # bit k + 1: item k
        for x in symbols:
            step = self.steps.get((reached, x))
            if step is None:
                step = 0
                for k in self.at.get(x, ()):
                    if any(reached >> (j + 1) & 1 and self._follows(j, k) for j in range(-1, k + 1)):
                        step |= 1 << (k + 1)
                self.steps[reached, x] = step
            if not step:
                return None
            passed.append(step)
            reached = step
        last = [k for k in range(-1, len(self.items)) if reached >> (k + 1) & 1 and self.needed[-1] == self.needed[k + 1]]
        if not last:
            return None
        out = []
        k = last[0]
        for i in range(len(symbols) - 1, -1, -1):
            out.append(k)
            before = passed[i - 1] if i else 1
            k = next(j for j in range(k, -2, -1) if before >> (j + 1) & 1 and self._follows(j, k))
        return out[::-1]

    def dump(self) -> list:
        return [[list(s), int(o), int(r), [None if n is None else n.dump() for n in (b.get(x) for x in s)]] for (s, o, r), b in zip(self.items, self.below, strict=True)]

    @staticmethod
    def load(x: list) -> Node:
        return Node([(tuple(s), bool(o), bool(r)) for s, o, r, _ in x], [{k: Node.load(n) for k, n in zip(s, b, strict=True) if n is not None} for s, _, _, b in x])


def _united(a: dict[str, Node], b: dict[str, Node]) -> dict[str, Node]:
    return {x: merge(a[x], b[x]) if x in a and x in b else a.get(x) or b[x] for x in {**a, **b}}


def _normal(items: list, below: list) -> Node:
    """Runs of one symbol become repeated, and symbols that come again among others become a repeated group."""

    def group(some: list, nodes: list) -> tuple:
        names = sorted({x for s, _, _ in some for x in s})
        under: dict[str, Node] = {}
        for n in nodes:
            under = _united(under, n)
        return (tuple(names), all(o for _, o, _ in some), True), under

    if len(items) > 1:
        last: dict[str, int] = {}
        grouped = {x for s, _, _ in items if len(s) > 1 for x in s}
        every = len(items) > ITEMS
        for k, (s, _, _) in enumerate(items):
            for x in s:
                last[x] = k
        out, under, k = [], [], 0
        while k < len(items):
            end, j = k, k
            while j <= end:
                for x in items[j][0]:
                    if every or x in grouped or _bare(x) in _FLOW or all(items[i][0] == (x,) for i in range(k, last[x] + 1)):
                        end = max(end, last[x])
                    elif j < len(items) - 1 and items[j + 1][0] == items[j][0]:
                        end = max(end, j + 1)
                j += 1
            if end == k:
                out.append(items[k])
                under.append(below[k])
            else:
                i, u = group(items[k : end + 1], below[k : end + 1])
                out.append(i)
                under.append(u)
            k = end + 1
        items, below = out, under
        if len(items) > ITEMS:
            i, u = group(items, below)
            items, below = [i], [u]
    for k, (s, o, r) in enumerate(items):
        if len(s) > SYMBOLS:
            under = {}
            for x in s:
                if x in below[k]:
                    under = _united(under, {_bare(x): below[k][x]})
            items[k], below[k] = (tuple(sorted({_bare(x) for x in s})), o, r), under
    return Node(items, below)


def inferred(children: list) -> Node:
    """The expression of the children of one element of a page."""
    items, below = [], []
    for c in children:
        symbol = SLOT if isinstance(c, int) else c[0]
        node = {} if isinstance(c, int) else {symbol: inferred(c[1])}
        if items and items[-1][0] == (symbol,):
            items[-1] = ((symbol,), False, True)
            below[-1] = _united(below[-1], node)
        else:
            items.append(((symbol,), False, False))
            below.append(node)
    return _normal(items, below)


def merge(a: Node, b: Node) -> Node:
    """An expression that accepts what either accepts: what they share in order stays, the rest is optional."""
    x, y = a.items, b.items
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
    items, below = [], []
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i][0] == y[j][0]:
            items.append((x[i][0], x[i][1] or y[j][1], x[i][2] or y[j][2]))
            below.append(_united(a.below[i], b.below[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            items.append((x[i][0], True, x[i][2]))
            below.append(a.below[i])
            i += 1
        else:
            items.append((y[j][0], True, y[j][2]))
            below.append(b.below[j])
            j += 1
    return _normal(items, below)


def _outside_value(value: str) -> bool:
    if value in OUTSIDE_WORDS:
        return True
    parts = re.split("[-_]+", value)
    return len(parts) > 1 and (parts[0] in _PART_WORDS or parts[-1] in _PART_WORDS) and not _STATES & set(parts)


def _main_value(value: str) -> bool:
    parts = re.split("[-_]+", value)
    return value in MAIN_WORDS or len(parts) == 2 and parts[0] in MAIN_WORDS and parts[1] in _MAIN_PARTS


def _holds_main(children: list) -> bool:
    todo = list(children)
    while todo:
        c = todo.pop()
        if not isinstance(c, int):
            if _is_main(c[0]):
                return True
            todo += c[1]
    return False


def _is_main(symbol: str) -> bool:
    return symbol in MAIN or symbol.partition("|")[0] in ("div", "section") and "main" in symbol.partition("|")[2].split()


class Slot:
    """A slot's place in the wrapper, and what the elements around it say: whether it is outside, in a main element, in one so named."""

    __slots__ = ("key", "outside", "main", "named")

    def __init__(self, key: str, outside: bool, main: bool, named: bool) -> None:
        self.key, self.outside, self.main, self.named = key, outside, main, named


def slots(page: Page, wrapper: Node) -> list[Slot]:
    """The slots of a page by a wrapper. Where one element may be either of two of the wrapper, the first that
    fits by its symbol counts; if its content doesn't fit, that is placed by its own expression, marked ``?``."""
    out: list[Slot] = [None] * len(page.texts)  # type: ignore[list-item]

    def walk(children: list, node: Node, place: str, outside: bool, main: bool, named: bool) -> None:
        symbols = [SLOT if isinstance(c, int) else c[0] for c in children]
        found = node.match(symbols)
        if found is None:
            symbols = [x if node.at.get(x) else _bare(x) for x in symbols]
            found = node.match(symbols)
        if found is None:
            node = inferred(children)
            place += "?"
            symbols = [SLOT if isinstance(c, int) else c[0] for c in children]
            found = node.match(symbols)
            if found is None:
                symbols = [x if node.at.get(x) else _bare(x) for x in symbols]
                found = node.match(symbols)
            if found is None:  # children that even this doesn't tell apart are items of their own
                node = Node([((x,), False, False) for x in symbols], [{x: inferred([] if isinstance(c, int) else c[1])} for c, x in zip(children, symbols, strict=True)])
                found = list(range(len(children)))
        for c, k, x in zip(children, found, symbols, strict=True):
            if isinstance(c, int):
                out[c] = Slot(f"{place}/{k}#", outside, main, named)
                continue
            name, _, values = c[0].partition("|")
            apart = outside
            if not apart and not _is_main(c[0]):
                apart = name in OUTSIDE and not (name == "header" and main) or any(map(_outside_value, values.split()))
                apart = apart and not _holds_main(c[1])
            walk(c[1], node.below[k][x], f"{place}/{k}{x}", apart, main or _is_main(c[0]), named or any(map(_main_value, values.split())))

    walk(page.root[1], wrapper, "", False, False, False)
    return out


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def main_blocks(page: Page, found: list[Slot], template: frozenset[int] = frozenset(), linked: frozenset[int] = frozenset()) -> list[str]:
    """The blocks of main text. ``template``: hashes of slots and texts of the template; ``linked``: hashes of slots that are lists of links."""
    kept = [i for i, s in enumerate(found) if not s.outside and (s.main or not page.has_main)]
    if not page.has_main:
        named = [i for i in kept if found[i].named]
        if 3 * sum(len(page.texts[i]) for i in named) >= sum(len(page.texts[i]) for i in kept):
            kept = named
    if template or linked:
        kept = [i for i in kept if _hash(f"{found[i].key}\0{page.texts[i]}") not in template and (found[i].main or _hash(found[i].key) not in linked)]
    return [page.texts[i] for i in kept]


@lru_cache(maxsize=512)
def _wrapper(text: str) -> Node:
    return Node.load(json.loads(text))


def _placed(html_text: str, wrapper: str | None) -> tuple[Page, list[Slot]]:
    """A page and its slots by its host's wrapper, or its own."""
    page = Page(html_text)
    return page, slots(page, _wrapper(wrapper) if wrapper else inferred(page.root[1]))


def main_text(page: str, wrapper: str | None = None, template: list[int] | None = None, linked: list[int] | None = None) -> str:
    """The main text of a page, by its host's wrapper and its evidence; without a wrapper by the page alone."""
    return "\n".join(main_blocks(*_placed(page, wrapper), frozenset(template or ()), frozenset(linked or ())))


def dump(node: Node) -> str:
    return json.dumps(node.dump(), ensure_ascii=False, separators=(",", ":"))


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shapes = Counter((h, dump(inferred(Page(p or "").root[1]))) for h, p in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True))
        rows = list(shapes.items())
        yield pa.RecordBatch.from_arrays([pa.array([h for (h, _), _ in rows], pa.string()), pa.array([x for (_, x), _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["host", "shape", "n"])


def _aligned(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
    node: Node | None = None
    for shape in f.sort_values(["n", "shape"], ascending=[False, True])["shape"]:
        one = Node.load(json.loads(shape))
        node = one if node is None else merge(node, one)
    return pd.DataFrame({"host": [key[0]], "shape": [dump(node)], "n": [int(f["n"].sum())]})


def wrappers(pages: DataFrame) -> DataFrame:
    """``pages(host, html)`` -> ``(host, shape, n)``: the wrapper of each host, inferred from all its pages."""
    out = "host string, shape string, n long"
    shapes = pages.select("host", "html").mapInArrow(_shapes, out)
    shapes = materialize(shapes.groupBy("host", "shape").agg(F.sum("n").alias("n")), "html-shapes")
    while True:
        sizes = materialize(shapes.groupBy("host").agg(F.ceil(F.count("*") / ALIGNED).cast("int").alias("parts")), "html-parts")
        most = sizes.agg(F.max("parts")).first()[0] or 1
        part = F.pmod(F.xxhash64("shape"), F.col("parts")).cast("int")
        shapes = materialize(shapes.join(sizes, "host").groupBy("host", part.alias("part")).applyInPandas(_aligned, out), "html-aligned")
        if most == 1:
            return shapes


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["of", "slot", "text", "n", "chars", "links"]
    for batch in batches:
        total: dict[tuple[int, int, int | None], list[int]] = {}
        for of, page, wrapper in zip(*(batch.column(c).to_pylist() for c in ("of", "html", "shape")), strict=True):
            parsed, found = _placed(page or "", wrapper)
            seen = set()
            for i, s in enumerate(found):
                if s.outside or parsed.has_main and not s.main:
                    continue
                slot = _hash(s.key)
                for text in (_hash(f"{s.key}\0{parsed.texts[i]}"), None):
                    x = total.setdefault((of, slot, text), [0, 0, 0])
                    x[0] += (slot, text) not in seen
                    if text is None:
                        x[1] += len(parsed.texts[i])
                        x[2] += parsed.links[i]
                    seen.add((slot, text))
        rows = [(*k, *v) for k, v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)], names)


def evidence(placed: DataFrame) -> DataFrame:
    """``placed(of, html, shape)`` -> ``(of, template, linked)``: for each host the hashes of texts of the template and of lists of links.

    A text is the template's if it is in one slot on nearly all pages that have the slot, while most
    texts of the host are found once; on a host of copies nothing can be told apart.
    """
    e = placed.mapInArrow(_evidence, "of long, slot long, text long, n long, chars long, links long")
    e = materialize(e.groupBy("of", "slot", "text").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "links")]), "html-evidence")
    at = e.where("text is null")
    varied = e.where("text is not null").groupBy("of").agg((2 * F.count("*") >= F.sum("n")).alias("varied")).where("varied").select("of")
    pages = at.where(F.col("n") >= LEAST).select("of", "slot", F.col("n").alias("pages"))
    same = e.where(F.col("text").isNotNull() & (F.col("n") >= LEAST)).join(pages, ["of", "slot"]).where(F.col("n") >= SAME * F.col("pages")).join(varied, "of", "left_semi")
    template = same.groupBy("of").agg(F.collect_list("text").alias("template"))
    linked = at.where((F.col("n") >= LEAST) & (F.col("links") >= LINKED * F.col("chars"))).groupBy("of").agg(F.collect_list("slot").alias("linked"))
    return template.join(linked, "of", "full")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("html", "shape", "template", "linked"))
        texts = [main_text(p or "", w, t, k) for p, w, t, k in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


#: Characters of wrappers that are broadcast, at most.
_BROADCAST_CHARS = 4_000_000


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> ``(page_id, url, text, n_chars)``, one row for each row.

    Blocks are joined by a line feed; inside a block character references are decoded and white
    space is one space. A null html is empty, and so is the text of a page without main text. Pages
    whose url is null or has no host share one wrapper. Repeated rows are extracted alike; an empty
    table gives an empty result; extra columns don't matter.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    p = p.withColumn("of", F.xxhash64("host"))
    w = materialize(wrappers(p).select(F.xxhash64("host").alias("of"), "shape"), "html-wrappers")
    beside = lambda w: F.broadcast(w) if (w.agg(F.sum(F.length("shape"))).first()[0] or 0) <= _BROADCAST_CHARS else w
    seen = evidence(p.select("of", "html").join(beside(w), "of", "left"))
    w = materialize(w.join(seen, "of", "left"), "html-evidence")
    both = p.join(beside(w), "of", "left").select("page_id", "url", "html", "shape", "template", "linked")
    return both.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
