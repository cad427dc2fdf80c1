"""Main text of web pages by template deduction over the pages of each host.

Tokens of a page are its elements, told apart by their place (the path of names with the number among like siblings), and
its texts, told apart by path and hash. Each token's occurrences over the pages of a host form a vector; tokens
with equal vectors form an equivalence class. Vectors are summed to fingerprints where pages are read, so that no
host's pages ever meet in one task. Classes whose tokens stand once on each of their pages make up the host's template:
those on nearly every page, and those on fewer that have elements of their own, as another form of page has, and none of running text. Elements
of the template that stand in elements of the template are nested; what remains between its tokens are slots. The deepest
nested container that holds most of what the slots of the host hold is the main slot: a page's text is what this page has
in it, less the template's texts. Names of elements and classes only break ties: parts that say of themselves that they are a menu,
a form or reader comments do not count as slots. Hosts with too few pages to deduce a template are read by these names alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, drop, rows_of, ship, slices

#: Elements that never hold article text, and words in class or id names of such parts.
APART = frozenset("head nav header footer aside form script style noscript template iframe svg button select option textarea menu dialog object canvas audio video title".split())
APART_WORD = re.compile(r"ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|sidebar\w*|side|nav\w*|menu\w*|breadcrumb\w*|header|masthead|topbar|footer\w*|foot|bottom|comment\w*|disqus\w*|replies|respond|reader\w*|cookie\w*|consent|notice\w*|alert|popup|modal|overlay|newsletter|subscribe\w*|signup|login|share\w*|sharing|social\w*|related\w*|recommend\w*|widget\w*|pagination|pager|toolbar|skip\w*|legal|copyright|disclaimer|tags?|taxonomy|search\w*|form", re.IGNORECASE)
SEPARATORS = re.compile(r"[\s_-]+")
#: Names that are wholly of such words set an element apart. A name with such a word among others does so only to elements that
#: neither hold the main article nor lie inside one. Names of headings, and ids of other elements than these, are often made from article text and count
#: as the latter do.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ID_HOLDERS = frozenset("div ul ol table".split())
#: Words that set an element apart inside an article too, if one of them is a word of its name. Others may well name a part of the article.
PLAIN_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos sidebar sidebars nav navbar menu menus breadcrumb breadcrumbs comment comments disqus cookie cookies consent popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations pagination pager toolbar".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDER = frozenset("article body div main section td center".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body table article section div main ul ol dl nav aside header footer form blockquote td th li".split())
MARKUP = re.compile(r"<(?:(!--)|(!\[CDATA\[)|[!?]|(/?)([a-zA-Z][^\s/<>]*))")
IN_TAG = re.compile(r"[<>\"']")
NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
#: A class belongs to the template if it is on this part of a host's pages; if on no more than a form's part of them, only with
#: elements of its own and none of running text. Classes and hosts with fewer pages show no template.
SUPPORT, FORM, LEAST_PAGES = 0.9, 0.1, 4
#: Tokens of a class at least.
LEAST_TOKENS = 3
#: The main slot holds this part of what all slots of the host hold, and links make up no more than ``MOST_LINKS`` of it.
MAIN_PART, MOST_LINKS = 0.6, 0.5
#: A page of which the texts of a form leave less than this part is one of many copies of an article: they stay.
COPY_PART = 0.25
#: Templates of up to so many texts in all (8 bytes each, and 64 bytes a host) are broadcast.
BROADCAST_TEXTS = 2_000_000
ELEMENT, HOLDER_ELEMENT, TEXT, PAGE, PROSE_ELEMENT = range(5)
#: Elements of running text: a class with one of them may be a passage that articles share, and is no advert.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figure table".split())
#: Elements at which a search for an open paragraph, item or cell looks; end tags reach no further than these.
STOPS = SCOPE | {"p"}.union(*SAME.values())
FENCES = frozenset(("article", "main", "body"))
OUTER = FENCES | {"html"}


class Element:
    """An element, with the nearest of its line (itself included) that is told apart by name, ends a search, or can hold a text."""

    __slots__ = ("apart", "depth", "hidden", "holder", "inside", "kids", "link", "loose", "name", "odd", "parent", "path", "seen", "spot", "stop", "text", "within")

    def __init__(self, name: str, label: str, parent: Element | None, apart: bool, loose: bool = False):
        self.name, self.parent, self.apart, self.loose = name, parent, apart, loose
        self.text = self.link = 0
        self.hidden = False
        self.kids: list[Element | str] = []
        self.seen: dict[str, int] | None = None
        self.odd: Element | None = self
        self.stop = self.holder = self
        if parent is None:
            self.path = self.spot = self.depth = 0
            self.inside = self.within = False
            self.odd = None
        else:
            self.odd = self if apart or loose else parent.odd
            self.stop = self if name in STOPS else parent.stop
            self.holder = self if name in HOLDER else parent.holder
            if parent.seen is None:
                parent.seen = {}
            k = parent.seen[label] = parent.seen.get(label, -1) + 1
            self.depth = parent.depth + 1
            self.within = parent.within or parent.name == "article"
            self.inside = self.within or parent.inside or parent.name == "main"
            self.path = xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), parent.path) >> 1 or 1
            self.spot = xxhash.xxh3_64_intdigest(f"{k} {label}".encode("utf-8", "surrogatepass"), parent.spot) >> 1 or 1


def _apart(name: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether an element is set apart from article text, whether a part of its names says so, and the name it has in paths.

    ``inside`` an article only the plain names set apart, and a header's headings stay (:func:`blocks`).
    """
    apart, loose, label = name in APART, False, name
    if attributes.strip():
        for key, *values in NAMES.findall(attributes):
            value, key = "".join(values), key.lower()
            if key in ("class", "id"):
                if name not in ("body", "html", "article", "main"):
                    for words in (SEPARATORS.split(n.lower()) for n in value.split()):
                        told = [bool(APART_WORD.fullmatch(w)) for w in words if w]
                        loose |= any(told)
                        if all(told) and told and name not in HEADINGS and (key == "class" or name in ID_HOLDERS):
                            apart |= not inside or not PLAIN_WORDS.isdisjoint(words)
                if value and key == "class":
                    label = f"{name}.{value.split()[0]}" if value.split() else name
            elif key == "role":
                apart |= value.lower() in APART_ROLES
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE)):
                apart |= name not in ("html", "body")
    return apart, loose and not apart, label


class Tags:
    """Ends of tags: the first ``>`` outside quotes. What was found to have none is not looked at again, so all searches together take time by the page's length."""

    def __init__(self, page: str):
        self.page, self.endless = page, set()
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def end(self, at: int) -> int:
        """The place of the end of a tag whose name ends at ``at``; -1 if there is none."""
        page, passed = self.page, [at]
        while at <= self.last[">"]:
            m = IN_TAG.search(page, at)
            c, at = m[0], m.end()
            if c == ">":
                return m.start()
            if c == "<":
                if at in self.endless:
                    break
                passed.append(at)
            elif at > self.last[c]:
                break
            else:
                at = page.index(c, at) + 1
        self.endless.update(passed)
        return -1


def parse(page: str) -> Element:
    """The tree of a page; unknown or unclosed markup never fails. Character references are decoded. Takes time by the page's length, whatever it holds."""
    root = now = Element("", "", None, False)
    tags, last_close = Tags(page), {}
    opened = [Counter()]  # names that an end tag may close, by the articles and the like around it
    at = begin = 0
    n = len(page)

    def back_to(e: Element) -> None:
        nonlocal now
        while now is not e:
            if now.name in FENCES:
                opened.pop()
            opened[-1][now.name] -= 1
            now = now.parent

    def closed_later(name: str) -> bool:
        if name not in last_close:
            last_close[name] = page.rfind(f"</{name}")
        return last_close[name] >= at

    while at < n:
        m = MARKUP.search(page, at)
        if not m:
            break
        start, name = m.start(), (m[4] or "").lower()
        if name:
            end = tags.end(m.end())
            if end < 0:
                at = start + 1
                continue
        else:
            close = "-->" if m[1] else "]]>" if m[2] else ">"
            end = page.find(close, m.end())
        if start > begin:
            now.kids.append(html.unescape(page[begin:start]))
        if not name:
            at = begin = n if end < 0 else end + len(close)
            if m[2]:
                now.kids.append(page[m.end() : n if end < 0 else end])
            continue
        attributes = page[m.end() : end]
        at = begin = end + 1
        if m[3]:
            level = opened if name in OUTER else opened[-1:]
            if any(o[name] > 0 for o in level):
                up = now
                while up.name != name:
                    up = up.parent
                back_to(up.parent)
            continue
        if name in ("article", "main") and (up := now.odd) and up.name not in ("aside", "nav", "footer") and not closed_later(up.name):
            back_to(up.parent)  # an unclosed part that is set apart does not swallow the article
        if name in CLOSES_P or name in SAME:
            up, same = now.stop, SAME.get(name, ())
            while up.parent and up.name not in SCOPE and up.name != "p" and up.name not in same:
                up = up.parent.stop
            if up.parent and ((up.name == "p" and name in CLOSES_P) or up.name in same):
                back_to(up.parent)
        apart, loose, label = _apart(name, attributes, now.inside or now.name in ("article", "main"))
        child = Element(name, label, now, apart, loose)
        now.kids.append(child)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = begin = close.end() if close else n
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            now = child
            opened[-1][name] += 1
            if name in FENCES:
                opened.append(Counter())
    if begin < n:
        now.kids.append(html.unescape(page[begin:]))
    return root


def measure(e: Element, apart: bool = False, link: bool = False) -> None:
    """Sets on each element whether it is in a part set apart, and the characters of article-like text and of links below it."""
    stack = [(e, apart, link, False)]
    while stack:
        e, apart, link, done = stack.pop()
        if done:
            for kid in e.kids:
                if isinstance(kid, Element):
                    e.text += kid.text
                    e.link += kid.link
            continue
        e.text = e.link = 0
        e.hidden = apart = apart or e.apart
        link = link or e.name == "a"
        stack.append((e, apart, link, True))
        for kid in e.kids:
            if isinstance(kid, Element):
                stack.append((kid, apart, link, False))
            elif not apart:
                size = len(kid.split()) and len(kid.strip())
                e.text += size
                e.link += size * link


def walk(e: Element) -> Iterator[tuple[Element, str | None]]:
    """All elements in page order with None, and their texts."""
    stack: list[tuple[Element, Element | str]] = [(e, e)]
    while stack:
        owner, x = stack.pop()
        if isinstance(x, str):
            yield owner, x
        else:
            yield x, None
            stack += [(x, k) for k in reversed(x.kids)]


def settle(root: Element) -> None:
    """Sets elements apart by parts of their names, and sizes all elements.

    An element with such a name stays if it lies in an article or holds the main article: the longest, with half of the page's
    text at least. On a page without articles it stays if it holds half of the page's text.
    """
    measure(root)
    elements = [e for e, text in walk(root) if text is None and e.loose]
    if not elements:
        return
    articles = [e for e, text in walk(root) if text is None and e.name in ("article", "main") and e.text and not e.hidden]
    main = max(articles, key=lambda e: e.text, default=None)
    held = set()
    while main and (held or 2 * main.text >= root.text):
        held.add(id(main))
        main = main.parent
    for e in elements:
        e.apart = not (e.inside or id(e) in held or (not articles and 2 * e.text >= root.text > 0))
    measure(root)


def text_token(path: int, text: str) -> int:
    """The token of a text: of one size whatever its length."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), path) >> 1


def blocks(main: Element, template: frozenset[int], forms: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks below ``main`` in page order, without parts set apart and texts of ``forms``.

    Blocks of nothing but the template's texts are cut before the first other block and behind the last, never between others; headings
    that stand right before the first other block are its own. Of a header inside an article the headings stay.
    """
    out: list[tuple[str, bool, bool]] = []  # text, whether the template's, whether a heading
    line: list[str] = []
    own = False
    around = [False]

    def flush() -> None:
        nonlocal own
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append((text, not own, around[-1]))
        own = False

    stack: list[Element | tuple[int, str] | None] = [main]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
            around.pop()
        elif isinstance(x, tuple):
            owner, text = x
            if template or forms:
                plain = " ".join(text.split())
                token = text_token(owner, plain)
                if token in forms:
                    continue
                own = own or (plain != "" and token not in template)
            else:
                own = True
            line.append(text)
        elif x.apart and x is not main:
            line.append(" ")
            if x.name == "header" and x.inside:
                stack += reversed([e for e, text in walk(x) if text is None and e.name in HEADINGS])
        elif x.name == "br":
            line.append("\n")
        else:
            if x.name in BLOCK:
                flush()
                stack.append(None)
                around.append(x.name in HEADINGS)
            stack += [(x.path, k) if isinstance(k, str) else k for k in reversed(x.kids)]
    flush()
    others = [i for i, (_, fixed, _) in enumerate(out) if not fixed]
    if not others:
        return []
    first = others[0]
    while first and out[first - 1][2]:
        first -= 1
    return [text for text, _, _ in out[first : others[-1] + 1]]


def tokens_of(root: Element) -> dict[tuple[int, int], list[int]]:
    """The tokens of a page: ``(token, kind)`` with parent's place, depth, times, text and link characters."""
    own: dict[tuple[int, int], list[int]] = {(0, PAGE): [0, 0, 1, 0, 0]}
    for e, text in walk(root):
        if text is None:
            if e.parent:
                own[e.spot, HOLDER_ELEMENT if e.name in HOLDER else PROSE_ELEMENT if e.name in PROSE else ELEMENT] = [e.parent.spot, e.depth, 1, e.text, e.link]
        elif t := " ".join(text.split()):
            x = own.setdefault((text_token(e.path, t), TEXT), [e.spot, e.depth, 0, 0, 0])
            x[0] = min(x[0], e.spot)
            x[2] += 1
            x[3] += len(text.strip()) if e.text else 0  # nothing below a part set apart counts
    return own


PROFILE = {"host": "string", "token": "long", "kind": "int", "up": "long", "depth": "int", "pages": "long", "times": "long", "v1": "long", "v2": "long", "seen1": "long", "seen2": "long", "text": "long", "link": "long"}


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of each token by host: pages, occurrences, two halves of the vector's fingerprint, marks of distinct pages, sizes.

    The marks are bit sets: a page sets the same bit of each however often its row is repeated.
    """
    sums: dict[tuple[str, int, int], list[int]] = {}
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 8]

    def rows():
        keys, values = list(sums), list(sums.values())
        cols = [[k[i] for k in keys] for i in range(3)] + [[v[i] for v in values] for i in range(10)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], list(PROFILE))

    for batch in slices(batches):
        for host, key, page in rows_of(batch, "host", "key", "html"):
            page = page or ""
            root = parse(page)
            settle(root)
            name = f"{key} {xxhash.xxh3_128_hexdigest(page.encode('utf-8', 'surrogatepass'))}"
            mark = xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"))
            m1, m2 = 1 << mark % 63, 1 << (mark >> 32) % 61
            for (token, kind), (up, depth, times, chars, link) in tokens_of(root).items():
                v = xxhash.xxh3_64_intdigest(times.to_bytes(8, "little"), mark)
                s = sums.get((host, token, kind))
                if s is None:
                    sums[host, token, kind] = [up, depth, 1, times, v >> 32, v & 0xFFFFFFFF, m1, m2, chars, link]
                else:
                    if up < s[0]:
                        s[0] = up
                    s[2] += 1
                    s[3] += times
                    s[4] += v >> 32
                    s[5] += v & 0xFFFFFFFF
                    s[6] |= m1
                    s[7] |= m2
                    s[8] += chars
                    s[9] += link
            if len(sums) >= 100_000:
                yield rows()
                sums.clear()
    yield rows()


def template(tokens: list[tuple[int, ...]], pages: int) -> tuple[int, list[int], list[int]]:
    """The place of the main slot of a host, its template's texts and those of forms that part of the pages have.

    ``tokens`` are ``(token, kind, up, depth, pages, v1, v2, text, link)``, each once on each of its pages. A class is valid if it
    has three tokens or more and is on nearly all pages or has elements; an element on nearly all pages is nested
    if its parent is. No nested container gives the place 0.
    """
    classes: dict[tuple[int, int, int], list] = {}
    for t in tokens:
        classes.setdefault(t[4:7], []).append(t)
    valid = [t for members in classes.values() if len(members) >= LEAST_TOKENS and (members[0][4] >= SUPPORT * pages or any(t[1] != TEXT for t in members)) for t in members]
    fixed = [t for t in valid if t[1] == TEXT]
    nested = {0}
    for t in sorted((t for t in valid if t[1] != TEXT and t[4] >= SUPPORT * pages), key=lambda t: t[3]):
        if t[2] in nested:
            nested.add(t[0])
    place = {t[0]: t for t in tokens if t[1] != TEXT}
    rest = {p: t[7] for p, t in place.items()}
    for t in fixed:
        at = t[2]
        while at in rest:
            rest[at] -= t[7]
            at = place[at][2]
    whole = max((rest[p] for p in nested if p in rest), default=0)
    best, depth = 0, 0
    for p in sorted(nested & rest.keys()):
        t = place[p]
        if t[1] == HOLDER_ELEMENT and rest[p] >= MAIN_PART * whole and rest[p] > 0 and t[8] <= MOST_LINKS * t[7] and t[3] > depth:
            best, depth = p, t[3]
    prose = {t[4:7] for t in valid if t[1] == PROSE_ELEMENT}
    return best, sorted(t[0] for t in fixed if t[4] >= SUPPORT * pages), sorted(t[0] for t in fixed if t[4] < SUPPORT * pages and t[4:7] not in prose)


def main_parts(root: Element, spot: int) -> list[Element]:
    """The elements that hold a page's main text, in page order.

    Under a template the element at the place of the main slot; if that is an article, with the articles beside it, and if
    articles hold most of it, these. Without one, or where a page lacks that place: all articles, else ``main``, else the
    holder with most text of its own.
    """
    elements = [e for e, text in walk(root) if text is None and e.parent and not e.hidden]
    articles = [e for e in elements if e.name == "article" and e.text and not e.within]
    at = next((e for e in elements if e.spot == spot and e.text), None) if spot else None
    if at:
        if at.name == "article":
            return [e for e in articles if e.parent is at.parent and not e.loose] or [at]
        inner = [e for e, text in walk(at) if text is None and e.name == "article" and e.text and not e.within and not e.hidden]
        return inner if sum(e.text for e in inner) >= MAIN_PART * at.text else [at]
    if articles:
        return articles
    mains = [e for e in elements if e.name == "main" and e.text]
    if mains:
        return [max(mains, key=lambda e: e.text)]
    own: dict[int, int] = {}
    for e in elements:
        if e.name == "p" or e.name in HOLDER:
            up = e.parent.holder if e.name == "p" else e
            direct = e.text - e.link if e.name == "p" else sum(len(k.strip()) for k in e.kids if isinstance(k, str))
            own[id(up)] = own.get(id(up), 0) + direct
    holders = [e for e in elements if own.get(id(e))]
    return [max(holders, key=lambda e: own[id(e)])] if holders else [root] if root.text else []


def extract(page: str | None, spot: int = 0, texts: frozenset[int] = frozenset(), forms: frozenset[int] = frozenset()) -> str:
    """Main text of one page under a host's template.

    An ``article`` or ``main`` that the template would leave empty is kept: it is one of many copies, not a part of the template.
    So is a page's text of which the ``forms`` would leave less than :data:`COPY_PART`.
    """
    root = parse(page or "")
    settle(root)
    mains = main_parts(root, spot)
    for main in mains:
        if main.parent and main.name not in ("body", "html"):  # parts of names do not count in the main text's own element
            for e, text in walk(main):
                if text is None and e.loose:
                    e.apart = False
    out = [b for m in mains for b in blocks(m, texts)]
    if forms:
        less = [b for m in mains for b in blocks(m, texts, forms)]
        if sum(map(len, less)) >= COPY_PART * sum(map(len, out)):
            out = less
    if not out and any(m.name in ("article", "main") for m in mains):
        out = [b for m in mains for b in blocks(m, frozenset())]
    return "\n\n".join(out)


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        out = {"host": [], "spot": [], "texts": [], "forms": []}
        for host, pages, tokens in rows_of(batch, "host", "pages", "tokens"):
            found = template([tuple(t.values()) for t in tokens], pages)
            for name, value in zip(out, (host, *found), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out["host"], pa.string()), pa.array(out["spot"], pa.int64()), pa.array(out["texts"], pa.list_(pa.int64())), pa.array(out["forms"], pa.list_(pa.int64()))], list(out))


@lru_cache(64)
def _texts_set(texts: tuple[int, ...]) -> frozenset[int]:
    return frozenset(texts)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        out = []
        for page, spot, texts, forms in rows_of(batch, "html", "spot", "texts", "forms"):
            out.append(extract(page, spot or 0, _texts_set(tuple(texts or ())), _texts_set(tuple(forms or ()))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def deduced(pages: DataFrame) -> DataFrame:
    """The template of each host of ``host, key, html``: ``host, spot, texts, forms``; hosts without one have no row.

    Only tokens on a tenth of a host's pages or more are gathered, so a host's are no more than those of ten pages.
    """
    profile = ", ".join(f"{n} {t}" for n, t in PROFILE.items())
    add = [F.sum(c).alias(c) for c in ("pages", "times", "v1", "v2", "text", "link")] + [F.bit_or(c).alias(c) for c in ("seen1", "seen2")]
    sums = pages.mapInArrow(_profiles, profile).groupBy("host", "token", "kind").agg(F.min("up").alias("up"), F.min("depth").alias("depth"), *add)
    often = F.greatest(F.bit_count("seen1"), F.bit_count("seen2")) >= LEAST_PAGES
    tokens = cut(sums.where(often & (F.col("pages") == F.col("times"))).drop("times", "seen1", "seen2"), "page-tokens")
    most = tokens.where(F.col("kind") == PAGE).select("host", F.col("pages").alias("all"))
    common = tokens.where(F.col("kind") != PAGE).join(most, "host").where(F.col("pages") >= FORM * F.col("all"))
    row = F.struct("token", "kind", "up", "depth", "pages", "v1", "v2", "text", "link")
    found = common.groupBy("host").agg(F.max("all").alias("pages"), F.collect_list(row).alias("tokens")).select("host", "pages", "tokens")
    out = cut(found.mapInArrow(_templates, "host string, spot long, texts array<long>, forms array<long>"), "templates")
    drop(tokens)
    return out


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: ``page_id, url, text, n_chars``; blocks in page order, two line ends between them.

    Templates come from all pages of a host, deduced in one pass that shuffles sums of tokens, never pages. They are
    broadcast up to a counted size; beyond it pages and the written templates are joined by host, two plain shuffles, of
    which Spark splits the hot hosts.

    Cases: null or empty html, or html without text, has empty text; a null url is a host of its own; null and repeated ids and
    rows pass through, and repeated rows count as one page where pages are counted; hosts with fewer than four distinct
    pages have no template and are read by their elements alone; other columns are not read.
    """
    ship(pages.sparkSession)
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col).cast("string")), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    found = deduced(base.select("host", F.concat_ws(" ", F.col("page_id").cast("string"), "url").alias("key"), "html"))
    size = found.agg(F.sum(F.size("texts") + F.size("forms") + 8).alias("n")).first()["n"] or 0
    if size <= BROADCAST_TEXTS:
        found = F.broadcast(found)
    return base.join(found, "host", "left").select("page_id", "url", "html", "spot", "texts", "forms").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
