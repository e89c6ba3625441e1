"""Main text of web pages by equivalence-class template deduction.

Pages of a host are compared in groups of bounded size. Every page is a sequence of tokens: opening tags
with the path of elements around them, and words of short texts with their path. Tokens that occur equally
often on every page of a group (the same occurrence vector) form an equivalence class. A class is valid
if it is frequent, has several tokens, and these stand in the same order on every page. The class that
occurs once everywhere is the skeleton of the template; other valid classes nest between two
neighbours of it (menus, lists). What no class holds is data. The element of the skeleton that holds nearly all
text outside the page furniture locates the main text; unless it is an article or main element, the slot
is the lowest element around it that holds all data outside the furniture.

Furniture is told by element (nav, footer, form, ...) and by class, id or role (sidebar, advert, cookie, ...), on headings
by element only. An id inside the slot does not tell it if the element is not of the template. Such a mark says nothing on
an element that holds nearly all text of the page, or the article itself (``Page._void``); if marks leave no text at all,
the widest are taken back. All other text inside the slot stays, also what stands on every page.
A host with too few pages has no classes; there the slot is found by the same measure on the page alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens.llm import common
from harvestlens.session import cut

GROUP = 64  # pages of a host compared together, about
LARGE_HOSTS = 100_000  # hosts of more than a group that are broadcast, at most (a few MB)
SUPPORT = 3  # different pages that a class needs
SHARE = 0.8  # of the text that the element locating the main text must hold
LITTLE = 0.05  # of the text outside of all marks, at most, where a mark on nearly all of it says nothing
SHORT = 12  # words of a text that count as tokens one by one

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Fixed sets of HTML element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe noembed noframes textarea title xmp".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split())
_NEVER_TEXT = frozenset(
    "button select option input head svg object embed canvas audio video map fieldset datalist".split()) | _RAW
_FURNITURE_TAGS = frozenset("nav footer aside form dialog menu".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
             "tfoot": {"tbody", "tr", "td", "th"}}
# Words in class, id and role that mark furniture.
_FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent notice notices gdpr alert popup "
    "modal overlay newsletter subscribe subscription signup login search share sharing social comment comments disqus replies "
    "respond related recommended recommendations toolbar topbar skip pagination pager tags complementary contentinfo "
    "discussion feedback".split())
_READERS = frozenset("comment comments disqus replies respond".split())  # of these, those that hold readers' comments
_PROSE = frozenset("header discussion feedback".split())  # may be parts of an article inside article and main
_OF_ARTICLE = frozenset("entry post article story".split())  # in one name with "header": the head of an article
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ARTICLE_HEADERS = frozenset(("article", "main"))


def _marks(attributes: str, inside: bool) -> tuple[str, set[str], set[str], bool]:
    """The class and id of an element, the furniture words of its class and role and of its id, whether it is hidden.

    ``inside`` tells that the element stands in an article or main element.
    """
    names, by_class, by_id, hidden = [], set(), set(), False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            names.append(value.lower())
            for one in value.lower().split():
                words = set(re.split(r"[^a-z]+", one))
                found = _FURNITURE & words
                if inside:
                    found -= _PROSE
                if words & _OF_ARTICLE:
                    found -= {"header"}
                if name == "id":
                    by_id |= found
                else:
                    by_class |= found
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(
                r"display\s*:\s*none", value, re.I):
            hidden = True
    return "." + "|".join(names) if names else "", by_class, by_id, hidden


class Element(NamedTuple):
    """An open element."""

    tag: str
    name: str  # tag with class and id
    never: bool  # whether nothing in it is text for readers
    marks: tuple[int, ...]  # numbers of the marks of furniture on it and around it
    ids: tuple[tuple, ...]  # for marks by id: number, path of the block, path of the element
    anchors: tuple[int, ...]  # numbers of the article and main elements around it


NOTHING = Element("", "", False, (), (), ())


class Page:
    """The blocks of text of a page and the tokens around them."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, ...]] = []
        self.blocks: list[tuple[tuple[str, ...], bool, str]] = []  # path, whether furniture, text
        self.doubtful: list[tuple] = []  # for each block that is furniture by ids only, the elements with these
        self._stack: list[Element] = []
        self._text: list[str] = []
        self._found: list[tuple[tuple[str, ...], Element, str]] = []  # path, element around, text
        self._kinds: list[str] = []  # of each mark: tag, form, class, id or readers
        self._anchors: list[tuple[str, tuple[int, ...]]] = []  # tag, marks around
        self._read(source)
        void = self._void()
        for path, around, text in self._found:
            ids = tuple((block, element) for mark, block, element in around.ids if mark not in void)
            marked = around.never or any(m not in void for m in around.marks)
            self.blocks.append((path, marked or bool(ids), text))
            self.doubtful.append(() if marked else ids)

    def _void(self) -> set[int]:
        """Marks that say nothing: on elements around the article, on nearly all text, or on all that could remain.

        The article is the largest main element, or article element if there is none, that is not among readers' comments
        and holds as much text as stands outside all marks. A mark of readers' comments is never void, one by
        the name of the element only around the article. Without such an article, marks on nearly all text are void if
        hardly any text stands outside of marks.
        """
        marked, anchored, free, total = Counter(), Counter(), 0, 0
        for _, around, text in self._found:
            if not around.never:
                all_marks = {*around.marks, *(i[0] for i in around.ids)}
                total += len(text)
                free += len(text) if not all_marks else 0
                for m in all_marks:
                    marked[m] += len(text)
                for a in around.anchors:
                    anchored[a] += len(text)
        fair = [a for a, (_, marks) in enumerate(self._anchors) if not any(self._kinds[m] == "readers" for m in marks)]
        fair = [a for a in fair if self._anchors[a][0] == "main"] or fair
        void: set[int] = set()
        if fair:
            best = max(fair, key=lambda a: (anchored[a], -a))
            if anchored[best] >= free:
                void |= set(self._anchors[best][1])
        loose = [m for m, kind in enumerate(self._kinds) if kind in ("class", "id", "form")]
        if not any(anchored[a] and void.issuperset(self._anchors[a][1]) for a in fair) and free <= LITTLE * total:
            void |= {m for m in loose if marked[m] >= SHARE * total}

        def remains() -> bool:
            return any(not e.never and all(m in void for m in e.marks) and all(i[0] in void for i in e.ids) for _, e, _ in self._found)

        for m in sorted(loose, key=lambda m: (-marked[m], m)):
            if remains():
                break
            void.add(m)
        return void

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text = []
        if text:
            block = tuple(e.name for e in self._stack if e.tag not in _INLINE)
            self._found.append((block, self._stack[-1] if self._stack else NOTHING, text))
            words = text.split(" ")
            self.tokens += [(*block, "#", w) for w in words] if len(words) <= SHORT else [(*block, "#", text)]

    def _pop(self, depth: int) -> None:
        del self._stack[depth:]

    def _mark(self, kind: str) -> int:
        self._kinds.append(kind)
        return len(self._kinds) - 1

    def _open(self, tag: str, attributes: str) -> None:
        if tag in _CLOSES_P:
            places = [i for i, e in enumerate(self._stack) if e.tag == "p"]
            if places:
                self._pop(places[-1])
        if tag in _SIBLINGS:
            for i in range(len(self._stack) - 1, -1, -1):
                if self._stack[i].tag in _SIBLINGS[tag]:
                    self._pop(i)
                    break
                if self._stack[i].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        outer = self._stack[-1] if self._stack else NOTHING
        name, by_class, by_id, hidden = _marks(attributes, bool(outer.anchors)) if attributes.strip() else ("", set(), set(), False)
        if tag in ("html", "body", "main", "article") or tag in _HEADINGS:
            by_class, by_id = set(), set()  # a theme's class names on the whole page, and ids made from a title, say nothing
        if tag in _VOID:
            self.tokens.append((*(e.name for e in self._stack), tag + name))
            return
        marks, ids, anchors = outer.marks, outer.ids, outer.anchors
        if by_class:
            marks = (*marks, self._mark("readers" if by_class & _READERS else "class"))
        elif tag in _FURNITURE_TAGS or tag == "header" and not anchors:
            marks = (*marks, self._mark("form" if tag == "form" else "tag"))
        if tag in _ARTICLE_HEADERS:
            self._anchors.append((tag, (*marks, *(i[0] for i in ids))))
            anchors = (*anchors, len(self._anchors) - 1)
        path = (*(e.name for e in self._stack), tag + name)
        if by_id:
            block = tuple(e.name for e in self._stack if e.tag not in _INLINE) + ((tag + name,) if tag not in _INLINE else ())
            ids = (*ids, (self._mark("readers" if by_id & _READERS else "id"), block, path))
        self._stack.append(Element(tag, tag + name, outer.never or hidden or tag in _NEVER_TEXT, marks, ids, anchors))
        self.tokens.append(path)

    def release(self, main: tuple[str, ...], known: set[tuple[str, ...]]) -> None:
        """What only ids mark as furniture is text where these stand inside the slot and are not of the template."""
        for i, elements in enumerate(self.doubtful):
            if elements and all(e[:len(main)] == main and len(e) > len(main) and path not in known for e, path in elements):
                self.blocks[i] = self.blocks[i][0], False, self.blocks[i][2]

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            start = source.find("<", at)
            if start < 0:
                self._text.append(html.unescape(source[at:]))
                break
            if start > at:
                self._text.append(html.unescape(source[at:start]))
            found = _TAG.match(source, start)
            if found is None:
                cut_off = source.find(">", start) < 0 and source[start + 1:start + 2].strip("/!?").isalpha()
                if cut_off:  # the page ends inside a tag
                    break
                self._text.append("<")
                at = start + 1
                continue
            at = found.end()
            if found[2] is None:
                continue
            tag = found[2].lower()
            if found[1]:
                places = [i for i, e in enumerate(self._stack) if e.tag == tag]
                if tag not in _INLINE:
                    self._flush()
                if places:
                    self._pop(places[-1])
                continue
            if tag not in _INLINE:
                self._flush()
            self._open(tag, found[3])
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else size
                self._pop(len(self._stack) - 1)
        self._flush()


def template(pages: list[Page]) -> tuple[set[tuple[str, ...]], set[tuple[str, ...]]]:
    """Tokens that stand once on every page in the same order, and tokens of valid classes nested between them."""
    if len(pages) < SUPPORT:
        return set(), set()
    counts = [Counter(p.tokens) for p in pages]
    support = Counter(t for c in counts for t in c)
    classes: dict[tuple[int, ...], list[tuple[str, ...]]] = defaultdict(list)
    for token, n in support.items():
        if n >= max(SUPPORT, len(pages) / 2):
            classes[tuple(c[token] for c in counts)].append(token)
    first = [{t: i for i, t in reversed(list(enumerate(p.tokens)))} for p in pages]
    skeleton = _ordered(classes.pop(tuple([1] * len(pages)), []), first)
    place = [sorted(f[t] for t in skeleton) for f in first]
    nested: set[tuple[str, ...]] = set()
    for vector, tokens in classes.items():
        if len(tokens) < 2:
            continue
        own = _ordered(tokens, [f for f, n in zip(first, vector, strict=True) if n])
        gaps = {tuple(int(np.searchsorted(places, f[t])) for f, places, n in zip(first, place, vector, strict=True) if n)
                for t in own}
        if len(own) > 1 and all(len(set(g)) == 1 for g in gaps):
            nested |= set(own)
    return set(skeleton), nested


def _ordered(tokens: list[tuple[str, ...]], first: list[dict]) -> list[tuple[str, ...]]:
    """Tokens of a class in the order of the first page, without those that stand elsewhere on another page."""
    if not tokens or not first:
        return []
    tokens = sorted(tokens, key=first[0].__getitem__)
    rank = np.array([[f[t] for t in tokens] for f in first])
    good = np.ones(len(tokens), bool)
    for row in rank:  # a token is out of order if an earlier one stands behind it
        good &= row >= np.maximum.accumulate(row)
    return [t for t, g in zip(tokens, good, strict=True) if g]


def slot(blocks: list[tuple[tuple[str, ...], bool, str]], allowed: set[tuple[str, ...]] | None) -> tuple[str, ...]:
    """The deepest element that holds ``SHARE`` of the text outside the furniture."""
    size: Counter = Counter()
    total = 0
    for path, furniture, text in blocks:
        if not furniture:
            total += len(text)
            for depth in range(1, len(path) + 1):
                size[path[:depth]] += len(text)
    named = [p for p in size if p[-1].split(".")[0] in ("article", "main")]
    found: tuple[str, ...] = ()
    for path, n in size.items():
        if n >= SHARE * total and len(path) > len(found) and (allowed is None or path in allowed):
            found = path
    for path in named:  # the author's own mark, unless the text lies elsewhere
        if len(path) < len(found) and found[:len(path)] == path:
            found = path
            break
    return found


def widened(found: tuple[str, ...], blocks: list[tuple[tuple[str, ...], bool, str]], known: set[tuple[str, ...]]) -> tuple[str, ...]:
    """The lowest element around ``found`` that holds all text outside the furniture that is not of the template."""
    if any(name.split(".")[0] in _ARTICLE_HEADERS for name in found):
        return found
    for path, furniture, text in blocks:
        if not furniture and path[:len(found)] != found and not all(t in known for t in _block_tokens(path, text)):
            same = [a == b for a, b in zip(found, path, strict=False)]
            found = found[:same.index(False) if False in same else len(same)]
    return found


def extract(sources: list[str]) -> list[str]:
    """The main texts of pages of one host."""
    pages = [Page(s) for s in sources]
    different = list({s: p for s, p in zip(sources, pages, strict=True)}.values())
    skeleton, nested = template(different)
    blocks = [b for p in different for b in p.blocks]
    main = widened(slot(blocks, skeleton), blocks, skeleton | nested) if skeleton else ()
    if main:
        for page in pages:
            page.release(main, skeleton | nested)
    out = []
    for page in pages:
        own = main
        kept = [b for b in page.blocks if not b[1] and b[0][:len(own)] == own]
        if not main or not kept:
            own = widened(slot(page.blocks, None), page.blocks, set())
            kept = [b for b in page.blocks if not b[1] and b[0][:len(own)] == own]
        out.append("\n".join(text for _, _, text in kept))
    return out


def _block_tokens(path: tuple[str, ...], text: str) -> list[tuple[str, ...]]:
    words = text.split(" ")
    return [(*path, "#", w) for w in words] if len(words) <= SHORT else [(*path, "#", text)]


def _group(table: pa.Table) -> pa.Table:
    table = table.sort_by([("page_id", "ascending"), ("html", "ascending")])
    texts = extract([x or "" for x in table["html"].to_pylist()])
    return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(texts, pa.string()),
                     "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def main_text(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html; other columns are ignored).

    Returns one row per input row: page_id, url, text (blocks in page order, one per line; empty if there is
    none), n_chars. Null html counts as empty. Pages with a null url, or one without a host, form a host of
    their own. Hosts are split by page_id into groups of about ``group`` pages, so that a host with
    any number of pages is worked on by many tasks. An empty table gives no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = common.own_columns(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        host.alias("host"))
    parts = cut(rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("parts")).filter("parts > 1"))
    few = parts.limit(LARGE_HOSTS + 1).count() <= LARGE_HOSTS
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1)))
    # one key for host and part, so that pages are dealt by both and not kept where a join by host left them
    dealt = rows.join(F.broadcast(parts) if few else parts, "host", "left").withColumn("group", F.concat_ws(" ", "host", part))
    return (dealt.select("group", "page_id", "url", "html").groupBy("group")
            .applyInArrow(_group, "page_id long, url string, text string, n_chars long"))
