"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tags, told apart by their place: the path of elements with class and id.
Tags of one host that occur equally often on the same pages - the same occurrence vector - are
one equivalence class. Spark keeps a vector as a sum of page hashes times counts, so it needs no
list of pages and adds up hot hosts inside the tasks. Classes of two tags or more on enough pages
are valid; they nest by their paths, and those that occur once per page form the host's
templates, one per layout its pages have. Their elements are the slots. A slot can be the main
one if it is an article or main element, or if it holds most of the text of the pages it is on.

A second pass extracts the main slot of each page: of the host's main slots that the page has,
the article or main element with the most text, or else the deepest that holds most of the text
of this page. Nothing inside it is dropped for being on other pages as well. A page without one
(few pages, or other mark-up) has its own article or main element, or the whole body, instead.

Elements such as nav and aside are never part of the article. A word such as "sidebar" in class,
id or role is only evidence: it takes an element out unless that holds most of the article or,
on pages without article element, most of the text.

Defined cases: null or empty html gives an empty text; null urls form one host; unclosed and
wrongly nested elements are closed as browsers do; repeated rows are extracted each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import Steps

#: Pages from which a class is valid.
LEAST_PAGES = 3
#: Share of the text of its pages that a main slot holds at least, and share of the article that
#: an element with a listed word holds at most.
MAIN_SHARE, MARK_SHARE = 0.6, 0.7

_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""",
                  re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORDS = re.compile(r"[a-z]+")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q "
              "ruby rp rt s samp small span strike strong sub sup time tt u var".split())
_MAIN = {"article", "main"}
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
                 "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                 "th": {"td", "th"}}
_SCOPES = {"html", "body", "article", "main", "table", "ul", "ol", "dl", "select", "section", "div",
           "blockquote", "nav", "aside", "header", "footer", "form"}
#: Elements and words of class, id and role that mark what is not the article.
_OUTSIDE = set("nav aside form script style noscript template iframe button select svg dialog head "
               "menu object canvas footer header".split())
_MARKS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
             "comments consent contentinfo complementary cookie cookies dialog discussion disqus "
             "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices "
             "pagination popup promo promotion related replies respond search share sharing sidebar "
             "signup social sponsor sponsored subscribe toolbar widget".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(text)} \
        if text and not text.isspace() else {}


class _Walk:
    """Events of a page: ("open" | "close" | "text" | "break", text). `elements` grows by one
    [name, path, parent, side, marked, link] each: `side` tells whether it is in a part that is
    never the article, `marked` whether it has a listed word, `link` whether it is in a link.
    `stack` holds the places of the open ones."""

    def __init__(self, html: str):
        self.html, self.stack, self.elements = html, [], []

    def _top(self):
        return self.elements[self.stack[-1]] if self.stack else ("", "", -1, False, False, False)

    def _pop_to(self, names, scopes):
        """Close the innermost element of one of the names, unless a scope stands before it."""
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.elements[self.stack[i]][0]
            if name in names:
                closed = [self.elements[e] for e in self.stack[i:]]
                del self.stack[i:]
                return [c for c in reversed(closed) if c[0] not in _INLINE]
            if name in scopes:
                return []
        return []

    def events(self):
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                yield "text", html[at:]
                break
            if m.start() > at:
                yield "text", html[at:m.start()]
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if name not in _INLINE:
                yield "break", ""
            if m[1]:
                scopes = () if name in _MAIN or name in ("html", "body") else _MAIN | {"html", "body"}
                for c in self._pop_to({name}, scopes):
                    yield "close", c[1]
                continue
            if name in _VOID:
                continue
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
                continue
            if name not in _INLINE and name not in ("html", "body"):
                names = _SELF_CLOSING.get(name, {"p"})
                for c in self._pop_to(names, _SCOPES - {name}):
                    yield "close", c[1]
            had = _attributes(m[3])
            marks = f"{had.get('class', '')} {had.get('id', '')} {had.get('role', '')}".lower()
            _, path, _, side, _, link = self._top()
            if name not in _INLINE:
                path += "/" + name + "".join(sorted("." + w for w in set(_WORDS.findall(marks))))
            open_ = [self.elements[e] for e in self.stack]
            inside_main = any(e[0] in _MAIN and not e[3] for e in open_)
            side = side and name not in _MAIN or (
                name in _OUTSIDE and not (name == "header" and inside_main)) \
                or "hidden" in had or had.get("aria-hidden") == "true"
            marked = name not in ("html", "body", "main") and not _MARKS.isdisjoint(_WORDS.findall(marks))
            self.elements.append([name, path, self.stack[-1] if self.stack else -1, side, marked,
                                  link or name == "a"])
            self.stack.append(len(self.elements) - 1)
            if name not in _INLINE:
                yield "open", path
        for e in reversed(self.stack):
            if self.elements[e][0] not in _INLINE:
                yield "end", self.elements[e][1]


class _Page:
    """A page's elements and texts: `items` are (place of the element or -1, text, size), size 0
    for breaks and white space; `outside` tells per element whether it is not the article."""

    def __init__(self, html: str):
        walk = _Walk(html)
        self.items, self.tags = [], []
        for kind, text in walk.events():
            if kind in ("open", "close"):
                self.tags.append((kind, text))
            if kind in ("text", "break"):
                self.items.append((walk.stack[-1] if walk.stack else -1, text, len(text.strip())))
        self.elements = walk.elements
        # the article's text as far as it is certain: in article and main elements, or all
        n = len(self.elements)
        self.article = [False] * n
        for i, (name, _, up, side, marked, _) in enumerate(self.elements):
            self.article[i] = not side and (name in _MAIN and not marked or up >= 0 and self.article[up])
        held, every = self._sums(lambda i: self.article[i])
        if not every:
            held, every = self._sums(lambda i: not self.elements[i][3])
        self.outside = [False] * n
        for i, (name, _, up, side, marked, _) in enumerate(self.elements):
            drop = marked and held[i] <= MARK_SHARE * every
            self.outside[i] = side or drop or (up >= 0 and self.outside[up] and not (
                name in _MAIN and self.elements[up][3] and not self._dropped(up)))
            self.elements[i].append(drop)

    def _dropped(self, i: int) -> bool:
        """Whether a listed word took the element or one around it out."""
        while i >= 0:
            if self.elements[i][6]:
                return True
            i = self.elements[i][2]
        return False

    def _sums(self, counts) -> tuple[list, int]:
        """Text below every element, and in all, of the texts whose element counts."""
        sums, total = [0] * len(self.elements), 0
        for i, _, size in self.items:
            if size and i >= 0 and counts(i):
                sums[i] += size
                total += size
        for i in range(len(sums) - 1, -1, -1):
            if (up := self.elements[i][2]) >= 0:
                sums[up] += sums[i]
        return sums, total

    def inside(self, i: int) -> bool:
        return i < 0 or not self.outside[i]

    def sizes(self) -> dict[str, list]:
        """Per path: text below its elements that is not outside, and text in links of it."""
        out: dict[str, list] = {}
        texts, _ = self._sums(self.inside)
        links, _ = self._sums(lambda i: self.inside(i) and self.elements[i][5])
        for i, e in enumerate(self.elements):
            if e[0] not in _INLINE:
                got = out.setdefault(e[1], [0, 0])
                got[0] += texts[i]
                got[1] += links[i]
        return out

    def whole(self) -> int:
        return sum(size for i, _, size in self.items if self.inside(i))


def _tokens(batches):
    """Tag counts of one task per host: pages, occurrences, occurrence vector; of opening tags
    the text below that is not outside, its link text, and the text of the whole pages."""
    for batch in batches:
        total: dict[tuple, list] = {}
        for host, draw, rows, html in zip(*(batch.column(c).to_pylist() for c in (
                "host", "draw", "rows", "html"))):
            page = _Page(html or "")
            sizes, whole = page.sizes(), page.whole()
            for (kind, path), n in Counter(page.tags).items():
                size, link = sizes[path] if kind == "open" else (0, 0)
                sums = total.setdefault((host, kind, path), [0] * 6)
                for i, x in enumerate((rows, n * rows, draw * n, size * rows, link * rows, whole * rows)):
                    sums[i] += x
        if total:
            keys, sums = zip(*total.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.string()) for x in zip(*keys)] + [pa.array(x, pa.int64()) for x in zip(*sums)],
                ["host", "kind", "token", "pages", "n", "vector", "size", "link", "whole"])


def templates(pages: DataFrame, steps: Steps) -> DataFrame:
    """(host, mains): the paths of the slots that can be the main one, over all its layouts."""
    # copies are read once and count as so many pages
    contents = pages.groupBy("host", "html").agg(F.count(F.lit(1)).alias("rows"), F.sum(
        F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 24))).alias("draw"))
    tags = steps.put("tokens", contents.mapInArrow(
        _tokens, "host string, kind string, token string, pages long, n long, vector long, "
                 "size long, link long, whole long").groupBy("host", "kind", "token").agg(
        *[F.sum(c).alias(c) for c in ("pages", "n", "vector", "size", "link", "whole")]))
    valid = tags.groupBy("host", "pages", "n", "vector").agg(F.count(F.lit(1)).alias("members")) \
        .filter(f"members > 1 and pages >= {LEAST_PAGES} and n = pages")
    slots = tags.filter("kind = 'open' and size > 0").join(valid, ["host", "pages", "n", "vector"])
    most = (F.col("size") >= MAIN_SHARE * F.col("whole")) & (F.col("link") * 2 < F.col("size"))
    named = F.regexp_extract("token", r"/([^/.]+)[^/]*$", 1).isin(*_MAIN)
    return steps.put("templates", slots.filter(named | most).groupBy("host").agg(
        F.collect_set("token").alias("mains")))


def _slot(page: _Page, mains: frozenset) -> str | None:
    """The main slot of a page among those of its host."""
    sizes = page.sizes()
    here = {path: size for path, (size, _) in sizes.items() if size and path in mains}
    named = [p for p in here if re.split(r"[.]", p.rsplit("/", 1)[1], maxsplit=1)[0] in _MAIN]
    if named:
        return max(named, key=lambda p: (here[p], p.count("/"), p))
    least = MAIN_SHARE * page.whole()
    most = [p for p in here if here[p] >= least]
    return max(most, key=lambda p: (p.count("/"), p)) if most else None


def main_text(html: str, mains: frozenset) -> str:
    """Text of the main slot (without one: the page's own article, or body), blocks joined by
    spaces."""
    page = _Page(html)
    main = _slot(page, mains) if mains else None
    found = [False] * len(page.elements)
    for i, e in enumerate(page.elements):
        found[i] = e[1] == main or e[2] >= 0 and found[e[2]]
    for taken in (lambda i: i >= 0 and found[i], lambda i: i >= 0 and page.article[i], lambda i: True):
        parts = [unescape(text) or " " for i, text, _ in page.items if page.inside(i) and taken(i)]
        if text := " ".join("".join(parts).split()):
            return text
    return ""


def _extract(batches):
    for batch in batches:
        texts = [main_text(html or "", frozenset(mains or ())) for html, mains in zip(
            *(batch.column(c).to_pylist() for c in ("html", "mains")))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages (page_id, url, html)."""
    steps = Steps(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), (
        r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"), 1))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    return pages.join(templates(pages, steps), "host", "left").select(
        "page_id", "url", "html", "mains").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
