"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from .common import pick, tidy

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'=<>`]++)))?+")

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul caption option optgroup select".split()
)
CLOSES_P = BLOCK - frozenset("body html dd dt li td th tr tbody thead tfoot caption option optgroup".split())
#: An opening tag ends an open one of these names, unless one of the second names lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
DROPPED = frozenset(
    "head script style noscript template iframe object embed applet svg annotation canvas audio video nav aside footer "
    "button select input textarea label fieldset dialog menu title noembed noframes xmp".split()
)
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar "
    "advertisement".split()
)
#: Words in a class or id that mark what surrounds an article.
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot adunit banner breadcrumb breadcrumbs "
    "comment comments commentlist commentary consent cookie cookies copyright dialog disclaimer disqus footer footnav "
    "form gdpr header hidden login masthead menu menus modal nav navbar navigation navi newsletter notice notices "
    "notification overlay pager pagination paywall popup print promo promoted promotion related replies reply respond "
    "recommended search share sharing shoutbox sidebar signup skip social sponsor sponsored sponsors subscribe "
    "subscription tags toolbar topbar widget widgets".split()
)
#: Those of them that also name what stands around a whole page.
FRAMES = frozenset(
    "banner form header hidden masthead menu modal nav navbar navigation overlay print sidebar toolbar topbar widget "
    "widgets".split()
)
#: Those of them that never name an article, or a part of one.
APART = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot adunit breadcrumb breadcrumbs comment "
    "comments commentlist consent cookie cookies disqus footer footnav gdpr login newsletter paywall popup pager "
    "pagination promo promoted replies reply respond share sharing shoutbox signup skip subscribe".split()
)
MODIFIERS = frozenset("has with without no is".split())
CONTENT = frozenset("article body content entry hentry main page post story text".split())
MIN_PARAGRAPH = 25
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _unwanted_name(value: str) -> int:
    """0 for a name that marks nothing, 1 if it can also name what stands around a page, 3 if it never names an article
    or a part of one, else 2."""
    out = 0
    for name in value.split():
        found = [w.lower() for w in _WORDS.findall(name)]
        if found and found[0] not in MODIFIERS:
            marks = UNWANTED.intersection(found)
            if marks:
                frame = marks <= FRAMES or not CONTENT.isdisjoint(found)
                out = max(out, 1 if frame else 3 if marks & APART else 2)
    return out


def _doubt(tag: str, classes: str, ident: str) -> int:
    """What the names of an element say of it, as _unwanted_name tells.

    Words inside a line and headings are never marked by their names, and a paragraph only by one that never names a part
    of an article. The id of a section is often made from its heading, so it counts only if it says nothing else.
    """
    if tag not in BLOCK or tag in HEADINGS:
        return 0
    if tag == "section" and not all(w.lower() in UNWANTED for w in _WORDS.findall(ident)):
        ident = ""
    found = _unwanted_name(f"{classes} {ident}")
    return found if tag != "p" or found == 3 else 0


class Page:
    """The element tree of a page as parallel lists, and its text in page order."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.drop, self.weight = ["#root"], [-1], [False], [0]
        #: what _unwanted_name says of an element; such elements are dropped unless they hold the article
        self.doubt = [0]
        #: (element, text) or (element, None) for a block boundary, in page order
        self.flow: list[tuple[int, str | None]] = []
        self.open_count: dict[str, int] = {}
        self._parse(source)
        if any(self.doubt):
            self._settle()

    def _open(self, tag: str, raw: str, stack: list[int]) -> None:
        node, above = len(self.tag), stack[-1]
        names, drop, weight = "", tag in DROPPED, 0
        doubt = 1 if tag == "form" else 0
        if raw and not raw.isspace():
            attributes = {}
            for name, a, b, c in _ATTRIBUTE.findall(raw):
                attributes.setdefault(name.lower(), a or b or c)
            names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
            hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
            style = attributes.get("style", "").replace(" ", "").lower()
            hidden = hidden or "display:none" in style or "visibility:hidden" in style
            drop = drop or hidden or attributes.get("role", "").lower() in DROPPED_ROLES
            if names != " " and tag not in ("html", "body"):
                if tag not in ("article", "main") or (tag == "article" and any(self.tag[s] == "article" for s in stack)):
                    doubt = max(doubt, _doubt(tag, attributes.get("class", ""), attributes.get("id", "")))
                weight = 25 if not CONTENT.isdisjoint(w.lower() for w in _WORDS.findall(names)) else 0
        if tag == "header" and not any(self.tag[s] in ("article", "main") for s in stack):
            drop = True
        self.tag.append(tag)
        self.parent.append(above)
        self.drop.append(drop or self.drop[above])
        self.weight.append(weight)
        self.doubt.append(doubt)
        stack.append(node)

    def _close(self, stack: list[int], names: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> bool:
        """Pop up to the nearest open element of these names; False if a barrier or none was met."""
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in names:
                while len(stack) > k:
                    node = stack.pop()
                    self.open_count[self.tag[node]] -= 1
                    if self.tag[node] in BLOCK:
                        self.flow.append((stack[-1], None))
                return True
            if tag in barrier:
                return False
        return False

    def _parse(self, source: str) -> None:
        stack, at, n = [0], 0, len(source)
        lower, open_count = None, self.open_count
        while at < n:
            begin = source.find("<", at)
            if begin < 0:
                begin = n
            if begin > at:
                self.flow.append((stack[-1], source[at:begin]))
            if begin == n:
                break
            found = _TAG.match(source, begin)
            if found is None:  # a bare sign
                self.flow.append((stack[-1], "<"))
                at = begin + 1
                continue
            at = found.end()
            tag = found[2]
            if tag is None:
                if found[0].startswith("<![CDATA["):
                    self.flow.append((stack[-1], html.escape(found[0][9:].removesuffix("]]>"))))
                continue
            tag = tag.lower()
            if found[1]:
                if open_count.get(tag, 0):
                    barrier = frozenset() if tag in ("body", "html", "article", "main", "table", "div", "section") else frozenset(["table"]) - {tag}
                    if tag not in BLOCK:
                        barrier = barrier | {"td", "th", "li", "p", "div", "article", "section"}
                    self._close(stack, {tag}, barrier)
                elif tag in BLOCK or tag == "br":
                    self.flow.append((stack[-1], None if tag in BLOCK else " "))
                continue
            if tag in CLOSES_P and open_count.get("p", 0):
                self._close(stack, {"p"}, {"button", "table", "td", "th", "article", "section", "div", "li"})
            if tag in IMPLIED and any(open_count.get(x, 0) for x in IMPLIED[tag][0]):
                while self._close(stack, *IMPLIED[tag]):
                    if tag in ("li", "dt", "dd", "option"):
                        break
            if tag in BLOCK:
                self.flow.append((stack[-1], None))
            if tag in VOID:
                if tag == "br":
                    self.flow.append((stack[-1], " "))
                continue
            self._open(tag, found[3], stack)
            open_count[tag] = open_count.get(tag, 0) + 1
            if tag in RAW:
                if lower is None:
                    lower = source.lower()
                    if len(lower) != n:  # some capitals change length
                        lower = source.translate({c: c + 32 for c in range(65, 91)})
                stop = lower.find(f"</{tag}", at)
                at = n if stop < 0 else stop

    def _settle(self) -> None:
        """Drop the elements in doubt, but not those around the article.

        An element in doubt stays if it holds an article or main, or most of the page's paragraph points; one whose name
        never stands around a page, like that of a notice, must hold nine tenths of the points. Within an article, main
        or element named as content, a name that can only mean something apart is dropped whatever it holds, and others
        must hold eight or nine tenths of its points; an article counts there only if none is open outside.
        """
        n = len(self.tag)
        owner, near = list(range(n)), [0] * n  # near: the innermost element in doubt, the element itself included
        for k in range(1, n):
            owner[k] = k if self.tag[k] in BLOCK else owner[self.parent[k]]
            near[k] = k if self.doubt[k] else near[self.parent[k]]
        length, commas, filled = [0] * n, [0] * n, [False] * n
        for node, text in self.flow:
            if text and not self.drop[node] and not text.isspace():
                length[owner[node]] += len(text.strip())
                commas[owner[node]] += text.count(",")
                filled[node] = True
        points, articles, anchors = [0.0] * n, [0] * n, [0] * n
        for k in range(n - 1, 0, -1):
            if self.drop[k]:
                continue
            above, tag = self.parent[k], self.tag[k]
            if tag in BLOCK and tag not in HEADINGS and length[k] >= MIN_PARAGRAPH:
                points[k] += 1 + commas[k] + min(length[k] / 100, 3)
            if filled[k] and tag in ("article", "main"):
                articles[k] += 1
            if filled[k] and not self.doubt[k] and (tag in ("article", "main") or self.weight[k]):
                anchors[near[k]] += 1
            points[above] += points[k]
            articles[above] += articles[k]
            filled[above] = filled[above] or filled[k]
        around = [0] * n  # anchors outside, up to the page
        enclosed = [False] * n  # whether an article is open
        within = [0] * n  # the innermost anchor that is open, or the page
        for k in range(1, n):
            above = self.parent[k]
            enclosed[k] = enclosed[above] or self.tag[above] == "article"
            anchor = filled[above] and not self.doubt[above] and (self.tag[above] in ("article", "main") or self.weight[above])
            within[k] = above if anchor and above else within[above]
            if self.doubt[k] and not self.drop[above]:
                around[k] = around[near[above]] + anchors[near[above]]
                share = points[k] / points[within[k]] if points[within[k]] else 0.0
                if around[k] and self.doubt[k] == 3:
                    fits = False
                elif self.doubt[k] > 1:
                    fits = share >= 0.9
                else:
                    fits = (articles[k] > 0 and not enclosed[k]) or share > (0.8 if around[k] else 0.5)
                if not fits:
                    self.drop[k] = True
            self.drop[k] = self.drop[k] or self.drop[above]

    def kept(self) -> tuple[int, set[int]]:
        """The best container, and the siblings of it that are kept too."""
        n = len(self.tag)
        length, commas, links = [0] * n, [0] * n, [0] * n
        owner, inside = list(range(n)), [False] * n
        for k in range(1, n):
            above = self.parent[k]
            owner[k] = k if self.tag[k] in BLOCK else owner[above]
            inside[k] = inside[above] or self.tag[k] == "a"
        total, linked, n_links = [0] * n, [0] * n, [0] * n
        for node, text in self.flow:
            if text and not self.drop[node]:
                size = len(text.strip())
                length[owner[node]] += size
                commas[owner[node]] += text.count(",")
                total[node] += size
                if inside[node]:
                    linked[node] += size
        carry, score = [0.0] * n, [0.0] * n
        for k in range(n - 1, 0, -1):
            above = self.parent[k]
            if self.drop[k]:
                continue
            if self.tag[k] == "a":
                n_links[k] += 1
            points = 0.0
            if self.tag[k] in BLOCK and self.tag[k] not in HEADINGS and length[k] >= MIN_PARAGRAPH:
                points = 1 + commas[k] + min(length[k] / 100, 3)
                if self.tag[k] != "p":
                    score[k] += points
            score[k] += carry[k]
            carry[above] += points + carry[k] / 2
            total[above] += total[k]
            linked[above] += linked[k]
            n_links[above] += n_links[k]
        self.total, self.linked, self.n_links = total, linked, n_links
        for k in range(n):
            density = linked[k] / total[k] if total[k] else 0.0
            score[k] = (score[k] + (self.weight[k] if score[k] else 0)) * (1 - density)
        container = [k for k in range(1, n) if not self.drop[k] and self.tag[k] in BLOCK and self.tag[k] != "p"]
        best = max(container, key=lambda k: (score[k], -k), default=0)
        if not container or score[best] <= 0:
            named = [k for k in container if self.tag[k] in ("article", "main") and total[k]]
            best = max(named, key=lambda k: total[k], default=next((k for k in container if self.tag[k] == "body"), 0))
            return best, set()
        node = best
        while node > 0:  # the article around the best part is the container
            if self.tag[node] in ("article", "main"):
                best = node
                break
            node = self.parent[node]
        if self.tag[best] in ("body", "html"):
            return best, set()
        more, limit = set(), max(10.0, 0.2 * score[best])
        for k in range(1, n):
            if k == best or self.parent[k] != self.parent[best] or self.drop[k]:
                continue
            density = linked[k] / total[k] if total[k] else 0.0
            paragraph = self.tag[k] == "p" and total[k] and density < 0.25
            if score[k] >= limit or paragraph or (self.tag[k] in ("h1", "h2", "hgroup") and k < best):
                more.add(k)
        return best, more

    def text(self) -> str:
        best, more = self.kept()
        n = len(self.tag)
        keep = [False] * n
        keep[0] = best == 0
        for k in range(1, n):
            inner = k == best or k in more or keep[self.parent[k]]
            keep[k] = inner and not self.drop[k] and not self._menu(k, best)
        lines, current = [], []
        for node, text in self.flow:
            if text is None:
                if current:
                    line = " ".join(html.unescape("".join(current)).split())
                    if line:
                        lines.append(line)
                    current = []
            elif keep[node]:
                current.append(text)
        line = " ".join(html.unescape("".join(current)).split())
        if line:
            lines.append(line)
        return "\n".join(lines)

    def _menu(self, k: int, best: int) -> bool:
        """A list or box inside the container that is mostly several links."""
        return (
            k != best
            and self.tag[k] in ("ul", "ol", "div", "section", "table", "dl")
            and self.n_links[k] >= 3
            and self.linked[k] > 0.6 * self.total[k]
        )


def main_text(source: str | None) -> str:
    """The article text of a page: one line for each block."""
    return Page(source).text() if source else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        texts = [t.encode("utf-8", "replace").decode() for t in texts]  # references can name lone surrogates
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of `pages` (page_id, url, html).

    Paragraphs give points for their length and commas to their ancestors, half as many with each step up; the points
    of an element are discounted by its link density. The best container (or the article around it) and good siblings
    are kept, without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments. A form or
    an element that is named so stays if the article is within it. Each block is one line; character references are decoded and white space in a block becomes one space.

    Defined cases: a null or empty page, or one without text, gives an empty text; a page without long paragraphs
    falls back to its article, main or body element; among equal containers the first wins; tags that are not closed
    end where the standard implies it; repeated rows give repeated results; a null id or url is passed on; an empty
    table gives no rows; further columns are ignored; pages of any length or depth take linear time in one row.
    """
    ship(pages.sparkSession)
    rows = pick(pages, {"page_id": "long", "url": "string", "html": "string"})
    return rows.mapInArrow(tidy(_extract), "page_id long, url string, text string, n_chars long")
