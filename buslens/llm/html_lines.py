"""Text lines of an HTML page, each with what the markup says about it."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from html.parser import HTMLParser
from typing import NamedTuple

# Element kinds, by the HTML standard.
SILENT = frozenset("script style noscript template svg math iframe object embed canvas audio video map head title select datalist textarea button".split())
CHROME = frozenset("nav header footer aside form menu dialog search fieldset".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
#: Elements that a start tag of the key closes by itself.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which none is closed that way.
LISTS = ("ul", "ol", "dl", "table", "select", "body")
#: Words in class, id, role and aria-label that mark what is not the article.
CHROME_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies
 consent copyright disclaimer footer gdpr header menu modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promotion
 related respond reply replies share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets""".split())
#: Of these, the words that also name parts of an article, such as its title or a paragraph: they say nothing inside it.
ARTICLE_WORDS = frozenset("banner copyright disclaimer header menu notice notices notification".split())
#: And the words of readers' comments, which may well be longer than what they comment on.
READER_WORDS = frozenset("comment comments respond reply replies".split())
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    main: bool  #: inside the page's article or main element
    chrome: bool  #: inside an element that is not part of the article


def _is_chrome(tag: str, attrs: list[tuple[str, str | None]], inside_main: bool) -> bool:
    """Whether the kind of an element, or its being hidden, rules it out whatever it holds."""
    if tag in CHROME:
        # A header in the article holds its title.
        return not (tag == "header" and inside_main)
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        if name in ("hidden", "aria-hidden") and (value or "true").lower() in ("true", "hidden", ""):
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _named(tag: str, attrs: list[tuple[str, str | None]], inside_main: bool) -> frozenset[str]:
    """Words of an element's names that speak against it."""
    if tag in ("html", "body", "article", "main"):
        return frozenset()
    words = [w.lower() for name, value in attrs if name in ("class", "id", "role", "aria-label") and value for w in _NAME.findall(value)]
    found = CHROME_WORDS.intersection(words)
    return found - ARTICLE_WORDS if inside_main else found


class _Lines(HTMLParser):
    """Lines with what is around them. Names are weighed when the whole page is known: `named` has the words of each element that its names
    speak against, and a line has the number of the nearest such element around it, which links to the next one around that. Open elements are
    found by their tag, so time grows with the page however deep it nests."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int]] = []  # text, number of the main element or -1, chrome by kind, nearest named element or -1
        self.open: list[tuple[str, bool, int, bool, int]] = []  # tag, silent, main, chrome, nearest named element
        self.places: dict[str, list[int]] = defaultdict(list)  # where in `open` each tag stands
        self.blocks: list[int] = []  # and where blocks stand
        self.parts: list[str] = []
        self.named: list[frozenset[str]] = []
        self.around: list[int] = []  # for each named element, the next one around it or -1
        self.inside: list[int] = []  # for each named element, the main element around it or -1
        self.mains: list[int] = []  # for each outermost article or main, the nearest named element around it or -1

    def state(self) -> tuple[bool, int, bool, int]:
        return self.open[-1][1:] if self.open else (False, -1, False, -1)

    def finished(self) -> list[Line]:
        void = self._void()
        against: list[bool] = []  # whether a named element, or one around it, speaks against its lines
        for k, around in enumerate(self.around):
            against.append(k not in void or (around >= 0 and against[around]))
        return [Line(text, main >= 0, chrome or (k >= 0 and against[k])) for text, main, chrome, k in self.lines]

    def _void(self) -> set[int]:
        """Named elements whose names say nothing: those around the largest article, and around others by the same names; without one, those
        with most of the page's text; in an article, those with most of its text. A lone teaser or comment may be marked as an article too:
        it does not count beside more text that no names speak against."""
        if not self.named:
            return set()
        held, total, free = [0] * len(self.named), [0] * (len(self.mains) + 1), 0
        for text, main, chrome, k in self.lines:
            if not chrome:
                total[main] += len(text)  # the last for text outside articles
                free += len(text) if main < 0 and k < 0 else 0
                if k >= 0:
                    held[k] += len(text)
        holds = [False] * len(self.named)  # an outermost article or main
        for k in self.mains:
            if k >= 0:
                holds[k] = True
        for k in range(len(self.named) - 1, -1, -1):  # inner elements come later
            if self.around[k] >= 0:
                held[self.around[k]] += held[k]
                holds[self.around[k]] |= holds[k]
        largest = max(range(len(self.mains)), key=total.__getitem__, default=-1)
        marked = largest >= 0 and total[largest] > 0 and (total[largest] >= free or self.mains[largest] < 0)
        void = set()
        if marked:
            cleared, k = set(), self.mains[largest]
            while k >= 0:
                cleared.add(self.named[k])
                k = self.around[k]
            void = {k for k, words in enumerate(self.named) if holds[k] and words in cleared}
        page = sum(total)
        for k, words in enumerate(self.named):
            if (self.inside[k] >= 0 or not marked) and 2 * held[k] > (total[self.inside[k]] if self.inside[k] >= 0 else page) and not words <= READER_WORDS:
                void.add(k)
        return void

    def end_line(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            self.parts = []
            if text:
                _, main, chrome, named = self.state()
                self.lines.append((text, main, chrome, named))

    def close(self) -> None:
        super().close()
        self.end_line()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.end_line()
            self._close_implied(tag)
        silent, main, chrome, named = self.state()
        inner_article = tag == "article" and main >= 0  # an article in an article is a reader's comment
        own_chrome = chrome or inner_article or _is_chrome(tag, attrs, main >= 0)
        words = _named(tag, attrs, main >= 0) if tag not in VOID else ()
        if own_chrome != chrome or words:
            self.end_line()
        if tag in MAIN and main < 0:
            main = len(self.mains)
            self.mains.append(named)
        if words:
            self.named.append(words)
            self.around.append(named)
            self.inside.append(main)
            named = len(self.named) - 1
        if tag not in VOID:
            self.places[tag].append(len(self.open))
            if tag in BLOCKS:
                self.blocks.append(len(self.open))
            self.open.append((tag, silent or tag in SILENT, main, own_chrome, named))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        elif tag in BLOCKS:
            self.end_line()

    def _last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _close(self, place: int) -> None:
        """Closes the element at this place and all in it."""
        while len(self.open) > place:
            self.places[self.open.pop()[0]].pop()
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()

    def _close_implied(self, tag: str) -> None:
        if self.blocks and self.open[self.blocks[-1]][0] == "p":  # a block ends a paragraph
            self._close(self.blocks[-1])
        if tag in CLOSES:
            place = self._last(CLOSES[tag])
            if place > self._last(LISTS):
                self._close(place)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        place = self._last((tag,))
        if place < 0:
            if tag in BLOCKS:
                self.end_line()
            return
        within = bool(self.blocks) and self.blocks[-1] > place
        if within and tag not in BLOCKS:
            return  # an inline end tag does not close a block
        if within or tag in BLOCKS or self.open[place][3:] != (self.open[place - 1][3:] if place else (False, -1)):
            self.end_line()
        self._close(place)

    def handle_data(self, data: str) -> None:
        if not self.state()[0]:
            self.parts.append(data)


def page_lines(html: str) -> list[Line]:
    """All text lines of a page in order: one per block, white space collapsed, none empty. Any markup gives some result."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    return parser.finished()
