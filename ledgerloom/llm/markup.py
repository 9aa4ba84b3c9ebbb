"""Main text of web pages by the distribution of text over lines."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .common import map_rows

#: Lines of a window.
WINDOW = 3
#: Characters outside links that a window must hold where the text begins.
SURGE = 80

# Element names of HTML and words that pages use for what is not their text.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
INLINE_OUTSIDE = frozenset("button select svg canvas object noscript template script style textarea iframe noembed noframes".split())
OUTSIDE = INLINE_OUTSIDE | frozenset("head nav header footer aside menu dialog title xmp".split())
MAIN = frozenset(("article", "main"))
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
PLACES = "site|page|main|top|bottom|left|right|user|reader|global|primary|secondary|cookie|post|blog|article|content|entry"
BESIDE = (r"ads?|adverts?|advertisements?|advertising|adsense|sponsors?|sponsored|promos?|promotions?|banners?|nav|navbar|navigation|menus?|"
          r"breadcrumbs?|header|masthead|footer|side-?bars?|widgets?|cookies?|consent|gdpr|notices?|alerts?|pop-?ups?|modal|overlay|"
          r"newsletters?|subscribe|subscription|sign-?up|log-?in|comments?|replies|respond|disqus|discussion|share|sharing|socials?|related|"
          r"recommended|recommendations?|pagination|pager|toolbar|skip-?links?|copyright|legal|disclaimer|forms?|search")
PARTS = (r"box|bar|blocks?|container|wrapper|wrap|inner|outer|lists?|area|section|panel|units?|slot|rows?|items?|links?|buttons?|thread|text|"
         r"message|top|bottom|left|right|posts|articles|stories|news|icons|media|policy|main|content|body|desktop|mobile|\d+(?:x\d+)?")
NOT_TEXT = re.compile(
    rf"(?:^|\s)(?!(?:post|blog|article|content|entry)[-_]+header(?:\s|$))"
    rf"(?:(?:{PLACES})[-_]+)*(?:{BESIDE})(?:[-_]+(?:{PARTS}|{BESIDE}))*(?=\s|$)", re.I)

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<!\[CDATA\[.*?(?:\]\]>|$)"
    r"|<[!?][^>]*(?:>|$)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S | re.I)
#: One attribute, name and value, as HTML reads them one behind the other.
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def _outside(name: str, attributes: str) -> tuple[bool, bool]:
    """Is an element beside the text of the page, and is that only what its class, its id or a form says?"""
    if name in OUTSIDE:
        return True, False
    named = name == "form"
    if name in ("main", "html", "body") or not attributes:
        return named, named
    for key, *value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(value)
        if name not in MAIN and (key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value.lower() in ROLES)):
            return True, False
        named |= name != "h1" and key in ("class", "id") and NOT_TEXT.search(value) is not None
    return named, named


class Lines:
    """The lines that are left of a page without its markup."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.length: list[int] = []  # characters outside links
        self.main: list[bool] = []
        self.title: list[bool] = []
        self.gaps: set[int] = set()  # lines before which something was left out
        self.held: list[tuple[int, int]] = []  # lines of elements with a name of things beside the text that hold a headline
        self.now: list[str] = []
        self.outside_links = 0

    def add(self, raw: str, in_link: bool) -> None:
        self.now.append(raw)
        if not in_link:
            self.outside_links += len(raw.strip())

    def gap(self) -> None:
        """Something was left out here."""
        self.gaps.add(len(self.text))

    def end(self, main: bool, title: bool) -> None:
        text = " ".join(html.unescape("".join(self.now)).split()) if self.now else ""
        if text:
            self.text.append(text)
            self.length.append(min(self.outside_links, len(text)))
            self.main.append(main)
            self.title.append(title)
        self.now, self.outside_links = [], 0

    def leave_out(self, start: int) -> None:
        """Take back the lines from ``start`` on."""
        del self.text[start:], self.length[start:], self.main[start:], self.title[start:]
        self.gaps = {g for g in self.gaps if g < start} | {start}
        while self.held and self.held[-1][1] > start:
            self.held.pop()

    def weigh_held(self) -> None:
        """Of elements that hold a headline, those stay that have most characters of the page, whatever their name."""
        total = sum(self.length)
        gone: set[int] = set()
        for start, end in self.held:
            if 2 * sum(self.length[start:end]) <= total:
                gone.update(range(start, end))
        if gone:
            left = [i for i in range(len(self.text)) if i not in gone]
            place, n = [], 0
            for i in range(len(self.text) + 1):
                place.append(n)
                n += i not in gone
            self.gaps = {place[g] for g in self.gaps | gone}
            for name in ("text", "length", "main", "title"):
                setattr(self, name, [getattr(self, name)[i] for i in left])


def lines_of(page: str) -> Lines:
    """Strip the markup: each block with text is a line; where something is left out is a gap."""
    out, stack, skipped, links, mains, titles, heads, at = Lines(), [], 0, 0, 0, 0, 0, 0
    opened: Counter[str] = Counter()

    def close() -> str:
        nonlocal skipped, links, mains, titles
        gone, skip, start, seen = stack.pop()
        opened[gone] -= 1
        skipped -= skip
        if skip and not skipped and gone not in INLINE and gone not in INLINE_OUTSIDE:
            out.gap()
        if start is not None and not skipped:
            out.end(mains > 0, titles > 0)
            if heads > seen and len(out.text) > start:
                out.held.append((start, len(out.text)))
            else:
                out.leave_out(start)
        links -= gone == "a"
        mains -= gone in MAIN
        titles -= gone in TITLES
        return gone

    for token in TOKEN.finditer(page):
        if at < token.start() and not skipped:
            out.add(page[at : token.start()], links > 0)
        at = token.end()
        if token["raw"]:
            continue
        name = (token["name"] or "").lower()
        if not name:
            continue
        if name in VOID:
            if name == "br" or name == "wbr":
                out.now.append(" " if name == "br" and not skipped else "")
            elif name not in INLINE and not skipped:
                out.end(mains > 0, titles > 0)
            continue
        apart = name not in INLINE and name not in INLINE_OUTSIDE
        if not token["end"]:
            skip, named = _outside(name, token["attributes"])
            if apart and not skipped:
                out.end(mains > 0, titles > 0)
            if token["attributes"].endswith("/") and name not in MAIN and (name in ("svg", "path") or skip):
                continue
            named &= apart
            stack.append((name, skip and not named, len(out.text) if named and not skipped else None, heads))
            opened[name] += 1
            skipped += skip and not named
            links += name == "a"
            mains += name in MAIN
            titles += name in TITLES
            heads += name in ("h1", "main") and not skipped
        elif opened[name]:
            if apart and not skipped:
                out.end(mains > 0, titles > 0)
            while stack and close() != name:
                pass
    if at < len(page) and not skipped:
        out.add(page[at:], links > 0)
    out.end(mains > 0, titles > 0)
    while stack:
        close()
    out.weigh_held()
    return out


def parts_of(lines: Lines) -> Iterator[tuple[int, int]]:
    """First line and end of each stretch between gaps."""
    first = 0
    for at in sorted(lines.gaps | {len(lines.text)}):
        if first < at <= len(lines.text):
            yield first, at
            first = at


def weights(lines: Lines) -> list[int]:
    """What each line counts in the distribution: its characters outside links.

    Where article and main elements hold at least half of these characters, the
    page says itself where its text is: their lines count whole and a surge more,
    the others nothing.
    """
    if 2 * sum(n for m, n in zip(lines.main, lines.length) if m) >= sum(lines.length) > 0:
        return [m * (len(t) + SURGE) for m, t in zip(lines.main, lines.text)]
    return lines.length


def between(lines: Lines, weight: list[int], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The lines between surge and dive points of the distribution of ``weight``; see ``main_text``."""
    text = lines.text
    low = all(sum(weight[i : i + window]) < surge for i in range(len(text)))
    kept: list[str] = []
    waiting: list[str] = []
    inside = False
    done = 0
    for first, last in parts_of(lines):
        own, chars = text[first:last], sum(weight[first:last])
        blocks = [sum(weight[i : min(i + window, last)]) for i in range(first, last)]
        if inside and 2 * chars >= sum(map(len, own)):
            if not low and chars < surge / 4 and len(own) < window and not own[-1].endswith(tuple(".!?…。")):
                waiting += own
                continue
            kept += waiting
        else:
            inside = False
        waiting = []
        for i, block in enumerate(blocks, first):
            if inside:
                inside = block > 0
            elif 2 * weight[i] > len(text[i]) and (any(map(str.isalnum, text[i])) if low else block >= surge):
                inside = True
                titles = [] if low else [j for j in range(max(first, done, i - window), i) if lines.title[j]]
                kept += text[min(titles, default=i) : i]
            if inside:
                kept.append(text[i])
                done = i + 1
    return kept


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between surge and dive points of the line-block distribution, its blocks joined by newlines.

    Every line with text gets the sum of the ``weights`` of the ``window`` lines
    from it on. The text begins at a line mostly outside links where the sum
    surges past ``surge`` and ends where it dives to nothing; lines in between are
    kept whatever their own length, and so is a headline up to ``window`` lines before a surge. On a page where nothing surges, any line
    mostly outside links begins the text.
    What is left out inside the text does not end it: the stretch behind goes on
    if at least half of it is outside links and it holds a quarter of ``surge``,
    ``window`` lines or the end of a sentence; a smaller one waits for the next.
    A class, an id or a form leaves an element out only by whole words of
    ``NOT_TEXT``, and not where it holds a headline and most of the page.
    """
    if not page:
        return ""
    lines = lines_of(page)
    return "\n".join(between(lines, weights(lines), window, surge))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Main text of every whole page: page_id, url, text, n_chars. One pass, nothing shuffled.

    Defined cases: a null or empty page, or one without text, gives the empty
    text; null keys and urls are passed on; repeated rows give repeated results;
    other columns are not read. The scan of a page is linear in its length.
    """
    def run(keys: list, urls: list, texts: list) -> Iterator[tuple]:
        for k, u, t in zip(keys, urls, texts):
            out = main_text(t)
            yield k, u, out, len(out)

    slim = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    return map_rows(slim, run, page_id="bigint", url="string", text="string", n_chars="bigint")
