"""Main text of web pages by line-block distribution.

Markup is stripped, and each block of a page becomes a line. What the markup says of a line isn't a verdict but its mass: the length of
its text, more in an article that the page names, nothing if most of it are links, and little inside of menus, headers, footers,
sidebars, notices, adverts, forms and reader comments. Masses are summed over a sliding window of lines. The text starts where this sum
surges, and ends where it dives to nothing; lines between are kept. Each such part of a page, and what is left of the page without
them, has a distribution of its own, so that an advert between two paragraphs doesn't part them.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE = 3, 60  # lines in a window, mass that a window of running text has
FAINT = 50  # characters of a part that is no text for one of mass
FAINT_MOST = SURGE // WINDOW - 1  # of such a line, so that a window of them is below a surge

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|noscript|svg|math|iframe|object|textarea|select|title|head(?=[\s>]))\b(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
    r"""|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attributes>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[/!?a-z][^<>]*+(?:>|\Z)""",
    re.I | re.S,
)
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NESTED = set("address article aside blockquote body center dd details dialog div dl fieldset figure footer form header li main menu nav ol section table tbody td tfoot th thead tr ul button".split())
ELEMENTS_APART = set("nav aside footer form menu dialog button search".split())
MARKED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# names of parts that are no text; those of the second list may also be names of text
NO_TEXT = "nav navbar navigation menu menus submenu masthead footer sidebar aside widget widgets ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr popup modal comment comments disqus respond replies breadcrumb breadcrumbs related recommended recommendations newsletter subscribe subscription signup login search searchbox pagination pager".split()
HARDLY_TEXT = "header banner foot side notice notices alert overlay reply share sharing social form tags toolbar skip copyright legal disclaimer contentinfo complementary".split()
NAMES_TEXT = "article main content post entry story".split()
RIGHTS = re.compile(r"^\W*(?:©|\(c\)\s|copyright\b)|\ball rights reserved\b", re.I)


TEXT, PLAIN, HARDLY, APART = "text", "plain", "hardly", "apart"


class Part:
    """A part of a page with a distribution of its own."""

    def __init__(self, kind: str, inside: "Part | None" = None):
        self.kind, self.inside, self.lines = kind, inside, []  # lines: place in the page, text, characters in links

    def length(self) -> int:
        return sum(len(text) - links for _, text, links in self.lines)


def kind_of(name: str, attributes: str, now: str) -> str | None:
    """The kind of part that an element opens inside of one of kind ``now``; None: it goes on."""
    words = set(re.split(r"[\s_-]+", " ".join(a or b or c for a, b, c in MARKED.findall(attributes)).lower()))
    words |= {w.rstrip("0123456789") for w in words}
    if now == APART:
        return None
    if name in ELEMENTS_APART or name == "header" and now != TEXT:
        return APART
    if name in ("article", "main"):
        return TEXT
    if name == "body" or not words:
        return None
    if not words.isdisjoint(NAMES_TEXT) and name in ("div", "section", "td"):
        return TEXT if now != HARDLY else None
    return APART if not words.isdisjoint(NO_TEXT) else HARDLY if not words.isdisjoint(HARDLY_TEXT) else None


def parts_of(page: str) -> list[Part]:
    """The parts of a page with their lines. Elements of the same kind inside of each other are one part."""
    text, links, place = [], 0, 0
    here = Part(PLAIN)
    parts, stack = [here], []  # of open elements: name, the part around
    at, endless, in_link = 0, set(), False

    def close() -> None:
        nonlocal text, links, place
        if text:
            line = " ".join("".join(text).split())
            if line:
                here.lines.append((place, line, min(links, len(line))))
                place += 1
        text, links = [], 0

    while True:
        m = TAG.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            piece = html.unescape(piece)
            text.append(piece)
            if in_link:
                links += len(" ".join(piece.split()))
        if m is None:
            break
        at = m.end()
        if raw := m["raw"]:
            ended = None if raw.lower() in endless else re.compile(rf"</{raw}\b[^>]*+>", re.I).search(page, at)
            if ended:
                at = ended.end()
            elif raw.lower() == "head":
                endless.add("head")  # goes on to the body without an end
            else:
                at = len(page)
            continue
        name = (m["name"] or "").lower()
        if name == "a":
            in_link = not m["end"]
        elif name == "br":
            text.append("\n")
        elif name in BLOCKS or name == "button":
            close()
            if name in NESTED:
                if m["end"]:
                    if any(n == name for n, _ in stack):
                        while True:
                            opened, here = stack.pop()
                            if opened == name:
                                break
                elif not (m["attributes"] or "").endswith("/"):
                    stack.append((name, here))
                    kind = kind_of(name, m["attributes"] or "", here.kind)
                    if kind and kind != here.kind:
                        here = Part(kind, here)
                        parts.append(here)
            in_link = False
    close()
    return parts


def settled(parts: list[Part]) -> list[Part]:
    """Parts that are hardly text join the named article that they are in, if they have most of its text."""
    out = []
    for p in reversed(parts):  # inner ones first
        if p.kind == HARDLY and p.inside.kind == TEXT and p.length() > p.inside.length():
            p.inside.lines = sorted(p.inside.lines + p.lines)
        else:
            out.append(p)
    return out[::-1]


def mass(kind: str, text: str, links: int) -> int:
    if kind == TEXT:
        return len(text) + SURGE  # any line of it is a surge
    if kind == PLAIN:
        return 0 if 2 * links > len(text) or RIGHTS.search(text) else len(text)
    return min((len(text) - links) // FAINT, FAINT_MOST)


def regions(masses: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first, past the last) line of each text in a distribution: from a surge, back to where its window sums rise from nothing, to the dive."""
    out, first, most, total = [], None, 0, sum(masses[:window])
    for i in range(len(masses) + 1):
        if i < len(masses) and total > 0:
            first = i if first is None else first
            most = max(most, total)
        elif first is not None:
            if most >= surge:
                out.append((first, i))
            first, most = None, 0
        if i < len(masses):
            total += (masses[i + window] if i + window < len(masses) else 0) - masses[i]
    return out


def main_text(page: str | None) -> str:
    """The main text: blocks joined by a line feed. Null, empty and textless pages give an empty text; if no window of a page surges, its text is the part with most of it that isn't apart."""
    parts = settled(parts_of(page or ""))
    kept = []
    for p in parts:
        masses = [mass(p.kind, text, links) for _, text, links in p.lines]
        kept += [p.lines[i][:2] for a, b in regions(masses) for i in range(a, b) if masses[i]]
    if not kept:
        lines = max(([line for line in p.lines if mass(PLAIN, *line[1:])] for p in parts if p.kind != APART), key=lambda lines: sum(len(text) for _, text, _ in lines), default=[])
        kept = [line[:2] for line in lines]
    return "\n".join(text for _, text in sorted(kept))


def extract(pages: DataFrame) -> DataFrame:
    """pages -> one row per row: page_id, url, text, n_chars. Null html counts as empty, pages of any length are read whole, rows that repeat an id each for themselves; an empty table gives no rows, and further columns are ignored."""

    def read(batches):
        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(read, "page_id long, url string, text string, n_chars long")
