"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block of text; what lies in menus, headers,
footers, adverts, forms, scripts, comments and the like becomes blank lines.
Text lengths outside links are summed over a sliding window of lines.  Where the
sum first surges the text begins, where it last dives to nothing it ends, and all
that lies between is kept; what was stripped makes no dive.  On pages with article
elements this is done in each of them, and any text surges: a menu of ``WIDTH`` or
more link lines before or behind the story goes, single links stay.  On pages
without one, a surge needs ``SURGE`` characters.

On Spark this is a map over rows: a page is parsed by itself, in one pass.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WIDTH, SURGE = 3, 86

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?/][^>]*>", re.S)
ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Element names and words of class, id and role.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
BOILERPLATE = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "object", "audio", "video", "canvas", "datalist"}
SCOPE = {"article", "main"}
NEVER = {"html", "body", "article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
# Elements whose end tag may be left out, and the start tags that then end them.
ROWS = {"tr", "tbody", "thead", "tfoot"}
ENDED_BY = {"li": {"li"}, "p": BLOCKS, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"} | ROWS, "th": {"td", "th"} | ROWS, "tr": ROWS, "option": {"option", "optgroup"}}
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "footer", "header", "masthead", "comment", "comments", "disqus", "share", "sharing", "social", "related",
    "newsletter", "subscribe", "signup", "login", "popup", "modal", "widget", "toolbar", "pagination", "pager", "search",
    "contentinfo", "complementary", "alert", "recommended", "skip",
}
# Words that say nothing beside a mark: in an article, ``ad-box`` is an advert, but ``alert-story`` is a story.
NEUTRAL = {"area", "bar", "block", "body", "box", "container", "content", "inner", "item", "items", "link", "links", "list", "outer", "panel", "section", "slot", "text", "top", "bottom", "unit", "wrap", "wrapper"}


def _marked(name_of: str, attrs: str, scope: int) -> bool:
    """Whether class, id, role or style say that the element is not main text.

    In an article, a class or id must be nothing but marks (and neutral words) to count, and
    a heading's id, mostly made from its title, says nothing.
    """
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "id" and scope and name_of in HEADINGS:
            continue
        if name in ("class", "id", "role"):
            for token in value.split():
                words = set(re.split(r"[^a-z0-9]+", token)) - {""}
                if words & MARKS and (not scope or words <= MARKS | (NEUTRAL if name_of != "section" else set())):
                    return True
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, characters in links, scope) of each line; scope numbers the outermost article, 0 outside any."""
    lines: list[tuple[str, int, int]] = []
    part: list[str] = []
    skip, in_link, linked, depth, scope, scopes, at = "", 0, 0, 0, 0, 0, 0
    opened: list[str] = []  # elements around, the skipped one at skip_at
    skip_at = 0

    def close():
        nonlocal linked
        text = " ".join(html.unescape("".join(part)).split())
        part.clear()
        if text:
            lines.append((text, min(linked, len(text)), scope))
        linked = 0

    def blank():
        close()
        lines.extend([("", 0, scope)] * WIDTH)

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not skip:
            run = page[at : m.start() if m else end]
            part.append(run)
            if in_link and HEADINGS.isdisjoint(opened):  # a heading that is a link is a title
                linked += len(run)
        if not m:
            break
        at = m.end()
        closing, name, attrs = m[1], (m[2] or "").lower(), m[3] or ""
        if not name:
            continue
        if name in RAW and not closing:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            if not skip and name != "title":
                close() if name != "noscript" else None
            continue
        empty = name in VOID or attrs.endswith("/")
        if closing:
            if name in INLINE:
                for i in range(len(opened) - 1, -1, -1):
                    if opened[i] == name:
                        del opened[i:]
                        break
                    if opened[i] not in INLINE:
                        break
            elif name in opened:
                while opened.pop() != name:
                    pass
        else:
            while name not in INLINE:  # what this start tag ends
                i = len(opened) - 1
                while i >= 0 and opened[i] in INLINE:
                    i -= 1
                if i < 0 or name not in ENDED_BY.get(opened[i], ()):
                    break
                del opened[i:]
        if skip:
            own = closing and name == skip
            if len(opened) > skip_at:
                # a menu or the like left open, or a wrapper, ends where the article begins; later articles in it are comments and teasers
                if name in SCOPE and not closing and (skip in BOILERPLATE or skip in ENDED_BY or not scopes):
                    skip = ""
                    del opened[skip_at:]
                else:
                    if not closing and not empty:
                        opened.append(name)
                    continue
            else:
                skip = ""
                if own:
                    continue
        if not closing and not empty:
            opened.append(name)
        if not closing and not empty and name not in NEVER and (name in BOILERPLATE or name == "header" and not scope or _marked(name, attrs, scope)):
            blank()
            skip, skip_at = name, len(opened) - 1
            continue
        if name == "a":
            in_link = 0 if closing else 1
        if name not in INLINE:
            close()
        if name in SCOPE:
            if closing:
                depth = max(0, depth - 1)
                if not depth:
                    blank()
                    scope = 0
            else:
                depth += 1
                if depth == 1:
                    blank()
                    scopes += 1
                    scope = scopes
    close()
    return lines


def blocks(lengths: list[int]) -> list[int]:
    """Sum of lengths over the window of ``WIDTH`` lines that starts at each line."""
    return [sum(lengths[i : i + WIDTH]) for i in range(len(lengths))]


def story(lines: list[tuple[str, int]], surge: int, ends: bool) -> list[str]:
    """Texts of the lines (text, characters in links) from the first surge to the last dive.

    Lines that are mostly links have no length, and stripped parts are lines without
    text.  A line with length surges where the window that it starts holds
    ``surge``.  Behind the last surge the text goes on to a dive: a window of lines
    with text that has no length.  With ``ends``, fewer than ``WIDTH`` lines before
    the surge or behind the dive, which make no window of their own, stay.
    """
    lengths = [len(t) if 2 * linked <= len(t) else 0 for t, linked in lines]
    surges = [i for i, n in enumerate(blocks(lengths)) if lengths[i] and n >= surge]
    if not surges:
        return []
    solid = [i for i, (t, _) in enumerate(lines) if t]
    sums = blocks([lengths[i] for i in solid])
    first, last = solid.index(surges[0]), solid.index(surges[-1])
    while last + 1 < len(solid) and sums[last + 1]:
        last += 1
    while not lengths[solid[last]]:
        last -= 1
    if ends:
        first, last = 0 if first < WIDTH else first, len(solid) - 1 if len(solid) - last <= WIDTH else last
    return [lines[i][0] for i in solid[first : last + 1]]


def main_text(page: str | None) -> str:
    """Text of the page's article; empty if it has none."""
    lines = lines_of(page or "")
    kept: list[str] = []
    scopes = sorted({s for t, _, s in lines if t and s})
    for scope in scopes:
        part = [(t, linked) for t, linked, s in lines if s == scope]
        kept += story(part, 1, True) or [t for t, _ in part if t]
    if not scopes:
        part = [(t, linked) for t, linked, _ in lines]
        kept = story(part, SURGE, False) or story(part, 1, False)
    return " ".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages``.

    Null and empty html give an empty text.  Nulls in page_id or url pass
    through, repeated rows repeat, other columns are not read.  Pages are read
    whole, whatever their length.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    out = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
