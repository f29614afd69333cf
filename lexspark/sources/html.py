"""Pages: an exact tokeniser of HTML, and a native form for the common subset.

The tokeniser is a state machine (quotes, nested sections), so it runs as an Arrow-fed
function; ``title_words``, ``out_links`` and ``tag_counts`` are regular enough for
column expressions. Every input ends: a tag that is never closed ends the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.functions import urls as U
from lexspark.workers import ship

SECTIONS = frozenset(("script", "style", "svg"))
DISCARD = frozenset(
    """!-- !doctype abbr acronym address applet area article aside audio b basefont bdi bdo bgsound big blink blockquote
    body br button canvas caption center cite code col colgroup content data datalist dd del details dfn dialog dir div dl
    dt em fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe
    img input ins isindex kbd keygen label legend li link listing main map mark marquee menu menuitem meta meter nav nobr
    noframes noscript object ol optgroup option output p param picture plaintext pre progress q rp rt rtc ruby s samp
    section select shadow slot small source spacer span strike strong sub summary sup table tbody td template textarea
    tfoot th thead time tr track tt u ul var video wbr xmp""".split()
)

_NAME_END = re.compile(r"[ \t\n\r>/]")
_SPACES = re.compile(r"[ \t\n\r]+")
_LETTERS = re.compile(r"[A-Za-z]+\Z")


@dataclass
class Page:
    title_words: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    links: list[tuple[str, list[str]]] = field(default_factory=list)
    base: str = ""


def _tag_end(s: str, at: int) -> int:
    """The first > outside double quotes from ``at``; -1 if there is none."""
    quoted = False
    for k in range(at, len(s)):
        c = s[k]
        if c == '"':
            quoted = not quoted
        elif c == ">" and not quoted:
            return k
    return -1


def _href(tag: str) -> str:
    k = tag.find("href")
    a = tag.find('"', k) if k >= 0 else -1
    b = tag.find('"', a + 1) if a >= 0 else -1
    return tag[a + 1 : b] if b >= 0 else ""


def parse_html(s: str, embed: str = "href") -> Page:
    """Words, title words, links with their anchor words, and the base of a page.
    ``embed``: the attribute that is taken from <embed>."""
    page = Page()
    in_title = in_anchor = False
    text_from = k = 0

    def text(a: int, b: int) -> None:
        for w in _SPACES.split(s[a:b]):
            if _LETTERS.match(w):
                w = w.lower()
                (page.title_words if in_title else page.words).append(w)
                if in_anchor:
                    page.links[-1][1].append(w)

    while True:
        k = s.find("<", k)
        if k < 0:
            text(text_from, len(s))
            return page
        closing = s[k + 1 : k + 2] == "/"
        begin = k + 1 + closing
        m = _NAME_END.search(s, begin)
        raw = s[begin : m.start()] if m else s[begin:]
        name = raw.lower()
        if not (name in DISCARD or name in SECTIONS or name in ("a", "base", "embed", "title")):
            k += 1
            continue
        text(text_from, k)
        end = _tag_end(s, begin + len(raw))
        if end < 0:
            return page
        tag = s[begin + len(raw) : end]
        if closing:
            if name == "title":
                in_title = False
            elif name == "a":
                in_anchor = False
        elif name in SECTIONS:
            depth, p = 1, end + 1
            pattern = re.compile(rf"<(/?){re.escape(raw)}(?=[ \t\n\r>/])")
            while depth:
                found = pattern.search(s, p)
                if found is None:
                    return page
                depth += -1 if found[1] else 1
                p = found.end()
            end = s.find(">", p)
            if end < 0:
                return page
        elif name == "title":
            in_title = True
        elif name == "a":
            url = _href(tag)
            in_anchor = bool(url)
            if url:
                page.links.append((url, []))
        elif name == "base":
            page.base = page.base or _href(tag)
        elif name == "embed":
            url = _href(tag.replace(embed, "href", 1)) if embed != "href" else _href(tag)
            if url:
                page.links.append((url, []))
                in_anchor = False
        text_from = k = end + 1


#: Pages, and bytes of html (by their mean), that are parsed and handed on at a time: words
#: as Python strings take some ten times the page.
PIECE_ROWS, PIECE_BYTES = 256, 1 << 20


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, min(PIECE_ROWS, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


_LINK = "array<struct<url:string,anchor:array<string>>>"


def parse_pages(pages: DataFrame, embed: str = "href") -> DataFrame:
    """``page_id, url, title_words, words, links, base``. Null html is an empty page."""
    ship(pages.sparkSession)
    link = pa.list_(pa.struct([("url", pa.string()), ("anchor", pa.list_(pa.string()))]))

    def run(batches):
        for batch in pieces(batches):
            found = [parse_html(x or "", embed) for x in batch.column("html").to_pylist()]
            links = [[{"url": u, "anchor": a} for u, a in p.links] for p in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array([p.title_words for p in found], pa.list_(pa.string())), pa.array([p.words for p in found], pa.list_(pa.string())), pa.array(links, link), pa.array([p.base for p in found], pa.string())],
                names=["page_id", "url", "title_words", "words", "links", "base"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id long, url string, title_words array<string>, words array<string>, links {_LINK}, base string")


def write_raw(pages: DataFrame, path: str) -> None:
    """Pages as they were fetched: ``key`` (a file name made of the URL), ``url, html``."""
    pages.select(U.doc_key(F.col("url")).alias("key"), "url", "html").write.mode("append").parquet(path)


def title_words(html: Column) -> Column:
    """The title's words, without the state machine."""
    return T.tokenize(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]*)</title>", 1))


def out_links(html: Column) -> Column:
    """The targets of <a href="..."> in order, without the state machine."""
    return F.regexp_extract_all(html, F.lit(r'<a [^>]*?href[^">]*"([^"]+)"'), F.lit(1))


def tag_names(html: Column) -> Column:
    """The names of all opening tags, in lower case."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"<([A-Za-z][A-Za-z0-9]*)[ \t\n\r>/]"), F.lit(1)), F.lower)


def body_words(html: Column) -> Column:
    """Words outside title, script, style, svg, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<title[^>]*>[^<]*</title>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<svg[^>]*>.*?</svg>", " ")
    return T.tokenize(F.regexp_replace(bare, r'(?s)<[^">]*("[^"]*"[^">]*)*>', " "))
