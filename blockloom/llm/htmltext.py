"""HTML extraction (operator 1): line-block distribution.

Markup is stripped to lines, one for each block of the page. A line weighs as much as it
has text: nothing if its element is furniture (menus, headers, footers, sidebars, notices,
adverts, forms, comments), if it is mostly links, or if it is a short label without the end
of a sentence. Weights are summed over a sliding window of lines. The fullest window is
where the page's main text is. Where a main element (article, main) surrounds it, the text
is what that element holds, so that short paragraphs are never lost; main elements that
don't hold it, such as teaser cards, say nothing. Otherwise a text surges where the sum
rises over a threshold and dives where it falls to nothing; what stands between is kept.

Class names are only a weak prior: they never drop a heading, and where they would leave
no text at all they are ignored.

Scale: a map over rows with whole pages, no shuffle; one pass over each page."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

WINDOW = 3
SURGE = 80  # characters in a window; pages whose fullest window has fewer use that one's sum
LABEL = 60  # shorter lines without the end of a sentence weigh nothing
SENTENCE_END = tuple(".!?\u2026:;\"'\u201d\u2019\u00bb)\u3002\uff01\uff1f")

# Fixed values of HTML: elements that end a line, that hold no text, that are furniture.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
NEVER = frozenset(
    "head script style noscript template svg math canvas object embed iframe audio video nav header footer aside form "
    "button select datalist textarea input label fieldset dialog menu title xmp noembed noframes".split()
)
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Parts of a text have headers of their own.
TEXT_PARTS = frozenset("article entry post story content section chapter main page title".split())
# Elements that a block's start closes when they are open inside it.
CLOSED_BY_BLOCK = frozenset(["p"])
ITEMS = frozenset("li dt dd tr td th option".split())
FURNITURE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment "
    "comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header hidden login masthead "
    "menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall "
    "popup promo promoted promotion recommended related replies respond share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets alert reactions discussion".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
BODY_CLASSES = frozenset("article-body articlebody entry-content post-content post-body story-body main-content article-content".split())

TAG = re.compile(r"""<(?:!--(?:>|->|(?:[\s\S]*?(?:--!?>|\Z)))|(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[!?/][^>]*(?:>|\Z))""")
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)")
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WANTED = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop"))


def _attributes(raw: str) -> dict[str, str]:
    if "=" not in raw and "hidden" not in raw:
        return {}
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(raw) if m[1].lower() in WANTED}


def _furniture(tag: str, attrs: dict[str, str]) -> int:
    """2: by its element or because it isn't shown; 1: by its names; 0: it isn't."""
    if tag in NEVER:
        return 2
    if tag in ("html", "body", "main"):
        return 0
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return 2
    if attrs.get("role", "").lower() in FURNITURE_ROLES:
        return 2
    if tag in HEADINGS:
        return 0
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = re.split(r"[-_:]+", name)
        if {"with", "has", "no", "without"} & set(parts[:-1]):
            continue
        if parts[-1] in ("header", "title") and TEXT_PARTS & set(parts[:-1]):
            continue
        if name in FURNITURE or parts[-1] in FURNITURE or parts[0] in FURNITURE and len(parts) > 1 and parts[-1] not in ("content", "body", "text"):
            return 1
    return 0


def _main(tag: str, attrs: dict[str, str]) -> bool:
    if tag in MAIN or attrs.get("role", "").lower() == "main" or attrs.get("itemprop", "").lower() == "articlebody":
        return True
    return bool(BODY_CLASSES & set(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()))


class _Line:
    __slots__ = ("parts", "linked", "inside", "gone", "heading")

    def __init__(self):
        self.parts: list[str] = []
        self.linked, self.inside, self.gone, self.heading = 0, (), 0, False


def page_lines(html: str) -> list[tuple[str, int, tuple[int, ...], int, bool]]:
    """(text, characters of it in links, the main elements around it, furniture, heading)
    per block; furniture as in ``_furniture``."""
    lines, open_tags = [_Line()], []  # open_tags: (name, furniture, number of a main element)
    depth = [0, 0, 0, 0]  # of links, furniture by names, furniture by element, headings
    mains: list[int] = []
    numbers = 0
    count: Counter[str] = Counter()  # of open tags by name

    def mark(line: _Line) -> None:
        line.inside, line.gone, line.heading = tuple(mains), 2 if depth[2] else 1 if depth[1] else 0, depth[3] > 0

    def new_line() -> None:
        if not lines[-1].parts and _blank_run(lines):
            mark(lines[-1])  # a longer gap says nothing more
            return
        if lines[-1].parts or len(lines) < 2 or any(x.parts for x in lines[-WINDOW - 1 :]):
            lines.append(_Line())
        mark(lines[-1])

    def push(name: str, bad: int, main: int) -> None:
        open_tags.append((name, bad, main))
        count[name] += 1
        depth[0] += name == "a"
        depth[3] += name in HEADINGS
        if bad:
            depth[bad] += 1
        if main:
            mains.append(main)

    def drop(name: str, bad: int, main: int) -> None:
        count[name] -= 1
        depth[0] -= name == "a"
        depth[3] -= name in HEADINGS
        if bad:
            depth[bad] -= 1
        if main:
            mains.remove(main)

    def close(k: int) -> None:
        for t in open_tags[k:]:
            drop(*t)
        del open_tags[k:]

    def text(raw: str) -> None:
        if depth[2] or not raw:
            return
        run = unescape(raw) if "&" in raw else raw
        lines[-1].parts.append(run)
        if depth[0]:
            lines[-1].linked += len(run.strip())

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        if lt > at:
            text(html[at:lt])
        m = TAG.match(html, lt) or LOOSE.match(html, lt)
        if not m:  # a bare "<" is text
            text("<")
            at = lt + 1
            continue
        at = m.end()
        if m.re is TAG and m[2] is None:
            continue
        tag, raw = m[2].lower(), m[3]
        if m[1]:
            if tag == "br" or tag == "p" and not count["p"]:
                text(" ")
                if tag == "p":
                    new_line()
                continue
            if count[tag]:
                k = next(i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == tag)
                # an inline end tag doesn't close the blocks opened inside it
                if tag in BLOCKS or not any(t[0] in BLOCKS for t in open_tags[k:]):
                    close(k)
                else:
                    drop(*open_tags.pop(k))
            if tag in BLOCKS:
                new_line()
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCKS:
            k = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] in BLOCKS), None)
            if k is not None and open_tags[k][0] in CLOSED_BY_BLOCK:
                # what goes on in the next block and matters there; mere formatting doesn't
                inner = [t for t in open_tags[k + 1 :] if t[1] or t[2] or t[0] == "a"]
                close(k)
                for t in inner:
                    push(*t)
            elif k is not None and tag in ITEMS and open_tags[k][0] == tag:
                close(k)
        if tag in VOID:
            if tag in BLOCKS:
                new_line()
            continue
        if tag in RAW:
            if tag in BLOCKS:
                new_line()
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if raw.endswith("/") and tag not in BLOCKS and tag not in ("a", "b", "i", "span", "em", "strong"):
            continue
        attrs = _attributes(raw)
        bad, main = _furniture(tag, attrs), 0
        if _main(tag, attrs):
            main = numbers = numbers + 1
        push(tag, bad, main)
        if tag in BLOCKS or bad:
            new_line()
    return [(" ".join("".join(x.parts).split()), x.linked, x.inside, x.gone, x.heading) for x in lines]


def _blank_run(lines: list[_Line]) -> bool:
    """Whether WINDOW lines before the last are blank."""
    return len(lines) > WINDOW and not any(x.parts for x in lines[-WINDOW - 1 :])


def weigh(text: str, linked: int, gone: bool, heading: bool) -> int:
    """What a line adds to the distribution."""
    if gone or 2 * linked > len(text) or not heading and len(text) < LABEL and not text.endswith(SENTENCE_END):
        return 0
    return len(text)


def window_sums(weights: list[int]) -> list[int]:
    """The sum of each line's weight and those of the WINDOW - 1 lines after it."""
    sums, run = [0] * len(weights), 0
    for i in range(len(weights) - 1, -1, -1):
        run += weights[i] - (weights[i + WINDOW] if i + WINDOW < len(weights) else 0)
        sums[i] = run
    return sums


def runs(weights: list[int]) -> list[tuple[int, int]]:
    """(surge, dive) of each stretch of text: from a weighing line whose window sum reaches
    the threshold to where the sum is nothing."""
    sums, out, i = window_sums(weights), [], 0
    surge = min(SURGE, max(sums, default=0))
    while i < len(weights):
        if not surge or sums[i] < surge or not weights[i]:
            i += 1
            continue
        end = i
        while end < len(weights) and sums[end]:
            end += 1
        out.append((i, end))
        i = end
    return out


def _element(lines: list, weights: list[int], peak: int) -> int | None:
    """The innermost main element around the fullest window that holds at least half of
    what the outermost one there holds."""
    around = next((lines[k][2] for k in range(peak, min(peak + WINDOW, len(lines))) if weights[k] and lines[k][2]), ())
    if not around:
        return None
    held = Counter()
    for (_, _, inside, _, _), w in zip(lines, weights):
        for number in inside:
            held[number] += w
    return next(n for n in reversed(around) if 2 * held[n] >= held[around[0]])


def main_text(html: str | None) -> str:
    """The blocks of the main text, joined by two line feeds."""
    if not html:
        return ""
    lines = page_lines(html)
    for least in (1, 2):  # furniture by names counts unless nothing else is there
        gone = [x[3] >= least or not x[0] for x in lines]
        weights = [weigh(t, linked, out, heading) for (t, linked, _, _, heading), out in zip(lines, gone)]
        if not any(weights):  # a page of labels only: their lengths must do
            weights = [0 if out or 2 * linked > len(t) else len(t) for (t, linked, *_), out in zip(lines, gone)]
        if any(weights):
            break
    else:
        return ""
    sums = window_sums(weights)
    number = _element(lines, weights, sums.index(max(sums)))
    if number is not None:
        return "\n\n".join(x[0] for x, out in zip(lines, gone) if not out and number in x[2])
    return "\n\n".join(lines[k][0] for a, b in runs(weights) for k in range(a, b) if not gone[k])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``.

    Null or empty html gives the empty text; unclosed markup is closed as browsers do;
    pages whose main text no main element holds are judged by the distribution alone; ties
    between equally full windows go to the first; repeated rows come back as often as they are there. An empty table gives an empty
    table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    thin = only(pages, page_id="page_id", url="url", html="html").select(F.col("page_id").cast("long"), "url", "html")
    return thin.mapInArrow(run, "page_id long, url string, text string, n_chars long")
