"""Main text of web pages by the distribution of text over their lines."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from domainlake.llm.common import map_slices

#: Elements whose content is never text of the page.
HIDDEN = ("script", "style", "noscript", "template", "svg", "iframe", "head", "object", "canvas", "math", "select")
#: Elements whose content belongs to the frame of a page.
FRAME = ("nav", "footer", "aside", "form", "header", "menu", "dialog", "button", "textarea", "label", "fieldset")
#: Words in class, id or role of what never holds the main text.
NEVER_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs "
    "footer cookie cookies consent gdpr related recommend recommended recommendations share sharing social comment comments "
    "commentlist replies reply respond disqus newsletter subscribe signup login pagination pager contentinfo".split()
)
#: Such words of what is frame unless it holds much of the text.
FRAME_WORDS = frozenset(
    "promo banner sidebar side aside header masthead topbar notice popup modal overlay alert search widget toolbar "
    "complementary skip copyright legal".split()
)
#: Words that may stand beside those of a frame; others make it a name of something else.
BESIDE = frozenset(
    "area articles bar block bottom box boxes button buttons center col column container first form global group icons inner "
    "item items last left link links list lists main mobile news outer page panel policy posts primary products right row "
    "secondary section site slot stories thread top topics unit widgets wrap wrapper".split()
)
#: Words of an article's parts: beside the first kind of words only, as a post's header is part of the post.
PARTS = frozenset("article blog body content entry post single story text".split())
#: Elements that end one block of text and begin another.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are closed by the start of a paragraph.
INLINE = frozenset("p b i em strong span a u small".split())
#: Elements that may hold the main text as a whole.
MAIN = ("article", "main")
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|"
    r"<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.DOTALL,
)
MARK = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDES = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
SENTENCE = re.compile(r"""\w\W+\w+\W+\w.*[.!?…]["'”’»)\]]*$""")
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>|\Z", re.IGNORECASE) for name in HIDDEN if name != "head"}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

HARD, SOFT, CORE = "hard", "soft", "core"


def kind_of_name(name: str) -> str:
    """HARD or SOFT for a class, id or role that names a part of the frame, else nothing.

    Every word of the name has to be a word of frames or one that stands beside such: `share-buttons` is
    frame, `share-of-market` is not.
    """
    words = {w.lower() for w in _PART.findall(name)}
    if words & NEVER_MAIN and words <= NEVER_MAIN | FRAME_WORDS | BESIDE | PARTS:
        return HARD
    return SOFT if words & FRAME_WORDS and words <= FRAME_WORDS | BESIDE else ""


def kind_of_marks(rest: str, without: str = "") -> str:
    """The kind of an element by its attributes; names equal to `without` don't count."""
    kinds = set()
    for attribute, *values in MARK.findall(rest):
        value = "".join(values)
        for name in [value] if attribute.lower() == "aria-label" else value.split():
            if name.lower() != without:
                kinds.add(kind_of_name(name))
    return HARD if HARD in kinds else SOFT if SOFT in kinds else ""


class Page:
    """Blocks of text of a page in order, and the marked elements (frames and main ones) around them.

    text, weight (characters that aren't of links) and at (innermost marked element, -1 for none) of every
    block; parent and kind of every marked element, outer ones first. Markup is taken off, character
    references are decoded, and white space becomes one space. Comments, scripts and the like give no
    text. Elements that are never closed end with their parent. Time is linear in the page's length.
    """

    def __init__(self, page: str):
        self.text: list[str] = []
        self.weight: list[int] = []
        self.at: list[int] = []
        self.parent: list[int] = []
        self.kind: list[str] = []
        self._read(page)

    def _read(self, page: str) -> None:
        parts: list[str] = []
        linked = 0  # characters of the parts that stand in links
        stack: list[tuple[str, int]] = []  # name, and the innermost marked element from here on
        places: dict[str, list[int]] = {}  # of each open name on the stack
        blocks: list[int] = []  # places of open block elements
        cores = 0
        links = False
        at = 0

        def inner() -> int:
            return stack[-1][1] if stack else -1

        def close_block():
            nonlocal linked
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    self.text.append(text)
                    self.weight.append(max(0, len(text) - linked))
                    self.at.append(inner())
                parts.clear()
                linked = 0

        def pop():
            nonlocal cores
            name, mark = stack.pop()
            places[name].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            if mark != inner() and self.kind[mark] == CORE:
                cores -= 1

        while m := TAG.search(page, at):
            if m.start() > at:
                parts.append(page[at : m.start()])
                if links:
                    linked += len(" ".join(html.unescape(parts[-1]).split())) + (page[m.start() - 1] == " ")
            at = m.end()
            if m["cdata"] is not None:
                parts.append(m["cdata"].replace("&", "&amp;"))
                continue
            name = m["name"] or m["name2"]
            if name is None:
                continue
            name, rest = name.lower(), m["rest"] if m["name"] else m["rest2"]
            block = name in BLOCKS or name in FRAME or name in HIDDEN
            if name == "br":
                parts.append(" ")
            if name == "a":
                links = not (m["end"] or m["end2"])
            if block:
                close_block()
            if m["end"] or m["end2"]:
                if places.get(name):
                    k = places[name][-1]
                    # An inline end tag doesn't close the blocks around it.
                    if block or not (blocks and blocks[-1] > k):
                        if inner() != (stack[k - 1][1] if k else -1):
                            close_block()
                        while len(stack) > k:
                            pop()
                continue
            if name in _ENDS and not rest.endswith("/"):
                at = _ENDS[name].search(page, at).end()
                continue
            if name in VOID or rest.endswith("/"):
                continue
            if name == "p":  # a paragraph ends the one before
                while stack and stack[-1][0] in INLINE:
                    pop()
            kind = ""
            if "=" in rest and name not in ("html", "body"):
                # The heading of an article is part of it.
                kind = kind_of_marks(rest, "header" if name == "header" and cores else "")
            if name in ("form", "fieldset"):  # some pages stand in a form
                kind = kind or SOFT
            elif name in FRAME and not (name == "header" and cores):
                kind = HARD
            if name == "head" or ("=" in rest or "hidden" in rest) and HIDES.search(rest):
                kind = HARD
            if name in MAIN and kind != HARD:
                kind = CORE
            mark = inner()
            if kind:
                close_block()
                self.parent.append(mark)
                self.kind.append(kind)
                mark = len(self.kind) - 1
                cores += kind == CORE
            places.setdefault(name, []).append(len(stack))
            if name in BLOCKS:
                blocks.append(len(stack))
            stack.append((name, mark))
        if at < len(page):
            parts.append(page[at:])
        close_block()


def _regions(page: Page, small: float) -> np.ndarray:
    """For every marked element the region of its text: -1 the frame, 0 outside of all main elements, or the
    outermost main element that holds it (its number plus 1)."""
    count = len(page.kind)
    hard, core = np.zeros(count, dtype=bool), np.zeros(count, dtype=np.int64)
    mass, links = np.zeros(count + 1), np.zeros(count + 1)  # the last one is the page
    for text, weight, at in zip(page.text, page.weight, page.at):
        mass[at] += weight
        links[at] += len(text) - weight
    for k in range(count):
        up = page.parent[k]
        hard[k] = page.kind[k] == HARD or (up >= 0 and hard[up])
        core[k] = core[up] if up >= 0 and core[up] else (k + 1) * (page.kind[k] == CORE)
    mass[:count][hard] = 0
    for k in range(count - 1, -1, -1):  # inner elements first: what they hold is held by outer ones
        mass[page.parent[k]] += mass[k]
        links[page.parent[k]] += links[k]
    region = core.copy()
    for k in range(count):
        up = page.parent[k]
        if hard[k] or (up >= 0 and region[up] == -1):
            region[k] = -1
        elif page.kind[k] == SOFT:
            if up >= 0 and core[up]:  # within an article: a small part, or one of links
                frame = mass[k] <= small * mass[core[up] - 1] or links[k] > mass[k]
            else:  # else it may be what is around the article
                frame = 2 * mass[k] <= mass[count]
            region[k] = -1 if frame else region[k]
    return region


def lines_of(page: Page, small: float = 0.2, share: float = 0.25) -> tuple[list[str], np.ndarray, bool]:
    """Lines of text that may be main text, their text lengths, and whether a main element holds them.

    Tags weigh: what is frame by its element or its name gives no lines, but such a name doesn't count for
    an element with most of the page's text, nor within an article for one with more than `small` of it. Of
    several articles, and the text outside of them, those count that have `share` of the largest one's
    text; text outside counts only where no article has more. Links have no length outside of articles.
    """
    region = _regions(page, small)
    of = [int(region[at]) if at >= 0 else 0 for at in page.at]
    held: dict[int, int] = {}
    for r, weight in zip(of, page.weight):
        if r >= 0:
            held[r] = held.get(r, 0) + weight
    outside, largest = held.get(0, 0), max((n for r, n in held.items() if r), default=0)
    if largest >= outside and any(held):
        counted = {r for r, n in held.items() if r and n >= share * largest}
    else:
        counted = {0} | {r for r, n in held.items() if n >= share * outside}
    own = [k for k, r in enumerate(of) if r in counted]
    lengths = [len(page.text[k]) if of[k] else page.weight[k] for k in own]
    return [page.text[k] for k in own], np.array(lengths, dtype=np.int64), 0 not in counted


def surges_and_dives(lengths: np.ndarray, window: int = 3) -> list[tuple[int, int, int]]:
    """(first line, line after the last, largest sum) of every stretch of text, from the lines' text lengths.

    Lengths are summed over a window sliding from line to line. Text surges where the sums leave zero, and
    dives where they are zero again, that is, where `window` lines in a row have no text.
    """
    if not len(lengths):
        return []
    sums = np.convolve(lengths, np.ones(window, dtype=np.int64))  # sums[k] ends at line k
    inside = np.concatenate([[False], sums > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return [(a, min(b, len(lengths)), int(sums[a:b].max())) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def main_text(page: str, window: int = 3, surge: int = 86) -> str:
    """Main text of a page: its text lines between surge and dive points, joined by newlines.

    Lines are those of `lines_of`. Outside of articles a stretch counts if its largest sum comes to `surge`
    characters, if no other is larger, or if it has a sentence; lines of links within it go. Of an article
    everything stays.
    """
    lines, lengths, marked = lines_of(Page(page))
    spans = surges_and_dives(lengths, window)
    least = 1 if marked else min(surge, max((peak for *_, peak in spans), default=1))
    kept = []
    for a, b, peak in spans:
        own = [lines[k] for k in range(a, b) if lengths[k]]
        if peak >= least or any(SENTENCE.search(line) for line in own):
            kept += own
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, window: int = 3, surge: int = 86) -> DataFrame:
    """`pages` with text, the main text of column html, and n_chars, its code points.

    A null or empty page, or one without text, has an empty text. Rows with equal or null ids are treated
    one by one; all other columns are returned, but columns named text and n_chars are replaced. An empty
    table gives an empty table. The whole html is read, however long.
    """
    kept = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars")]
    names = [f.name for f in kept]

    def work(batch):
        texts = [main_text(x or "", window, surge) for x in batch.column("html").to_pylist()]
        columns = [batch.column(n) for n in names] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_chars"])

    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return map_slices(pages.select(*[f"`{n}`" for n in names], "html"), "html", work, schema)
