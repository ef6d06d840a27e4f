"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags by a scanner that reads every
character a bounded number of times.  In the first pass each block is judged by
itself, by link density, length and the density of stop words: good, nearly
good, bad, or ambiguous (short, or long without stop words).  In the second
pass nearly good and ambiguous blocks inherit the label of the nearest decided
neighbours.  This holds inside a marked article (article, main) as well; the
mark only narrows the blocks that are looked at.

Places that are never part of an article (menus, footers, asides, forms,
adverts, comments, hidden parts) are set aside before.  Tags and names of
classes only suggest such a place: where nothing good would remain, the
suggested place that holds most good text is taken back, and one whose name
merely mentions such a word (`has-sidebar`) is taken back if it holds most of
the page's good text.

Defined results: a null or empty page has the empty text; broken markup is read
as far as it goes: a quote that never closes is an ordinary character, a `<`
without a `>` behind it is text, unclosed elements end with their parents.
Between neighbours at equal distance the good one decides; where no block of a
page is decided, all that is not set aside is kept.  In a page without any
block as dense in known stop words as prose, the language counts as unknown and
length and links decide alone.  Every character counts, however long the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from papyr.llm.common import read, slices

#: Characters below which a block is short, and from which a dense one is good.
LOW, HIGH = 70, 200
#: Share of a block's characters in links above which it is bad; the first for short blocks.
LINKS_SHORT, LINKS = 0.3, 0.5
STOP_LOW, STOP_HIGH = 0.10, 0.20
#: Suggested places inside each other; deeper ones count as the enclosing one.
NESTED = 32

#: Function words of the languages served; a parameter of the operator.
STOP_WORDS = frozenset(
    """
    the of and to in a is that it for was on are as with be by this from or an at not which have has but were they his her you we their
    der die das und ist von zu den mit für auf ein eine im dem nicht des als auch es an werden aus er hat dass sie nach bei um einer wie
    le la les de des et en un une du est que pour dans qui par sur pas au plus ce avec il sont se ne ou son aux
    el los las y del que por con para una su al lo como más pero sus o este fue ha
    il di che è per non sono della dei nel o e do da em os na um uma het van een op te dat niet zijn
    и в не на что с по это как к из у за от но его она он они был для при так же
    """.split()
)

_RAW = {k: re.compile(rf"</{k}(?=[\s/>]|\Z)[^>]*+>?", re.I) for k in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
#: One attribute: its name and, behind an equals sign, a value in closed quotes or a bare one.
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_BARE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+()()([^\s>]*+))?+""")
_BETWEEN = re.compile(r"[\s/=]*+")
_SPACE = re.compile(r"\s+")

_BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul video audio object".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that show nothing of an article, whatever they hold.
_NEVER = frozenset("select button template noscript head svg math object video audio canvas datalist".split())
_OUT = frozenset("nav footer aside form dialog menu fieldset search".split())
_MAIN = frozenset("article main".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr notice notices notification alert sidebar rail menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended recommendations newsletter subscribe subscription popup modal overlay login signin signup register comment comments commentlist disqus reply replies respond discussion footer masthead topbar toolbar pagination pager widget widgets skip copyright legal disclaimer tags search".split()
)
#: Words beside a name above that leave it the subject of the class: `comment-list`, not `has-sidebar`.
_BESIDE = frozenset("list box bar area section block wrap wrapper container inner outer left right top bottom site page global item items group link links text title count unit slot thread form row column".split())
_NAME_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    heading: bool
    marked: bool  # inside an article or main element
    places: tuple[int, ...]  # suggested places around it, from the outside in


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    strong: list[bool] = field(default_factory=list)  # for each suggested place whether its name says so plainly


def _tag(page: str, at: int, quotes: bool) -> tuple[int, dict[str, str]]:
    """(index of the tag's `>` or -1, attributes) of the attributes that begin at `at`."""
    pattern, found, n = (_ATTRIBUTE if quotes else _BARE), {}, len(page)
    while True:
        at = _BETWEEN.match(page, at).end()
        if at >= n:
            return -1, found
        if page[at] == ">":
            return at, found
        m = pattern.match(page, at)
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = m.end()


def _suggests(tag: str, a: dict[str, str], in_main: bool) -> str:
    """never, strong or weak for a place that may lie outside an article; empty for others."""
    if tag in _NEVER or "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return "never"
    if tag in _MAIN:  # what an article's class names mention does not make it something else
        return ""
    if tag in _OUT or (tag == "header" and not in_main) or a.get("role", "").lower() in _OUT_ROLES:
        return "strong"
    out = ""
    for name in (a.get("class", ""), a.get("id", "")):
        for part in html.unescape(name).split() if name else ():
            words = [w.lower() for w in _NAME_SPLIT.split(part) if w]
            told = [w in _OUT_NAMES or (w == "header" and not in_main) for w in words]
            if any(told):
                if all(t or w in _BESIDE for t, w in zip(told, words, strict=True)):
                    return "strong"
                out = "weak"
    return out


def blocks(page: str) -> Page:
    """Every block of the page that holds text, in page order, but for what is never shown."""
    found = Page()
    # open containers: tag, inside main, suggested places, never shown
    stack: list[tuple[str, bool, tuple[int, ...], bool]] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = 0
    in_link = heading = False
    marked, places, never = False, (), False
    own: tuple[tuple[int, ...], bool] | None = None  # of a paragraph or heading with names of its own

    def close() -> None:
        nonlocal text, linked
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            p, hidden = own or (places, never)
            if line and not hidden:
                found.blocks.append(Block(line, min(linked, len(line)), heading, marked, p))
        text, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if in_link:
            linked += len(_SPACE.sub(" ", html.unescape(piece)))

    def inner(tag: str, a: dict[str, str]) -> tuple[tuple[int, ...], bool]:
        kind = _suggests(tag, a, marked)
        if kind in ("strong", "weak") and len(places) < NESTED:
            found.strong.append(kind == "strong")
            return (*places, len(found.strong) - 1), never
        return places, never or kind == "never"

    at, end, quotes, last = 0, len(page), True, page.rfind(">")
    while at < end:
        start = page.find("<", at)
        if start < 0 or start > last:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        at = start
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if page.startswith("<![CDATA[", at):
            stop = page.find("]]>", at)
            at = stop + 3 if stop >= 0 else end
            continue
        if page.startswith(("<!", "<?"), at):
            at = page.index(">", at) + 1
            continue
        name = _NAME.match(page, at + 1)
        if name is None:
            add("<")
            at += 1
            continue
        stop, a = _tag(page, name.end(), quotes)
        if stop < 0 and quotes:  # a quote swallowed the rest of the page: quotes mean nothing from here on
            quotes = False
            stop, a = _tag(page, name.end(), quotes)
        if stop < 0:
            add(page[at:])
            break
        at = stop + 1
        tag = name[0].lower()
        if tag[0] == "/":
            tag = tag[1:]
            if tag == "a":
                in_link = False
            elif tag in _BLOCK:
                close()
                own = None
                if tag in _HEADING:
                    heading = False
                elif tag != "p" and opened[tag]:
                    while (shut := stack.pop()[0]) != tag:
                        opened[shut] -= 1
                    opened[tag] -= 1
                    _, marked, places, never = stack[-1] if stack else ("", False, (), False)
                    in_link = False
            continue
        if tag in _RAW:
            done = _RAW[tag].search(page, at)
            at = done.end() if done else end
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = True
        elif tag in _BLOCK:
            close()
            own = None
            heading = tag in _HEADING
            if heading or tag == "p":
                own = inner(tag, a) if a else None
            elif tag not in _VOID and page[stop - 1] != "/":
                if tag == "body":
                    stack, marked, places, never = [], False, (), False
                    opened.clear()
                p, hidden = inner(tag, a)
                marked, places, never = marked or tag in _MAIN, p, hidden
                stack.append((tag, marked, places, never))
                opened[tag] += 1
    close()
    return found


def judge(b: Block, stop_words: frozenset[str], served: bool) -> str:
    """First pass: good, near, bad or open (ambiguous)."""
    n, share = len(b.text), b.linked / len(b.text)
    # a short line with the sign is a page's notice, but may credit a picture inside a marked article
    if share > (LINKS if n >= LOW else LINKS_SHORT) or (n < LOW and "©" in b.text and not b.marked):
        return "bad"
    if n < LOW:
        return "open"
    stops = stop_density(b.text, stop_words) if served else 1.0
    if stops >= STOP_HIGH:
        return "good" if n > HIGH else "near"
    return "near" if stops >= STOP_LOW else "open"


def stop_density(line: str, stop_words: frozenset[str]) -> float:
    words = line.lower().split()
    return sum(w.strip(".,;:!?\"'()") in stop_words for w in words) / len(words)


def inherit(kinds: list[str], headings: list[bool]) -> list[bool]:
    """Second pass: whether each block is kept, by the nearest decided neighbours of those that are not decided."""
    n = len(kinds)
    before, after = [-1] * n, [-1] * n
    last = -1
    for i in range(n):
        before[i] = last
        last = i if kinds[i] in ("good", "bad") else last
    last = -1
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if kinds[i] in ("good", "bad") else last
    keep = []
    for i, k in enumerate(kinds):
        sides = [kinds[j] for j in (before[i], after[i]) if j >= 0]
        if k in ("good", "bad"):
            keep.append(k == "good")
        elif k == "near" or len(set(sides)) < 2:
            keep.append(not sides or "good" in sides)
        else:  # a heading goes with what follows it, other blocks with the nearer side, the good one of two as near
            back, on = i - before[i], after[i] - i
            j = after[i] if headings[i] or on < back else before[i] if back < on else before[i] if kinds[before[i]] == "good" else after[i]
            keep.append(kinds[j] == "good")
    return keep


def set_aside(page: Page, kinds: list[str]) -> set[int]:
    """The suggested places that are outside the article after all."""
    out = set(range(len(page.strong)))
    good = [(b, len(b.text)) for b, k in zip(page.blocks, kinds, strict=True) if k == "good"] or [
        (b, len(b.text)) for b, k in zip(page.blocks, kinds, strict=True) if k != "bad"
    ]
    total = sum(n for _, n in good)
    held: dict[int, int] = {}
    for b, n in good:
        for p in b.places:
            held[p] = held.get(p, 0) + n
    out -= {p for p, n in held.items() if not page.strong[p] and 2 * n > total}
    while good and all(any(p in out for p in b.places) for b, _ in good):
        first: dict[int, int] = {}  # of the outermost places, the one with most good text is none
        for b, n in good:
            p = next(p for p in b.places if p in out)
            first[p] = first.get(p, 0) + n
        out.remove(max(first, key=lambda p: (first[p], -p)))
    return out


def classify(page: Page, stop_words: frozenset[str] = STOP_WORDS) -> list[bool]:
    """For each block whether it belongs to the main text."""
    served = any(len(b.text) >= LOW and stop_density(b.text, stop_words) >= STOP_LOW for b in page.blocks)
    kinds = [judge(b, stop_words, served) for b in page.blocks]
    out = set_aside(page, kinds)
    inside = [not any(p in out for p in b.places) for b in page.blocks]
    if any(i and b.marked and k != "bad" for i, b, k in zip(inside, page.blocks, kinds, strict=True)):
        inside = [i and b.marked for i, b in zip(inside, page.blocks, strict=True)]
    at = [i for i, x in enumerate(inside) if x]
    keep = [False] * len(inside)
    for i, k in zip(at, inherit([kinds[i] for i in at], [page.blocks[i].heading for i in at]), strict=True):
        keep[i] = k
    return keep


def main_text(page: str, stop_words: frozenset[str] = STOP_WORDS) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, ok in zip(found.blocks, classify(found, stop_words), strict=True) if ok)


def extract(pages: DataFrame, stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages`(page_id, url, html, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 4_000_000):
            text = [main_text(x or "", stop_words) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every whole page: page_id, url, text, n_chars.

    A null or empty page has the empty text and 0 characters; a null page_id or
    url stays null; repeated rows give repeated results; an empty table gives no rows.
    """
    return extract(read(spark, sf_dir, "pages"))
