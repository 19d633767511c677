"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags; a block knows the regions it is in. What is in menus, headers, footers, sidebars, notices,
adverts, forms, comments (by tag, role, class or id), scripts, styles and templates goes. First pass: each block is classified by its share of
stop words, its length and its share of linked text as good, bad or undecided (too short, or neither). Second pass: an undecided block takes
the label of its nearest decided neighbours; if they differ, the nearer one's, on a tie good. The edges of an article (article or main
element) count as good neighbours, the edges of a page without one don't count. So inside an article link lists go, with what is short between
them, and in an article too short or too strange for the first pass all stays. An article rules out no good block beside it: if it holds half of the good text or more, only the good ones of the blocks beside it stay, else
these are labelled by their neighbours beside it as on a page without one.

Character references are decoded, white space in a block is one space, blocks are joined by a newline. Nothing else is dropped or cut.
Nulls: null and empty pages give an empty text. Broken markup is read as far as it goes: unclosed tags end where their parents end.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ._tables import pieces

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/><]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A new one of these ends an open one of these, up to the nearest box.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOX = frozenset("article aside blockquote body div fieldset figure footer form header main nav section table ul ol dl".split())
OUT_TAGS = frozenset("nav footer aside form head button dialog menu".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside widget "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login comment comments commentlist discussion replies reply respond disqus share sharing social related recommended "
    "pagination pager toolbar skip copyright".split()
)
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ARTICLE = frozenset({"article", "main"})
STOP = frozenset(
    "a an and are as at be by for from has have he her his i in is it its not of on or she that the their they this to was were which with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur ne nous ou par pas pour que qui sa se ses son sur un une vous "
    "als am auf aus bei das dem den der die ein eine einem einen einer es für hat ich im ist mit nach nicht oder sich sie sind so und von war wie wir zu zum zur "
    "al como con del el ella en es esta este la las lo los más mi no para pero por que se sin su sus un una y ya".split()
)
LINKED, LONG, SHORT = 0.33, 140, 60
MANY_STOPS, FEW_STOPS = 0.30, 0.12
GOOD, BAD, OPEN = 1, -1, 0


@dataclass
class Block:
    text: str
    linked: int
    article: bool
    heading: bool


def boilerplate(tag: str, attrs: str, article: bool) -> bool:
    """Whether an element begins something that isn't main text."""
    if tag in OUT_TAGS or tag == "header" and not article:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in OUT_ROLES:
            return True
        if name in ("class", "id") and any(OUT_NAMES.intersection(NAME.findall(CAMEL.sub("-", x).lower())) for x in value.split()):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """Blocks in page order, without what regions and tags rule out."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, out, article
    parts: list[str] = []
    linked = links = at = 0
    heading = ""
    opened: Counter[str] = Counter()  # of tags in the stack, so that a stray end tag costs no look through it
    never: set[str] = set()  # raw tags that don't end any more

    def pop_to(tag: str) -> None:
        while (top := stack.pop()[0]) != tag:
            opened[top] -= 1
        opened[tag] -= 1

    def end() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, linked, bool(stack) and stack[-1][2], bool(heading)))
            parts.clear()
        linked = 0

    while m := TOKEN.match(page, at):
        at = m.end()
        kind = m.lastgroup
        if kind in ("text", "cdata"):
            if not (stack and stack[-1][1]):
                t = m[kind]
                parts.append(t)
                if links:
                    linked += len(t)
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            if tag in BLOCK:
                end()
                if opened[tag]:
                    pop_to(tag)
                if tag[0] == "h" and tag[1:].isdigit():
                    heading = ""
                links = 0
            elif tag == "a":
                links = 0
            elif opened[tag]:  # an inline element that was ruled out
                pop_to(tag)
            continue
        attrs = m["attrs"] or ""
        if tag in RAW:
            if not attrs.rstrip().endswith("/") or tag in ("script", "style", "textarea", "title"):
                close = None if tag in never else re.compile(rf"</{tag}\s*>", re.I).search(page, at)  # what is inside is no markup
                if not close:
                    never.add(tag)
                at = close.end() if close else len(page) if tag in ("script", "style") else at
            continue
        if tag in VOID:
            if tag == "hr":
                end()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag == "a":
            links = 1
        above = stack[-1] if stack else ("", False, False)
        if tag in BLOCK:
            end()
            links = 0
            for k in range(len(stack) - 1, -1, -1) if tag in ENDS or tag in BOX else ():  # unclosed siblings
                if stack[k][0] in ENDS.get(tag, ()):
                    pop_to(stack[k][0])
                    break
                if stack[k][0] in BOX:
                    if tag in BOX and stack[-1][0] == "p":
                        pop_to("p")
                    break
            above = stack[-1] if stack else ("", False, False)
            if tag[0] == "h" and tag[1:].isdigit():
                heading = tag
            if not attrs.rstrip().endswith("/"):
                opened[tag] += 1
                stack.append((tag, above[1] or boilerplate(tag, attrs, above[2]), above[2] or tag in ARTICLE))
        elif not above[1] and tag in ("span", "button", "label", "small", "ins") and boilerplate(tag, attrs, above[2]):
            opened[tag] += 1
            stack.append((tag, True, above[2]))
    end()
    return out


def first_pass(b: Block) -> int:
    n = len(b.text)
    if b.linked > LINKED * n:
        return BAD if not b.article or b.linked > 0.9 * n else OPEN
    found = WORD.findall(b.text.lower())
    stops = sum(w in STOP for w in found) / len(found) if found else 0.0
    if n >= SHORT and stops >= (MANY_STOPS if n < LONG else FEW_STOPS):
        return GOOD
    if n >= LONG and not b.article and stops < FEW_STOPS / 2:
        return BAD
    return OPEN


def beside(found: list[Block], labels: list[int]) -> list[int]:
    """Labels of the blocks that are in no article of a page that has one."""
    out = [k for k, b in enumerate(found) if not b.article]
    good = sum(len(b.text) * (-1 if b.article else 1) for b, x in zip(found, labels, strict=True) if x == GOOD)
    if good <= 0:
        return [x if x == GOOD else BAD for x in (labels[k] for k in out)]
    return by_neighbours([found[k] for k in out], [labels[k] for k in out], False)


def nearest(found: list[Block], labels: list[int], only_article: bool, edge: int) -> list[tuple[int, int]]:
    """For each block the distance to the nearest decided block before it and that one's label; the edge's label (OPEN: none) if nothing decided comes between."""
    out, last, label = [], -1, edge
    for k, (b, x) in enumerate(zip(found, labels, strict=True)):
        if only_article and not b.article:
            last, label = k, edge
            out.append((0, OPEN))
            continue
        out.append((k - last, label))
        if x != OPEN:
            last, label = k, x
    return out


def by_neighbours(found: list[Block], labels: list[int], has_article: bool) -> list[int]:
    """Labels of all blocks; linear in their number. With an article, those beside it come from beside()."""
    edge = GOOD if has_article else OPEN
    before = nearest(found, labels, has_article, edge)
    after = nearest(found[::-1], labels[::-1], has_article, edge)[::-1]
    others = iter(beside(found, labels) if has_article else ())
    out = []
    for b, x, back, ahead in zip(found, labels, before, after, strict=True):
        if has_article and not b.article:
            out.append(next(others))
            continue
        if x == OPEN:
            near = [(distance, -label) for distance, label in (back, ahead) if label != OPEN]
            x = -min(near)[1] if near else OPEN
            if x == OPEN:
                x = GOOD  # nothing decided anywhere
            elif b.heading and ahead[1] == GOOD:
                x = GOOD
        out.append(x)
    return out


def second_pass(found: list[Block]) -> list[int]:
    return by_neighbours(found, [first_pass(b) for b in found], any(b.article for b in found))


def judged(page: str) -> list[tuple[Block, int, int]]:
    """Each block with its label after the first and after the second pass."""
    found = blocks(page)
    return list(zip(found, [first_pass(b) for b in found], second_pass(found), strict=True))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, x in zip(found, second_pass(found), strict=True) if x == GOOD)


def extracted(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """pages without the html column, with the main text; a column of pages with its name is replaced."""
    from pyspark.sql import types as T

    kept = [c for c in pages.columns if c not in (html_col, name)]
    own = pages.select(*kept, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, html_col):
                texts = pa.array([main_text(t.as_py()) for t in part.column(html_col)], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], texts], names=[*kept, name])

    return own.mapInArrow(run, T.StructType([*[own.schema[c] for c in kept], T.StructField(name, T.StringType())]))
