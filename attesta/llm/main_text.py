"""Main text of HTML pages by tag-path ratios.

A page is read once into elements (end tags that HTML leaves out are implied) and blocks of text, each with the tag path that leads to it from the root. Formatting tags are
transparent. Elements that say what they are (nav, footer, aside, form, a class or role such as comments or sidebar) take their blocks out.
For the rest, text length and punctuation are added up by tag path; a path's ratios are those sums over its number of blocks. The logarithms of the two
ratios are smoothed along the page with a Gaussian, fused by their product and the share of text outside links, and averaged over each path again. Paths at or
above half of the page's mean (by characters) are content paths.

The content paths choose the region: the article or main element that holds most of their score, one with a top heading before others; without such an
element, the page's root, and from there down while one child holds nine tenths of the score and a top heading, if there is one. An article's blocks are all kept, short ones and those of other paths too, but for lists
of nothing but links; of other regions, the content paths' blocks stay, headings, and what lies in the same element as such a block.

A block is what a block element holds up to the next block tag. References are decoded, white space becomes one space, empty blocks go, and blocks are joined in page order by an empty
line. Text is taken whole.

Null and empty html give an empty text, as do pages without content. Rows that repeat, and null ids, are pages of their own. Markup that is never closed ends with the page; a tag, comment
or script cut off by its end is no text. Extra columns are not read. Ties between regions go to the first.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import lean

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, and goes.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes, up to the element that holds such elements.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"})}
CLOSES |= {c: ({"td", "th", "caption"}, {"tr", "table"}) for c in ("td", "th")}
CLOSES |= {"tr": ({"tr", "caption"}, {"table"}), "body": ({"head"}, {"html"})} | {s: ({"thead", "tbody", "tfoot", "caption"}, {"table"}) for s in ("thead", "tbody", "tfoot")}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that are never main text.
ASIDE = frozenset("head nav footer aside form menu dialog button select option fieldset template svg math canvas audio video object search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status tooltip".split())
#: Words of a class or id that name a page's other parts.
PARTS = frozenset(
    """nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar skip header masthead topbar banner footer colophon copyright legal sidebar aside rail widget widgets
    ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted teaser teasers related recommended recommendations trending popular
    cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay toast paywall newsletter subscribe subscription signup signin login register search form
    share sharing social follow comment comments commentlist disqus respond reply replies discussion responses reactions guestbook""".split()
)
#: Of these, the ones that an article element may be.
NOT_ARTICLES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promos promotion promoted teaser teasers related recommended comment comments reply replies".split())
#: A class such as has-sidebar tells what lies beside.
BESIDE = frozenset(("has", "with", "no", "without", "is", "js", "not", "hide", "show"))

_TOKEN = re.compile(r"""<!--|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))|[^>])*+)(>|\Z)|<[!?/][^>]*+(?:>|\Z)""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s"'>]++))?""")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？।؟،]")
#: Share of the score that a child holds for the region to narrow to it, and of the mean that makes a content path.
NARROWS, CONTENT = 0.9, 0.5
_KERNEL = np.exp(-(np.arange(-2, 3) ** 2) / 2.0)


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in reversed(_ATTRIBUTE.findall(text))} if text.strip(" /\t\r\n") else {}


def _named(value: str) -> set[str]:
    """The words of class names, but for those that tell what lies beside."""
    out = set()
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and words[0] not in BESIDE:
            out.update(words)
    return out


class Page:
    """The elements and blocks of a page.

    For each element: parent, tag, path (a number for the root-to-leaf tag path), other (its tag or role takes its text out), named (its class or id says so).
    For each block: text, element, and the number of its characters in links.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.other, self.named, self.main = [-1], [""], [0], [False], [False], [False]
        self.blocks: list[tuple[str, int, int]] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._read(source)

    def _open(self, tag: str, block: int, attributes: dict[str, str]) -> int:
        if not attributes:
            self.parent.append(block)
            self.tag.append(tag)
            self.path.append(self._paths.setdefault((self.path[block], tag), len(self._paths) + 1))
            self.main.append(tag in ("article", "main"))
            self.other.append(tag in ASIDE)
            self.named.append(False)
            return len(self.tag) - 1
        words = _named(attributes.get("class", "") + " " + attributes.get("id", ""))
        role = attributes.get("role", "").lower()
        step = tag + "." + ".".join(sorted(words)) if words else tag
        self.parent.append(block)
        self.tag.append(tag)
        self.path.append(self._paths.setdefault((self.path[block], step), len(self._paths) + 1))
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(attributes.get("style", "")))
        self.main.append(tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody")
        self.other.append(tag in ASIDE or role in ROLES or hidden)
        self.named.append(tag not in ("html", "body", "main") and bool(words & (NOT_ARTICLES if tag == "article" else PARTS)))
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack = [("", 0)]  # open elements: tag, the block element that they are or lie in
        count: dict[str, int] = {}  # of open elements by tag
        held: list[str] = []  # the block's text so far
        linked, links = 0, 0  # its characters in links, open links
        paragraph = -1  # where in the stack the open p is
        at, size = 0, len(source)

        def flush():
            nonlocal linked
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self.blocks.append((text, stack[-1][1], min(linked, len(text))))
                held.clear()
            linked = 0

        def pop(low: int):
            nonlocal paragraph, links
            if any(t in BLOCK or e != stack[low - 1][1] for t, e in stack[low:]):
                flush()
            for t, _ in stack[low:]:
                count[t] -= 1
                links -= t == "a"
            del stack[low:]
            if paragraph >= low:
                paragraph = -1

        while at < size:
            m = _TOKEN.search(source, at)
            text = source[at : m.start()] if m else source[at:]
            if text:
                if "&" in text:
                    text = html.unescape(text)
                held.append(text)
                if links:
                    linked += len(text.strip())
            if not m:
                break
            at = m.end()
            closing, tag, own, whole = m.groups()
            if not whole:  # a comment, a declaration, or a tag that the page's end cuts off
                if source.startswith("<!--", m.start()):
                    end = source.find("-->", m.start() + 2)
                    at = size if end < 0 else max(end + 3, at)
                continue
            tag = tag.lower()
            if closing:
                if tag == "br":
                    held.append(" ")
                elif count.get(tag):
                    low = len(stack) - 1
                    while stack[low][0] != tag and (tag in BLOCK or stack[low][0] not in BLOCK):
                        low -= 1
                    if stack[low][0] == tag:
                        pop(low)
                continue
            if tag in RAW:
                end = _ENDS[tag].search(source, at)
                at = end.start() if end else size
                continue
            if tag == "br":
                held.append(" ")
                continue
            if tag in ("html", "body") and count.get(tag):
                continue
            if tag in BLOCK or tag == "hr":
                flush()
                if paragraph >= 0:
                    pop(paragraph)
                if tag in HEADINGS and stack[-1][0] in HEADINGS:
                    pop(len(stack) - 1)
                closed, within = CLOSES.get(tag, ((), ()))
                if any(count.get(t) for t in closed):
                    low = len(stack) - 1
                    while low and stack[low][0] not in closed and stack[low][0] not in within:
                        low -= 1
                    if stack[low][0] in closed:
                        pop(low)
            if tag in VOID:
                continue
            if tag in BLOCK or tag in ASIDE:
                if tag not in BLOCK:
                    flush()
                element = self._open(tag, stack[-1][1], _attributes(own))
            else:
                element = stack[-1][1]
                if own and tag != "a":  # formatting, unless it says that it is another part
                    attributes = _attributes(own)
                    if attributes.keys() & {"class", "id", "role", "hidden", "aria-hidden", "style"}:
                        made = self._open(tag, element, attributes)
                        if self.other[made] or self.named[made]:
                            flush()
                            element = made
                if tag == "a":
                    links += 1
            if own.rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            stack.append((tag, element))
            count[tag] = count.get(tag, 0) + 1
            if tag == "p":
                paragraph = len(stack) - 1
        flush()


def _left(page: Page) -> list[int]:
    """The blocks that no element takes out."""
    n = len(page.tag)
    # What holds the main element or the top heading is not another part, whatever its class.
    holds = [page.main[e] and not page.named[e] and not page.other[e] or page.tag[e] == "h1" for e in range(n)]
    inside = [False] * n  # an article or main
    for e in range(1, n):
        p = page.parent[e]
        inside[e] = inside[p] or (page.main[e] and not page.named[e])
    for e in range(n - 1, 0, -1):
        if holds[e] and not (page.other[e] or (page.tag[e] == "header" and not inside[e])):
            holds[page.parent[e]] = True
    out = [False] * n
    for e in range(1, n):
        header = page.tag[e] == "header" and not inside[page.parent[e]]
        out[e] = out[page.parent[e]] or page.other[e] or header or (page.named[e] and not holds[e])
    return [i for i, (_, e, _) in enumerate(page.blocks) if not out[e]]


def _fused(page: Page, blocks: list[int]) -> tuple[list[float], float]:
    """Each block's path score, and the least score of a content path."""
    sums: dict[int, list[float]] = {}
    for i in blocks:
        text, element, linked = page.blocks[i]
        s = sums.setdefault(page.path[element], [0, 0, 0, 0, 0.0])
        s[0] += 1
        s[1] += len(text)
        s[2] += len(_PUNCTUATION.findall(text))
        s[3] += linked
    paths = [page.path[page.blocks[i][1]] for i in blocks]
    kernel = np.convolve(np.ones(len(blocks)), _KERNEL, "same") if len(blocks) >= len(_KERNEL) else None

    def smooth(values):
        v = np.array(values)
        return v if kernel is None else np.convolve(v, _KERNEL, "same") / kernel

    length = smooth([math.log1p(sums[p][1] / sums[p][0]) for p in paths])
    marks = smooth([math.log1p(sums[p][2] / sums[p][0]) for p in paths])
    plain = np.array([1 - sums[p][3] / sums[p][1] for p in paths])
    fused = length * (0.1 + marks) * (0.01 + plain)
    for p, f in zip(paths, fused, strict=True):
        sums[p][4] += f
    scores = [sums[p][4] / sums[p][0] for p in paths]
    chars = sum(len(page.blocks[i][0]) for i in blocks)
    return scores, CONTENT * sum(s * len(page.blocks[i][0]) for s, i in zip(scores, blocks, strict=True)) / chars


def main_text(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    blocks = _left(page)
    if not blocks:
        return ""
    scores, least = _fused(page, blocks)
    n = len(page.tag)
    weight, tops, over = [0.0] * n, [0] * n, [False] * n
    for i, s in zip(blocks, scores, strict=True):
        text, e, _ = page.blocks[i]
        weight[e] += s * len(text) * (1.0 if s >= least else 0.01)
        tops[e] += page.tag[e] == "h1"
    for e in range(n - 1, 0, -1):
        weight[page.parent[e]] += weight[e]
        tops[page.parent[e]] += tops[e]
    mains = [e for e in range(1, n) if page.main[e] and weight[e] > 0]
    if mains:
        region = max(mains, key=lambda e: (min(tops[e], 1), page.tag[e] == "article", weight[e], -e))
    else:
        children: dict[int, list[int]] = {}
        for e in range(1, n):
            children.setdefault(page.parent[e], []).append(e)
        region = 0
        while True:
            wide = [e for e in children.get(region, ()) if weight[e] >= NARROWS * weight[0] and children.get(e) and (tops[e] or not tops[0])]
            if not wide:
                break
            region = wide[0]
    within = [False] * n
    for e in range(n):
        within[e] = e == region or (e > 0 and within[page.parent[e]])
    own = [(i, s, page.blocks[i]) for i, s in zip(blocks, scores, strict=True) if within[page.blocks[i][1]]]
    lists: dict[int, list[bool]] = {}  # of each list, whether its items are links and nothing else
    for _, s, (text, e, linked) in own:
        if page.tag[e] == "li":
            lists.setdefault(page.parent[e], []).append(linked >= len(text) and s < least)
    menus = {e for e, items in lists.items() if len(items) > 1 and all(items)}
    if page.tag[region] != "article":
        beside = {page.parent[e] for _, s, (_, e, _) in own if s >= least}
        own = [(i, s, (text, e, linked)) for i, s, (text, e, linked) in own if s >= least or page.tag[e] in HEADINGS or (page.parent[e] in beside and 2 * linked < len(text))]
    return "\n\n".join(text for _, _, (text, e, _) in own if page.parent[e] not in menus)


def main_texts(pages: DataFrame, id_: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: id_, url, text, n_chars."""
    lean(pages.sparkSession)

    def extract(batches):
        for b in batches:
            texts = [main_text(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_, url, "text", "n_chars"])

    rows = pages.select(F.col(id_).cast("long").alias(id_), F.col(url).cast("string").alias(url), F.col(source).cast("string").alias(source))
    return rows.mapInArrow(extract, f"`{id_}` long, `{url}` string, text string, n_chars long")
