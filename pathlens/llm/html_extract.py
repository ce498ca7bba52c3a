"""Main text of web pages by tag-path ratios.

A page becomes a list of text blocks, each under its root-to-leaf path of block-level tags (inline tags are
transparent). Per path p the blocks n, text T, punctuation Q and link text A are summed and fused into one score,

    f(p) = T * log(1 + T/n) * log(2 + Q/n) * (1 - A/T)

which is smoothed over the tree of paths: every path also gets the text-weighted mean score of the paths that end
in the same element as itself or in one above, less by FADE a level, so headings, short lists and tables stand or
fall with the text around them:

    S(p) = (f(p) + BOOST * (1 - A/T) * max over ancestors a, k levels up, of FADE**k * mean f below a) / (1 + BOOST)

A block is main text if its S reaches THRESHOLD of the page's best. Names and semantic tags only weigh in: under
an element whose class or id says boilerplate and nothing else, f counts half and isn't smoothed; outside of
``article`` and ``main``, where a page has them, S counts OUTSIDE. What no score decides is structure: scripts,
styles, navigation, forms, footers, asides, page headers, hidden elements and readers' comments never are text (by
tag, role, or a name that stands for one); and where the selected blocks lie less than INSIDE within ``article``
and ``main`` (a page of a few words), the scores are taken anew there alone. Headings right before the first
selected block go with it.

Null or empty html gives an empty text. A page without tags is one block. Very long pages and unclosed or
deeply nested tags cost time in proportion. Rows are independent: repeated rows, ties and extra columns of any
name change nothing; an empty table gives an empty one.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlens.llm import runtime
from pathlens.llm.simhash_vptree import free_name

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+|[^>]*)>""", re.S)
#: What may still open after the last ">".
OPEN = re.compile(r"<!--.*|<!\[CDATA\[.*", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
NEVER = set("nav footer aside form button select option dialog menu svg math canvas object audio video map head".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names that stand for structural tags, and names of boilerplate; a class or id counts if it has no other words but LAYOUT's.
REGIONS = set("nav navbar navigation menu menus sidebar sidebars rail footer masthead topbar breadcrumb breadcrumbs pagination pager toolbar".split())
CUES = set("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted
banner banners cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay interstitial
widget widgets copyright disclaimer share sharing social related recommended recommendations newsletter subscribe subscription signup
login signin skip hidden trending teaser teasers outbrain taboola paywall feedback""".split())
LAYOUT = set("""left right top bottom main site page box block section area wrap wrapper container inner outer bar list item unit
slot panel row col column header head content primary secondary global sticky mobile desktop text link links title group user
users reader readers view module region zone stories posts thread form""".split())
COMMENT_CUES = {"comment", "comments", "commentlist", "reply", "replies", "respond", "disqus"}
KEEP = {"html", "body", "main", "article"}
SEMANTIC = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
SCOPE = {"ul", "ol", "table", "div", "section", "article", "main", "body", "dl", "blockquote", "select", "aside", "header", "footer", "nav", "form"}
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؛،]")
THRESHOLD, BOOST, FADE, OUTSIDE, CUED, INSIDE = 0.35, 4.0, 0.85, 0.75, 0.5, 0.8


@dataclass
class Element:
    tag: str
    parent: int
    label: str
    cue: bool
    never: bool
    is_comment: bool
    path: int = 0
    holds_main: bool = False
    holds_head: bool = False


@dataclass
class Block:
    element: int
    path: int
    parts: list = field(default_factory=list)
    link: int = 0
    text: str = ""


def _names(attrs: dict[str, str]) -> list[list[str]]:
    """The words of each class and of the id."""
    return [w for t in [*attrs.get("class", "").split(), attrs.get("id", "")] if (w := re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", t).lower()))]


def _says(names: list[list[str]], cues: set[str]) -> bool:
    return any(not cues.isdisjoint(w) and all(x in cues or x in LAYOUT or x in CUES or x in REGIONS for x in w) for w in names)


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Elements in page order (0 is the page itself) and the text blocks below them."""
    elements, blocks = [Element("", -1, "", False, False, False)], []
    stack, links, at = [0], 0, 0
    block: Block | None = None
    paths: dict[tuple[int, str], int] = {}  # (path above, label) -> path: numbers, as deep pages have long ones
    opened: Counter = Counter()  # open elements by tag
    unclosed: set[str] = set()
    last = page.rfind(">") + 1  # no tag ends beyond

    def token() -> re.Match | None:
        return (at < last and TOKEN.search(page, at, last)) or OPEN.search(page, max(at, last))

    def close(k: int) -> None:
        opened.subtract(elements[e].tag for e in stack[k:])
        del stack[k:]

    def text(raw: str) -> None:
        nonlocal block
        if not raw:
            return
        if block is None:
            if raw.isspace():
                return
            block = Block(stack[-1], elements[stack[-1]].path)
        block.parts.append(raw)
        if links:
            block.link += len(raw.strip())

    def flush() -> None:
        nonlocal block
        if block is not None:
            block.text = " ".join(_html.unescape("".join(block.parts)).split())
            if block.text:
                blocks.append(block)
            block = None

    while m := token():
        text(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--") and (len(m[0]) < 7 or not m[0].endswith("-->")) or m[0].startswith("<![CDATA[") and not m[0].endswith("]]>"):
            at = len(page)  # never closed
        if m.re is OPEN or m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(_html.escape(page[m.start() + 9 : at].removesuffix("]]>"), quote=False))
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in RAW and not closing:
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at, last)
            if end is None:
                unclosed.add(tag)
            if end is None and tag in ("noscript", "template", "title", "textarea"):
                continue  # never closed: what follows is still the page
            at = end.end() if end else len(page)
            if tag not in ("noscript", "textarea"):
                flush() if tag not in ("script", "style") else None
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        flush()
        links = 0
        if tag == "hr":
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if elements[stack[k]].tag == tag:
                    close(k)
                    break
            continue
        closes = CLOSES.get(tag) or ({"p"} if tag not in ("html", "body", "head") else set())
        for k in range(len(stack) - 1, 0, -1) if any(opened[c] for c in closes) else ():
            open_tag = elements[stack[k]].tag
            if open_tag in closes:
                close(k)
                break
            if open_tag in SCOPE:
                break
        if tag == "body" and opened["head"]:  # an unclosed head ends here
            opened["head"] = 0
            stack = [e for e in stack if elements[e].tag != "head"]
        attrs = {a.lower(): v.strip("\"'") for a, v in ATTRIBUTE.findall(m[3])} if m[3] else {}
        named = _names(attrs)
        cue = _says(named, CUES)
        never = tag in NEVER or (tag not in KEEP and _says(named, REGIONS)) or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        name = re.sub(r"\d+", "", "".join(f".{c}" for c in sorted(attrs.get("class", "").split())) + ("#" + attrs["id"] if attrs.get("id") else ""))
        elements.append(Element(tag, stack[-1], tag + name, cue, never, _says(named, COMMENT_CUES)))
        elements[-1].path = paths.setdefault((elements[stack[-1]].path, elements[-1].label), len(paths) + 1)
        if not m[0].endswith("/>") or tag in ("p", "div", "li"):
            stack.append(len(elements) - 1)
            opened[tag] += 1
        if tag in ("article", "main", "h1"):
            for k in range(len(stack) - 2, -1, -1):
                above = elements[stack[k]]
                if above.holds_main and (above.holds_head or tag == "article"):
                    break  # and so all above it
                above.holds_main = True
                above.holds_head |= tag != "article"
    text(page[at:])
    flush()
    return elements, blocks


def path_scores(blocks: list[Block], up: dict[int, int], named: list[bool]) -> tuple[dict[int, float], dict[int, float]]:
    """f and S of every path of blocks; up: path -> the path above; named: blocks under a boilerplate name."""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        for i, v in enumerate((1, len(b.text), len(PUNCTUATION.findall(b.text)), min(b.link, len(b.text)))):
            s[i] += v
    plain = {p: 1 - a / t for p, (n, t, q, a) in sums.items()}
    fused = {p: t * math.log(1 + t / n) * math.log(2 + q / n) * plain[p] for p, (n, t, q, _) in sums.items()}
    below: dict[int, list[float]] = {}  # element path -> text, text-weighted score of what ends in or right below it
    open_ = {b.path for b, cue in zip(blocks, named) if not cue}
    for p in open_:
        for a in {p, up[p]}:
            w = below.setdefault(a, [0.0, 0.0])
            w[0] += sums[p][1]
            w[1] += sums[p][1] * fused[p]
    boost: dict[int, float] = {-1: 0.0}

    def best(p: int) -> float:
        """The largest faded mean from p upwards."""
        chain = []
        while p not in boost:
            chain.append(p)
            p = up[p]
        for q in reversed(chain):
            own = below[q][1] / below[q][0] if q in below else 0.0
            boost[q] = max(own, FADE * boost[up[q]])
        return boost[chain[0]] if chain else boost[p]

    return fused, {p: (fused[p] + BOOST * plain[p] * max(best(p), best(up[p]))) / (1 + BOOST) for p in sums}


def content(page: str) -> list[str]:
    """The main text's blocks in page order."""
    elements, blocks = parse(page)
    up = {e.path: elements[e.parent].path if e.parent >= 0 else -1 for e in elements}
    out_of_page, inside, named = ([False] * len(elements) for _ in range(3))
    for k, e in enumerate(elements[1:], 1):
        inside[k] = inside[e.parent] or e.tag in SEMANTIC
        comments = e.is_comment and e.tag not in ("html", "body") and not e.holds_head
        out_of_page[k] = out_of_page[e.parent] or e.never or comments or (e.tag == "header" and not inside[k])
        named[k] = named[e.parent] or (e.cue and e.tag not in KEEP and not e.holds_main)
    blocks = [b for b in blocks if not out_of_page[b.element]]
    within = [b for b in blocks if inside[b.element]]
    chosen = selected(blocks, up, named, inside if within else None)
    if within and sum(len(b.text) for b in chosen if inside[b.element]) < INSIDE * sum(len(b.text) for b in chosen):
        blocks, chosen = within, selected(within, up, named, None)
    if not chosen:
        return []
    kept = {id(b) for b in chosen}
    first = next(i for i, b in enumerate(blocks) if id(b) in kept)
    home = elements[blocks[first].element].parent
    while first and elements[blocks[first - 1].element].tag in HEADINGS and home in (above := elements[blocks[first - 1].element].parent, elements[above].parent):
        first -= 1
        kept.add(id(blocks[first]))
    return [b.text for b in blocks if id(b) in kept]


def selected(blocks: list[Block], up: dict[int, int], named: list[bool], inside: list[bool] | None) -> list[Block]:
    """The blocks whose weighed score reaches the threshold."""
    if not blocks:
        return []
    fused, smooth = path_scores(blocks, up, [named[b.element] for b in blocks])
    score = [(CUED * fused[b.path] if named[b.element] else smooth[b.path]) * (OUTSIDE if inside and not inside[b.element] else 1.0) for b in blocks]
    best = max(score)
    return [b for b, s in zip(blocks, score) if best > 0 and s >= THRESHOLD * best]


def main_text(page: str | None) -> str:
    return "\n\n".join(content(page)) if page else ""


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with out_col added (replaced, if there): the main text of each page's whole html."""
    runtime.ship(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html_col, out_col)]
    src = pages.select(*kept, F.col(html_col).cast("string").alias(free_name(pages, "__html")))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runtime.slices(batches, rows=256):
            texts = [main_text(x) for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + [pa.array(texts, pa.string())], names=[*kept, out_col])

    return src.mapInArrow(run, schema)
