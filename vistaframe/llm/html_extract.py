"""Operator 1: main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags, each with a weight. A word has that of its
block: the log odds of standing in the main text, by a logistic model of what the
block is (paragraph, heading, item), where it stands (in the box that holds most
of the page's sentences or beside it, in a landmark or beside it), how much of it is
links, how it ends, and what the names of the boxes around it say. A tag has a
negative weight by its kind. All weights are fitted to labelled pages. One linear
scan finds the contiguous run with the greatest sum; a box's name decides nothing
by itself. Blocks inside the run whose odds are below ``DROP`` (an advert between
paragraphs) are left out, and cost the run no more than ``GAP``.

Text of scripts, styles, form controls and hidden elements is none. Character
references are decoded; white space in a block becomes one space; blocks are
joined in page order by a line feed. Nothing else is dropped.

Defined results: a null, empty or tag-only page has the empty text, and so has one
without a run above zero; unclosed, crossed and truncated tags end where their
surroundings do; a very long page is read whole, in one pass; of runs of equal
sum the first counts; repeated rows are extracted each for itself; an empty table
gives no rows; ``keep`` names the columns to carry.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_batches
from .common import column, table
from .labelled_pages import CLOSE, OPEN, pages

MARKUP = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^<>]*+(?:>|\Z|(?=<)))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Elements whose content is no text at all, up to their end tag.
RAW = frozenset("script style noscript template iframe object svg canvas math textarea select title".split())
CONTROLS = frozenset("button label input select textarea option".split())
LANDMARKS = {"nav": "nav", "menu": "nav", "aside": "aside", "header": "header", "footer": "footer", "form": "form", "dialog": "dialog", "head": "head"}
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What a block is, by the nearest element of these.
KINDS = {"p": "p", "li": "item", "dt": "item", "td": "cell", "th": "cell", "blockquote": "quote", "pre": "quote", "dd": "quote", "figcaption": "quote", "caption": "quote"} | dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading")
#: An end tag does not close what lies beyond the nearest of these.
WALLS = frozenset("article main nav aside footer header form section div table ul ol body".split())
#: Words in names of boxes, by what they say; how much each kind weighs is learnt.
SAID = {
    "ad": "ad ads adv advert adverts advertisement adslot adbox adunit adsbygoogle sponsor sponsored banner promo promotion promoted",
    "notice": "cookie cookies consent gdpr notice notices alert alerts notification notifications popup modal overlay",
    "menu": "menu menus nav navigation navbar topnav subnav sidenav breadcrumb breadcrumbs toolbar pager pagination",
    "head": "header masthead topbar",
    "foot": "foot footer copyright",
    "side": "sidebar rail widget widgets",
    "remarks": "comment comments reply replies respond responses thread discussion disqus",
    "more": "related recommended recommendations teaser teasers",
    "share": "share sharing social",
    "sign": "subscribe subscription newsletter signup login search",
    "story": "article content post entry story text",
}
SAYS = {word: kind for kind, words in SAID.items() for word in words.split()}
#: The longer of these also count as parts of a word.
PARTS = {w: SAYS[w] for w in ("advert", "sponsor", "cookie", "sidebar", "navbar", "breadcrumb", "footer", "masthead", "comments", "newsletter", "copyright")}
#: Words that leave the meaning of others as it is.
PLAIN = frozenset("site page main top bottom left right box boxes container wrap wrapper block unit area list bar item items section inner outer user users button buttons link links group slot posts stories form js is the my".split())
#: A word after one of these says what a page has, not what an element is.
ABOUT = frozenset("has with no without hide show".split())
ROLES = {"navigation": "menu", "banner": "head", "contentinfo": "foot", "complementary": "side", "search": "sign", "form": "sign", "dialog": "notice", "alert": "notice", "alertdialog": "notice", "menu": "menu", "menubar": "menu"}
#: What boxes around an article say of it too; all else an article leaves behind.
FOREIGN = frozenset(("remarks", "more", "in:remarks", "in:more"))
BESIDE = frozenset("ad notice menu foot side remarks more share sign <nav <aside <footer <form <dialog".split())
LEXICAL = {
    "rights": re.compile(r"©|copyright|rights reserved|rechte vorbehalten|droits réservés|powered by|impressum|privacy|\bterms\b"),
    "notice": re.compile(r"cookie|\bbrowser\b|\bscripts\b"),
    "offer": re.compile(r"\bbuy\b|\bsave \d|\d ?%|\boffers?\b|\border (now|today)|\bfree\b|\bdiscount|\bsale\b|advertisement|\bsponsored|rabatt|bestellen|\boffre\b|achetez|\bcompra\b|descuento|\bquote in\b|\d[.,]99\b"),
    "sign": re.compile(r"subscribe|newsletter|\bsign up|\blog ?in\b"),
    "remark": re.compile(r"\bcomments?\b|\breply\b|kommentar|\bdays ago\b|\bthanks?\b|\bdanke\b|\bmerci\b|\bgracias\b"),
    "share": re.compile(r"\bshare\b|\btweet\b|\bprint\b|\bprevious\b|\bnext\b|\byou may also like\b|\brelated\b|\bmost read\b"),
}
ENDS = tuple(".!?…:;\"'”»)。")
LABELLED, SEED, CAP, PER_TAG, FIRST = 600, 1, 6.0, 0.002, 0.35


@lru_cache(maxsize=4096)
def said(value: str) -> frozenset[str]:
    """What the words of a class or id value say, ``?`` before what they only may say."""
    found: set[str] = set()
    for name in value.split():
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
        if ABOUT & set(words[:1]):
            continue
        kinds, strange = set(), False
        for w in words:
            kind = SAYS.get(w) or next((k for p, k in PARTS.items() if p in w), None)
            if kind:
                kinds.add(kind)
            elif w not in PLAIN and len(w) > 1:
                strange = True
        if len(kinds) > 1 and "story" in kinds:
            kinds = set() if kinds == {"story", "head"} else kinds - {"story"}
        found |= {"?" + k if strange else k for k in kinds}
    if "story" in found and (more := found - {"story"}):
        found = {"story"} | {k if k[0] == "?" else "?" + k for k in more}
    return frozenset(found)


class Box:
    """An element: where it stands, and what it and those around it say."""

    __slots__ = ("tag", "up", "depth", "says", "hidden", "link", "main", "form", "kind", "room")

    def __init__(self, tag: str, up: Box | None, says: frozenset, hidden: bool):
        self.tag, self.up, self.says = tag, up, says
        self.depth = up.depth + 1 if up else 0
        self.hidden = hidden or bool(up and up.hidden)
        self.link = tag == "a" or bool(up and up.link)
        self.main = self if tag in MAIN else up.main if up else None
        self.form = self if tag == "form" else up.form if up else None
        # the box that a paragraph's or a heading's own element stands in; of bare text, its box
        self.room = self if not up or tag in BLOCK and (tag not in KINDS or tag in ("td", "th", "blockquote")) else up.room
        self.kind = KINDS.get(tag) or ("div" if tag in BLOCK or not up else up.kind)

    def landmarks(self) -> Iterator[Box]:
        at = self.main
        while at:
            yield at
            at = at.up.main if at.up else None


def box_of(tag: str, attributes: str, up: Box) -> Box:
    own, hidden = set(), tag in CONTROLS
    if attributes and tag not in ("html", "body"):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                own |= said(value)
            elif name == "role" and value.lower() in ROLES:
                own.add(ROLES[value.lower()])
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                hidden = True
    if tag in MAIN:
        return Box(tag, up, (up.says & FOREIGN) | frozenset(own & {"ad", "more", "remarks"}), hidden)
    if tag in LANDMARKS:
        own.add("<" + LANDMARKS[tag])
    if tag in ("p", "li", "span", "b", "i", "em", "strong", "small", "a", "h1", "h2", "h3", "h4", "h5", "h6"):
        own = {"own:" + k.lstrip("?") if k[0] != "?" else "own?" for k in own}
    return Box(tag, up, up.says | own if own else up.says, hidden)


class Piece(NamedTuple):
    """Text between two tags."""

    text: str
    words: int
    block: int
    hidden: bool


class Page(NamedTuple):
    """Pieces and kinds of tags in page order, and the box, text and linked words of each block."""

    items: list[Piece | str]
    boxes: dict[int, Box]
    texts: dict[int, list[str]]
    linked: Counter


def parse(page: str) -> Page:
    out = Page([], {}, defaultdict(list), Counter())
    items = out.items
    stack = [Box("", None, frozenset(), False)]
    block, at, size = 0, 0, len(page)

    def text(upto: int) -> None:
        if upto > at:
            box = stack[-1]
            said_ = html.unescape(page[at:upto])
            words = len(said_.split())
            items.append(Piece(said_, words, block, box.hidden))
            if words and not box.hidden:
                out.boxes.setdefault(block, box)
                out.texts[block].append(said_)
                if box.link:
                    out.linked[block] += words

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                del stack[k:]
                return
            if stack[k].tag in MAIN and tag not in ("body", "html") or stack[k].tag in WALLS and tag not in WALLS and tag not in ("body", "html"):
                return

    while at < size:
        m = MARKUP.search(page, at)
        if m is None:
            text(size)
            break
        text(m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0] in (OPEN, CLOSE):
                items.append(m[0])
            continue
        if m[1]:
            if tag in BLOCK:
                block += 1
            close(tag)
            items.append("/")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            if not m[0].endswith("/>"):
                at = end.start() if end else size
            items.append("raw")
            continue
        if tag in BLOCK:
            block += 1
            if stack[-1].tag == "p" or tag == "li" and stack[-1].tag == "li":
                stack.pop()
        if tag not in VOID:
            up = stack[-1] if tag != "body" else stack[0]
            stack.append(box_of(tag, m[3], up))
        items.append(tag if tag in ("a", "br", "p", "li") else KINDS.get(tag) or ("block" if tag in BLOCK else "inline"))
    return out


class Known(NamedTuple):
    """What is known of a block by itself, its length, and the box that its element stands in."""

    found: list[str]
    words: int
    room: Box
    end: bool


def known(page: Page) -> dict[int, Known]:
    """What each block is: its kind, size, end and links, what its words and the boxes around it say."""
    out, rooms, says, mains, total = {}, {}, {}, Counter(), 0.0
    texts = {b: " ".join("".join(t).split()) for b, t in page.texts.items()}
    words = {b: t.count(" ") + 1 for b, t in texts.items()}
    forms: Counter[Box] = Counter()
    for b, box in page.boxes.items():
        if "<form" in box.says and box.form:
            forms[box.form] += words[b]
    wide = {x for x, n in forms.items() if 2 * n > sum(words.values())}  # around the whole page, say
    for b, t in texts.items():
        box = page.boxes[b]
        rooms[b], says[b] = box.room, box.says
        if box.form in wide:
            says[b] = box.says - {"<form"}
        n = (words[b] - page.linked[b]) * (1.0 if t.endswith(ENDS) else 0.3) * (1.0 if says[b].isdisjoint(BESIDE) else 0.1)
        total += n
        for at in box.landmarks():
            if at.says.isdisjoint(FOREIGN):
                mains[at] += n
    # a landmark is one only if it holds much of the page's sentences
    main = max(mains, key=lambda x: (mains[x], -x.depth), default=None)
    if main is not None and mains[main] < 0.3 * total:
        main = None
    for b, t in texts.items():
        box, n, linked = page.boxes[b], words[b], page.linked[b] / words[b]
        land = "none" if main is None else "in" if main in box.landmarks() else "out"
        size = "1" if n < 3 else "3" if n < 10 else "10" if n < 25 else "25"
        link = "0" if not linked else "some" if linked < 0.4 else "much" if linked < 0.9 else "all"
        end = t.endswith(ENDS)
        found = ["bias", f"kind {box.kind}", f"size {size} {'end' if end else 'open'}", f"link {link}", f"land {land}", f"land {land} {box.kind}"]
        found += [f"says {k}" for k in says[b]]
        if land == "in":
            found += [f"says {k} inside" for k in says[b]]
        if n < 60:
            low = t.lower()
            found += [f"lexical {k}" for k, r in LEXICAL.items() if r.search(low)]
        out[b] = Known(found, n, rooms[b], end)
    return out


def placed(blocks: dict[int, Known], run: set[int], odds: dict[int, float]) -> tuple[dict[int, list[str]], set[int]]:
    """The same with where each block stands beside the run that a first scan found:
    in it or not, and in the box that holds most of it or not. Also the blocks in that box."""
    holds: Counter[Box] = Counter()
    for b in run:
        # half of what a box holds counts for the box around it
        n = blocks[b].words / (1 + math.exp(-odds[b])) * (1.0 if blocks[b].end else 0.3)
        holds[blocks[b].room] += n
        if blocks[b].room.up:
            holds[blocks[b].room.up] += n / 2
    best = max(holds, key=lambda x: (holds[x], x.depth), default=None)
    near = best.up if best and best.up and best.up.tag not in ("", "body", "html") else None
    places: dict[Box | None, str] = {None: "away"}
    for k in blocks.values():
        path, at = [], k.room
        while at not in places and at is not best and at is not near:
            path.append(at)
            at = at.up
        if at not in places:
            places[at] = "same" if at is best else "beside"
        for box in path:
            places[box] = "within" if places[at] in ("same", "within") else places[at]
    out = {}
    for b, k in blocks.items():
        where, by = places[k.room], "run" if b in run else "off"
        size = "1" if k.words < 3 else "3" if k.words < 10 else "10" if k.words < 25 else "25"
        more = [f"{by} {where}", f"{where} {k.found[1]}", f"{where} size {size}", f"{where} {k.found[4]}", f"{by} {k.found[4]}"]
        if where in ("same", "within"):
            more += [f"{f} here" for f in k.found if f.startswith(("says", "lexical"))]
        out[b] = k.found + more
    return out, {b for b, k in blocks.items() if places[k.room] in ("same", "within")}


def fitted(rows: list[list[str]], labels: list[int], penalty: float = 1.0, rounds: int = 12) -> dict[str, float]:
    """Logistic weights of features, by Newton's method with an L2 penalty."""
    names = {f: k for k, f in enumerate(sorted({f for r in rows for f in r}))}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [names[f] for f in r]] = 1
    y, w = np.array(labels, float), np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.linalg.solve(curve, x.T @ (p - y) + penalty * w)
    return {f: float(w[k]) for f, k in names.items()}


class Weights(NamedTuple):
    """Of features in the first scan and in the second, and of kinds of tags."""

    first: dict[str, float]
    second: dict[str, float]
    tags: dict[str, float]


def odds_of(found: dict[int, list[str]], weights: dict[str, float]) -> dict[int, float]:
    """Log odds, within ``CAP``, that a block is of the main text."""
    return {b: max(-CAP, min(CAP, sum(weights.get(f, 0.0) for f in fs))) for b, fs in found.items()}


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the greatest sum, by one scan; (0, 0) if none is above zero."""
    best, found, now, start = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(scores):
        if now <= 0:
            now, start = 0.0, k
        now += x
        if now > best:
            best, found = now, (start, k + 1)
    return found


def scan(page: Page, odds: dict[int, float], tags: dict[str, float], even: float, free: set[int] = frozenset()) -> tuple[int, int]:
    """The best run of words and tags. Blocks of ``free`` that are left out (an advert
    between paragraphs, however long) do not part what is before from what is after."""
    least, scores = min(tags.values()), []
    for item in page.items:
        if not isinstance(item, Piece):
            scores.append(tags.get(item, least))
        elif item.hidden or not item.words or odds[item.block] < 0 and item.block in free:
            scores.append(0.0)
        else:
            scores.append(item.words * (1 / (1 + math.exp(-odds[item.block])) - even))
    return best_run(scores)


def blocks_in(page: Page, run: tuple[int, int]) -> set[int]:
    return {x.block for x in page.items[run[0] : run[1]] if isinstance(x, Piece) and x.words and not x.hidden}


def learn(labelled: list[str]) -> Weights:
    tags: tuple[Counter, Counter] = (Counter(), Counter())
    read = []
    for source in labelled:
        page, inside, label = parse(source), False, {}
        for item in page.items:
            if isinstance(item, Piece):
                if item.words and not item.hidden:
                    label.setdefault(item.block, int(inside))
            elif item in (OPEN, CLOSE):
                inside = item == OPEN
            else:
                tags[inside][item] += 1
        read.append((page, known(page), label))
    n = [sum(c.values()) + len(c) for c in tags]
    of = {k: math.log((tags[1][k] + 1) / n[1]) - math.log((tags[0][k] + 1) / n[0]) for k in {*tags[0], *tags[1]}}
    most = max(of.values())
    of_tag = {k: (v - most - 1) * PER_TAG for k, v in of.items()}
    first = fitted([k.found for _, blocks, _ in read for k in blocks.values()], [label[b] for _, blocks, label in read for b in blocks])
    rows, labels = [], []
    for page, blocks, label in read:
        odds = odds_of({b: k.found for b, k in blocks.items()}, first)
        for b, found in placed(blocks, blocks_in(page, scan(page, odds, of_tag, FIRST)), odds)[0].items():
            rows.append(found)
            labels.append(label[b])
    return Weights(first, fitted(rows, labels), of_tag)


@lru_cache(maxsize=1)
def weights() -> Weights:
    """Weights of words, by their block, and of tags, from the labelled pages."""
    return learn(pages(LABELLED, SEED))


def extract(source: str | None, by: Weights | None = None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    by = by or weights()
    page = parse(source)
    blocks = known(page)
    odds = odds_of({b: k.found for b, k in blocks.items()}, by.first)
    found, within = placed(blocks, blocks_in(page, scan(page, odds, by.tags, FIRST)), odds)
    odds = odds_of(found, by.second)
    lo, hi = scan(page, odds, by.tags, 0.5, within)
    out, block, parts = [], -1, []
    for item in page.items[lo:hi]:
        if isinstance(item, Piece) and not item.hidden and odds.get(item.block, 0) >= 0:
            if item.block != block:
                out.append(" ".join("".join(parts).split()))
                block, parts = item.block, []
            parts.append(item.text)
    out.append(" ".join("".join(parts).split()))
    return "\n".join(x for x in out if x)


def extract_pages(rows: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), source: str = "html") -> DataFrame:
    """The columns of ``keep`` and ``text``."""
    own = rows.select(*(column(c).alias(f"__{i}") for i, c in enumerate(keep)), column(source).alias("__html"))
    schema = own.drop("__html").schema.add("__text", "string")
    by = weights()  # fitted once, on the driver

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, html_ = batch.columns
            yield pa.RecordBatch.from_arrays([*kept, pa.array([extract(x.as_py(), by) for x in html_], pa.string())], schema.names)

    out = map_batches(own, kernel, schema)
    return out.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)), F.col("__text").alias("text"))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
