"""Main text of web pages by two passes of rules over blocks.

The page is cut into blocks at block-level tags. The first pass classifies each
block by where it stands, its length, its share of link text and its density of
stop words; the second lets short and undecided blocks take the label of their
nearest decided neighbours. A marked main part (article, main) is one signal: it
keeps its short blocks if it has most of the prose, and dense prose outside it
is kept as well.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import extended, others, quoted

#: Frequent words of the languages that are read.
STOP_WORDS = frozenset(
    """the of and to in a is that it for on was with as be by at this are or an from not have had his her which but they we you
    der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei sie nach
    de la le les et des en un une du que est pour qui dans par sur pas plus au ce il ne se son avec
    el los las y del que en por con para una su al lo como más pero sus ya o este si porque
    il di che e la per un del con non le si da dei nel una al sono come
    o os do da em um para com não uma no na por mais dos
    van het een in is dat op te zijn met voor niet aan er om ook""".split()
)

#: Tags by what they do to the text.
RAW = frozenset("script style noscript template iframe object svg math textarea title xmp noembed noframes".split())
SKIPPED = frozenset("head nav footer aside form button select option label fieldset dialog menu canvas audio video".split())
BLOCK = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select
    summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that name parts beside the article.
BESIDE = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist
    respond replies cookie cookies consent copyright disclaimer footer gdpr legal login masthead menu modal nav navbar navigation
    newsletter notice notices overlay pagination pager popup popular promo promoted promotion recommended related share sharing
    sidebar side skip social sponsor sponsored subscribe subscription tags teaser toolbar widget widgets complementary contentinfo
    alert search disqus alertbar""".split()
)
#: Parts of compound names, as in has-sidebar or menu-open, that tell of a state and not of what the element is.
STATES = frozenset("has no not with without is by open opened closed active enabled disabled toggle toggled".split())
MAIN_ROLES = frozenset(["main", "article"])

#: A quoted value ends at a quote that white space or the tag's end follows; any other quote is a sign like others, so that one
#: that is never closed does not swallow what follows, and no pattern reads on to the page's end more than once.
_ATTRS = r"""(?:=\s*"[^"]{0,20000}"(?=[\s/>]|\Z)|=\s*'[^']{0,20000}'(?=[\s/>]|\Z)|[^<>"'=]|[="'])*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRS})>|</?[a-zA-Z][^<>]*\Z", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

#: Block rules: characters of a short block and of one long enough to decide by stop words alone, and densities.
SHORT, LONG, LINKS, STOP_LOW, STOP_HIGH = 70, 200, 0.33, 0.15, 0.25
#: Share of link text allowed in the main part, and of stop words in the prose of a page whose language has a list.
LINKS_MAIN, LISTED = 0.75, 0.1


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    beside: bool = False
    named: int = -1  # innermost element around it that is named like a part beside the article
    inside: bool = False
    heading: bool = False
    text: str = ""
    label: str = ""


def _names(attrs: str) -> set[str]:
    found: set[str] = set()
    for groups in _NAMED.findall(attrs):
        for name in " ".join(groups).split():
            parts = _PART.findall(_CAMEL.sub(" ", name).lower())
            if not STATES.intersection(parts):
                found.update(parts)
    return found


def _settle(found: list[Block], around: list[int]) -> None:
    """Decide which elements named like parts beside the article are; ``around`` has the element around each.

    Where the main part is marked only within such elements, those with half of
    its text or more are not beside it. Where no marked part outside them has a
    long block's worth of prose, one with most of the page's prose is not either.
    """
    n = len(around)
    prose, main, total, free, marked_free, within = [0] * n, [0] * n, 0, 0, False, 0
    holds = [False] * n
    for b in found:
        if b.beside:
            continue
        size = len(b.text) * (len(b.text) >= SHORT and b.linked <= LINKS * len(b.text))
        total += size
        if b.named >= 0:
            prose[b.named] += size
            main[b.named] += len(b.text) * b.inside
            holds[b.named] |= b.inside
            within += len(b.text) * b.inside
        elif b.inside:
            free, marked_free = free + size, True
    aside = [True] * n
    for k in reversed(range(n)):
        most = prose[k] >= LONG and 2 * prose[k] > total
        aside[k] = not (2 * main[k] >= within if holds[k] and not marked_free else most and free < LONG)
        outer = around[k]
        if outer >= 0:
            main[outer] += main[k]
            holds[outer] |= holds[k]
            prose[outer] += 0 if aside[k] else prose[k]
    for k, outer in enumerate(around):
        aside[k] |= outer >= 0 and aside[outer]
    for b in found:
        b.beside |= b.named >= 0 and aside[b.named]


def blocks(page: str | None) -> tuple[list[Block], bool]:
    """The page's blocks in order, and whether the page marks its main part."""
    page = page or ""
    out, block = [], Block()
    opened: Counter[str] = Counter()  # tags on the stack
    stack: list[tuple[str, bool, bool, int]] = []  # tag, starts something beside the article, starts the main part, named element around
    around: list[int] = []  # of each named element: the one around it
    beside = inside = links = 0
    named = -1
    at = 0

    def add(piece: str) -> None:
        if piece:
            block.parts.append(piece)
            if links and not piece.isspace():
                block.linked += len("".join(piece.split()))

    def cut(heading: bool = False) -> None:
        nonlocal block
        if block.parts:
            out.append(block)
        block = Block(beside=beside > 0, named=named, inside=inside > 0, heading=heading)

    def close(entry) -> None:
        nonlocal beside, inside, links, named
        tag, was_beside, was_main, named = entry
        opened[tag] -= 1
        beside -= was_beside
        inside -= was_main
        links -= tag == "a"

    cut()
    while found := _TOKEN.search(page, at):
        add(html.unescape(page[at : found.start()]))
        at = found.end()
        if found["cdata"] is not None:
            add(found["cdata"])
        if not (tag := (found["tag"] or "").lower()):
            continue
        if not found["end"]:
            if tag in RAW and not found["attrs"].endswith("/"):
                shut = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = shut.end() if shut else len(page)
                continue
            if tag == "a":
                while stack and links:  # links do not nest
                    close(stack.pop())
            if tag in ("p", "li", "option", "td", "th", "tr", "dt", "dd") and stack and stack[-1][0] == tag:
                close(stack.pop())
            if tag in VOID or found["attrs"].endswith("/"):
                if tag in BLOCK:
                    cut(block.heading)
                continue
            names = _names(found["attrs"])
            main = tag in ("article", "main") or bool(names & MAIN_ROLES and "role" in found["attrs"].lower())
            aside = tag in SKIPPED or (tag == "header" and not inside) or bool(_HIDDEN.search(found["attrs"]))
            main = main and not beside and not aside
            stack.append((tag, aside, main, named))
            opened[tag] += 1
            if names & BESIDE and tag not in ("html", "body", "article", "main"):
                around.append(named)
                named = len(around) - 1
            beside += aside
            inside += main
            links += tag == "a"
            if tag in BLOCK:
                cut(tag in HEADINGS)
        elif opened[tag]:
            while stack:
                entry = stack.pop()
                close(entry)
                if entry[0] == tag:
                    break
            if tag in BLOCK:
                cut()
        elif tag in BLOCK:
            cut()
    add(html.unescape(page[at:]))
    cut()
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    out = [b for b in out if b.text]
    _settle(out, around)
    return out, any(b.inside and not b.beside for b in out)


def _stop_words(text: str) -> tuple[int, int]:
    """How many words of a text are stop words, and how many words it has."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words), len(words)


def _first_pass(found: list[Block]) -> list[str]:
    """Labels; stop words count where the page's prose is in a language that has a list, else length decides alone."""
    labels, counts = [], {}
    for k, b in enumerate(found):
        solid = len(b.text.replace(" ", ""))
        if b.beside:
            labels.append("bad")
        elif b.linked > (LINKS_MAIN if b.inside else LINKS) * solid and not (b.heading and b.inside):
            labels.append("bad" if b.linked > 0.9 * solid or len(b.text) >= SHORT else "short")
        elif len(b.text) < SHORT or b.heading:
            labels.append("bad" if b.text.startswith("©") else "short")
        else:
            labels.append("")
            counts[k] = _stop_words(b.text)
    listed = sum(stop for stop, _ in counts.values()) >= LISTED * sum(n for _, n in counts.values())
    for k, (stop, n) in counts.items():
        long = len(found[k].text) >= LONG
        if not listed:
            labels[k] = "good" if long else "near"
        elif stop >= STOP_HIGH * n:
            labels[k] = "good" if long else "near"
        else:
            labels[k] = "near" if stop >= STOP_LOW * n else "short"
    return labels


def _second_pass(labels: list[str], inside: list[bool], trusted: bool) -> list[bool]:
    """Which blocks are kept: a good one, or a short one whose nearest decided neighbour is; ties are kept.

    Where the marked main part is trusted, its short blocks are kept, and short
    blocks outside need a good neighbour outside.
    """
    decided = [k for k, x in enumerate(labels) if x != "short"]
    good = {k for k in decided if labels[k] in ("good", "near")}
    kept, after = [], 0
    for k in range(len(labels)):
        while after < len(decided) and decided[after] < k:
            after += 1
        if after < len(decided) and decided[after] == k:
            kept.append(k in good)
            continue
        near = decided[max(0, after - 1) : after + 1]
        least = min((abs(d - k) for d in near), default=0)
        like = [d for d in near if d in good and abs(d - k) == least]
        if trusted:
            kept.append(inside[k] or any(not inside[d] for d in like))
        else:
            kept.append(not near or bool(like))
    return kept


def main_text(page: str | None) -> str:
    """The article of a page: its kept blocks, in page order, joined by one space.

    A marked main part is trusted if it has at least as much prose as the rest
    of the page; then only long dense blocks outside decide by themselves.
    """
    found, marked = blocks(page)
    labels = _first_pass(found)
    inside = [b.inside and not b.beside for b in found]
    prose = [0, 0]
    for b, label, within in zip(found, labels, inside, strict=True):
        prose[within] += len(b.text) * (label in ("good", "near"))
    trusted = marked and prose[True] >= prose[False]
    if trusted:
        labels = ["short" if label == "near" and not within else label for label, within in zip(labels, inside, strict=True)]
    kept = _second_pass(labels, inside, trusted)
    return " ".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages`` plus ``text`` and ``n_chars`` (its code points), one row per row.

    Reads the whole ``html``; a null or empty page, or one without main text,
    has an empty text. Unclosed tags end with what contains them. Equal pages
    get equal texts, and repeated rows come back as often as they came. Columns
    named like the new ones, in whatever case, are replaced. An empty table
    gives an empty result. The work grows with the length of a page.
    """
    kept = pages.select(*[F.col(quoted(c)) for c in others(pages.columns, ("text", "n_chars"))])
    place = kept.columns.index("html")

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(place).to_pylist()]
            columns = [*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "text", "n_chars"])

    return kept.mapInArrow(run, extended(kept.schema, "text string, n_chars bigint"))
