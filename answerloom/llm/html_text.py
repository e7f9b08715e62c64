r"""HTML extraction by a maximum-scoring subsequence.

A page is a sequence of tags and runs of text. Words score positive, tags negative; how much comes from labelled
pages, those with exactly one ``article`` or ``main`` element, by counting which names and classes stand inside it or
hold it, and which stand outside. A linear scan finds the contiguous region with the best sum; its text is the result.

Elements that the weights place outside content give no text, wherever they stand. Three things weigh: the labelled
pages; names of elements for something else (``nav``, ``footer`` and the like); and a class, id or role made of words of
BOILERPLATE_WORDS alone (``ad``, ``cookie-notice``, but not ``has-sidebar``), which some ten sightings inside
content outweigh. Never dropped are ``html``, ``body`` and what holds an ``article`` or ``main``; nor, unless the labelled
pages are sure of it (SURE), a ``form`` or elements of one class that hold most of the words outside such names. If nothing is left,
the page is scanned again with names of elements alone deciding.

Text: character references decoded, white space inside a block one space, blocks in page order joined by \n. ``br`` is
white space; inline tags are nothing.

Defined cases: null or empty html, and pages without any word outside boilerplate, give empty text; an unclosed script, style or comment reaches the
end of the page; unclosed tags end with their parent; a ``<`` that starts no tag is text; on ties the first region
wins; without labelled pages the fixed names and words alone decide; a script, svg or the like that ends in ``/>`` is empty; repeated rows are extracted each. Only page_id, url and
html are read.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.texts import bounded_batches, keep_share, strings, table

FIT_PAGES = 4000
TAG_COST = 0.05
DROP_COST = 0.3
FAR = 3.0
DROP_BELOW = -1.0
SURE = -4.0
PRIOR = 8.0
HINT = 4.0

# Element names and words of class, id and role by their usual meaning.
RAW = ("script", "style", "textarea", "template", "noscript", "svg", "iframe")
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BOILERPLATE_NAMES = (
    "nav footer aside form header head title button select option label fieldset menu dialog script style noscript "
    "template iframe svg textarea"
).split()
NEUTRAL_NAMES = (
    "html body div span section main article p table thead tbody tfoot tr td th ul ol li dl dt dd a b i u em strong "
    "small sub sup mark code pre blockquote q cite h1 h2 h3 h4 h5 h6 br hr img figure figcaption picture center font"
).split()
BOILERPLATE_WORDS = (
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner sidebar side comment comments "
    "reply replies respond disqus cookie cookies consent notice notices alert newsletter subscribe subscription share sharing "
    "social related recommended menu nav navbar navigation breadcrumb breadcrumbs footer header masthead popup modal "
    "overlay widget login signup search pagination pager skip legal copyright complementary contentinfo hidden"
).split()
BLOCKS = frozenset(
    (
        "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
        "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead "
        "title tr ul"
    ).split()
)
LABELS = ("article", "main")
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>%s)\b(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)|<(?P<cut>[a-zA-Z][^<>]*+)\Z|(?P<text>[^<]++|<)" % "|".join(RAW),
    re.DOTALL | re.IGNORECASE,
)
WORD = re.compile(r"[a-z]+")
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def features(name: str, attrs: str) -> tuple[str, ...]:
    """What tells where an element stands: its name, unless that says nothing, and the words of its class, id and role."""
    out = [] if name in NEUTRAL_NAMES else [name]
    for m in ATTRIBUTE.finditer(attrs):
        if m[1].lower() in ("class", "id", "role"):
            out += ["." + x for x in (m[2] or m[3] or m[4] or "").lower().split()]
    return tuple(out)


def prior(feature: str) -> float:
    """Log-odds of standing inside content before any page is seen."""
    if feature[:1] != ".":
        return -PRIOR if feature in BOILERPLATE_NAMES else 0.0
    parts = WORD.findall(feature)
    return -HINT if parts and all(x in BOILERPLATE_WORDS for x in parts) else 0.0


@dataclass(frozen=True, eq=False)
class Mark:
    """What is known of an element by its name and attributes."""

    score: float  # of its tags
    odds: float  # of standing inside content, by its least likely feature
    sure: bool  # whether labelled pages alone say that it stands outside
    named: bool  # whether the name alone says so


class Weights:
    """Log-odds per feature from counts (inside, outside) of the labelled pages; names of elements weigh ``PRIOR``, words ``HINT``."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.seen = {f: math.log((a + 0.5) / (b + 0.5)) for f, (a, b) in counts.items()}
        self.cache: dict[tuple[str, str], Mark] = {}

    def of(self, feature: str) -> float:
        return self.seen.get(feature, 0.0) + prior(feature)

    def element(self, name: str, attrs: str) -> Mark:
        key = (name, attrs)
        if key not in self.cache:
            if len(self.cache) > 50_000:
                self.cache.clear()
            marks = features(name, attrs)
            odds = min([0.0, *map(self.of, marks)])
            sure = min([0.0, *(self.seen.get(f, 0.0) for f in marks)]) < SURE
            named = name != "form" and self.of(name) < DROP_BELOW
            self.cache[key] = Mark(-TAG_COST + FAR * min(0.0, self.of("<" + name)), odds, sure, named)
        return self.cache[key]


HINTS = Weights({})


def _closed(stack: list, name: str, start: bool) -> int:
    """How many elements stay open when this tag comes."""
    if start:
        if name in BLOCKS:
            depth = len(stack)
            if stack and stack[-1][0] not in BLOCKS or stack and stack[-1][0] in CLOSED_BY_BLOCK:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSED_BY_BLOCK:
                        depth = k
                    if stack[k][0] in BLOCKS:
                        break
            if name in SIBLINGS and depth and stack[depth - 1][0] in SIBLINGS[name]:
                depth -= 1
            return depth
        return len(stack)
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == name:
            return k
    return len(stack)


class Element:
    """An element of a page; its words are those of all it holds."""

    __slots__ = ("name", "attrs", "parent", "words", "holds")

    def __init__(self, name: str, attrs: str, parent: int):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.words, self.holds = 0, name in LABELS


def parse(page: str) -> tuple[list[Element], list[tuple]]:
    """(elements, events) in page order; element 0 stands around all. An event is (kind, element, name or text) with
    kind ``text``, ``start``, ``end``, ``void`` or ``raw``; the element of a start is the one that begins."""
    elements, events = [Element("", "", -1)], []
    stack: list[tuple[str, int]] = []
    for m in TOKEN.finditer(page):
        here = stack[-1][1] if stack else 0
        text = m["text"]
        if text is not None:
            elements[here].words += len(text.split())
            events.append(("text", here, text))
        elif m["raw"]:
            events.append(("raw", here, None))
        elif m["name"]:
            name = m["name"].lower()
            if m["end"]:
                del stack[_closed(stack, name, False) :]
                events.append(("end", here, (stack[-1][1] if stack else 0, name)))
                continue
            del stack[_closed(stack, name, True) :]
            here = stack[-1][1] if stack else 0
            if name in VOID or name in RAW or m["attrs"].endswith("/"):
                events.append(("void", here, name))
                continue
            elements.append(Element(name, m["attrs"], here))
            stack.append((name, len(elements) - 1))
            events.append(("start", len(elements) - 1, name))
    for e in reversed(elements[1:]):
        elements[e.parent].words += e.words
        elements[e.parent].holds |= e.holds
    return elements, events


def tokens(page: str, weights: Weights, names_only: bool = False) -> list[tuple[float, bool, str | None]]:
    """(score, block break, text or None) in page order; elements whose text does not count are one token.

    ``names_only``: no class, id or role and no labelled page takes a part.
    """
    elements, events = parse(page)
    marks = [HINTS.element(e.name, "") if names_only else weights.element(e.name, e.attrs) for e in elements]
    suspect = [m.odds < DROP_BELOW and not (e.holds or e.name in ("html", "body")) for e, m in zip(elements, marks)]
    inside, together, words = [False], Counter(), elements[0].words
    for e, m, s in zip(elements[1:], marks[1:], suspect[1:]):
        inside.append(inside[e.parent] or s)
        if s and not inside[e.parent]:
            together[m] += e.words
            words -= e.words if m.named else 0
    gone, most = [False], words / 2
    for e, m, s in zip(elements[1:], marks[1:], suspect[1:]):
        gone.append(gone[e.parent] or (s and (m.sure or m.named or together[m] <= most)))
    out = []
    for kind, e, what in events:
        if kind == "start":
            if not gone[elements[e].parent]:
                out.append((-DROP_COST if gone[e] else marks[e].score, what in BLOCKS, None))
        elif kind == "end":
            parent, name = what
            if not gone[parent]:
                out.append((-TAG_COST if gone[e] else weights.element(name, "").score, name in BLOCKS, None))
        elif not gone[e]:
            if kind == "text":
                out.append((float(len(what.split())), False, what))
            else:
                out.append((-TAG_COST, what == "hr", " " if what == "br" else None))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the first contiguous run with the largest sum; empty if no score is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best:
            best, region = total, (start, k + 1)
    return region


def region_text(found: list[tuple[float, bool, str | None]]) -> str:
    """Text of the best region, blocks joined by line breaks."""
    start, end = best_region([x[0] for x in found])
    blocks, current = [], []
    for _, block, text in found[start:end]:
        if block:
            blocks.append("".join(current))
            current = []
        if text is not None:
            current.append(text)
    blocks.append("".join(current))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def extract(page: str, weights: Weights) -> str:
    return region_text(tokens(page, weights)) or region_text(tokens(page, weights, names_only=True))


def count_features(page: str, totals: dict[str, Counter]) -> None:
    """Add a labelled page's elements to the counts inside and outside its content; other pages add nothing. Elements
    that hold the content count as inside; what stands in an element dropped by its name is not counted."""
    elements, _ = parse(page)
    if sum(e.name in LABELS for e in elements) != 1:
        return
    inside, skipped = [False], [False]
    for e in elements[1:]:
        inside.append(inside[e.parent] or e.name in LABELS)
        named = HINTS.element(e.name, "").odds < DROP_BELOW and not e.holds
        skipped.append(skipped[e.parent] or named)
        if not skipped[e.parent]:
            # Where names stand says how dear their tags are, so around the content they are outside it.
            totals["in" if inside[e.parent] else "out"]["<" + e.name] += 1
            for f in set(features(e.name, e.attrs)):
                totals["in" if inside[-1] or e.holds else "out"][f] += 1


def _count(batches):
    totals = {"in": Counter(), "out": Counter()}
    for batch in batches:
        for page in strings(batch["html"]):
            count_features(page, totals)
    names = sorted({*totals["in"], *totals["out"]})
    yield pa.record_batch(
        [pa.array(names, pa.string()), *(pa.array([totals[k][n] for n in names], pa.int64()) for k in ("in", "out"))],
        names=["feature", "inside", "outside"],
    )


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Weights:
    """Weights from about ``fit_pages`` pages, all where there are fewer; a class has to occur twice to count."""
    bounded_batches(pages.sparkSession)
    n = pages.count()
    share = min(1.0, fit_pages / n) if n else 0.0
    sample = pages.where(keep_share(F.struct("page_id", F.length("html")), F.lit(share))).select("html")
    counts = sample.mapInArrow(_count, "feature string, inside long, outside long")
    counts = counts.groupBy("feature").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b")).where("a + b > 1")
    return Weights({r["feature"]: (r["a"], r["b"]) for r in counts.collect()})


def _extract(batches, shared):
    weights = shared.value
    for batch in batches:
        texts = [extract(x, weights) for x in strings(batch["html"])]
        columns = [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.record_batch(columns, names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """(page_id, url, text, n_chars) of (page_id, url, html)."""
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        functools.partial(_extract, shared=shared), f"page_id {kind}, url string, text string, n_chars long"
    )


def op4_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, fit(pages))
