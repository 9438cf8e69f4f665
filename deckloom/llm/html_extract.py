"""Main text of web pages by consensus host paths.

Each page's containers are scored by the plain text of the blocks below them;
the page votes for the generalised tag-class path of its best one.  Votes are
counted per host in Spark, and every page is extracted again with its host's
winning path, or its own best container where that path holds little of it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm.store import materialise

_TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?>[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+[^>]*+)>)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object canvas".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul caption button".split()
)
_CONTAINER = frozenset("html article body center div main section td".split())
#: Elements whose text is never part of an article.
_OUTSIDE = frozenset("aside button dialog fieldset footer form head menu nav optgroup option search select label input".split())
#: Words of classes, ids and roles that say the same.
_OUTSIDE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies discussion disqus footer form gdpr masthead menu modal nav navbar navigation newsletter notice "
    "notices notification pager pagination popup promo promoted promotion recommended related replies respond search share "
    "sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
_HEADER_WORDS = frozenset(["header", "topbar"])
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_INSIDE_WORDS = frozenset("article articlebody body content entry main post story text".split())
#: An open element of the first kind ends where one of the second starts.
_ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]), "option": frozenset(["option", "optgroup"]),
}
_SCOPES = frozenset(["table", "ul", "ol", "dl", "article", "body", "html", "div", "section", "main"])


@dataclass(eq=False, slots=True)
class _Element:
    """An element that was open: ``place`` counts elements as they start,
    ``last`` is the count when it ended; ``near`` are the closest containers
    around its text; ``agreed`` says how far its path is the host's."""

    tag: str
    step: str
    above: _Element | None
    out: bool
    heading_only: bool
    bonus: bool
    place: int = 0
    last: float = math.inf
    depth: int = 1
    agreed: int = 0
    under: bool = False
    near: tuple[_Element, ...] = ()
    score: float = 0.0

    @property
    def path(self) -> str:
        return ">".join(reversed([e.step for e in _up(self)]))


@dataclass
class Page:
    """The blocks of a page in order, with the elements around them."""

    blocks: list[tuple[_Element, str]] = field(default_factory=list)
    containers: list[_Element] = field(default_factory=list)

    def best(self) -> _Element | None:
        """The container of the highest score, the first in the page if equal;
        an article around it, or a parent that holds half as much beside it,
        stands for it."""
        some = [c for c in self.containers if c.score > 0]
        if not some:
            return None
        best = max(some, key=lambda c: (c.score * (1.3 if c.bonus else 1), -c.place))
        around = [e for e in _up(best) if e.tag == "article"] or [e for e in _up(best) if e.tag == "main"]
        if around:
            return around[-1]
        above = best.above
        while above is not None and above.tag not in ("body", "html") and above.score >= 0.75 * best.score:
            best, above = above, above.above
        return best

    def agreed(self) -> list[str]:
        """Texts of the blocks inside elements of the host's path."""
        return [text for element, text in self.blocks if element.under]

    def inside(self, container: _Element) -> list[str]:
        return [text for element, text in self.blocks if container.place <= element.place <= container.last]


def _up(element: _Element | None) -> Iterator[_Element]:
    while element is not None:
        yield element
        element = element.above


def _describe(tag: str, attributes: str) -> tuple[str, set[str], bool]:
    """The generalised step of a path, the words of class, id and role, and
    whether the element is hidden."""
    if "=" not in attributes:
        return tag, set(), bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attributes))
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    words: set[str] = set()
    for name in ("class", "id", "role"):
        words.update(w.lower() for w in _TOKEN.findall(found.get(name, "")))
    classes = sorted({_DIGITS.sub("#", c) for c in found.get("class", "").split()})
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "display:none" in style or found.get("aria-hidden") == "true" or bool(re.search(r"\shidden(?:\s|$)", f" {_ATTRIBUTE.sub('', attributes)}"))
    return ".".join([tag, *classes]), words, hidden


def parse(source: str, winner: str | None = None) -> Page:
    """Blocks and scored containers of a page, of any depth; broken markup is
    read as far as it goes.  ``winner`` is the host's path, where it has one."""
    page = Page()
    steps = winner.split(">") if winner else [""]
    root = _Element("html", "html", None, False, False, False, agreed=int(steps[0] == "html"), under=steps == ["html"])
    root.near = (root,)
    stack = [root]
    n_open: Counter[str] = Counter()  # elements of the stack by tag
    parts: list[str] = []
    linked = 0  # characters of the block's text inside links
    in_link = False
    place = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.blocks.append((stack[-1], text))
                worth = max(0, len(text) - 2 * linked)
                if stack[-1].tag in _HEADINGS:
                    worth *= 0.25
                for share, holder in zip((1, 0.5, 0.25), stack[-1].near, strict=False):
                    holder.score += worth * share
            parts.clear()
        linked = 0

    def close(index: int) -> None:
        flush()
        for element in stack[index:]:
            element.last = place
            n_open[element.tag] -= 1
        del stack[index:]

    def text(value: str) -> None:
        nonlocal linked
        top = stack[-1]
        if value and not top.out and (not top.heading_only or top.tag in _HEADINGS):
            value = html.unescape(value) if "&" in value else value
            parts.append(value)
            if in_link:
                linked += len(value)

    at, last = 0, source.rfind(">") + 1
    while True:
        found = _TAG.search(source, at, last)
        if not found:
            break
        text(source[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag == "a":
                in_link = False
            elif tag == "p" and not n_open["p"]:
                flush()
            elif tag not in ("html", "body"):
                for i in range(len(stack) - 1, 0, -1) if n_open[tag] else ():
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if stack[i].tag in ("td", "th", "article", "main") and tag not in _SCOPES | {"tr", "header", "footer", "nav", "aside", "form"}:
                        break
                else:
                    if tag in _BLOCK:
                        flush()
            continue
        if tag in _RAW:
            if not found[3].endswith("/"):
                end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(source, at)
                at = len(source) if not end else source.find(">", end.start()) + 1 or len(source)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag == "a":
            in_link = True
        if tag == "html":
            continue
        step, words, hidden = _describe(tag, found[3])
        block = tag in _BLOCK
        out = hidden or tag in _OUTSIDE or (tag not in ("body", "article", "main") and not words.isdisjoint(_OUTSIDE_WORDS))
        if not block and not out:
            continue
        if block:
            flush()
            in_link = in_link and tag not in ("p", "div", "li")
            if any(e.tag == "p" for e in stack[-3:]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in _BLOCK:
                        break
            if tag in _ENDS and any(n_open[x] for x in _ENDS if tag in _ENDS[x]):
                for i in range(len(stack) - 1, 0, -1):
                    if tag in _ENDS.get(stack[i].tag, ()):
                        close(i)
                        break
                    if stack[i].tag in _SCOPES:
                        break
        top = stack[-1]
        header = tag == "header" or (tag not in ("body", "article", "main") and not words.isdisjoint(_HEADER_WORDS))
        in_article = header and n_open["article"] + n_open["main"] > 0
        place += 1
        element = _Element(
            tag, step, top, top.out or out or (header and not in_article), top.heading_only or in_article,
            tag in ("article", "main") or not words.isdisjoint(_INSIDE_WORDS), place=place, depth=top.depth + 1, under=top.under, near=top.near,
        )
        if top.agreed == top.depth < len(steps) and steps[top.depth] == step:
            element.agreed = element.depth
            element.under |= element.depth == len(steps)
        stack.append(element)
        n_open[tag] += 1
        if tag in _CONTAINER:
            element.near = (element, *top.near)[:3]
            if not element.out:
                page.containers.append(element)
    rest = source[at:]  # markup that the end of the page cuts off is no text
    cut = re.search(r"<[a-zA-Z/!?]", rest)
    text(rest[: cut.start()] if cut else rest)
    flush()
    if root.score:
        page.containers.append(root)
    return page


#: Share of the page's own best container that the host's path must hold:
#: where it lies inside that container, and where it is elsewhere.
AGREED_INSIDE, AGREED = 0.8, 0.5


def main_blocks(source: str, winner: str | None) -> list[str]:
    """The article's blocks: under the host's winning path, unless the page's
    own best container holds more than twice as much, or a quarter more around
    that path."""
    page = parse(source, winner)
    best = page.best()
    own = page.inside(best) if best else []
    if best and winner:
        agreed = page.agreed()
        around = any(element.under and best.place <= element.place <= best.last for element, _ in page.blocks)
        if sum(map(len, agreed)) >= (AGREED_INSIDE if around else AGREED) * sum(map(len, own)):
            return agreed
    return own


def host_of(url: Column) -> Column:
    """Lower-case host of an address; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(host != "", host)


#: Most hosts whose paths are sent to all tasks; beyond, they are joined.
BROADCAST_HOSTS = 100_000


def host_paths(pages: DataFrame, *, url: str = "url", content: str = "html") -> DataFrame:
    """(host, path): the path most pages of a host vote for; ties go to the
    first in code point order."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [parse(x.as_py()).best() if x.is_valid else None for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([b.path if b else None for b in best], pa.string())], ["host", "path"])

    votes = pages.select(host_of(F.col(url)).alias("host"), F.col(content)).where("host IS NOT NULL")
    votes = votes.mapInArrow(vote, "host string, path string").where("path IS NOT NULL")
    counts = votes.groupBy("host", "path").agg(F.count("*").alias("votes"))
    return counts.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def extract_pages(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", content: str = "html", broadcast_hosts: int = BROADCAST_HOSTS
) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null and empty pages, and pages without an article, have an empty text.
    Pages without a host are extracted by their own best container.  Rows are
    never merged; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                "\n\n".join(main_blocks(x.as_py(), w)) if x.is_valid else ""
                for x, w in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    winners = materialise(host_paths(pages, url=url, content=content), "host-paths")
    few = winners.count() <= broadcast_hosts
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(content).alias("html"), host_of(F.col(url)).alias("host")
    )
    rows = rows.join(F.broadcast(winners) if few else winners, "host", "left").select("page_id", "url", "html", "path")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
