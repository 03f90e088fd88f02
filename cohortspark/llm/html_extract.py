"""Main text of web pages by consensus of their host.

Every page's containers are scored by their own prose, and a page votes for the generalised path of its best
one (tags with the classes and ids of the ancestors, digits folded). Votes are counted per host in Spark; the
winning paths of a host are then used to extract all of its pages again. A page without a winning path
falls back on its own best container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import stored

#: Share of a host's best vote count that a path needs in order to win, next to the best one.
SHARE = 0.1

# a comment, a declaration, a processing instruction, or a tag with its attributes; an unclosed one ends the page
_MARKUP = re.compile(
    r"<!--(?:.*?)(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DIGITS = re.compile(r"\d+")

RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of the article.
OUTSIDE = frozenset(
    "head nav footer aside form button select dialog menu script style noscript template textarea title iframe object svg math".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("article main section div body td center".split())
#: Words of a class, id or role that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsbox banner sponsor sponsored promo promotion nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs sidebar side aside footer foot header masthead topbar toolbar cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login register comment comments "
    "respond reply replies discussion disqus reader readers related recommended recommendations share sharing social follow "
    "search form widget widgets pagination pager skip copyright legal disclaimer complementary contentinfo".split()
)
#: Words that say nothing about what an element holds: inside an article, a name marks boilerplate only if all its
#: words are of these or the ones above (`share-buttons` does, `social-history` is a subject).
NEUTRAL = frozenset(
    "area bar block body bottom box boxes button buttons col column container content footer form group grid header heading icon icons "
    "inline inner item items label left line link links list main more outer panel post posts right row section slot small stories "
    "text title top unit view widget wrap wrapper".split()
)
#: Unlinked characters of a block that make it prose.
PROSE = 80
#: Tags that end an open paragraph, and for others the open tags that they end themselves.
_ENDS_P = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol p pre section table ul".split()
)
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}


@dataclass
class Block:
    """A run of text between block borders, with its open containers and whether it lies in boilerplate."""

    text: str
    path: tuple[int, ...]
    linked: int
    outside: bool


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    #: Generalised path of every container, and the container around it.
    paths: list[str] = field(default_factory=list)
    parents: list[int | None] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip() else {}


def _step(tag: str, attrs: dict[str, str]) -> str:
    classes = ".".join(sorted(set(_DIGITS.sub("0", attrs.get("class", "")).split())))
    name = _DIGITS.sub("0", attrs.get("id", "").strip())
    return tag + (f".{classes}" if classes else "") + (f"#{name}" if name else "")


def _boilerplate(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6", "p"):
        names = attrs.get("class", "") if tag == "p" else ""
    else:
        names = " ".join(attrs.get(k, "") for k in ("class", "id", "role"))
    if not in_article:
        return any(w in BOILERPLATE for w in re.split(r"[^a-z]+", names.lower()))
    for name in names.lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if len(w) > 1]
        if any(w in BOILERPLATE for w in words) and all(w in BOILERPLATE or w in NEUTRAL for w in words):
            return True
    return False


def parse(page: str) -> Page:
    """Blocks and containers of a page. Never fails: what cannot be read as markup is text."""
    out = Page()
    # open elements: tag, container number or None, inside a link, inside boilerplate
    stack: list[tuple[str, int | None, bool, bool]] = []
    buffer: list[tuple[str, bool]] = []

    def flush() -> None:
        raw = "".join(t for t, _ in buffer)
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if text:
            linked = len("".join(t for t, is_link in buffer if is_link).strip())
            path = tuple(c for _, c, _, _ in stack if c is not None)
            out.blocks.append(Block(text, path, linked, bool(stack) and stack[-1][3]))
        buffer.clear()

    def pop(to: int) -> None:
        flush()
        del stack[to:]

    at, size = 0, len(page)
    while at < size:
        upto = page.find("<", at)
        upto = size if upto < 0 else upto
        m = _MARKUP.match(page, upto)
        if not m and upto < size:  # a lone sign is text
            upto += 1
        if upto > at:
            buffer.append((page[at:upto], bool(stack) and stack[-1][2]))
        at = m.end() if m else upto
        if not m:
            continue
        if m["cdata"]:
            buffer.append((m["cdata"].replace("&", "&amp;"), False))
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if found is None:
                if tag in ("p", "br"):
                    flush()
            elif tag in INLINE:
                # formatting that was left open inside ends with it, blocks do not
                if all(stack[i][0] in INLINE for i in range(found, len(stack))):
                    del stack[found:]
            else:
                pop(found)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                buffer.append((" ", False))
                if tag == "hr":
                    flush()
            continue
        attrs = _attributes(m["attrs"])
        if tag not in INLINE:
            flush()
            if tag in _ENDS_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _ENDS.get(tag, ()):
                    del stack[i:]
                    break
                if stack[i][0] in _SCOPE.get(tag, ()) or tag not in _ENDS:
                    break
        above = stack[-1] if stack else ("", None, False, False)
        in_article = any(t in ("article", "main") for t, *_ in stack)
        outside = above[3] or _boilerplate(tag, attrs, in_article)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        container = None
        if tag in CONTAINERS and not (tag == "section" and in_article):  # a section of an article is part of it
            container = len(out.paths)
            parents = [c for _, c, _, _ in stack if c is not None]
            out.paths.append((out.paths[parents[-1]] + ">" if parents else "") + _step(tag, attrs))
            out.parents.append(parents[-1] if parents else None)
            out.tags.append(tag)
        stack.append((tag, container, above[2] or tag == "a", outside))
    flush()
    return out


def scores(page: Page) -> list[float]:
    """Per container the prose it holds itself or in inline and block elements that are no containers, plus a
    share of its children's: text that is not linked and not boilerplate, long blocks more than short ones."""
    out = [0.0] * len(page.paths)
    for block in page.blocks:
        if block.outside or not block.path:
            continue
        prose = max(0, len(block.text) - 2 * block.linked)
        value = prose * (1.0 if len(block.text) >= 80 else 0.5)
        for depth, container in enumerate(reversed(block.path)):
            out[container] += value * 0.6**depth
    return out


def best_path(page: Page) -> str | None:
    """The path of the container with the highest score, or of the one around it that its article begins in.

    A part of an article may score higher than the article. So the best container gives way to the nearest
    `article` around it, and to any container around it that holds prose of its own beside it.
    """
    found = scores(page)
    best = max(range(len(found)), key=lambda i: (found[i], -i), default=None)
    if best is None or found[best] <= 0:
        return None
    own = {b.path[-1] for b in page.blocks if b.path and not b.outside and len(b.text) - 2 * b.linked >= PROSE}
    around, lifted = best, best
    while (around := page.parents[around]) is not None:
        if page.tags[lifted] != "article" and (page.tags[around] == "article" or around in own):
            lifted = around
    return page.paths[lifted]


def main_text(page: Page, winning: list[str]) -> str:
    """The text under the first of `winning` that the page has, else under its own best container, else all of it.

    Boilerplate inside the container is left out."""
    present = set(page.paths)
    path = next((p for p in winning if p in present), None) or best_path(page)
    chosen = {i for i, p in enumerate(page.paths) if p == path}
    kept = [b for b in page.blocks if not b.outside and (path is None or any(c in chosen for c in b.path))]
    return " ".join(b.text for b in kept)


def host(url: Column) -> Column:
    """The host of a URL in lower case, without port and user; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = [best_path(parse(h)) if h else None for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])


def host_paths(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, paths): the container paths that a host's pages agree on, most votes first, ties by path.

    Votes collapse per task before they are shuffled, so a host with a third of all pages is no hot spot.
    """
    votes = pages.mapInArrow(_votes, "host string, path string").where("path IS NOT NULL")
    counts = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    most = F.max("votes").over(Window.partitionBy("host"))
    won = counts.withColumn("most", most).where(F.col("votes") >= F.col("most") * share)
    listed = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("rank"), "path")))
    return won.groupBy("host").agg(F.transform(listed, lambda s: s["path"]).alias("paths"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            main_text(parse(h), paths or []) if h else ""
            for h, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null and empty pages give an empty text; a null url or one without a host votes with its like. Repeated
    rows give repeated results; other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select("page_id", "url", "html").withColumn("host", host(F.col("url")))
    paths = stored(host_paths(rows.select("host", "html")), "paths")
    kind = pages.schema["page_id"].dataType.simpleString()
    return (
        rows.join(paths, "host", "left")
        .select("page_id", "url", "html", "paths")
        .mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long")
    )
