"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: elements, told apart by the containers they stand in, and text blocks. Over the
distinct pages of a host every token has an occurrence vector (how often it is in each page), kept as two 64-bit sums so
that equal vectors are found by an aggregation, however many pages a host has. Tokens with equal vectors form a class.
Classes whose tokens occur once a page, in `slot_support` of a host's pages or more, lie in each other by the paths of their
containers: one that all pages have, such as html and body, around those of each of the host's page templates, and these
around the classes of parts that only some pages have. No tree of them is built; the depth of a path stands for it. A class's containers bound its slots; its main slot is the innermost that
holds most of what a page of the host has as text outside menus, adverts and the like. A page is read in the most telling
and innermost of the main slots that it has just once. Text blocks of a class that `support` of the pages have are
template, and go. What remains of a page's main slot is its text.

Hosts with fewer than `least_pages` distinct pages, and pages that lack their host's main slot, are read by the element
names alone. Null and empty html, and pages without text, give an empty string. Repeated rows each get their row. Broken
markup (unclosed elements, cut pages, stray brackets) is read as far as it goes. A page's url may be null. Empty tables
give no rows. Nothing but a host's few template tokens is ever brought together.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrays import chunks
from quillstone.llm.shared import stored

#: Fixed values of HTML: elements without content, elements whose content is not markup, containers, and blocks.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math".split())
CONTAINERS = set("html head body main article section div nav header footer aside form ul ol dl table tbody thead tr td th figure details dialog menu fieldset".split())
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre hr figcaption summary address caption legend option".split())
#: What is not an article, by element, by ARIA role and by a whole name in a class or id: a kind of aside,
#: with or without words of place before it and of layout after it, so that `related-posts` is one and `related-work` not.
ASIDE = set("head nav footer aside form dialog menu button select".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = re.compile(
    r"(?:(?:site|page|top|main|post|article|blog|global|left|right|bottom|primary|secondary|user|reader|mobile)[-_])*"
    r"(?:ads?|advert\w*|adsense|banners?|cookies?|consent|gdpr|newsletter|subscribe|subscription|promos?|promotions?|sponsor(?:ed|s)?|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|commentlist|respond|disqus|related|share|sharing|social|widgets?|popup|modal|notices?|alerts?|login|signup|search|pagination|pager|toolbar|tracking|hidden)"
    r"(?:[-_](?:ads?|box|bar|block|wrap|wrapper|container|list|area|slot|unit|banner|inner|top|bottom|left|right|header|footer|links?|menu|form|buttons?|icons?|posts?|panel|notice|message|thread|overlay|modal|popup|widgets?|nav|col|column|zone|placement|section|signup|\d+))*",
    re.I,
)
SITE_HEADER = re.compile(r"(?:^|\s)(?:(?:site|page|top|main|global)[_-])?header(?:$|\s)", re.I)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?][^>]*>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)


@dataclass(frozen=True)
class Extraction:
    """least_pages: distinct pages from which a host's template is deduced. support: share of a host's pages that have a
    text block of the template; slot_support: that have a class whose containers may be the main slot. share: of a page's
    text outside menus and the like that its main slot holds at least, on average. broadcast_hosts: up to which the
    templates go to every executor."""

    least_pages: int = 5
    support: float = 0.5
    slot_support: float = 0.2
    share: float = 0.7
    broadcast_hosts: int = 20_000


class Page:
    """Containers (path, aside or not, first token of their end) and text blocks (container, text) of one page."""

    def __init__(self, source: str):
        self.paths = [""]
        self.aside = [False]
        self.parent = [-1]
        self.blocks: list[tuple[int, str]] = []
        self._read(source)

    def _open(self, name: str, attributes: str, up: int) -> int:
        found = {a.lower(): b or c or d or "" for a, b, c, d in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        named = f"{found.get('class', '')} {found.get('id', '')}"
        in_article = bool(re.search(r">(?:article|main)\b", self.paths[up]))
        aside = (
            name in ASIDE or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true"
            or any(map(NAMES.fullmatch, named.split())) or (not in_article and (name == "header" or bool(SITE_HEADER.search(named))))
        )
        label = ".".join(found.get("class", "").split()[:2])
        self.paths.append(f"{self.paths[up]}>{name}" + (f".{label}" if label else ""))
        self.aside.append(self.aside[up] or (aside and name not in ("html", "body", "main", "article")))
        self.parent.append(up)
        return len(self.paths) - 1

    def _read(self, source: str) -> None:
        stack, names, held, at = [0], [""], [], 0

        def end_block() -> None:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                self.blocks.append((stack[-1], text))
            held.clear()

        while (m := TOKEN.match(source, at)) is not None:
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                if m[0][:1] != "<" or m[0] == "<":
                    held.append(m[0])
                continue
            if name in BLOCKS:
                end_block()
            elif name == "br":
                held.append(" ")
            if m[1]:
                if name in names:
                    while names[-1] != name:
                        stack.pop()
                        names.pop()
                    stack.pop()
                    names.pop()
            elif name in RAW:
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
                at = close.end() if close else len(source)
            elif name in CONTAINERS and not m[3].endswith("/"):
                stack.append(self._open(name, m[3], stack[-1]))
                names.append(name)
        end_block()

    def inside(self, container: int) -> list[bool]:
        """Which containers lie in one (itself included)."""
        out = [False] * len(self.paths)
        for i in range(len(out)):
            out[i] = i == container or (i > 0 and out[self.parent[i]])
        return out

    def text(self, slots: list[str], template: set[int]) -> str:
        """Blocks of the first of the slots (their paths) that the page has just once, or else of what element names tell,
        without asides and template blocks."""
        at = next(([self.paths.index(s)] for s in slots if self.paths.count(s) == 1), [])
        if not at:
            at = next((x for tag in ("article", "main") if (x := [i for i, p in enumerate(self.paths) if re.search(rf">{tag}(?:\.[^>]*)?$", p) and not self.aside[i]])), [0])
        within = [any(x) for x in zip(*(self.inside(a) for a in at), strict=True)]
        left = [(c, t) for c, t in self.blocks if within[c] and not self.aside[c]]
        if template and left:
            left = [x for x, h in zip(left, block_hashes(self, left), strict=True) if h not in template]
        return "\n".join(t for _, t in left)


def hashes(values: list[str]) -> list[int]:
    """Signed 64-bit hashes."""
    return [(h ^ 1 << 63) - (1 << 63) for h in map(xxhash.xxh3_64_intdigest, values)]


def block_hashes(page: Page, blocks: list[tuple[int, str]]) -> list[int]:
    return hashes([f"{page.paths[c]}\n{t}" for c, t in blocks])


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def occurrences(pages: DataFrame) -> DataFrame:
    """host, page, token (hash), path (of a container; null for a text block), n, chars (of text in the container)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "html"):
            rows: list[tuple] = []
            for host, number, source in zip(*(part.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
                page = Page(source)
                inner = [0] * len(page.paths)
                for c, t in page.blocks:
                    while c >= 0 and not page.aside[c]:
                        inner[c] += len(t)
                        c = page.parent[c]
                seen: dict = {}
                for path, size, aside in zip(page.paths, inner, page.aside, strict=True):
                    old = seen.get(path, (0, 0, aside))
                    seen[path] = (old[0] + 1, old[1] + size, aside)
                keys = hashes(list(seen))
                rows += [(host, number, k, None if aside else path, n, size) for k, (path, (n, size, aside)) in zip(keys, seen.items(), strict=True)]
                texts: dict = {}
                shown = [b for b in page.blocks if not page.aside[b[0]]]
                for k in block_hashes(page, shown) if shown else ():
                    texts[k] = texts.get(k, 0) + 1
                rows += [(host, number, k, "", n, 0) for k, n in texts.items()]
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["host", "page", "token", "path", "n", "chars"])

    return pages.mapInArrow(run, "host string, page long, token long, path string, n long, chars long")


def templates(pages: DataFrame, p: Extraction) -> DataFrame:
    """host, slots (paths of the classes' main slots, best first), boilerplate (hashes of template text blocks), for hosts
    with enough pages.

    A page that occurs several times adds the same to the vectors of all its tokens, so equal vectors stay equal.
    """
    keyed = pages.select("host", F.xxhash64("html").alias("page"), "html")
    enough = keyed.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("distinct_pages")).filter(F.col("distinct_pages") >= p.least_pages)
    mark = F.xxhash64("page", "n")
    vector = {"v1": F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))), "v2": F.sum(F.shiftrightunsigned(mark, 32))}
    tokens = occurrences(keyed).groupBy("host", "token").agg(F.max("path").alias("path"), F.count("*").alias("pages"), F.sum("n").alias("occurrences"), F.sum("chars").alias("chars"), *(v.alias(k) for k, v in vector.items()))
    tokens = stored(tokens.filter("pages > 1"), "tokens")
    whole = tokens.filter(F.col("token") == hashes([""])[0]).join(enough, "host").select("host", F.col("pages").alias("all_pages"), F.col("chars").alias("all_chars"))
    once = tokens.filter("occurrences = pages").join(whole, "host").filter(F.col("pages") >= p.slot_support * F.col("all_pages"))
    named = F.when(F.col("path").rlike(r">article(?:\.[^>]*)?$"), 2).when(F.col("path").rlike(r">main(?:\.[^>]*)?$"), 1).otherwise(0)
    # The text that so many pages have on average is held against what lies in the container on them.
    slot = (F.col("path") != "") & (F.col("chars") * F.col("all_pages") >= p.share * F.col("all_chars") * F.col("pages"))
    rank = F.when(slot, F.struct(named.alias("named"), F.size(F.split("path", ">")).alias("depth"), "path"))
    template = F.when((F.col("path") == "") & (F.col("token") != hashes([""])[0]) & (F.col("pages") >= p.support * F.col("all_pages")), F.col("token"))
    classes = once.groupBy("host", "v1", "v2").agg(F.max(rank).alias("slot"), F.collect_list(template).alias("texts"))
    by_host = classes.groupBy("host").agg(F.sort_array(F.collect_set("slot"), asc=False).alias("slots"), F.flatten(F.collect_list("texts")).alias("boilerplate"))
    return by_host.select("host", F.col("slots.path").alias("slots"), "boilerplate")


def extract_text(pages: DataFrame, p: Extraction | None = None) -> DataFrame:
    """page_id, url, html -> a row per page: page_id, url, text, n_chars."""
    p = p or Extraction()
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    found = stored(templates(rows, p), "templates")
    size = found.agg(F.count("*").alias("hosts"), F.coalesce(F.sum(F.size("boilerplate")), F.lit(0)).alias("blocks")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "html"):
            out = [Page(source).text(slots or [], set(drop or ())) for source, slots, drop in zip(*(part.column(c).to_pylist() for c in ("html", "slots", "boilerplate")), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    known = F.broadcast(found) if size.hosts <= p.broadcast_hosts and size.blocks <= 10 * p.broadcast_hosts else found
    return rows.join(known, "host", "left").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", "slots", "boilerplate").mapInArrow(run, "page_id long, url string, text string, n_chars long")
