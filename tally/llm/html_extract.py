"""Main text of web pages by template deduction from equivalence classes.

Pages of one host share a template.  Each page is cut into tokens (tags with
their path, text runs with their path); a token's occurrence vector says how
often it occurs on each page of the host.  Vectors are compared by sums of
per-page hashes, which Spark adds up in parallel, so no host's pages are ever
gathered.  Tokens of equal vectors form an equivalence class; a class is valid
when it is large and frequent enough, every token occurs once a page, and its
tokens keep their order (a token that leaves the order of the others on a page
is no template token there).  The classes nest into the host's template: the
tag tokens delimit slots, the text tokens are the template's own words.  What
remains in the slots is extracted: the main text is taken from the article (or
main) element, else from all slots, without regions whose element or class marks
them as menu, advert, comment and so on.  So on pages with an article the element
rules alone decide; the template decides on the others.

Names are of two kinds.  Some (adverts, comments, sharing, hidden elements, menu and
footer elements) mark a region that goes in any case.  Others (``sidebar``,
``header``, ``banner``, ``widget``, forms) are as often part of a wrapper's name,
``layout-no-sidebar`` or a form around the whole page: around an article or main
element, or around more than ``WRAPPER`` of the text where there is none, such a
region is a wrapper and stays.  A main element whose own text is longer than the
articles (in it or beside it) is the main text, and the articles are teasers.

Copies of a page are one page of the host.  A class of part of the host's pages
(a page kind, say blog or shop) needs tags of its own, so that text which some
pages share is no template.  Hosts of a few pages, or without a host, have no template; the rules on
elements alone hold there.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, with_python
from .url_filter import host_of

MIN_PAGES = 8  # pages a host needs for a template
FREQUENT = 0.9  # share of a host's pages (broken ones may lack the end) on which a class occurs
PART = 0.1  # the same for a class that has tags of its own (a page kind), on MIN_PAGES at least
WRAPPER = 0.7  # share of a page's text from which on a region's name does not drop it
SMALL_TEMPLATES = 8 << 20  # bytes of all templates together that may be broadcast

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(script|style|noscript|template|textarea|select|svg|iframe|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|</?[a-zA-Z][^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_ATTR = re.compile(r"""\b(class|id|role|style|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("head title nav header footer aside button menu dialog option fieldset".split())
KEPT = frozenset("html body article main".split())
_MARKED = r"(?:^|[-_\s])(?:%s)(?:$|[-_\s\d])"
_ADDED = re.compile(_MARKED % (
    "ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?|breadcrumbs?|cookies?|consent|gdpr|comments?|"
    "disqus|replies|reply|respond|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|popup|modal|"
    "pagination|pager|copyright|dialog"), re.I)
_LAYOUT = re.compile(_MARKED % (
    "banner|nav|navbar|navigation|menu|sidebar|aside|header|masthead|footer|notices?|alert|search|form|widget|toolbar|"
    "complementary|contentinfo"), re.I)
# inside a line only a name that says nothing else: a link of class nav-link is part of the text
_INSERTED = re.compile(r"(?:^|\s)(?:ads?|adverts?|advertisements?|advertising|sponsored|promo|share|sharing|social|newsletter|subscribe)"
                       r"(?:$|[-_\s\d])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")


class Region(NamedTuple):
    """Where a run of text stands: ``hard`` goes in any case; ``before`` and ``outer`` number the
    regions of layout names around the innermost article or main element, and inside it (for
    text outside of both: none and all)."""

    part: str = ""  # article or main, the innermost that is not dropped itself
    hard: bool = False
    before: tuple = ()
    outer: tuple = ()


def _marks(raw: str, tag: str) -> list[tuple[str, str]]:
    if len(raw) <= len(tag) + 2:
        return []
    return [(a.lower(), x or y or z) for a, x, y, z in _ATTR.findall(raw)]


def _hides(a: str, v: str) -> bool:
    return a == "hidden" or a == "style" and bool(_HIDDEN.search(v))


def _named(names: re.Pattern, a: str, v: str) -> bool:
    return a in ("class", "id", "role") and bool(names.search(v))


def tokens(page: str) -> Iterator[tuple[str, str, str, Region | None]]:
    """``(kind, path, value, region)`` in page order: kind ``tag`` or ``end`` with the
    element's path, ``text`` with a run's decoded text; no region: a paragraph or a part of a
    line that its own attributes hide or mark as an insertion."""
    root = ("", "", Region())
    stack: list[tuple[str, str, Region]] = []  # name, path, region
    soft: list[str] = []  # elements inside a line from the marked one on: those of its name
    for number, m in enumerate(_TOKEN.finditer(page)):
        raw = m[0]
        _, path, region = stack[-1] if stack else root
        if raw[0] != "<" or len(raw) == 1:
            yield "text", path, entities.unescape(raw), None if soft else region
            continue
        if raw.startswith("<![CDATA["):
            yield "text", path, raw[9:].removesuffix("]]>"), None if soft else region
            continue
        name = _NAME.match(raw)
        if m[1] or not name:
            continue  # scripts, styles, comments, declarations
        tag = name[1].lower()
        if soft and tag not in INLINE and tag not in VOID:
            soft.clear()  # a block ends the line, a paragraph's end the paragraph
        if raw[1] == "/":
            if soft and soft[-1] == tag:
                soft.pop()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    path = stack[i][1]
                    del stack[i:]
                    yield "end", path, tag, region
                    break
            else:
                yield "end", path, tag, region
            continue
        if tag in INLINE or tag in VOID or tag == "p":  # leaves that need not be closed are no containers
            if soft:
                if soft[0] == tag:
                    soft.append(tag)
            elif tag not in VOID and not raw.endswith("/>"):
                if any(_hides(a, v) or _named(_INSERTED, a, v)
                       or tag == "p" and (_named(_ADDED, a, v) or _named(_LAYOUT, a, v)) for a, v in _marks(raw, tag)):
                    soft.append(tag)
            yield "tag", path, tag, region
            continue
        marks = _marks(raw, tag)
        path = f"{path}/{tag}" + "".join("." + v for a, v in marks if a in ("class", "id"))
        if tag in ("article", "main") and not region.hard:
            # main inside an article is a part of it
            region = Region(region.part if region.part == "article" else tag, False, region.before + region.outer)
        if tag in DROPPED or tag not in KEPT and any(_hides(a, v) or _named(_ADDED, a, v) for a, v in marks):
            region = region._replace(hard=True)
        elif tag == "form" or tag not in KEPT and any(_named(_LAYOUT, a, v) for a, v in marks):
            region = (region._replace(hard=True) if region.part == "article"
                      else region._replace(outer=(*region.outer, number)))
        if tag == "li" and stack and stack[-1][0] == "li":
            stack.pop()
        if not raw.endswith("/>"):
            stack.append((tag, path, region))
        yield "tag", path, tag, region


def _key(kind: str, path: str, value: str) -> str:
    label = f"{kind} {path} {value}" if kind != "text" else f"text {path} {_SPACE.sub(' ', value).strip()}"
    return kind[1] + hashlib.blake2b(label.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _within(path: str, names: tuple[str, ...]) -> bool:
    return any(part.split(".", 1)[0] in names for part in path.split("/"))


def _is_template_kind(kind: str, path: str, value: str) -> bool:
    """Whether a token may belong to the template; an article's own text never does, however often
    the article is copied."""
    if kind == "text":
        return bool(value.strip()) and not _within(path, ("article", "main"))
    return value not in INLINE and value != "p"


def occurrences(page: str) -> dict[str, list]:
    """Token key (tags begin with ``a``) -> [occurrences, first place]."""
    out: dict[str, list] = {}
    for at, (kind, path, value, _) in enumerate(tokens(page)):
        if _is_template_kind(kind, path, value):
            out.setdefault(_key(kind, path, value), [0, at])[0] += 1
    return out


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """``(host, token, n_pages, total, v1, v2, place)`` from ``(host, page_key, html)``: sums over
    the host's pages; ``v1``, ``v2`` identify the occurrence vector, ``place`` orders tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, str], list] = defaultdict(lambda: [0, 0, 0, 0, 0.0])
            for host, page_key, page in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = occurrences(page)
                found[""] = [1, 0]  # counts the host's pages
                for token, (n, at) in found.items():
                    h = int.from_bytes(hashlib.blake2b(b"%d %d" % (page_key, n), digest_size=8).digest(), "little")
                    s = sums[host, token]
                    s[0] += 1
                    s[1] += n
                    s[2] += h & 0x7FFFFFFF
                    s[3] += h >> 33
                    s[4] += at
            rows = [(h, t, *s) for (h, t), s in sums.items()]
            cols = list(zip(*rows)) or [()] * 7
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["host", "token", "n_pages", "total", "v1", "v2", "place"])

    schema = "host string, token string, n_pages long, total long, v1 long, v2 long, place double"
    return (with_python(pages).mapInArrow(run, schema).groupBy("host", "token")
            .agg(*[F.sum(c).alias(c) for c in ("n_pages", "total", "v1", "v2", "place")]))


def templates(pages: DataFrame) -> DataFrame:
    """``(host, template)``: the classes of ordered template tokens of every host with enough pages."""
    vectors = materialize(occurrence_vectors(pages).where("token = '' or n_pages > 1"), "html-vectors")
    hosts = vectors.where(f"token = '' and n_pages >= {MIN_PAGES}").select("host", F.col("n_pages").alias("pages"))
    known = vectors.where("token != ''").join(hosts, "host")
    frequent = known.where(
        f"n_pages >= least({MIN_PAGES}, {FREQUENT} * pages) and n_pages >= {PART} * pages and total = n_pages")
    # classes: tokens of one vector; a class of a single token proves no template
    classes = frequent.groupBy("host", "pages", "n_pages", "v1", "v2").agg(
        F.collect_list(F.struct((F.col("place") / F.col("n_pages")).alias("place"), "token")).alias("tokens"))
    own_tags = F.exists("tokens", lambda x: x["token"].startswith("a"))
    valid = classes.where((F.size("tokens") >= 2) & ((F.col("n_pages") >= FREQUENT * F.col("pages")) | own_tags))
    return valid.groupBy("host").agg(F.collect_list(
        F.transform(F.sort_array("tokens"), lambda x: x["token"])).alias("template"))


def _places(template: list[list[str]] | None) -> dict[str, tuple[int, int]]:
    """Template token -> its class and its place there."""
    return {t: (c, i) for c, tokens_ in enumerate(template or ()) for i, t in enumerate(tokens_)}


def _blocks(page: str, order: dict[str, tuple[int, int]]) -> list[tuple[Region, str]]:
    """The blocks of text between the template's tokens, in page order."""
    slots: list[list[tuple[str, Region, list[str]]]] = [[]]  # per slot: path, region, runs of a block
    last, fresh = defaultdict(lambda: -1), True
    for kind, path, value, region in tokens(page):
        place = order.get(_key(kind, path, value)) if order and _is_template_kind(kind, path, value) else None
        if place is not None and place[1] > last[place[0]]:  # a template token in its class's order
            last[place[0]] = place[1]
            if kind == "text":
                fresh = True
                continue
            slots.append([])
            fresh = True
        elif kind != "text" and value not in INLINE:
            fresh = True
        if kind == "text" and region is not None:
            if fresh or not slots[-1] or slots[-1][-1][0] != path:
                slots[-1].append((path, region, []))
                fresh = False
            slots[-1][-1][2].append(value)
        elif value in ("br", "wbr", "img") and kind != "text" and slots[-1] and not fresh:
            slots[-1][-1][2].append(" ")
    found = ((region, _SPACE.sub(" ", "".join(runs)).strip()) for slot in slots for _, region, runs in slot)
    return [x for x in found if x[1]]


def _unwrapped(blocks: list[tuple[Region, str]]) -> list[str]:
    """The texts outside regions of layout names; one that holds most of the blocks' text is a wrapper."""
    inside: dict[int, int] = defaultdict(int)
    for region, text in blocks:
        for number in region.outer:
            inside[number] += len(text)
    limit = WRAPPER * sum(len(text) for _, text in blocks)
    return [text for region, text in blocks if all(inside[number] > limit for number in region.outer)]


def _chosen(blocks: list[tuple[Region, str]]) -> list[str]:
    left = [x for x in blocks if not x[0].hard]

    def size(texts: list[str]) -> int:
        return sum(map(len, texts))

    article = [text for r, text in left if r.part == "article" and not r.before]
    main = _unwrapped([x for x in left if x[0].part == "main" and not x[0].before])
    if article or main:
        return main if size(main) > size(article) else article
    if any(r.part == "article" and not r.before for r, _ in blocks):
        return []  # an article of boilerplate alone
    wrapped = _unwrapped([x for x in left if x[0].part and x[0].before])
    plain = _unwrapped([x for x in left if not x[0].part])
    return wrapped if wrapped and size(wrapped) >= size(plain) else plain


def main_text(page: str, template: list[list[str]] | None = None) -> str:
    """The blocks of the main text, joined by two line breaks; empty if none."""
    return "\n\n".join(_chosen(_blocks(page, _places(template))))


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None,
            out: str = "text") -> DataFrame:
    """The columns ``keep`` (all by default) with the main text ``out``.

    NULL html is an empty page with an empty text.  Pages without a host share
    no template.  Character references are decoded, white space inside a block
    becomes one space; blocks stand in page order.  Repeated pages are rows of
    their own, but one page for the template; an empty table gives no rows.  A page
    is read whole, however long.  A kept column named as ``out`` is replaced.
    """
    cols = [c for c in (pages.columns if keep is None else keep) if c != out]
    n = len(cols)
    src = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)],
                       host_of(F.col(f"`{url}`")).alias("__host"), text_or_empty(F.col(f"`{html}`")).alias("__html"))
    known = src.where("__host != ''").select(
        F.col("__host").alias("host"), F.xxhash64("__host", "__html").alias("page_key"), F.col("__html").alias("html")
    ).dropDuplicates(["host", "page_key"])
    found = materialize(templates(known), "html-templates").withColumnRenamed("host", "__site")
    size = found.agg(F.coalesce(F.sum(F.size(F.flatten("template")) * 25 + 100), F.lit(0)).alias("n")).first()["n"]
    joined = src.join(F.broadcast(found) if size <= SMALL_TEMPLATES else found, F.col("__host") == F.col("__site"), "left")
    joined = joined.select(*[f"c{i}" for i in range(n)], "__html", "__site", "template")
    schema = src.select(*[f"c{i}" for i in range(n)]).schema.add("__text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, order = None, {}
        for b in batches:
            texts = []
            for i, (page, own) in enumerate(zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist())):
                if own != site:  # a template is unpacked once for a run of pages of its host
                    site, order = own, _places(b.column(n + 2)[i].as_py())
                texts.append("\n\n".join(_chosen(_blocks(page, order))))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, pa.string())],
                                             names=[*(f"c{i}" for i in range(n)), "__text"])

    return with_python(joined).mapInArrow(run, schema).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], F.col("__text").alias(out))
