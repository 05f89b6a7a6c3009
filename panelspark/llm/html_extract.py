"""HTML extraction with site style trees.

Pages of one host are merged into a tree whose nodes are branches: the tags, classes and ids from the
root down. A branch's importance comes from two entropies over the host's distinct pages: of its
texts, the content, which is low for what many pages repeat, and of its presentation, the number of
its blocks. Importance counts as evidence for or against a branch, the more the more pages have it.

Tags, roles, class and id names shift what evidence a branch needs: an article or main part needs
none, a plain branch goes if its host repeats it, one that is named as a header or widget stays only if
its pages differ in it. What differs from page to page and still isn't main text (menus, adverts,
forms, reader comments) is shifted further than importance can make good.

A name counts only if all its words say the same (`share-buttons`, but neither `share-price` nor
`no-sidebar`), and never against a branch that holds the page's main part. If names would leave nothing of
a page, the branches in which its host's pages differ stay whatever their names, but for comments and adverts.

Parsing is linear in the page: no scan goes twice over the same signs, and no stack is searched.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, fresh, ship_code
from .textkit import column_chunks

#: Branches of a host whose evidence may lie in one row.
BRANCHES = 4096
#: Weight of texts against presentation in a branch's importance.
TEXT_WEIGHT = 0.9
#: What a plain branch has before evidence, and one in an article or main part has besides.
PLAIN, ARTICLE = 0.35, 0.65
#: Shifts by tag, role and name. Evidence lies between -1 and 1.
NEVER, FIRM, SOFT, MILD = -9.0, -1.75, -1.3, -0.9

_START = re.compile(r"<(?=[a-zA-Z/!?])")
_STOP = re.compile(r"""[>"']""")
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_WORD = re.compile(r"[a-z]+")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input br".split())
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_NEVER_TAGS = set("head script style noscript template iframe object svg select button textarea".split())
_FIRM_TAGS = set("nav footer aside form dialog menu".split())
_FIRM_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Tags whose class and id say what they hold; in others every word must be one of those below.
_CONTAINERS = set("div section ul ol dl table aside nav header footer form details fieldset".split())
#: Words of class and id names for what isn't main text whether or not it differs from page to page,
#: for what may be either, and for main text.
_FIRM_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe "
    "subscription popup modal sidebar menu nav navbar navigation breadcrumb breadcrumbs related recommended recommendations share sharing "
    "comment comments commentlist cmt cmts talkback talkbacks usercomments respond disqus reply replies pagination pager login signup".split()
)
_SOFT_WORDS = set("banner notice notices overlay header footer masthead social widget widgets search copyright disclaimer toolbar".split())
_STATE_WORDS = set("no not non has have with without is are hide hidden show open closed js".split())
#: Words beside which the others keep their meaning.
_BESIDE_WORDS = set(
    "list box block wrapper wrap container area section bar inner outer top bottom left right page site global primary secondary main item items link links row col "
    "column panel group button buttons btn icon icons slot unit zone title heading head foot body text content post posts article articles story stories news thread "
    "field email mobile desktop fixed sticky small large first last author form".split()
)
_MAIN_WORDS = set("article content entry post story text body main title headline image figure caption".split())
_ARTICLE_WORDS = set("comment comments commentlist cmt cmts talkback talkbacks usercomments reply replies ad ads advert sponsored related promo".split())


class Block(NamedTuple):
    path: int
    text: str
    shift: float  # the lowest of the branch's shifts
    inside: bool  # in an article or main part
    bare: float  # the lowest shift but for names, comments' and adverts' names among them


def _said(name: str) -> tuple[str, list[str]]:
    """What a class or id name says: firm, soft, main or nothing; and its words."""
    words = _WORD.findall(name)
    if not words or words[0] in _STATE_WORDS or words[-1] in _STATE_WORDS or ("sidebar" in words and "content" in words):
        return "", words  # a state, or a layout of both
    if all(w in _FIRM_WORDS or w in _SOFT_WORDS or w in _BESIDE_WORDS or len(w) == 1 for w in words):
        if any(w in _FIRM_WORDS for w in words):
            return "firm", words
        if any(w in _SOFT_WORDS for w in words):
            return ("main" if any(w in _MAIN_WORDS for w in words) else "soft"), words
    return ("main" if any(w in _MAIN_WORDS for w in words) else ""), words


@lru_cache(8192)
def _describe(tag: str, source: str) -> tuple[str, float, float, bool]:
    """A node's name in the tree, the shift of its tag, role and names, that but for names (those of comments and
    adverts count), and whether it is a main part."""
    name, said, role = tag, [], ""
    for key, a, b, c in _ATTRIBUTE.findall(source):
        key, value = key.lower(), (a or b or c).lower()
        if key == "role":
            role = value.strip()
        elif key in ("class", "id"):
            found = [_said(x) for x in value.split()]
            said += found
            name += ("." if key == "class" else "#") + "-".join(w for _, words in found for w in words)
    if tag in _NEVER_TAGS:
        return name, NEVER, NEVER, False
    if tag == "form" and not role:
        return name, FIRM, 0.0, False
    if tag in _FIRM_TAGS or role in _FIRM_ROLES:
        return name, FIRM, FIRM, False
    if tag in ("html", "body", "main"):
        return name, 0.0, 0.0, tag == "main"
    firm = [words for what, words in said if what == "firm"]
    beside = FIRM if any(_ARTICLE_WORDS.intersection(words) for words in firm) else 0.0
    if tag == "article":
        return name, beside, beside, beside == 0.0
    soft = sum(what == "soft" for what, _ in said)
    if tag not in _CONTAINERS:
        every = bool(said) and len(firm) + soft == len(said)
        return name, (FIRM if firm else MILD) if every else 0.0, beside if every else 0.0, False
    if firm:
        return name, FIRM, beside, False
    if not soft or any(what == "main" for what, _ in said):
        return name, 0.0, 0.0, role == "main"
    return name, SOFT if all(w in _SOFT_WORDS for _, words in said for w in words) else MILD, 0.0, False


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


@lru_cache(65536)
def _child_path(parent: int, name: str) -> int:
    return _hash(parent.to_bytes(8, "little", signed=True), name.encode("utf-8", "surrogatepass"))


class _Node:
    __slots__ = ("tag", "path", "parent", "own", "bare", "part", "holds", "shift", "least", "inside", "inline", "held")

    def __init__(self, tag: str, source: str, parent: _Node | None):
        name, self.own, self.bare, self.part = (_describe if len(source) < 1000 else _describe.__wrapped__)(tag, source)
        self.tag, self.path, self.parent = tag, _child_path(parent.path if parent else 0, name), parent
        self.holds = False  # whether the page's main part is below
        self.settle()
        self.inline: list[_Node] = []  # open inline elements since this block began, and how many of each tag
        self.held: dict[str, int] = {}

    def settle(self) -> None:
        """Shifts from the parent's and the node's own; a node that holds the main part has none by name."""
        above = self.parent
        inside = bool(above and above.inside)
        shift, bare = (self.bare if self.holds else self.own), self.bare
        if self.tag == "header" and not inside:
            shift = bare = FIRM
        self.shift = min(shift, above.shift) if above else shift
        self.least = min(bare, above.least) if above else bare
        self.inside = inside or (self.shift >= 0 and self.part)


class _Tags:
    """Ends of tags: the first `>` outside quotes; a quote that is never closed is an ordinary sign."""

    def __init__(self, page: str):
        self.page, self.last, self.known = page, page.rfind(">"), {}

    def end(self, at: int) -> int:
        """The place after the tag that begins at `at`, or -1 if it has no end."""
        if self.last < at:
            return -1
        page, here, passed = self.page, at, []
        while True:
            if (found := self.known.get(here)) is not None:
                break
            passed.append(here)
            m = _STOP.search(page, here)
            if not m or m[0] == ">":
                found = m.end() if m else -1
                break
            here = page.find(m[0], m.end()) + 1
            if not here:
                found = -1
                break
        for p in passed:
            self.known[p] = found
        return found if found >= 0 else page.find(">", at) + 1 or -1


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order. Tags that may be left out are closed as browsers do; what isn't
    a tag is text; an unclosed comment or script goes on to the end."""
    out: list[tuple[_Node, _Node, str]] = []
    root = _Node("", "", None)
    stack, opened, made, articles = [root], {"": 1}, [root], 0
    text: list[str] = []
    tags, at = _Tags(page), 0

    def flush() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if joined:
                top = stack[-1]
                here = top.inline[-1] if top.inline else top
                out.append((top, here, joined))

    def pop() -> None:
        flush()
        opened[stack.pop().tag] -= 1

    while True:
        m = _START.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.start()
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else len(page)
            continue
        named = _TAG.match(page, at)
        stop = tags.end(at + 1) if named else page.find(">", at) + 1 if page[at + 1] in "!?/" and tags.last > at else -1
        if stop < 0:
            text.append("<")
            at += 1
            continue
        source, at = page[at:stop], stop
        if not named:
            continue
        tag = named[1].lower()
        top = stack[-1]
        if source[1] == "/":
            if tag == "br":
                text.append(" ")
            elif tag in _INLINE:
                while top.held.get(tag):
                    if top.inline[-1].shift < top.shift:
                        flush()
                    gone = top.inline.pop().tag
                    top.held[gone] -= 1
                    if gone == tag:
                        break
            elif opened.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in _RAW:
            if tag != "textarea" or not source.endswith("/>"):
                end = _RAW[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in _INLINE:
            node = _Node(tag, source, top.inline[-1] if top.inline else top)
            made.append(node)
            if node.shift < top.shift:
                flush()
            top.inline.append(node)
            top.held[tag] = top.held.get(tag, 0) + 1
            continue
        flush()
        closes = _CLOSES.get(tag, ("p",))
        while stack[-1].tag in closes:
            pop()
        top = stack[-1]
        parent = top.inline[-1] if top.inline and top.inline[-1].shift < top.shift else top
        node = _Node(tag, source, parent)
        made.append(node)
        if node.part and (tag != "article" or not articles):  # the first article, else a main part
            above = parent
            while above and not above.holds:
                above.holds, above = True, above.parent
        articles += node.part
        if parent is top:
            top.inline, top.held = [], {}  # formatting that is still open doesn't go on
        if not (source.endswith("/>") and tag not in ("p", "div", "li")):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    for node in made:  # parents come before their children
        node.settle()
    return [Block(top.path, joined, here.shift, here.inside, here.least) for top, here, joined in out]


def main_text(page: str, evidence: dict[int, float]) -> str:
    """The page's text without branches that shift and evidence speak against. If evidence alone leaves
    nothing, as on pages that all of a host's repeat, what isn't shifted stays; if names leave nothing, what
    its host's pages differ in."""
    found = blocks(page)
    kept = [b for b in found if b.shift + PLAIN + (ARTICLE if b.inside and b.shift >= 0 else 0) + evidence.get(b.path, 0.0) >= -1e-9]
    kept = kept or [b for b in found if b.shift >= 0] or [b for b in found if b.bare >= 0 and evidence.get(b.path, 0.0) > 0]
    return "\n".join(b.text for b in kept)


def host(url: F.Column) -> F.Column:
    """Lower-case host of a URL; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, path, text, blocks): how many blocks of a branch have a text; text is a hash."""
    names = ["host", "page", "path", "text", "blocks"]
    for batch in batches:
        for lo, hi in column_chunks(batch.column("html")):
            part = batch.slice(lo, hi - lo)
            rows: list[tuple] = []
            for site, page, html in zip(part.column("host").to_pylist(), part.column("page").to_pylist(), part.column("html").to_pylist(), strict=True):
                counts: dict[tuple[int, str], int] = {}
                for b in blocks(html):
                    counts[b.path, b.text] = counts.get((b.path, b.text), 0) + 1
                rows += [(site, page, path, _hash(text.encode("utf-8", "surrogatepass")), n) for (path, text), n in counts.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)


def merged_pages(pages: DataFrame) -> DataFrame:
    """(host, page, path, text, blocks): the branches of each host's distinct pages, from pages (host, page, html).

    page says which pages of a host are equal; equal pages count once. path and text are hashes."""
    ship_code(pages.sparkSession)
    rows = pages.select("host", "page", "html").mapInArrow(_features, "host string, page long, path long, text long, blocks long")
    return rows.groupBy("host", "page", "path", "text").agg(F.first("blocks").alias("blocks"))


def style_tree(rows: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of every branch with text, from the rows of merged_pages.

    Of m pages with the branch, a text on n of them has the entropy log(n) / log(m); texts weigh by
    their pages. The presentation's entropy is that of the number of blocks a page. On one page both
    are 1. Importance is 1 less the texts' entropy, and the presentation's, weighted. A branch above
    others is unimportant if all those below are, so that these decide.
    """
    per_page = rows.groupBy("host", "path", "page").agg(F.sum("blocks").alias("blocks"))
    styles = per_page.groupBy("host", "path", "blocks").agg(F.count("*").alias("n"))
    m = F.sum("n")
    style = styles.groupBy("host", "path").agg(m.alias("pages"), F.when(m > 1, F.log(m) - F.sum(F.col("n") * F.log("n")) / m).otherwise(0.0).alias("spread"))
    style = style.withColumn("shown", F.when(F.col("pages") > 1, F.col("spread") / F.log("pages")).otherwise(1.0))
    texts = rows.groupBy("host", "path", "text").agg(F.count("*").alias("n"))
    texts = texts.groupBy("host", "path").agg(F.sum("n").alias("weight"), F.sum(F.col("n") * F.log("n")).alias("repeats"))
    both = texts.join(style, ["host", "path"])
    said = F.when(F.col("pages") > 1, 1 - F.col("repeats") / F.col("weight") / F.log("pages")).otherwise(1.0)
    return both.select("host", "path", "pages", (TEXT_WEIGHT * F.greatest(said, F.lit(0.0)) + (1 - TEXT_WEIGHT) * F.col("shown")).alias("importance"))


def evidence_of(pages: F.Column, importance: F.Column) -> F.Column:
    """From -1 for a branch that many pages repeat to 1 for one in which they differ; 0 for a branch of one page."""
    return (pages - 1) / (pages + 1) * (2 * importance - 1)


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with text, the main text, and n_chars, its code points.

    Blocks are joined by newlines; white space in a block is one space. Null and empty html give an
    empty text. A page without a host (null or odd url) is judged by its own markup alone. Repeated
    rows are extracted alike, and count once in their host's tree. Other columns pass through, whatever
    their names; text and n_chars are replaced; html goes. An empty table gives an empty one.

    Pages are parsed once for the trees and once for their texts. Hosts have their branches' evidence in one
    row each, which Spark broadcasts only if all are small; the pages of a host of more than BRANCHES
    branches get that of their own branches alone.
    """
    scratch = Scratch(pages.sparkSession, "html")
    pages = pages.drop("text", "n_chars")
    site, page, found, own = fresh(pages, "site", "page", "found", "own")
    keyed = pages.withColumns({site: host(F.col("url")), page: F.xxhash64("html")})
    known = keyed.filter((F.col(site) != "") & F.col("html").isNotNull()).select(F.col(site).alias("host"), F.col(page).alias("page"), "html")
    rows = scratch.save(merged_pages(known), "branches")
    tree = style_tree(rows).filter("pages > 1").select("host", "path", evidence_of(F.col("pages"), F.col("importance")).alias("evidence"))
    tree = scratch.save(tree, "tree")
    branches = F.collect_list(F.struct("path", "evidence"))
    wide = scratch.save(tree.groupBy("host").count().filter(F.col("count") > BRANCHES).select("host"), "wide-hosts")
    usual = tree.join(wide, "host", "left_anti").groupBy(F.col("host").alias(site)).agg(branches.alias(found))
    keyed = keyed.join(scratch.save(usual, "evidence"), site, "left")
    if not wide.isEmpty():
        met = rows.join(wide, "host", "left_semi").select("host", "page", "path").distinct().join(tree, ["host", "path"])
        met = met.groupBy(F.col("host").alias(site), F.col("page").alias(page)).agg(branches.alias(own))
        keyed = keyed.join(scratch.save(met, "own-evidence"), [site, page], "left").withColumn(found, F.coalesce(found, own)).drop(own)

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, lists in batches:
            known = ({e["path"]: e["evidence"] for e in x} if x is not None else {} for x in lists)
            yield pd.Series([main_text(h or "", x) for h, x in zip(htmls, known, strict=True)], dtype=object)

    return keyed.withColumn("text", text("html", found)).withColumn("n_chars", F.length("text").cast("long")).drop(site, page, found, "html")
