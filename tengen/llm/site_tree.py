"""Main text of web pages by site style trees.

The pages of one host are merged into a style tree: a node is the path of presentations (tag, class, id) from the root, and
holds how its pages render it (the sequence of child tags) and which texts it carries. A node whose style hardly varies
(entropy over styles) and whose texts come back on most pages (entropy of each text over the pages) matters little to its
host; such branches are removed from each page. Counts are taken over distinct pages, so copies of one page do not make its
article look like a template, and only nodes met on `MIN_PAGES` pages are judged.

Every branch is judged by the tree, inside marked articles (article or main element) too. Marks and names are priors:

* Text outside of a marked article that holds at least half of the page's important text loses `OUTSIDE` of its importance;
  nodes that the tree does not judge have 0.5. A lesser article (a teaser) says nothing about the rest of its page.
* A class, id or role that names a menu, sidebar, notice, advert, comments or the like, and a form, takes its whole branch out,
  unless the branch holds most of the important text of the page (of its marked article, if there is such a one).
* Scripts, styles, controls, hidden elements, and the tags nav, footer, aside and a header outside of an article are not read.

Character references are decoded, white space within a block becomes one space, blocks are joined by an empty line.
Null or empty html gives an empty text; pages without a host form one site; broken markup is read as far as it goes; repeated
rows keep one result each; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, stage, table, take_columns, texts_of

MIN_PAGES = 5
THRESHOLD = 0.35
OUTSIDE = 0.4  # taken from the importance of what lies outside of a marked article
OWN_SHARE = 0.8  # of a node's texts in its importance; the rest is its parent's style
BROADCAST_ROWS = 200_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*>|[^<]+|<", re.S | re.I)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
            "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table "
            "tbody tfoot thead tr ul".split())
NOISE = set("nav footer aside script style noscript template iframe svg head button select textarea input menu dialog "
            "title object canvas audio video map".split())
PARAGRAPH_ENDS = BLOCK - {"option", "optgroup", "legend"}
#: words in a class, id or role that name what is no article
NOISE_WORDS = set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar "
                  "navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice popup "
                  "modal comment comments disqus respond replies share sharing social related recommended newsletter "
                  "subscribe signup login pagination pager widget toolbar skip".split())
WEAK_WORDS = {"header"}
SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Element:
    tag: str
    node: int
    noise: bool
    main: bool
    names: tuple[int, ...] = ()  # elements from the root down whose name says they are no article, by number on the page
    within: bool = False  # such a name inside the marked article
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    text: str
    raw: str
    paragraph: int  # parts of one paragraph are parted by named elements in it
    inside: bool  # the marked article
    node: int
    names: tuple[int, ...]
    within: bool


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    styles: list[tuple[int, str, int]] = field(default_factory=list)  # node, child tags, parent's node

    def text(self, low: set[int], high: set[int]) -> str:
        """Blocks that stay, given the nodes of the site under THRESHOLD, and those at least OUTSIDE over it."""
        blocks = [b for b in self.blocks if b.node not in low]
        core = [b for b in blocks if b.inside and not b.within]
        rest = sum(len(b.text) for b in blocks if not b.inside and not b.names)
        size = sum(len(b.text) for b in core)
        marked = size > 0 and size >= rest
        if not marked:
            core, size = blocks, sum(len(b.text) for b in blocks)
        held: dict[int, int] = {}
        for b in core:
            for n in b.names:
                held[n] = held.get(n, 0) + len(b.text)
        whole = {n for n, held_here in held.items() if 2 * held_here > size}
        paragraphs: dict[int, list[str]] = {}
        for b in blocks:
            if whole.issuperset(b.names) and (b.inside or not marked or b.node in high):
                paragraphs.setdefault(b.paragraph, []).append(b.raw)
        return "\n\n".join(" ".join("".join(p).split()) for p in paragraphs.values())


def hashed(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def parse(html: str) -> Page:
    page = Page()
    stack = [Element("", 0, False, False)]
    words: list[str] = []
    where: tuple = ()
    named = paragraph = 0

    def part() -> None:
        raw = "".join(words)
        text = " ".join(raw.split())
        words.clear()
        if text:
            page.blocks.append(Block(text, raw, paragraph, *where))

    def flush() -> None:
        nonlocal paragraph
        part()
        paragraph += 1

    def close(upto: int) -> None:
        while len(stack) > upto:
            e = stack.pop()
            if not e.noise:
                page.styles.append((e.node, ",".join(e.children), stack[-1].node))
            if e.tag in BLOCK:
                flush()
            elif e.names != stack[-1].names:
                part()

    for m in TOKEN.finditer(html):
        tag = m.group(3)
        if tag is None:
            token = m.group()
            top = stack[-1]
            if token[0] != "<" or token == "<":
                if not top.noise:
                    if not words or words == [" "]:
                        where = (top.main, top.node, top.names, top.within)
                    words.append(entities.unescape(token) if "&" in token else token)
            continue
        tag = tag.lower()
        if m.group(2):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in PARAGRAPH_ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        for same, walls in (({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}), ({"tr"}, {"table", "tbody"}),
                            ({"td", "th"}, {"tr"}), ({"option"}, {"select"})):
            if tag in same:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in same:
                        close(i)
                        break
                    if stack[i].tag in walls:
                        break
        top = stack[-1]
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                words.append(" ")
            continue
        noise, main, mark = top.noise or tag in NOISE, top.main or tag in ("article", "main"), ""
        other = tag == "form"
        if m.group(4).strip():
            found = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(m.group(4))}
            mark = f"{found.get('class', '')}#{found.get('id', '')}"
            if tag not in ("html", "body", "article", "main"):
                said = set(SPLIT.split(f"{mark} {found.get('role', '')}".lower()))
                other = other or bool(said & NOISE_WORDS) or (bool(said & WEAK_WORDS) and not main)
                noise = noise or (
                    "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower())
            main = main or found.get("role", "") == "main"
        noise = noise or (tag == "header" and not top.main)
        names, within = top.names, top.within
        if other and not noise:
            named += 1
            names, within = (*names, named), within or top.main
            part()
        if tag in BLOCK:
            flush()
        elif tag in ("td", "th"):
            words.append(" ")
        top.children.append(tag)
        stack.append(Element(tag, hashed(top.node, tag, mark), noise, main, names, within))
    close(1)
    flush()
    return page


def site_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.parse_url(F.when(url.rlike(r"^[a-zA-Z][\w+.-]*://[^\s]*$"), url), F.lit("HOST"))), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """site, node, importance of every node with texts, met on at least MIN_PAGES distinct pages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for site, html in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                page, whole = parse(html), hashed(html)
                parents = {node: parent for node, _, parent in page.styles}
                out += {(site, node, 0, hashed(style), whole, 0) for node, style, _ in page.styles}
                out += {(site, b.node, 1, hashed(b.text), whole, parents.get(b.node, 0)) for b in page.blocks}
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["site", "node", "is_text", "value", "page", "parent"])

    seen = pages.select("site", "html").mapInArrow(
        run, "site string, node long, is_text int, value long, page long, parent long")
    # pages by value, then values by node: both sums are taken map-side first
    by_value = (seen.groupBy("site", "node", "is_text", "value", "page", "parent").agg(F.lit(1).alias("one"))
                .groupBy("site", "node", "is_text", "value", "parent").agg(F.count("*").alias("n")))
    by_value = stage(by_value, "style-tree")
    styles = (by_value.where("is_text = 0").groupBy("site", "node")
              .agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlog")))
    # -sum p log p over styles, in units of log m
    styles = styles.select("site", "node", "m", F.when(F.col("m") > 1, 1 - F.col("nlog") / F.col("m") / F.log("m"))
                           .otherwise(1.0).alias("style"))
    texts = (by_value.where("is_text = 1").groupBy("site", "node", "parent")
             .agg(F.count("*").alias("kinds"), F.sum(F.log("n")).alias("nlog")))
    pages_of, parent = styles.select("site", "node", "m"), styles.select("site", F.col("node").alias("parent"), "style")
    return (texts.join(pages_of, ["site", "node"]).join(parent, ["site", "parent"], "left").where(F.col("m") >= MIN_PAGES)
            .withColumn("content", 1 - F.col("nlog") / F.col("kinds") / F.log("m"))
            .groupBy("site", "node").agg(F.max(OWN_SHARE * F.col("content")
                                               + (1 - OWN_SHARE) * F.coalesce("style", F.lit(1.0))).alias("importance")))


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html)."""
    pages = take_columns(pages, "page_id", "url", "html").withColumn("site", site_of(F.col("url")))
    judged, high = style_tree(pages), threshold + OUTSIDE
    # presentations of one site's templates, and those whose texts are nearly all their own
    sides = (judged.where((F.col("importance") < threshold) | (F.col("importance") >= high)).groupBy("site")
             .agg(F.collect_set(F.when(F.col("importance") < threshold, F.col("node"))).alias("low"),
                  F.collect_set(F.when(F.col("importance") >= high, F.col("node"))).alias("high")))
    sides = stage(sides, "style-low")
    small = (sides.agg(F.sum(F.size("low") + F.size("high"))).first()[0] or 0) <= BROADCAST_ROWS
    rows = pages.join(F.broadcast(sides) if small else sides, "site", "left").select("page_id", "url", "html", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = (batch.column(3).to_pylist(), batch.column(4).to_pylist())
            out = [parse(html).text(set(low or ()), set(high or ()))
                   for html, low, high in zip(texts_of(batch.column(2)), *lists, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_site_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
