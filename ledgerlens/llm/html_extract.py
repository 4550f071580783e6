"""Main text of HTML pages by wrapper induction.

Each page becomes a tree of block elements labelled by tag and class; siblings of one label are folded, so that lists
and paragraphs of any length have one node. Siblings of a folded tree have different labels, so nodes of two trees that
simple tree matching can pair have equal label paths; all trees of a host are aligned by these paths, without a pattern
tree that could lack a node. A text is template if it stands on nearly all different pages that have its node, of
the host or of the host's section (the first directory of the url), and if the rest of these pages varies, as it does
not on copies; the others fill varying slots. All blocks of text are aligned, whatever they are called. Of the varying
slots, elements that say what they are (menus, footers, forms, comments, ...) and those that are mostly links are no
content; an everyday word in a class (widget, search, ...) counts only where there is no running text, and an article
element shuts out the rest of the page unless that holds over ``OUTSIDE_SHARE`` times as much of what is left.

All pages count, by grouped sums over (site, node, text); paths are taken once per distinct tree of a site. No host is
gathered in one task, and only texts of candidate blocks are shuffled, once.

Cases: NULL or empty html has empty text; a NULL or odd url belongs to the empty host; texts on fewer than
``MIN_PAGES`` different pages are no template; copies of a page count once; unclosed, wrongly nested and deep markup is
accepted (elements deeper than ``MAX_DEPTH`` belong to the one above them); repeated rows give repeated rows; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .url_filter import host_of

#: A text is template if it stands in a node on this share of the site's different pages that have the node ...
TEMPLATE_SHARE = 0.9
#: ... and on so many pages whose other texts differ.
MIN_PAGES = 5
#: Share of link characters from which a block outside an article is a menu.
LINK_SHARE = 0.5
MAX_DEPTH = 60

# HTML element names by their role, and words of class and id attributes.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
            "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p "
            "pre section select summary table tbody td tfoot th thead tr ul button iframe noscript head "
            "template svg".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noframes xmp".split())
CLOSES_P = BLOCK - set("button option optgroup select svg template".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table body article section div main aside nav td th blockquote form fieldset select".split())
BOILERPLATE = set("nav header footer aside form menu button select option dialog iframe noscript head template svg "
                  "fieldset".split())
#: A whole class or id, or outside an article a part of a class, that names boilerplate.
BOILERPLATE_WORDS = set(
    "ad adbox ads adslot adunit advert advertisement advertising adverts breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer gdpr masthead nav navbar navigation pager pagination sidebar sponsor sponsored".split())
#: Everyday words: an element of such a whole class or id is boilerplate unless it has running text.
EVERYDAY_WORDS = set(
    "alert announcement banner byline copyright disclaimer discussion feedback legal login menu modal newsletter notice "
    "notices notification popup privacy promo promoted promotion recommended related replies reply respond response "
    "responses search share sharing signup skip social subscribe teaser teasers toast toolbar trending widget "
    "widgets".split())
#: Article elements are the main text unless so many times their text is left outside of them.
OUTSIDE_SHARE = 2
#: A block of so many words that is no menu is running text.
RUNNING_WORDS = 12
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
                        "toolbar".split())

# Atomic throughout: no part of a page is read again for a tag that does not end.
_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+")
_SHOWN = re.compile(r"[^\s]")


class Block(NamedTuple):
    """A block of text: its node's number, whether it is marked or looks like boilerplate, whether it stands in an
    article or main element, and whether it is mostly links."""

    at: int
    text: str
    named: bool
    inside: bool
    links: bool


class Node:
    """A folded element: label, children by label, and its place in page order of first appearance."""

    __slots__ = ("label", "children", "at")

    def __init__(self, label: str, at: int):
        self.label, self.children, self.at = label, {}, at


def _attributes(written: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(written)}


def _says_boilerplate(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    if tag in ("html", "body", "main"):
        return False
    if attrs.get("role", "").lower() in BOILERPLATE_ROLES or "hidden" in attrs:
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if tag in HEADINGS:
        return False
    classes = attrs.get("class", "").lower().split()
    if not BOILERPLATE_WORDS.isdisjoint(classes):
        return True
    if inside or tag == "article":
        return False
    words = set(_WORD.findall(" ".join(classes)))
    name = attrs.get("id", "").lower()
    if words & BOILERPLATE_WORDS or name in BOILERPLATE_WORDS:
        return True
    return ("header" in words or name == "header") and not words & {"article", "entry", "post", "content"}


def _may_be_boilerplate(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    if tag in HEADINGS or tag in ("html", "body", "main", "article"):
        return False
    names = attrs.get("class", "").lower().split()
    return not EVERYDAY_WORDS.isdisjoint(names if inside else [*names, attrs.get("id", "").lower()])


def parse(page: str | None) -> tuple[Node, list[Block]]:
    """The folded tree of a page, and its blocks of text in page order."""
    page = page or ""
    root, made = Node("", 0), 1
    # open elements: (tag, folded node, is boilerplate, is in article, innermost element of an everyday word or 0)
    stack: list[tuple[str, Node, bool, bool, int]] = [("", root, False, False, 0)]
    blocks: list[Block] = []
    doubts: list[int] = []  # that element, per block
    opened = 0
    text: list[str] = []
    links = in_link = 0

    def flush() -> None:
        nonlocal links
        if text:
            _, node, bad, inside, doubt = stack[-1]
            whole = "".join(text)
            if _SHOWN.search(whole):
                shown = " ".join(entities.unescape(whole).split())
                if shown:
                    blocks.append(Block(node.at, shown, bad, inside, links >= LINK_SHARE * len(whole)))
                    doubts.append(doubt)
            text.clear()
        links = 0

    def say(piece: str) -> None:
        nonlocal links
        text.append(piece)
        if in_link:
            links += len(piece)

    at, raw_until = 0, 0
    for m in _TAG.finditer(page, 0, last_tag_end(page)):
        if m.start() < raw_until:
            continue
        if m.start() > at and at >= raw_until:
            say(page[at:m.start()])
        elif raw_until > at:
            if m.start() > raw_until:
                say(page[raw_until:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if not m[1]:
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
                at = raw_until = end.end() if end else len(page)
            elif tag == "a":
                in_link = 1
            elif tag == "br":
                say(" ")
            elif tag in BLOCK:
                flush()
                if tag in CLOSES_P and stack[-1][0] == "p":
                    stack.pop()
                if tag in SIBLINGS:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in SIBLINGS[tag]:
                            del stack[k:]
                            break
                        if stack[k][0] in SCOPES:
                            break
                if tag in VOID:
                    continue
                attrs = _attributes(m[3]) if m[3] else {}
                _, parent, bad, inside, doubt = stack[-1]
                bad = bad or tag in BOILERPLATE or bool(attrs) and _says_boilerplate(tag, attrs, inside)
                opened += 1
                if attrs and _may_be_boilerplate(tag, attrs, inside):
                    doubt = opened
                label = tag + "." + ".".join(sorted(_WORD.findall(attrs.get("class", "").lower()))) if attrs else tag
                node = parent
                if len(stack) <= MAX_DEPTH:
                    node = parent.children.get(label)
                    if node is None:
                        node = parent.children[label] = Node(label, made)
                        made += 1
                stack.append((tag, node, bad, inside or tag in ("article", "main"), doubt))
        elif tag == "a":
            in_link = 0
        elif tag in BLOCK:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
    if max(at, raw_until) < len(page):
        say(page[max(at, raw_until):])
    flush()
    running = {d for b, d in zip(blocks, doubts, strict=True)
               if not b.named and not b.links and len(b.text.split()) >= RUNNING_WORDS}
    return root, [b._replace(named=b.named or d > 0 and d not in running) for b, d in zip(blocks, doubts, strict=True)]


def last_tag_end(page: str) -> int:
    """Where the last tag may end: a ``<`` behind the last ``>`` is text, unless a comment opens there."""
    end = page.rfind(">") + 1
    return len(page) if page.find("<!--", end) >= 0 else end


def main_blocks(blocks: list[Block]) -> list[Block]:
    """Of the blocks that are no template: those that are not named boilerplate and stand in article elements, unless
    over OUTSIDE_SHARE times as much text stands outside of them; then all that are no lists of links."""
    left = [b for b in blocks if not b.named]
    inside = sum(len(b.text) for b in left if b.inside)
    if inside and OUTSIDE_SHARE * inside >= sum(len(b.text) for b in left if not b.inside and not b.links):
        return [b for b in left if b.inside]
    return [b for b in left if not b.links]


def written(root: Node) -> str:
    """The tree as JSON: [label, number, children]."""
    def of(n: Node) -> list:
        return [n.label, n.at, [of(c) for c in n.children.values()]]
    return json.dumps(of(root), separators=(",", ":"))


def match_trees(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the most node pairs of equal labels that keep order and ancestry, and these pairs."""
    if a[0] != b[0]:
        return 0, []
    n, m = len(a[2]), len(b[2])
    best = [[0] * (m + 1) for _ in range(n + 1)]
    inner: dict[tuple[int, int], list] = {}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            score, pairs = match_trees(a[2][i - 1], b[2][j - 1])
            inner[i, j] = pairs
            best[i][j] = max(best[i][j - 1], best[i - 1][j], best[i - 1][j - 1] + score)
    found = [(a[1], b[1])]
    i, j = n, m
    while i and j:
        if best[i][j] == best[i][j - 1]:
            j -= 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            found += inner[i, j]
            i, j = i - 1, j - 1
    return best[n][m] + 1, found


_BLOCK_TYPE = "array<struct<slot:int,h:long,text:string,named:boolean,inside:boolean,links:boolean>>"


def _parsed(pages: DataFrame, with_text: bool) -> DataFrame:
    """(page_id, url, host, section, tree, blocks) of every page; without texts, blocks carry hashes only."""
    block = pa.list_(pa.struct([("slot", pa.int32()), ("h", pa.int64()), ("text", pa.string()), ("named", pa.bool_()),
                                ("inside", pa.bool_()), ("links", pa.bool_())]))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("section", pa.string()), ("tree", pa.string()),
                        ("blocks", block)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees, blocks = [], []
            for page in b.column(4):
                root, found = parse(page.as_py())
                trees.append(written(root))
                blocks.append([{"slot": f.at, "h": xxhash.xxh64_intdigest(f.text.encode("utf-8", "surrogatepass")) - (1 << 63),
                                **({"text": f.text, "named": f.named, "inside": f.inside, "links": f.links} if with_text else {})}
                               for f in found])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(trees, pa.string()), pa.array(blocks, block)],
                                             schema=schema)

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         host_of(F.col("url")).alias("host"), F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit(
                             "")), "^[^/?#]*://[^/?#]*/([^/?#]+)/", 1).alias("section"), F.col("html").cast("string").alias("html"))
            .mapInArrow(run, f"page_id long, url string, host string, section string, tree string, blocks {_BLOCK_TYPE}"))


def node_paths(tree: list) -> list[tuple[int, int]]:
    """(number, hash of the label path) of every node of a folded tree."""
    found, todo = [], [(tree, 0)]
    while todo:
        (label, at, children), above = todo.pop()
        path = xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), above)
        found.append((at, path - (1 << 63)))
        todo += [(c, path) for c in children]
    return found


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """(host, section, tree, template): for every tree of a section, the (slot, h) of its blocks that are template."""
    # hashes only, written once, so that the pages are not parsed for each use
    page = stored(_parsed(pages, False).select("host", "section", "tree", F.array_sort(F.array_distinct(F.arrays_zip(
        F.col("blocks.slot").alias("own"), F.col("blocks.h").alias("h")))).alias("blocks")).distinct(), "hashed")
    # a site is a host or one of its sections; a NULL section stands for the host
    sites = F.explode(F.array(F.lit(None).cast("string"), F.col("section"))).alias("of")
    different = page.select("host", sites, "tree", "blocks").distinct()
    trees = different.groupBy("host", "of", "tree").agg(F.count("*").alias("n"))

    node = pa.list_(pa.struct([("own", pa.int32()), ("node", pa.int64())]))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [[{"own": x, "node": y} for x, y in node_paths(json.loads(t))] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(paths, node)],
                                             names=["host", "of", "tree", "n", "nodes"])

    own = stored(trees.mapInArrow(align, "host string, of string, tree string, n long, nodes array<struct<own:int,node:long>>")
                 .select("host", F.xxhash64(F.col("of").isNull(), "of").alias("site"), F.xxhash64("tree").alias("t1"),
                         F.xxhash64(F.lit("tree"), "tree").alias("t2"), "n", F.explode("nodes").alias("p"))
                 .select("host", "site", "t1", "t2", "n", "p.own", "p.node"), "nodes")
    different = different.select("host", F.xxhash64(F.col("of").isNull(), "of").alias("site"), F.xxhash64("tree").alias("t1"),
                                 F.xxhash64(F.lit("tree"), "tree").alias("t2"), "blocks")
    layout = ["host", "site", "t1", "t2"]
    block = (different.select(*layout, F.explode("blocks").alias("b")).select(*layout, "b.own", "b.h")
             .groupBy(*layout, "own", "h").agg(F.count("*").alias("n")))
    having = own.groupBy("host", "site", "node").agg(F.sum("n").alias("pages"))
    constant = (block.join(own.drop("n"), [*layout, "own"]).groupBy("host", "site", "node", "h").agg(F.sum("n").alias("n"))
                .where(F.col("n") >= MIN_PAGES).join(having, ["host", "site", "node"])
                .where(F.col("n") >= TEMPLATE_SHARE * F.col("pages")).select("host", "site", "node", "h"))
    # as a table of its own, so that Spark may split the partitions of a layout that very many pages have
    constant = stored(own.join(constant, ["host", "site", "node"]).groupBy(*layout)
                      .agg(F.collect_list(F.struct("own", "h", "node")).alias("constant")), "constant")
    held = "filter(constant, c -> exists(blocks, b -> b.own = c.own AND b.h = c.h))"
    rest = "filter(blocks, b -> NOT exists(constant, c -> b.own = c.own AND b.h = c.h))"
    varying = (different.join(constant, layout)
               .select("host", "site", F.xxhash64(F.expr(rest)).alias("rest"), F.explode(F.expr(held)).alias("c"))
               .select("host", "site", "c.node", "c.h", "rest").distinct()
               .groupBy("host", "site", "node", "h").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
               .select("host", "site", "node", "h"))
    template = (constant.select(*layout, F.explode("constant").alias("c")).select(*layout, "c.own", "c.node", "c.h")
                .join(varying, ["host", "site", "node", "h"]).groupBy(*layout)
                .agg(F.collect_list(F.struct(F.col("own").alias("slot"), "h")).alias("template")))
    return (page.select("host", "section", "tree").distinct().select("host", "section", "tree", sites)
            .select("host", "section", "tree", F.xxhash64(F.col("of").isNull(), "of").alias("site"),
                    F.xxhash64("tree").alias("t1"), F.xxhash64(F.lit("tree"), "tree").alias("t2"))
            .join(template, layout).groupBy("host", "section", "tree")
            .agg(F.array_distinct(F.flatten(F.collect_list("template"))).alias("template")))


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_template) of every row of ``pages`` (page_id, url, html)."""
    # as a table of its own, so that Spark may split the partitions of a host that very many pages belong to
    wrappers = stored(induce_wrappers(pages), "wrappers")
    out = _parsed(pages, True).join(wrappers, ["host", "section", "tree"], "left")
    is_template = "exists(template, t -> t.slot = b.slot AND t.h = b.h)"
    out = out.withColumn("varying", F.expr(
        f"filter(CASE WHEN template IS NULL THEN blocks ELSE filter(blocks, b -> NOT {is_template}) END, b -> NOT b.named)"))
    # as main_blocks
    length = "aggregate(filter(varying, b -> {}), 0L, (n, b) -> n + length(b.text))"
    out = out.withColumns({"within": F.expr(length.format("b.inside")),
                           "outside": F.expr(length.format("NOT b.inside AND NOT b.links"))})
    main = F.expr(f"filter(varying, b -> CASE WHEN within > 0 AND {OUTSIDE_SHARE} * within >= outside THEN b.inside "
                  "ELSE NOT b.links END)")
    n_template = F.expr(f"size(filter(blocks, b -> template IS NOT NULL AND {is_template}))")
    return out.select("page_id", "url", F.array_join(main["text"], "\n\n").alias("text"),
                      F.coalesce(n_template, F.lit(0)).cast("long").alias("n_template"))
