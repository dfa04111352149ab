"""HTML extraction by wrapper induction over the pages of a host.

A page is parsed to a tree of block elements (inline markup is transparent, runs of like siblings are one iterated
node). The tree's upper levels are the page's layout; each of a host's ``LAYOUTS`` most frequent layouts has a reference
page, the first by hash. A page's tree is aligned with the reference of its layout (of the layout it matches best, if its
own has none) by simple tree matching; the texts of aligned nodes vote, and a text that most distinct pages of a
reference have at the same node is constant: template. Varying slots are content, if they stand in the content region: the article or main
element where the page has one, never a menu, header, footer, aside, form, script, style, notice, advert or reader
comment (told by element, role, class or id). Votes alone can't tell these apart, as their text may vary by page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import BROADCAST_BYTES, materialize

#: A text is template if this share of the host's distinct pages, and at least so many, have it at one node.
SHARE, LEAST_PAGES = 0.6, 5
LAYOUTS, LAYOUT_DEPTH = 8, 4
STEP_PAGES = 200
#: Lists of children of this length or more are aligned by whole rows of the table; the sums are the same.
WIDE = 48
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head nav footer aside form script style noscript template button select option textarea iframe svg object canvas audio video map dialog menu title".split())
#: Elements that an opening one of the same group ends.
ENDED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ROLE = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|sidebar|footer|header|masthead|ad|ads|advert|advertisement|banner|sponsor|sponsored|promo|cookie|consent|notice|alert|comment|comments|respond|disqus|related|recommended|share|sharing|social|newsletter|subscribe|breadcrumb|breadcrumbs|pagination|popup|modal|overlay|widget|complementary|contentinfo|search|skip)(?:$|[\s_-]|\d)", re.I)


class Node:
    __slots__ = ("tag", "label", "dropped", "region", "children", "texts", "number")

    def __init__(self, tag: str, label: str, dropped: bool, region: int):
        self.tag, self.label, self.dropped, self.region = tag, label, dropped, region
        self.children: list[Node] = []
        self.texts: list[tuple[int, str]] = []


def looks_dropped(tag: str, attributes: str, region: int) -> tuple[str, bool]:
    """Label (element and first class) and whether class, id, role or element mark boilerplate."""
    label, marked = tag, tag in DROPPED or (tag == "header" and not region)
    if attributes and not attributes.isspace():
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "class" and value.split():
                label = f"{tag}.{value.split()[0]}"
            if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main", "h1") and ROLE.search(value):
                marked = True
            if name in ("class", "id") and tag == "article" and re.search(r"comment", value, re.I):
                marked = True
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                marked = True
    return re.sub(r"[(),]", "_", label), marked


def parse(html: str) -> Node:
    """Tree of block elements; each has its own text blocks as (place on the page, text)."""
    root = Node("#", "#", False, 0)
    stack, blocks, buffer, at, end = [root], 0, [], 0, len(html)

    def flush() -> None:
        nonlocal blocks
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                stack[-1].texts.append((blocks, text))
                blocks += 1

    while at < end:
        m = TAG.search(html, at)
        if m is None:
            buffer.append(unescape(html[at:]) if not stack[-1].dropped else "")
            break
        if m.start() > at and not stack[-1].dropped:
            buffer.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or not m[0].endswith(">"):
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in INLINE:
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ENDS_P or tag in ENDED:
            ended = ENDED.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ended:
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "article", "section", "div", "body", "main"):
                    break
        if tag in VOID:
            continue
        above = stack[-1]
        label, marked = looks_dropped(tag, attributes, above.region)
        node = Node(tag, label, above.dropped or marked, 2 if tag == "article" or above.region == 2 else 1 if tag == "main" or above.region else 0)
        above.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = close.end() if close else end
        else:
            stack.append(node)
    flush()
    return root


def collapsed(nodes: list[Node]) -> str:
    """Runs of like siblings as one node, written ``label(children)``; numbers every node by its place in that tree."""
    out, number, pending = [], 0, [nodes]
    while pending:
        group = pending.pop()
        if isinstance(group, str):
            out.append(group)
            continue
        for n in group:
            n.number = number
        number += 1
        runs: list[list[Node]] = []
        for n in group:
            for c in n.children:
                if c.label in DROPPED and c.tag not in ("nav", "footer", "aside", "form"):
                    continue
                if runs and runs[-1][0].label == c.label:
                    runs[-1].append(c)
                else:
                    runs.append([c])
        out.append(group[0].label)
        if runs:
            pending.append(")")
            for k in range(len(runs) - 1, -1, -1):
                pending.append(runs[k])
                pending.append("," if k else "(")
    return "".join(out)


def layout_of(signature: str, depth: int = LAYOUT_DEPTH) -> str:
    """The labels of the tree's first levels."""
    out, level = [], 0
    for m in re.finditer(r"[^(),]+|[()]", signature):
        if m[0] == "(":
            level += 1
        elif m[0] == ")":
            level -= 1
        elif level < depth:
            out.append(f"{level}{m[0]}")
    return " ".join(out)


@dataclass(eq=False)
class Tree:
    """A node of ``collapsed``'s text: ``size`` nodes from ``number`` on; equal ``shape``, equal text."""

    label: str
    number: int
    children: list[Tree] = field(default_factory=list)
    size: int = 1
    shape: int = 0


def tree(signature: str) -> Tree:
    stack: list[Tree] = [Tree("", -1)]
    last, number = stack[0], 0

    def done(t: Tree) -> None:
        t.size = 1 + sum(c.size for c in t.children)
        t.shape = hash((t.label, *(c.shape for c in t.children)))

    for m in re.finditer(r"([^(),]+)|([(),])", signature):
        if m[1] is not None:
            last = Tree(m[1], number)
            number += 1
            stack[-1].children.append(last)
            done(last)
        elif m[2] == "(":
            stack.append(last)
        elif m[2] == ")":
            done(last := stack.pop())
    return stack[0].children[0]


def children_match(a: list[Tree], b: list[Tree]):
    """Order-preserving match of two lists, as a generator: it is sent the match size of each pair of like trees it yields."""
    first = 0
    while first < min(len(a), len(b)) and a[first].shape == b[first].shape:
        first += 1
    end = 0
    while end < min(len(a), len(b)) - first and a[-1 - end].shape == b[-1 - end].shape:
        end += 1
    pairs = [(x, y) for k in (range(first), range(-end, 0)) for x, y in ((a[i], b[i]) for i in k)]
    a, b = a[first : len(a) - end], b[first : len(b) - end]
    common = {x.label for x in a} & {y.label for y in b}
    a, b = [x for x in a if x.label in common], [y for y in b if y.label in common]
    sizes: dict[tuple[int, int], int] = {}
    places: dict[str, dict[int, list[int]]] = {}
    for j, y in enumerate(b):
        places.setdefault(y.label, {}).setdefault(y.shape, []).append(j)

    def row_after(last, x: Tree):
        if len(b) < WIDE:
            own = [sizes[x.shape, y.shape] if x.label == y.label else 0 for y in b]
            row = [0]
            for j, both in enumerate(own):
                row.append(max(last[j + 1], row[j], last[j] + both if both else 0))
            return row
        own = np.zeros(len(b), np.int64)
        for shape, at in places[x.label].items():
            own[at] = sizes[x.shape, shape]
        return np.concatenate(([0], np.maximum.accumulate(np.maximum(last[1:], last[:-1] + own))))

    # one row of sums in ``every`` is kept, and the others are made again on the way back
    every = max(64, isqrt(len(a)))
    kept = {0: [0] * (len(b) + 1) if len(b) < WIDE else np.zeros(len(b) + 1, np.int64)}
    block = dict(kept)
    for i, x in enumerate(a, 1):
        for shape, at in places[x.label].items():
            if (x.shape, shape) not in sizes:
                sizes[x.shape, shape] = yield x, b[at[0]]
        if (i - 1) % every == 0:
            block = {i - 1: kept[i - 1]}
        block[i] = row_after(block[i - 1], x)
        if i % every == 0:
            kept[i] = block[i]
    i, j, found = len(a), len(b), []
    while i and j:
        if i - 1 not in block:
            base = (i - 1) // every * every
            block = {base: kept[base]}
            for k in range(base + 1, i + 1):
                block[k] = row_after(block[k - 1], a[k - 1])
        here, above = block[i], block[i - 1]
        if here[j] == above[j]:
            i -= 1
        elif here[j] == here[j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((a[i], b[j]))
    for x, y in found:
        yield x, y
    return pairs + found


def tree_match(a: Tree, b: Tree) -> tuple[int, dict[int, int]]:
    """Simple tree matching: size of an order-preserving match of like nodes, and a's numbers -> b's; of any depth."""
    if a.label != b.label:
        return 0, {}
    sizes: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list] = {}
    stack, answer = [(a, b, children_match(a.children, b.children))], None
    while stack:
        x, y, steps = stack[-1]
        try:
            c, d = steps.send(answer)
        except StopIteration as done:
            stack.pop()
            chosen[x.number, y.number] = done.value
            answer = sizes[x.number, y.number] = 1 + sum(u.size if u.shape == v.shape else sizes[u.number, v.number] for u, v in done.value)
            continue
        answer = c.size if c.shape == d.shape else sizes.get((c.number, d.number))
        if answer is None:
            stack.append((c, d, children_match(c.children, d.children)))
    out, pending = {}, [(a, b)]
    while pending:
        x, y = pending.pop()
        if x.shape == y.shape:
            out.update(zip(range(x.number, x.number + x.size), range(y.number, y.number + y.size)))
        else:
            out[x.number] = y.number
            pending += chosen[x.number, y.number]
    return len(out), out


@lru_cache(maxsize=4096)
def aligned(page: str, references: tuple[tuple[str, str], ...]) -> tuple[int, dict[int, int]]:
    """Which of the (layout, tree) ``references`` the page goes with, and its node numbers -> the reference's; -1: none."""
    if not references:
        return -1, {}
    layout, own = layout_of(page), tree(page)
    mine = [k for k, (name, _) in enumerate(references) if name == layout] or range(len(references))
    found = {k: tree_match(own, tree(references[k][1])) for k in mine}
    best = max(found, key=lambda k: (found[k][0], -k))
    return best, found[best][1]


def content(root: Node) -> list[tuple[int, int, str]]:
    """(place, node number, text) of the content region's blocks, in page order."""
    found: list[tuple[int, int, int, str]] = []
    pending = [root]
    while pending:
        n = pending.pop()
        if not n.dropped:
            found += [(place, n.number, n.region, text) for place, text in n.texts]
            pending += n.children
    region = max((f[2] for f in found), default=0)
    return sorted((place, number, text) for place, number, r, text in found if r >= region)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


BLOCKS = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))


def parsed(rows: DataFrame) -> DataFrame:
    """page_id, url, host, layout, signature (the collapsed tree) and content blocks (node, text) of each page."""
    names = ["page_id", "url", "host", "layout", "signature", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, STEP_PAGES):
                batch, signatures, blocks = whole.slice(a, STEP_PAGES), [], []
                for html in batch.column(3):
                    root = parse(html.as_py() or "")
                    signatures.append(collapsed([root]))
                    blocks.append([{"node": number, "text": text} for _, number, text in content(root)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(map(layout_of, signatures), pa.string()), pa.array(signatures, pa.string()), pa.array(blocks, BLOCKS)], names)

    return rows.select("page_id", "url", "host", "html").mapInArrow(run, "page_id bigint, url string, host string, layout string, signature string, blocks array<struct<node:int,text:string>>")


def placed(pages: DataFrame) -> DataFrame:
    """Each page's blocks with the node of reference ``ref`` they are aligned with (-1: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, STEP_PAGES):
                batch, refs, blocks = whole.slice(a, STEP_PAGES), [], []
                for signature, references, own in zip(batch.column(3), batch.column(4), batch.column(5)):
                    ref, to = aligned(signature.as_py(), tuple((x["layout"], x["signature"]) for x in references.as_py() or ()))
                    refs.append(ref)
                    blocks.append([{"node": to.get(b["node"], -1), "text": b["text"]} for b in own.as_py()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(refs, pa.int32()), pa.array(blocks, BLOCKS)], ["page_id", "url", "host", "ref", "blocks"])

    return pages.select("page_id", "url", "host", "signature", "references", "blocks").mapInArrow(run, "page_id bigint, url string, host string, ref int, blocks array<struct<node:int,text:string>>")


def bounded(df: DataFrame, column: str) -> DataFrame:
    """``df``, marked for broadcast if the measured bytes of ``column`` (text) fit the bound."""
    size = df.agg(F.sum(F.length(F.col(column).cast("string")) + 100)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def main_text(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every page's main text.

    A null html is empty; a page without content has the empty text. Pages without a host in their url form one host;
    a page may be nested to any depth.
    Repeated rows give repeated results and count once as evidence for template, as do pages of equal content. An empty
    table gives an empty one; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    read = materialize(parsed(rows), "wr-parsed")
    order = F.struct(F.xxhash64("url", "page_id").alias("h"), F.xxhash64("signature").alias("s"))
    layouts = read.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.col("n").desc(), "layout"))
    firsts = materialize(layouts.withColumn("rank", rank).where(F.col("rank") <= LAYOUTS).select(F.col("host").alias("of"), F.col("layout").alias("known"), "rank", "first"), "wr-first")
    mine = (F.col("host") == F.col("of")) & (F.col("layout") == F.col("known")) & (order == F.col("first"))
    named = read.join(bounded(firsts, "known"), mine).groupBy("host", "rank", "layout").agg(F.min("signature").alias("signature"))
    references = named.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "layout", "signature"))).alias("references"))
    references = materialize(references, "wr-references")
    # blocks are aligned twice, for the votes and for the result: that is cheaper than to write them again
    blocks = placed(read.join(bounded(references, "references"), "host", "left"))
    votes = blocks.select("host", "ref", F.xxhash64("blocks").alias("page"), F.explode("blocks").alias("b")).where("b.node >= 0").select("host", "ref", "page", F.col("b.node").alias("node"), F.xxhash64("b.text").alias("t")).distinct()
    often = votes.groupBy("host", "ref", "node", "t").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    per_reference = blocks.select("host", "ref", F.xxhash64("blocks").alias("page")).distinct().groupBy("host", "ref").agg(F.count("*").alias("pages"))
    constant = often.join(per_reference, ["host", "ref"]).where(F.col("n") >= F.col("pages") * share).groupBy("host", "ref").agg(F.collect_list(F.struct("node", "t")).alias("template"))
    constant = materialize(constant, "wr-template")
    out = blocks.join(bounded(constant, "template"), ["host", "ref"], "left")
    kept = F.filter("blocks", lambda b: F.col("template").isNull() | ~F.array_contains(F.col("template"), F.struct(b["node"].alias("node"), F.xxhash64(b["text"]).alias("t"))))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("bigint"))
