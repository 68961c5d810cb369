"""Main text of HTML pages by wrapper induction over the pages of each host.

1. Every page becomes a DOM tree of its block elements; runs of siblings of one shape fold into one node, so that lists and
   paragraphs of any number have one skeleton. Texts sit in slots, the skeleton's text leaves.
2. A host's template is its most frequent skeleton. Every other skeleton of the host is aligned with it once, whatever the
   number of its pages, by simple tree matching: equal labels match, children in order, as many nodes as possible.
3. Over all pages of the host, a template node whose text never changes is template; one whose text varies is content.
   A node that holds mostly links, outside of articles, is template too.
4. A page's text is that of its slots that are not template, inside its articles if it has any, else inside <main>, else
   anywhere, less what elements say of themselves: menus, headers, footers, asides, notices, adverts, forms, comments.

Nothing is held by host: counts, least and greatest text hashes are aggregates, an alignment needs one pair of skeletons.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, shared_folder

# Elements of HTML by what they mean here.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "noscript", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "template", "tfoot", "th", "thead", "tr", "ul",
}
NEVER = {"head", "nav", "footer", "aside", "form", "noscript", "template", "button", "select", "option", "optgroup", "dialog", "menu", "search", "svg", "canvas", "object", "audio", "video", "map", "datalist"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "status"}
#: Words of class and id that name such parts, and those that do so outside of articles only.
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promoted", "promotion", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager",
    "sidebar", "aside", "widget", "widgets", "related", "recommended", "recommendations", "trending", "share", "sharing", "social", "footer", "colophon", "copyright", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "banner", "alert", "popup", "modal", "overlay", "toast", "subscribe", "subscription", "newsletter", "signup", "login", "paywall", "comment", "comments", "disqus", "replies", "respond",
}
OUTSIDE = {"header", "masthead", "topbar", "toolbar"}
#: What an element of the first kind closes if it is open, up to the second kind.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSES |= {k: ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}) for k in ("thead", "tbody", "tfoot")}

ATTRIBUTE = r"""[^\s>/=][^\s>/=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|["'][^>]*+|(?=>)))?+"""
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:-->|--!>|\Z))|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=|{ATTRIBUTE})*+)(?:>|\Z)", re.S)
VALUE = re.compile(r"""([^\s>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))|(?<![^\s"'])(hidden)(?![^\s/])""")
#: A page that nobody has an example of: so few pages do not tell what is constant.
FEWEST = 5


class Node:
    __slots__ = ("article", "boiler", "children", "label", "links", "main", "parent", "shape", "soft", "tag", "text")

    def __init__(self, tag: str, label: str, parent: Node | None, hard: bool = False, soft: str = ""):
        self.tag, self.label, self.parent, self.boiler, self.soft = tag, label, parent, hard, soft
        self.children: list[Node] = []
        self.text, self.links, self.shape, self.article, self.main = "", 0, 0, False, False


def described(tag: str, attributes: str) -> tuple[str, bool, str]:
    """Label of an element, whether it never holds content, and whether words of class or id say so: yes or outside."""
    values = {}
    for name, a, b, c, hidden in VALUE.findall(attributes):
        values.setdefault((name or hidden).lower(), entities.unescape(a or b or c))
    words = [w for w in re.split(r"[^a-z]+", f"{values.get('class', '')} {values.get('id', '')}".lower()) if w]
    style = values.get("style", "").replace(" ", "").lower()
    hard = tag in NEVER or values.get("role", "").lower() in ROLES or "hidden" in values or "display:none" in style or values.get("aria-hidden") == "true"
    soft = ""
    if tag not in ("html", "body", "main"):
        soft = "yes" if WORDS & set(words) else "outside" if tag == "header" or OUTSIDE & set(words) else ""
    label = [tag, *sorted({w for w in values.get("class", "").lower().split() if w.isalpha()})]
    return ".".join([*label, "main"] if values.get("role", "").lower() == "main" else label), hard, soft


_described: dict = {}


def tree(html: str) -> Node:
    """The block elements of a page with their texts as leaves named #. Unclosed and misnested elements are closed as
    browsers do for paragraphs, lists and tables; an unknown end tag is ignored; inline elements are part of the text."""
    at_block = root = Node("#root", "", None)
    inline: list[str] = []
    buffer: list[str] = []
    linked = 0
    cut_off = 0  # open inline elements that hold no content

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                leaf = Node("#", "#", at_block)
                leaf.text, leaf.links = text, linked
                at_block.children.append(leaf)
            buffer.clear()
        linked = 0

    def leave(node: Node) -> None:
        nonlocal at_block, cut_off
        flush()
        at_block = node.parent
        inline.clear()
        cut_off = 0

    at, size, low = 0, len(html), None
    while at < size:
        found = html.find("<", at)
        if found < 0:
            found = size
        if found > at and not cut_off:
            buffer.append(html[at:found])
            if "a" in inline:
                linked += found - at
        if found == size:
            break
        match = TOKEN.match(html, found)
        if match is None:
            if not cut_off:
                buffer.append("<")
            at = found + 1
            continue
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:  # an end tag
            if tag in BLOCK:
                node = at_block
                while node is not None and node.tag != tag and not (tag == "p" and node.tag in ("article", "td", "th", "body")):
                    node = node.parent
                if node is not None and node.tag == tag and node.parent is not None:
                    leave(node)
                elif tag == "p":
                    flush()
            elif tag in inline:
                while (last := inline.pop()) != tag:
                    cut_off -= last in NEVER
                cut_off -= tag in NEVER
            continue
        if tag in RAW:
            if low is None:
                low = html.lower() if len(html.lower()) == size else re.sub("[A-Z]", lambda m: m[0].lower(), html)
            end = low.find(f"</{tag}", at)
            at = size if end < 0 else end
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                buffer.append(" ")
            continue
        if tag not in BLOCK:
            if not match[3].rstrip().endswith("/"):
                inline.append(tag)
                cut_off += tag in NEVER
            continue
        if tag in CLOSES:
            over, stop = CLOSES[tag]
            node, top = at_block, None
            while node is not None and node.tag not in stop:
                if node.tag in over:
                    top = node
                node = node.parent
            if top is not None:
                leave(top)
        if at_block.tag == "p" or (at_block.parent is not None and re.fullmatch("h[1-6]", at_block.tag) and re.fullmatch("h[1-6]", tag)):
            leave(at_block)
        flush()
        key = (tag, match[3])
        facts = _described.get(key)
        if facts is None:
            if len(_described) > 5_000:
                _described.clear()
            facts = described(*key)
            if len(match[3]) < 500:
                _described[key] = facts
        node = Node(tag, facts[0], at_block, facts[1], facts[2])
        at_block.children.append(node)
        at_block = node
        inline.clear()
        cut_off = 0
    flush()
    return root


def in_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


def marked(nodes: list[Node]) -> None:
    """What holds no content, what is in an article, what in <main>: handed down. Words of class and id do not count for an
    element that holds a first heading or <main>, since layouts are named after what they hold."""
    holds = set()
    for node in nodes:
        if node.tag in ("h1", "main"):
            up = node.parent
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    for node in nodes:
        up = node.parent
        if up is None:
            continue
        node.article = up.article or node.tag == "article"
        node.main = up.main or node.tag == "main" or node.label.endswith(".main")
        within = up.article or up.main
        soft = node.soft == "yes" or (node.soft == "outside" and not within)
        node.boiler = up.boiler or node.boiler or (soft and (id(node) not in holds or node.tag == "header"))


def folded(nodes: list[Node]) -> tuple[str, dict[int, int]]:
    """The skeleton (labels in order, each with the number of its children) and the slot of each text leaf."""
    shapes: dict[tuple, int] = {}
    kept: list[list[int]] = []
    sizes: list[int] = []
    labels: list[str] = []
    for node in reversed(nodes):
        children: list[int] = []
        for child in node.children:
            if not children or children[-1] != child.shape:
                children.append(child.shape)
        key = (node.label, *children)
        if key not in shapes:
            shapes[key] = len(shapes)
            kept.append(children)
            labels.append(node.label)
            sizes.append(1 + sum(sizes[c] for c in children))
        node.shape = shapes[key]
    slots, todo = {}, [(nodes[0], 0)]
    while todo:
        node, base = todo.pop()
        if node.tag == "#":
            slots[id(node)] = base
        at, last = base + 1, None
        for child in node.children:
            if last is not None and child.shape != last:
                at += sizes[last]
            todo.append((child, at))
            last = child.shape
    out, walk = [], [nodes[0].shape]
    while walk:
        shape = walk.pop()
        out.append(f"{labels[shape]} {len(kept[shape])}")
        walk.extend(reversed(kept[shape]))
    return ";".join(out), slots


def read(html: str | None) -> tuple[str, list[tuple[int, str, int, bool, bool]]]:
    """Skeleton of a page, and its blocks that may be content in page order: slot, text, letters in links, whether in an
    article, whether a heading."""
    root = tree(html or "")
    nodes = in_order(root)
    marked(nodes)
    skeleton, slots = folded(nodes)
    leaves = [n for n in nodes if n.tag == "#" and not n.boiler]
    some = [n for n in leaves if n.article] or [n for n in leaves if n.main] or leaves
    return skeleton, [(slots[id(n)], n.text, n.links, n.article, re.fullmatch("h[1-6]", n.parent.tag) is not None) for n in some]


def matching(skeleton: str, template: str) -> list[int]:
    """Simple tree matching: for each node of a skeleton the template's node it matches, or -1."""
    (labels_a, kids_a), (labels_b, kids_b) = unfolded(skeleton), unfolded(template)
    if skeleton == template:
        return list(range(len(labels_a)))
    levels, seen = [[(0, 0)]], {(0, 0)}
    while levels[-1]:
        level = []
        for a, b in levels[-1]:
            by_label: dict[str, list[int]] = {}
            for y in kids_b[b]:
                by_label.setdefault(labels_b[y], []).append(y)
            for x in kids_a[a]:
                for y in by_label.get(labels_a[x], ()):
                    if (x, y) not in seen:
                        seen.add((x, y))
                        level.append((x, y))
        levels.append(level)
    weight: dict[tuple[int, int], int] = {}
    best: dict[tuple[int, int], np.ndarray] = {}
    for level in reversed(levels):
        for a, b in level:
            xs, ys = kids_a[a], kids_b[b]
            total = np.zeros((len(xs) + 1, len(ys) + 1), np.int32)
            for i, x in enumerate(xs):
                step = np.array([weight.get((x, y), 0) if labels_a[x] == labels_b[y] else 0 for y in ys], np.int32)
                total[i + 1, 1:] = np.maximum.accumulate(np.maximum(total[i, 1:], total[i, :-1] + step))
            weight[a, b] = 1 + int(total[-1, -1])
            if xs and ys:
                best[a, b] = total
    out, todo = [-1] * len(labels_a), [(0, 0)]
    while todo:
        a, b = todo.pop()
        out[a] = b
        total = best.get((a, b))
        if total is None:
            continue
        i, j = len(kids_a[a]), len(kids_b[b])
        while i and j:
            if total[i, j] == total[i - 1, j]:
                i -= 1
            elif total[i, j] == total[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((kids_a[a][i], kids_b[b][j]))
    return out


def unfolded(skeleton: str) -> tuple[list[str], list[list[int]]]:
    labels, kids, open_nodes = [], [], []
    for k, part in enumerate(skeleton.split(";")):
        label, _, n = part.rpartition(" ")
        labels.append(label)
        kids.append([])
        while open_nodes and not open_nodes[-1][1]:
            open_nodes.pop()
        if open_nodes:
            kids[open_nodes[-1][0]].append(k)
            open_nodes[-1][1] -= 1
        open_nodes.append([k, int(n)])
    return labels, kids


def text_hash(texts: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(texts).encode(), digest_size=8).digest(), "big", signed=True)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def slots_seen(pages: DataFrame) -> DataFrame:
    """By host, skeleton and slot: pages, least and greatest hash of the slot's text, letters, letters in links. Headings are
    left out: they are never template, since copies of an article share theirs."""

    def start():
        def each(host, html):
            skeleton, blocks = read(html)
            slots: dict[int, list] = {}
            for slot, text, links, article, heading in blocks:
                if not heading:
                    slots.setdefault(slot, []).append((text, links, article))
            for slot, got in slots.items():
                yield host, skeleton, slot, text_hash([g[0] for g in got]), sum(len(g[0]) for g in got), 0 if got[0][2] else sum(g[1] for g in got)

        return each

    schema = pa.schema([("host", pa.string()), ("skeleton", pa.string()), ("slot", pa.int32()), ("hash", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())])
    rows = map_rows(pages.where("host <> ''").select("host", "html"), start, schema, "host string, skeleton string, slot int, hash bigint, chars bigint, links bigint")
    return rows.groupBy("host", "skeleton", "slot").agg(F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))


def induced(seen: DataFrame) -> DataFrame:
    """The wrappers: by host and skeleton the slots that are template. A node is constant if one text fills it on all of
    at least ``FEWEST`` pages; hosts whose constant text outweighs what varies are copies of one page, and keep it."""
    by_skeleton = seen.groupBy("host", "skeleton").agg(F.max("n").alias("n"))
    template = by_skeleton.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "skeleton")).alias("template"))

    def start():
        def each(host, skeleton, to):
            for slot, node in enumerate(matching(skeleton, to)):
                yield host, skeleton, slot, node if node >= 0 else None

        return each

    schema = pa.schema([("host", pa.string()), ("skeleton", pa.string()), ("slot", pa.int32()), ("node", pa.int32())])
    aligned = map_rows(by_skeleton.join(template, "host").select("host", "skeleton", "template"), start, schema, "host string, skeleton string, slot int, node int")
    placed = seen.join(aligned, ["host", "skeleton", "slot"]).where("node is not null")
    nodes = placed.groupBy("host", "node").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    nodes = nodes.withColumn("constant", (F.col("low") == F.col("high")) & (F.col("n") >= FEWEST))
    mass = nodes.groupBy("host").agg(F.sum(F.when(F.col("constant"), -F.col("chars")).otherwise(F.col("chars"))).alias("varying"))
    out = nodes.join(mass, "host").where((F.col("constant") & (F.col("varying") > 0)) | ((F.col("n") >= FEWEST) & (2 * F.col("links") > F.col("chars"))))
    return placed.join(out.select("host", "node"), ["host", "node"]).groupBy("host", F.md5("skeleton").alias("key")).agg(F.collect_list("slot").alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row page_id, url, text and n_chars (code points).

    Blocks are joined by a newline, white space inside one is a single space, character references are decoded; <br> is
    white space, cells and list items are blocks. Null or empty html and pages without content give an empty text. Pages
    without a host in the url are read on their own, without a wrapper. Rows are independent but for the wrapper: repeated
    page_ids and rows come back each, null ids stay null, extra columns of any name are ignored, an empty table gives no
    rows. Of equally frequent skeletons the greatest string is the template."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    slots_seen(rows).write.parquet(path := shared_folder(spark, "slots"))
    induced(spark.read.parquet(path)).write.parquet(wrappers := shared_folder(spark, "wrappers"))

    def start():
        def each(page_id, url, host, html):
            skeleton, blocks = read(html)
            key = hashlib.md5(skeleton.encode(), usedforsecurity=False).hexdigest()
            yield page_id, url, host, key, [{"slot": slot, "text": text} for slot, text, *_ in blocks]

        return each

    block = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())]))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("key", pa.string()), ("blocks", block)])
    parsed = map_rows(rows, start, schema, "page_id bigint, url string, host string, key string, blocks array<struct<slot:int,text:string>>", rows_per_batch=128)
    out = parsed.join(spark.read.parquet(wrappers), ["host", "key"], "left")
    kept = F.when(F.col("template").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~F.array_contains("template", b["slot"])))
    return out.withColumn("text", F.array_join(F.transform(kept, lambda b: b["text"]), "\n")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
